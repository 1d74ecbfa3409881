"""Queries on sequences, codons and k-mers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from genomespark.functions import alphabets as A
from genomespark.functions import kmers as K
from genomespark.functions import sequences as S
from genomespark.operators import msa as P
from genomespark.plans.views import DNA, MSA, PROTEIN, Book, dna, msa, protein
from genomespark.runtime import cut, table

BOOK = Book()
query = BOOK.query
_MAP = "MAP {" + ", ".join(f"'{c}': '{a}'" for c, a in sorted(A.codon_map(1).items())) + "}"
_AA = "MAP {" + ", ".join(f"'{a}': {w}" for a, (_, w) in A.AMINO.items() if w) + "}"
_NUC = "MAP {" + ", ".join(f"'{a}': {w}" for a, w in A.DNA_WEIGHT.items()) + "}"
_TRANSLATE = f"array_to_string(list_transform(range(0, length(seq) // 3), lambda i: coalesce({{m}}[substr(seq, CAST(i * 3 + 1 AS INTEGER), 3)], 'X')), '')"


def _each(spark: SparkSession, sf_dir: str, name: str, column) -> DataFrame:
    return dna(spark, sf_dir).select("seq_id", column.alias(name))


@query(r"""SELECT rec_key AS seq_id, CASE WHEN regexp_full_match(s, '[ACGT]*') THEN 'DNA' WHEN regexp_full_match(s, '[ACGU]*') THEN 'RNA'
  WHEN regexp_full_match(s, '[-ACGTMRWSYKVHDBXN]*') THEN 'AmbiguousDNA' WHEN regexp_full_match(s, '[-ACGUMRWSYKVHDBXN]*') THEN 'AmbiguousRNA'
  WHEN regexp_full_match(s, '[-*ACDEFGHIKLMNPQRSTVWYXBZ]*') THEN 'Protein' END AS alphabet
  FROM (SELECT rec_key, upper(regexp_replace(seq, '\s', '', 'g')) AS s FROM seq_record) WHERE s IS NOT NULL""")
def seq_alphabet(spark, sf_dir):
    s = F.upper(F.regexp_replace("seq", r"\s", ""))
    return table(spark, sf_dir, "seq_record").where("seq IS NOT NULL").select(F.col("rec_key").alias("seq_id"), S.alphabet(s).alias("alphabet"))


@query(f"WITH {DNA} SELECT seq_id, translate(seq, '{A.COMPLEMENT_FROM}', '{A.COMPLEMENT_TO}') AS complement FROM dna")
def seq_complement(spark, sf_dir):
    return _each(spark, sf_dir, "complement", S.complement(F.col("seq")))


@query(f"WITH {DNA} SELECT seq_id, reverse(translate(seq, '{A.COMPLEMENT_FROM}', '{A.COMPLEMENT_TO}')) AS revcomp FROM dna")
def seq_revcomp(spark, sf_dir):
    return _each(spark, sf_dir, "revcomp", S.reverse_complement(F.col("seq")))


@query(f"WITH {DNA} SELECT seq_id, CAST(length(seq) - length(translate(seq, 'GC', '')) AS BIGINT) AS gc, CAST(length(seq) AS BIGINT) AS n FROM dna")
def seq_gc(spark, sf_dir):
    return dna(spark, sf_dir).select("seq_id", S.gc(F.col("seq")).alias("gc"), F.length("seq").cast("long").alias("n"))


@query(f"WITH {DNA} SELECT seq_id, translate(seq, 'T', 'U') AS rna, translate(translate(seq, 'T', 'U'), 'U', 'T') AS dna FROM dna")
def seq_transcribe(spark, sf_dir):
    rna = S.transcribe(F.col("seq"))
    return dna(spark, sf_dir).select("seq_id", rna.alias("rna"), S.back_transcribe(rna).alias("dna"))


@query(f"WITH {DNA} SELECT seq_id, {_TRANSLATE.format(m=_MAP)} AS protein FROM dna")
def seq_translate(spark, sf_dir):
    return _each(spark, sf_dir, "protein", S.translate(F.col("seq"), on_ambiguous="X"))


@query(f"WITH {DNA} SELECT seq_id, split_part({_TRANSLATE.format(m=_MAP)}, '*', 1) AS protein FROM dna")
def seq_translate_to_stop(spark, sf_dir):
    return _each(spark, sf_dir, "protein", S.translate(F.col("seq"), to_stop=True, on_ambiguous="X"))


@query(f"""WITH {DNA}, orf AS (SELECT seq_id, unnest(regexp_extract_all(seq, 'ATG(?:[ACGT][ACGT][ACGT])*?(?:TAA|TAG|TGA)')) AS seq FROM dna)
SELECT seq_id, 'M' || substr(split_part({_TRANSLATE.format(m=_MAP)}, '*', 1), 2) AS protein, CAST(count(*) AS BIGINT) AS n FROM orf GROUP BY ALL""")
def seq_translate_cds(spark, sf_dir):
    """Coding sequences found in frame, translated with the checks on."""
    orf = F.explode(F.regexp_extract_all("seq", F.lit("ATG(?:[ACGT][ACGT][ACGT])*?(?:TAA|TAG|TGA)"), F.lit(0)))
    rows = dna(spark, sf_dir).select("seq_id", orf.alias("seq"))
    return rows.select("seq_id", S.translate(F.col("seq"), cds=True).alias("protein")).groupBy("seq_id", "protein").agg(F.count("*").alias("n"))


@query(f"WITH {DNA} SELECT seq_id, CASE WHEN length(seq) >= 20 THEN substr(seq, length(seq) - 19, 15) END AS part, substr(seq, 3, 10) AS head FROM dna")
def seq_slice_negative(spark, sf_dir):
    return dna(spark, sf_dir).select("seq_id", S.slice_(F.col("seq"), -20, -6).alias("part"), S.slice_(F.col("seq"), 2, 11).alias("head"))


@query(f"WITH {DNA} SELECT seq_id, 'AC' || seq || repeat('GT', 3) AS joined FROM dna")
def seq_join_repeat(spark, sf_dir):
    return _each(spark, sf_dir, "joined", F.concat(F.lit("AC"), F.col("seq"), F.repeat(F.lit("GT"), F.lit(3))))


@query(f"WITH {DNA} SELECT seq_id, CAST(instr(seq, 'ACGT') - 1 AS BIGINT) AS first_at, CAST(CASE WHEN instr(reverse(seq), 'TGCA') = 0 THEN -1 ELSE length(seq) - 4 - instr(reverse(seq), 'TGCA') + 1 END AS BIGINT) AS last_at, contains(seq, 'GATTACA') AS has FROM dna")
def seq_index_of(spark, sf_dir):
    s = F.col("seq")
    return dna(spark, sf_dir).select("seq_id", S.index_of(s, "ACGT").alias("first_at"), S.last_index_of(s, "ACGT").alias("last_at"), F.contains(s, F.lit("GATTACA")).alias("has"))


@query(f"""WITH {DNA} SELECT seq_id, CAST(length(seq) - length(replace(seq, 'A', '')) AS BIGINT) AS n_a, CAST((length(seq) - length(replace(seq, 'AA', ''))) // 2 AS BIGINT) AS n_aa,
CAST(len(list_filter(range(1, length(seq)), lambda i: substr(seq, CAST(i AS INTEGER), 2) = 'AA')) AS BIGINT) AS n_aa_overlap FROM dna""")
def seq_count(spark, sf_dir):
    s = F.col("seq")
    return dna(spark, sf_dir).select("seq_id", S.count_letter(s, "A").alias("n_a"), S.count(s, "AA").alias("n_aa"), S.count_overlap(s, "AA").alias("n_aa_overlap"))


@query(f"WITH {MSA} SELECT aln_id, sample_idx, replace(seq, '-', '') AS ungapped FROM msa")
def msa_ungapped(spark, sf_dir):
    return msa(spark, sf_dir).select("aln_id", "sample_idx", S.ungap(F.col("seq")).alias("ungapped"))


@query(f"WITH {MSA} SELECT aln_id, CAST(count(*) AS BIGINT) AS n_samples, CAST(max(length(seq)) AS BIGINT) AS n_sites, min(length(seq)) = max(length(seq)) AS is_aligned FROM msa GROUP BY aln_id")
def msa_shape(spark, sf_dir):
    """Samples and sites of each alignment, and whether all rows have one length."""
    n = F.length("seq")
    return msa(spark, sf_dir).groupBy("aln_id").agg(F.count("*").alias("n_samples"), F.max(n).cast("long").alias("n_sites"), (F.min(n) == F.max(n)).alias("is_aligned"))


@query(f"WITH {MSA} SELECT aln_id, sample_idx, substr(seq, 1, 1) || substr(seq, 6, 1) || substr(seq, 40, 1) AS sites, substr(seq, 4, 12) AS span FROM msa")
def msa_sites(spark, sf_dir):
    """Sites 0, 5 and the last, and sites 3 to 14, of every sample."""
    return msa(spark, sf_dir).select("aln_id", "sample_idx", P.sites(F.col("seq"), [5, -1, 0, 5]).alias("sites"), P.sites(F.col("seq"), range(3, 15)).alias("span"))


@query(f"WITH {MSA}, n AS (SELECT aln_id, max(sample_idx) AS m FROM msa GROUP BY aln_id) SELECT aln_id, sample_idx, seq FROM msa JOIN n USING (aln_id) WHERE sample_idx IN (0, 2) OR sample_idx = m")
def msa_samples(spark, sf_dir):
    """Samples 0, 2 and the last (negative index) of every alignment."""
    return P.samples(msa(spark, sf_dir), "aln_id", "sample_idx", [2, 0, -1]).select("aln_id", "sample_idx", "seq")


@query(f"""WITH {MSA}, c AS (SELECT aln_id, i AS site, substr(seq, CAST(i + 1 AS INTEGER), 1) AS base FROM msa, range(0, 40) t(i))
SELECT aln_id, CAST(site AS INTEGER) AS site, CAST(count(*) FILTER (base = 'A') AS BIGINT) AS a, CAST(count(*) FILTER (base = 'C') AS BIGINT) AS c, CAST(count(*) FILTER (base = 'G') AS BIGINT) AS g, CAST(count(*) FILTER (base = 'T') AS BIGINT) AS t, CAST(count(*) FILTER (base = '-') AS BIGINT) AS gap FROM c GROUP BY ALL""")
def msa_site_counts(spark, sf_dir):
    """Letters of each site of each alignment."""
    cells = msa(spark, sf_dir).select("aln_id", F.posexplode(F.split("seq", "")).alias("site", "base"))
    return cells.groupBy("aln_id", "site").agg(*[F.count_if(F.col("base") == b).alias(n) for b, n in (("A", "a"), ("C", "c"), ("G", "g"), ("T", "t"), ("-", "gap"))])


@query(f"WITH {DNA}, r AS (SELECT seq_id, unnest(regexp_extract_all(seq, 'N+')) AS run FROM dna) SELECT seq_id, CAST(count(*) AS BIGINT) AS n_runs, CAST(sum(length(run)) AS BIGINT) AS n_letters, CAST(max(length(run)) AS BIGINT) AS longest FROM r GROUP BY seq_id")
def seq_n_runs(spark, sf_dir):
    """Runs of unknown letters, as run-length storage needs them."""
    runs = dna(spark, sf_dir).select("seq_id", F.explode(S.runs(F.col("seq"))).alias("run")).where(F.startswith("run", F.lit("N")))
    return runs.groupBy("seq_id").agg(F.count("*").alias("n_runs"), F.sum(F.length("run")).alias("n_letters"), F.max(F.length("run")).cast("long").alias("longest"))


@query(f"WITH {DNA} SELECT seq_id, CASE WHEN length(seq) >= 60 THEN substr(seq, 1, 54) || '...' || right(seq, 3) ELSE seq END AS shown FROM dna")
def seq_repr(spark, sf_dir):
    return _each(spark, sf_dir, "shown", S.display(F.col("seq")))


@query(f"WITH {DNA} SELECT seq_id, round(list_sum(list_transform(string_split(seq, ''), lambda c: coalesce(CAST({_NUC}[c] AS DOUBLE), 0))), 4) AS weight FROM dna")
def nuc_weight(spark, sf_dir):
    return _each(spark, sf_dir, "weight", F.round(S.weight(F.col("seq"), A.DNA_WEIGHT), 4))


@query(f"WITH {PROTEIN}, c AS (SELECT seq_id, unnest(string_split(seq, '')) AS aa FROM protein WHERE seq <> '') SELECT seq_id, aa, CAST(count(*) AS BIGINT) AS n, round(count(*) * any_value(CAST({_AA}[aa] AS DOUBLE)), 4) AS weight FROM c GROUP BY seq_id, aa")
def protein_weight(spark, sf_dir):
    """Residues of each protein with their weight."""
    each = protein(spark, sf_dir).where("seq <> ''").select("seq_id", F.explode(F.split("seq", "")).alias("aa")).groupBy("seq_id", "aa").agg(F.count("*").alias("n"))
    weights = A.literal_map({k: w for k, (_, w) in A.AMINO.items() if w})
    return each.select("seq_id", "aa", "n", F.round(F.col("n") * F.element_at(weights, F.col("aa")), 4).alias("weight"))


@query(f"WITH {DNA}, c AS (SELECT unnest(list_transform(range(0, length(seq) // 3), lambda i: substr(seq, CAST(i * 3 + 1 AS INTEGER), 3))) AS codon FROM dna) SELECT codon, {_MAP}[codon] AS aa, CAST(count(*) AS BIGINT) AS n FROM c WHERE regexp_full_match(codon, '[ACGT]+') GROUP BY codon")
def codon_usage(spark, sf_dir):
    each = dna(spark, sf_dir).select(F.explode(S.codons(F.col("seq"))).alias("codon")).where(~F.col("codon").rlike("[^ACGT]")).groupBy("codon").agg(F.count("*").alias("n"))
    return each.select("codon", F.element_at(A.literal_map(A.codon_map(1)), F.col("codon")).alias("aa"), "n")


_TABLES = ", ".join(f"({t}, '{c}', '{a}', {str(s).lower()}, {str(e).lower()})" for t, c, a, s, e in A.codon_rows())


@query(f"SELECT CAST(t AS INTEGER) AS table_id, aa, CAST(count(*) AS BIGINT) AS n_codons, string_agg(c, ' ' ORDER BY c) AS codons FROM (VALUES {_TABLES}) v(t, c, aa, s, e) GROUP BY t, aa")
def codon_degeneracy(spark, sf_dir):
    """Codons of each amino acid in every table."""
    return A.codon_tables(spark).groupBy("table_id", "aa").agg(F.count("*").alias("n_codons"), F.array_join(F.array_sort(F.collect_list("codon")), " ").alias("codons"))


@query(f"SELECT CAST(t AS INTEGER) AS table_id, c AS codon, aa, s AS is_start, e AS is_stop FROM (VALUES {_TABLES}) v(t, c, aa, s, e)")
def codon_tables(spark, sf_dir):
    return A.codon_tables(spark)


# --- k-mers -----------------------------------------------------------------------------------------------------------
def _kmers(k: int, src: str = "dna") -> str:
    return f"kmers AS (SELECT * FROM (SELECT seq_id, record_id, unnest(list_transform(range(1, length(seq) - {k} + 2), lambda i: substr(seq, CAST(i AS INTEGER), {k}))) AS kmer FROM {src} WHERE length(seq) >= {k}) WHERE regexp_full_match(kmer, '[ACGT]+'))"


_CANON = "translate(least(translate(kmer, 'ACTG', '0123'), translate(reverse(translate(kmer, 'ACGT', 'TGCA')), 'ACTG', '0123')), '0123', 'ACTG')"
_CODE = "CAST(list_reduce(list_transform(string_split(translate(kmer, 'ACTG', '0123'), ''), lambda d: CAST(d AS BIGINT)), lambda a, d: a * 4 + d) AS BIGINT)"


@query(f"WITH {DNA}, {_kmers(7)} SELECT {_CANON} AS kmer, CAST(count(*) AS BIGINT) AS n FROM kmers GROUP BY 1")
def kmer_canonical(spark, sf_dir):
    """Counts of canonical 7-mers over all sequences."""
    rows = K.windows(dna(spark, sf_dir).select("seq"), "seq", 7).groupBy("kmer").agg(F.count("*").alias("n"))
    # the strands are folded after counting: far fewer rows
    return rows.groupBy(K.canonical(F.col("kmer")).alias("kmer")).agg(F.sum("n").alias("n"))


@query(f"WITH {DNA}, {_kmers(9)} SELECT record_id, CAST(count(DISTINCT kmer) AS BIGINT) AS n_kmers, CAST(count(*) AS BIGINT) AS n_windows FROM kmers GROUP BY record_id")
def kmer_set(spark, sf_dir):
    """Distinct 9-mers of each record."""
    rows = K.windows(dna(spark, sf_dir).select("record_id", "seq"), "seq", 9).groupBy("record_id", "kmer").agg(F.count("*").alias("n"))
    return rows.groupBy("record_id").agg(F.count("*").alias("n_kmers"), F.sum("n").alias("n_windows"))


@query(f"WITH {DNA}, {_kmers(5)}, both_ AS (SELECT kmer FROM kmers UNION ALL SELECT reverse(translate(kmer, 'ACGT', 'TGCA')) FROM kmers) SELECT kmer, CAST(count(*) AS BIGINT) AS n FROM both_ GROUP BY kmer")
def kmer_multiset(spark, sf_dir):
    """5-mers of both strands with counts."""
    one = K.windows(dna(spark, sf_dir).select("seq"), "seq", 5).groupBy("kmer").agg(F.count("*").alias("n"))
    other = one.select(S.reverse_complement(F.col("kmer")).alias("kmer"), "n")
    return one.unionByName(other).groupBy("kmer").agg(F.sum("n").alias("n"))


@query(f"WITH {DNA}, {_kmers(6)} SELECT DISTINCT kmer, {_CODE} AS code, {_CODE} AS back FROM kmers")
def kmer_encode(spark, sf_dir):
    """2-bit codes of all 6-mers, and the code of what decoding gives."""
    code = K.encode(F.col("kmer"))
    return K.windows(dna(spark, sf_dir).select("seq"), "seq", 6).select("kmer").distinct().select("kmer", code.alias("code"), K.encode(K.decode(code, 6)).alias("back"))


@query(f"""WITH {DNA}, p AS (SELECT seq_id, i, substr(seq, CAST(i + 1 AS INTEGER), 1) AS c, seq FROM dna, LATERAL (SELECT unnest(range(0, length(seq))) AS i))
SELECT seq_id, CAST(2 * sum(CASE WHEN c NOT IN ('A', 'C', 'G', 'T') THEN 1 WHEN i >= 6 AND regexp_matches(substr(seq, CAST(i - 5 AS INTEGER), 7), '[^ACGT]') THEN 1 ELSE 0 END) AS BIGINT) AS n_ambiguous FROM p GROUP BY seq_id""")
def kmer_ambiguous(spark, sf_dir):
    """Letters where no 7-mer ends because of an ambiguous letter, for both strands."""
    return dna(spark, sf_dir).where("seq <> ''").select("seq_id", K.ambiguous(F.col("seq"), 7).alias("n_ambiguous"))


@query(f"""WITH {DNA}, thin AS (SELECT seq_id, record_id, array_to_string(list_transform(range(0, (length(seq) + 2) // 3), lambda i: substr(seq, CAST(i * 3 + 1 AS INTEGER), 1)), '') AS seq FROM dna), {_kmers(5, "thin")}
SELECT kmer, CAST(count(*) AS BIGINT) AS n FROM kmers GROUP BY kmer""")
def kmer_spaced(spark, sf_dir):
    """5-mers of every third letter."""
    return K.windows(dna(spark, sf_dir).select("seq"), "seq", 5, step=3).groupBy("kmer").agg(F.count("*").alias("n"))


@query(f"WITH {DNA}, {_kmers(9)} SELECT n_records, CAST(count(*) AS BIGINT) AS n_kmers FROM (SELECT {_CANON} AS kmer, CAST(count(DISTINCT record_id) AS BIGINT) AS n_records FROM kmers GROUP BY 1) GROUP BY n_records")
def kmer_conservation(spark, sf_dir):
    """How many canonical 9-mers occur in how many records."""
    kmer = F.col("kmer")  # strands are paired by the smaller text: no k-mer needs its canonical name here
    rows = K.windows(dna(spark, sf_dir).select("record_id", "seq"), "seq", 9).select("record_id", F.least(kmer, S.reverse_complement(kmer)).alias("kmer")).distinct()
    return rows.groupBy("kmer").agg(F.count("*").alias("n_records")).groupBy("n_records").agg(F.count("*").alias("n_kmers"))


@query(f"WITH {DNA}, {_kmers(8)}, u AS (SELECT DISTINCT kmer FROM kmers) SELECT CAST(d AS INTEGER) AS distance, CAST(count(*) AS BIGINT) AS n FROM (SELECT least(hamming(kmer, 'ACGTACGT'), hamming(reverse(translate(kmer, 'ACGT', 'TGCA')), 'ACGTACGT')) AS d FROM u) GROUP BY d")
def kmer_min_hamming(spark, sf_dir):
    """Distance of each 8-mer (either strand) to a query, by the bit form."""
    rows = K.windows(dna(spark, sf_dir).select("seq"), "seq", 8).select("kmer").distinct()
    to = K.encode(F.lit("ACGTACGT"))
    d = F.least(K.hamming(K.encode(F.col("kmer")), to), K.hamming(K.encode(S.reverse_complement(F.col("kmer"))), to))
    return rows.select(d.alias("distance")).groupBy("distance").agg(F.count("*").alias("n"))


def hamming_counts(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """One row (h1, h_many, copy_count, copy_difference) for two tables (kmer, n).

    The distance of a k-mer to the other set is capped at 2.  Codes that differ in one letter agree once that letter is
    blanked: each k-mer goes to ``k`` groups of at most four, and one of a single set is at distance 1 if some group of it
    holds a k-mer of the other.  Both directions are one pass, and no pairs are made.
    """
    sides = a.select("kmer", "n", F.lit(0).cast("long").alias("m")).unionByName(b.select("kmer", F.lit(0).cast("long").alias("n"), F.col("n").alias("m")))
    each = cut(sides.groupBy(K.encode(F.col("kmer")).alias("code")).agg(F.sum("n").alias("n"), F.sum("m").alias("m")))
    side = F.when(F.col("m") == 0, 1).when(F.col("n") == 0, 2).otherwise(3)
    keys = each.select("code", side.alias("side"), F.explode(K.blanked(F.col("code"), k)).alias("key"))
    groups = keys.groupBy("key").agg(F.collect_list(F.struct("code", "side")).alias("l"), F.bit_or("side").alias("sides")).where("sides = 3")
    near = groups.select(F.explode(F.filter("l", lambda x: x["side"] < 3)).alias("x")).select("x.code").distinct().agg(F.count("*").alias("h1"))
    n, m = F.col("n"), F.col("m")
    rest = each.agg(F.count_if((n == 0) | (m == 0)).alias("alone"), (F.count_if((n > 0) & (m > 0) & (n != m)) * 2).alias("copy_count"), F.coalesce(F.sum(F.when((n > 0) & (m > 0), F.abs(n - m))), F.lit(0)).alias("copy_difference"))
    return near.join(F.broadcast(rest)).select("h1", (F.col("alone") - F.col("h1")).alias("h_many"), "copy_count", "copy_difference")


@query(f"""WITH {DNA}, {_kmers(6)}, u AS (SELECT DISTINCT {_CODE} AS code FROM kmers), b AS (SELECT 0 AS side, code & CAST(3689348814741910323 AS BIGINT) AS part FROM u UNION ALL SELECT 1, code & CAST(922337203685477580 AS BIGINT) FROM u)
SELECT side, part, CAST(count(*) AS BIGINT) AS n FROM b GROUP BY side, part""")
def kmer_evenodd_buckets(spark, sf_dir):
    """Sizes of the buckets of even and odd letters of all 6-mers."""
    codes = K.windows(dna(spark, sf_dir).select("seq"), "seq", 6).select(K.encode(F.col("kmer")).alias("code")).distinct()
    return codes.select(F.explode(K.buckets(F.col("code"))).alias("b")).groupBy("b.side", "b.part").agg(F.count("*").alias("n"))


@query(f"""WITH {DNA}, {_kmers(9)}, a AS (SELECT kmer, count(*) AS n FROM kmers WHERE record_id < 'ctg00_000100' GROUP BY kmer), b AS (SELECT kmer, count(*) AS n FROM kmers WHERE record_id >= 'ctg00_000100' GROUP BY kmer),
pa AS (SELECT kmer, unnest(list_transform(range(1, 10), lambda i: i || ':' || substr(kmer, 1, CAST(i - 1 AS INTEGER)) || '.' || substr(kmer, CAST(i + 1 AS INTEGER)))) AS key FROM a), pb AS (SELECT kmer, unnest(list_transform(range(1, 10), lambda i: i || ':' || substr(kmer, 1, CAST(i - 1 AS INTEGER)) || '.' || substr(kmer, CAST(i + 1 AS INTEGER)))) AS key FROM b),
da AS (SELECT kmer, CASE WHEN kmer IN (SELECT kmer FROM b) THEN 0 WHEN kmer IN (SELECT pa.kmer FROM pa JOIN pb USING (key)) THEN 1 ELSE 2 END AS d FROM a),
db AS (SELECT kmer, CASE WHEN kmer IN (SELECT kmer FROM a) THEN 0 WHEN kmer IN (SELECT pb.kmer FROM pb JOIN pa USING (key)) THEN 1 ELSE 2 END AS d FROM b), u AS (SELECT * FROM da UNION ALL SELECT * FROM db)
SELECT CAST(count(*) FILTER (d = 1) AS BIGINT) AS h1, CAST(count(*) FILTER (d = 2) AS BIGINT) AS h_many, (SELECT CAST(2 * count(*) AS BIGINT) FROM a JOIN b USING (kmer) WHERE a.n <> b.n) AS copy_count, (SELECT CAST(coalesce(sum(abs(a.n - b.n)), 0) AS BIGINT) FROM a JOIN b USING (kmer)) AS copy_difference FROM u""")
def kmer_hamming_counts(spark, sf_dir):
    """Distances between the 9-mers of the contigs named below and from ctg00_000100 on."""
    rows = K.windows(dna(spark, sf_dir).select("record_id", "seq"), "seq", 9).groupBy("kmer", (F.col("record_id") < "ctg00_000100").alias("first")).agg(F.count("*").alias("n"))
    side = lambda first: rows.where(F.col("first") if first else ~F.col("first")).select("kmer", "n")
    return hamming_counts(side(True), side(False), 9)


@query(f"""WITH {DNA}, {_kmers(6)}, g AS (SELECT substr(record_id, length(record_id)) AS grp, kmer, count(*) AS n FROM kmers GROUP BY ALL), len_ AS (SELECT substr(record_id, length(record_id)) AS grp, sum(length(seq)) AS len FROM dna GROUP BY 1),
keys AS (SELECT grp, kmer, unnest(list_transform(range(1, 7), lambda i: i || ':' || substr(kmer, 1, CAST(i - 1 AS INTEGER)) || '.' || substr(kmer, CAST(i + 1 AS INTEGER)))) AS key FROM g),
near AS (SELECT DISTINCT x.grp AS a, x.kmer, y.grp AS b FROM keys x JOIN keys y USING (key) WHERE x.grp <> y.grp),
ids AS (SELECT DISTINCT grp FROM g), p AS (SELECT x.grp AS a, y.grp AS b FROM ids x, ids y WHERE x.grp <> y.grp),
way AS (SELECT p.a, p.b, count(*) FILTER (t.kmer IS NULL AND near.kmer IS NOT NULL) AS h1, count(*) FILTER (t.kmer IS NULL AND near.kmer IS NULL) AS h_many, count(*) FILTER (g.n <> t.n) AS differ, coalesce(sum(abs(g.n - t.n)), 0) AS dist
  FROM p JOIN g ON g.grp = p.a LEFT JOIN g t ON t.grp = p.b AND t.kmer = g.kmer LEFT JOIN near ON near.a = p.a AND near.b = p.b AND near.kmer = g.kmer GROUP BY p.a, p.b)
SELECT x.a AS id_a, x.b AS id_b, CAST(x.h1 + y.h1 AS DOUBLE) / ((la.len + lb.len) / 2) AS h1, CAST(x.h_many + y.h_many AS DOUBLE) / ((la.len + lb.len) / 2) AS h_many, CAST(x.differ + y.differ AS DOUBLE) / ((la.len + lb.len) / 2) AS copy_count, CAST(x.dist AS DOUBLE) / ((la.len + lb.len) / 2) AS copy_difference
FROM way x JOIN way y ON x.a = y.b AND x.b = y.a JOIN len_ la ON la.grp = x.a JOIN len_ lb ON lb.grp = x.b""")
def kmer_distance_matrix(spark, sf_dir):
    """The four distance matrices of ten groups of records, by mean length, both halves."""
    base = dna(spark, sf_dir).select(F.right("record_id", F.lit(1)).alias("id"), "seq")
    return distance_matrices(base, "id", "seq", 6)


def distance_matrices(df: DataFrame, key: str, seq: str, k: int) -> DataFrame:
    """(id_a, id_b, h1, h_many, copy_count, copy_difference) of every ordered pair of different ids: the four numbers of
    :func:`hamming_counts` over the mean length of the two.

    The result has a row for each pair, so the ids are few enough for a matrix.  No k-mers are compared in pairs: those of
    a k-mer and of its neighbours (which agree once a letter is blanked) are two lists of ids, and sums over these give all
    cells; what is far follows from the numbers of k-mers.  Ids without a k-mer are left out.
    """
    rows = K.windows(df.select(F.col(key).alias("_id"), seq), seq, k).groupBy("_id", "kmer").agg(F.count("*").alias("n"))
    has = cut(rows.groupBy("kmer").agg(F.collect_list(F.struct(F.col("_id").alias("id"), "n")).alias("has")))
    keys = has.select("kmer", F.transform("has", lambda h: h["id"]).alias("ids"), F.explode(K.blanked(K.encode(F.col("kmer")), k)).alias("blank"))
    around = keys.groupBy("blank").agg(F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids"))
    near = keys.select("kmer", "blank").join(around, "blank").groupBy("kmer").agg(F.array_distinct(F.flatten(F.collect_list("ids"))).alias("near"))
    each = has.join(near, "kmer").select("near", "has", F.map_from_entries("has").alias("m"), F.explode("has").alias("a"))
    pair = each.select(F.col("a.id").alias("id_a"), F.explode("near").alias("id_b"), F.col("a.n").alias("n"), "m").where("id_a <> id_b")
    other = F.element_at("m", F.col("id_b"))
    one = pair.groupBy("id_a", "id_b").agg(F.count_if(other.isNull()).alias("h1"), F.count_if(other.isNotNull()).alias("same"), F.count_if(other != F.col("n")).alias("differ"), F.coalesce(F.sum(F.abs(F.col("n") - other)), F.lit(0)).alias("dist"))
    sizes = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.sum(F.length(seq)).alias("len"))
    kinds = cut(rows.groupBy(F.col("_id").alias("id")).agg(F.count("*").alias("kinds")).join(sizes, "id"))
    # every pair, from one row that lists the ids
    listed = kinds.agg(F.collect_set("id").alias("ids")).select(F.explode("ids").alias("id_a"), "ids").select("id_a", F.explode("ids").alias("id_b")).where("id_a <> id_b")
    way = cut(listed.join(one, ["id_a", "id_b"], "left").na.fill(0))
    back = way.select(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b"), F.col("h1").alias("h1b"))
    whole = way.join(back, ["id_a", "id_b"]).join(kinds.toDF("id_a", "kinds_a", "len_a"), "id_a").join(kinds.toDF("id_b", "kinds_b", "len_b"), "id_b")
    mean = (F.col("len_a") + F.col("len_b")) / 2
    h1 = F.col("h1") + F.col("h1b")
    cells = {"h1": h1, "h_many": F.col("kinds_a") + F.col("kinds_b") - 2 * F.col("same") - h1, "copy_count": 2 * F.col("differ"), "copy_difference": F.col("dist")}
    return whole.select("id_a", "id_b", *[(c.cast("double") / mean).alias(n) for n, c in cells.items()])


@query()
def random_nuc(spark, sf_dir):
    """A random sequence for each record, as long as the record's sequence."""
    return dna(spark, sf_dir).select("seq_id", S.random_sequence(F.col("seq_id"), F.length("seq")).alias("seq"))


_LETTER_ROWS = ", ".join(f"('{c}', '{t}', {round(A.nucleotide_weight(c), 4)}, '{A.AMBIGUITY.get(c, '')}')" for c, t in zip(A.COMPLEMENT_FROM, A.COMPLEMENT_TO) if c != "U")


@query(f"SELECT CAST(c AS VARCHAR) AS letter, CAST(t AS VARCHAR) AS dna_complement, CAST(w AS DOUBLE) AS dna_weight, a AS members FROM (VALUES {_LETTER_ROWS}) v(c, t, w, a)")
def nuc_table(spark, sf_dir):
    """Letters with complement, weight and the letters that ambiguous ones stand for."""
    data = [(c, t, round(A.nucleotide_weight(c), 4), A.AMBIGUITY.get(c, "")) for c, t in zip(A.COMPLEMENT_FROM, A.COMPLEMENT_TO) if c != "U"]
    return spark.createDataFrame(data, "letter string, dna_complement string, dna_weight double, members string")


@query(f"WITH {DNA} SELECT record_id, CAST(count(*) AS BIGINT) AS n_palindromes FROM (SELECT record_id, unnest(list_transform(range(1, length(seq) - 4), lambda i: substr(seq, CAST(i AS INTEGER), 6))) AS w FROM dna WHERE length(seq) >= 6) WHERE w = reverse(translate(w, 'ACGT', 'TGCA')) AND regexp_full_match(w, '[ACGT]+') GROUP BY record_id")
def seq_palindromes(spark, sf_dir):
    """6-mers that equal their reverse complement, by record."""
    rows = K.windows(dna(spark, sf_dir).select("record_id", "seq"), "seq", 6)
    return rows.where(F.col("kmer") == S.reverse_complement(F.col("kmer"))).groupBy("record_id").agg(F.count("*").alias("n_palindromes"))


@query(f"""WITH {DNA}, w AS (SELECT seq_id, i // 16 AS word_no, substr(seq, CAST(i + 1 AS INTEGER), 16) AS w FROM dna, LATERAL (SELECT unnest(range(0, length(seq), 16)) AS i))
SELECT seq_id, CAST(word_no AS INTEGER) AS word_no, CAST(list_reduce(list_transform(string_split(translate(w, 'ACTG', '0123'), ''), lambda d: CAST(d AS BIGINT)), lambda a, d: a * 4 + d) AS BIGINT) AS packed FROM w WHERE regexp_full_match(w, '[ACGT]+')""")
def seq_pack(spark, sf_dir):
    """2-bit words of 16 letters of every sequence; words with an unknown letter are left to the run-length form."""
    words = dna(spark, sf_dir).select("seq_id", F.posexplode(F.regexp_extract_all("seq", F.lit("(?s).{1,16}"), F.lit(0))).alias("word_no", "w"))
    return words.where(~F.col("w").rlike("[^ACGT]")).select("seq_id", "word_no", K.encode(F.col("w")).alias("packed"))
