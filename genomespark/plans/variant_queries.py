"""Queries on reads, variants, alignment blocks and mutations."""

from __future__ import annotations


from pyspark.sql import functions as F

from genomespark.operators import alignments as M
from genomespark.operators import mutations, reads
from genomespark.operators import variants as V
from genomespark.operators.packed import with_alleles
from genomespark.plans.views import ALN, DNA, Book, aln, dna, protein
from genomespark.runtime import cut, table

BOOK = Book()
query = BOOK.query


# --- reads --------------------------------------------------------------------------------------------------------------
@query("""SELECT read_group, CAST(count(*) FILTER (flag & 1 = 1) AS BIGINT) AS paired, CAST(count(*) FILTER (flag & 2 = 2) AS BIGINT) AS mapped_proper_pair, CAST(count(*) FILTER (flag & 4 = 4) AS BIGINT) AS unmapped, CAST(count(*) FILTER (flag & 4 = 0) AS BIGINT) AS mapped,
CAST(count(*) FILTER (flag & 8 = 8) AS BIGINT) AS mate_unmapped, CAST(count(*) FILTER (flag & 8 = 0) AS BIGINT) AS mate_mapped, CAST(count(*) FILTER (flag & 256 = 0) AS BIGINT) AS primary_, CAST(count(*) FILTER (flag & 256 = 256) AS BIGINT) AS not_primary FROM sam_record GROUP BY read_group""")
def sam_flag_filters(spark, sf_dir):
    rows = table(spark, sf_dir, "sam_record")
    name = lambda n: "primary_" if n == "primary" else n
    return rows.groupBy("read_group").agg(*[F.count_if(reads.matches(F.col("flag"), n)).alias(name(n)) for n in reads.FILTERS])


@query("""SELECT record_id, num_m, num_i, num_d, num_s, CASE WHEN flag & 16 = 16 THEN '-' ELSE '+' END AS strand FROM sam_record""")
def sam_cigar_stats(spark, sf_dir):
    """Letters by operation from CIGAR text (written from the counts and read again), and the strand by the flag."""
    part = lambda c, op: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(op))).otherwise("")
    cigar = F.concat(part("num_h", "H"), part("num_s", "S"), part("num_m", "M"), part("num_eq", "="), part("num_x", "X"), part("num_i", "I"), part("num_d", "D"))
    rows = table(spark, sf_dir, "sam_record").withColumn("cigar", cigar)
    return rows.select("record_id", *[reads.cigar_sum(F.col("cigar"), op).alias(c) for c, op in (("num_m", "M"), ("num_i", "I"), ("num_d", "D"), ("num_s", "S"))], reads.strand(F.col("flag")).alias("strand"))


@query("SELECT record_id, round(CAST(nm AS DOUBLE) / nullif(num_m + num_d + num_i, 0), 9) AS p_align_id, round(CAST(num_m AS DOUBLE) / nullif(query_length, 0), 9) AS p_align FROM sam_record")
def sam_prop_aligned(spark, sf_dir):
    rows = reads.aligned_shares(table(spark, sf_dir, "sam_record"))
    return rows.select("record_id", F.round("p_align_id", 9).alias("p_align_id"), F.round("p_align", 9).alias("p_align"))


# --- variants -----------------------------------------------------------------------------------------------------------
_BODY = r"regexp_replace(trim(alt_alleles, e' \t\r\n'), '^\[(.*)\]$', '\1')"
_FOUND = rf"""list_transform(regexp_extract_all({_BODY}, '"(?:[^"]|"")*"|<[^<>]*>|[^\s,;|/"<]+'), lambda x: CASE WHEN starts_with(x, '"') THEN trim(replace(substr(x, 2, length(x) - 2), '""', '"')) ELSE x END)"""
_ALTS = f"CASE WHEN alt_alleles IS NULL OR trim(alt_alleles, e' \\t\\r\\n') IN ('', '.') THEN CAST([] AS VARCHAR[]) ELSE list_filter({_FOUND}, lambda x: x <> '') END"
_VARS = f"vars AS (SELECT variant_id, sample_name, contig, start_pos, end_pos, ref_allele, {_ALTS} AS alts, genotype, list_transform(string_split(regexp_replace(split_part(genotype, ':', 1), '[|]', '/', 'g'), '/'), lambda x: CASE WHEN x = '.' THEN -1 ELSE TRY_CAST(x AS INTEGER) END) AS idx FROM simple_variant WHERE contig IS NOT NULL)"


def _records(spark, sf_dir):
    """All records with a contig."""
    return table(spark, sf_dir, "simple_variant").where("contig IS NOT NULL").select("variant_id", "sample_name", "contig", "start_pos", "end_pos", "ref_allele", "alt_alleles", "genotype")


def _vars(spark, sf_dir):
    """All records with a contig and their alternative alleles, however these are packed."""
    return with_alleles(_records(spark, sf_dir), "alt_alleles", "alts").drop("alt_alleles")


@query(f"""WITH {_VARS}, c AS (SELECT variant_id, ref_allele, alts, len(list_filter(idx, lambda i: i <> 0)) = 0 AS is_ref_block FROM vars)
SELECT variant_id, is_ref_block, NOT is_ref_block AND length(ref_allele) = 1 AND len(list_filter(alts, lambda a: NOT (starts_with(a, '<') OR length(a) = 1))) = 0 AS is_snp,
NOT is_ref_block AND len(list_filter(alts, lambda a: a = '<DEL>' OR (NOT starts_with(a, '<') AND length(a) < length(ref_allele)))) > 0 AS is_del, NOT is_ref_block AND len(list_filter(alts, lambda a: a = '<INS>' OR (NOT starts_with(a, '<') AND length(a) > length(ref_allele)))) > 0 AS is_ins FROM c""")
def vcf_classify(spark, sf_dir):
    kinds = V.classify(F.col("ref_allele"), F.col("alts"), F.col("genotype"))
    return _vars(spark, sf_dir).select("variant_id", *[kinds[k].alias(k) for k in ("is_ref_block", "is_snp", "is_del", "is_ins")])


@query(f"""WITH {_VARS}, u AS (SELECT *, list_sort(list_distinct(list_filter(idx, lambda i: i > 0))) AS used FROM vars)
SELECT variant_id, array_to_string(list_transform(used, lambda i: coalesce(alts[i], '?')), ',') AS alts, replace(array_to_string(list_transform(idx, lambda i: CASE WHEN i < 0 THEN '.' WHEN i = 0 THEN '0' ELSE CAST(list_position(used, i) AS VARCHAR) END), '/'), '/', CASE WHEN contains(genotype, '|') THEN '|' ELSE '/' END) AS gt FROM u""")
def vcf_reindex_alts(spark, sf_dir):
    """Alternative alleles that the genotype uses, and the genotype over them."""
    alts, gt = V.reindexed(F.col("alts"), F.col("genotype"))
    return _vars(spark, sf_dir).select("variant_id", F.array_join(F.transform(alts, lambda a: F.coalesce(a, F.lit("?"))), ",").alias("alts"), gt.alias("gt"))


def _snps(spark, sf_dir):
    kinds = V.classify(F.col("ref_allele"), F.col("alts"), F.col("genotype"))
    return _vars(spark, sf_dir).where(kinds["is_snp"])


_SNPS = f"{_VARS}, snps AS (SELECT * FROM vars WHERE len(list_filter(idx, lambda i: i <> 0)) > 0 AND length(ref_allele) = 1 AND len(list_filter(alts, lambda a: NOT (starts_with(a, '<') OR length(a) = 1))) = 0)"
_COVER = f"{_SNPS}, sites AS (SELECT DISTINCT contig, start_pos AS pos FROM snps), cover AS (SELECT s.contig, s.pos, v.sample_name, v.variant_id, v.start_pos, v.ref_allele, v.genotype FROM sites s JOIN vars v ON v.contig = s.contig AND v.start_pos <= s.pos AND v.end_pos >= s.pos), best AS (SELECT *, row_number() OVER (PARTITION BY contig, pos, sample_name ORDER BY start_pos DESC, variant_id) AS n FROM cover)"


def _cover(spark, sf_dir):
    """For every SNP position the record of each sample that covers it; of several the one that starts last."""
    sites = _snps(spark, sf_dir).select("contig", F.col("start_pos").alias("pos")).distinct()
    met = V.covering(sites, _records(spark, sf_dir).drop("alt_alleles"), "contig", "pos", "start_pos", "end_pos")
    pick = F.struct((-F.col("start_pos")).alias("s"), "variant_id")
    return met.groupBy("contig", "pos", "sample_name").agg(F.min_by(F.struct("variant_id", "start_pos", "ref_allele", "genotype"), pick).alias("v")).select("contig", "pos", "sample_name", "v.*")


@query(f"WITH {_COVER} SELECT contig, pos, CAST(count(*) AS BIGINT) AS n_samples, string_agg(sample_name || '=' || split_part(genotype, ':', 1), ';' ORDER BY sample_name) AS genotypes FROM best WHERE n = 1 GROUP BY contig, pos")
def vcf_positional_merge(spark, sf_dir):
    """All samples' genotypes at every SNP position."""
    text = F.concat("sample_name", F.lit("="), F.substring_index("genotype", ":", 1))
    rows = _cover(spark, sf_dir).groupBy("contig", "pos").agg(F.count("*").alias("n_samples"), F.array_sort(F.collect_list(F.struct("sample_name", text.alias("t")))).alias("l"))
    return rows.select("contig", "pos", "n_samples", F.array_join(F.transform("l", lambda x: x["t"]), ";").alias("genotypes"))


@query(f"""WITH {_COVER}, b AS (SELECT contig, pos, CASE WHEN pos - start_pos < length(ref_allele) THEN substr(ref_allele, CAST(pos - start_pos + 1 AS INTEGER), 1) END AS base FROM best WHERE n = 1)
SELECT contig, pos, min(base) AS ref, CAST(count(*) AS BIGINT) AS n_calls FROM b GROUP BY contig, pos HAVING count(DISTINCT base) = 1 AND min(base) <> 'N'""")
def vcf_merge_snp(spark, sf_dir):
    """Merged SNP sites: the reference base all samples agree on; sites with conflicts or N are dropped."""
    at = F.col("pos") - F.col("start_pos")
    base = F.when(at < F.length("ref_allele"), F.substring("ref_allele", at + 1, F.lit(1)))
    rows = _cover(spark, sf_dir).withColumn("base", base).groupBy("contig", "pos").agg(F.min("base").alias("ref"), F.max("base").alias("other"), F.count("*").alias("n_calls"))
    return rows.where("ref = other AND ref <> 'N'").select("contig", "pos", "ref", "n_calls")


@query(f"""WITH {_COVER}, k AS (SELECT b.contig, b.pos, b.sample_name, b.start_pos = b.pos AS first_, v.end_pos - v.start_pos + 1 AS n, CASE WHEN b.pos - b.start_pos < length(b.ref_allele) THEN substr(b.ref_allele, CAST(b.pos - b.start_pos + 1 AS INTEGER), 1) END AS base,
list_transform(v.idx, lambda i: CASE WHEN i < 0 THEN '.' WHEN i = 0 THEN v.ref_allele ELSE coalesce(v.alts[i], '.') END) AS g, len(list_filter(v.idx, lambda i: i <> 0)) = 0 AS is_ref,
length(v.ref_allele) = 1 AND len(list_filter(v.alts, lambda a: NOT (starts_with(a, '<') OR length(a) = 1))) = 0 AS plain, len(list_filter(v.alts, lambda a: a IN ('<DEL>', '<INS>') OR (NOT starts_with(a, '<') AND length(a) <> length(v.ref_allele)))) > 0 AS odd
FROM best b JOIN vars v USING (variant_id) WHERE b.n = 1),
kind AS (SELECT *, CASE WHEN NOT is_ref AND odd THEN 'indel' WHEN NOT is_ref AND plain THEN 'snp' WHEN is_ref THEN 'ref' ELSE 'none' END AS kind FROM k),
site AS (SELECT contig, pos, arg_min(base, sample_name) FILTER (base IS NOT NULL) AS ref FROM kind GROUP BY contig, pos HAVING count(DISTINCT base) = 1 AND count(*) FILTER (kind = 'snp') > 0),
calls AS (SELECT s.contig, s.pos, s.ref, sample_name, list_transform(g, lambda x: CASE WHEN kind = 'none' OR (kind = 'indel' AND x = '.') THEN '.' WHEN kind = 'ref' THEN s.ref WHEN kind = 'snp' THEN x
WHEN x = '<INS>' OR (NOT starts_with(x, '<') AND length(x) > n) THEN '<INS>' WHEN x = '<DEL>' OR length(x) < n THEN CASE WHEN first_ AND substr(x, 1, 1) = s.ref THEN substr(x, 1, 1) ELSE '<DEL>' END WHEN length(x) = 1 THEN x ELSE '.' END) AS g FROM site s JOIN kind USING (contig, pos) WHERE s.ref <> 'N'),
a AS (SELECT contig, pos, sample_name, unnest(g) AS x, generate_subscripts(g, 1) AS i, ref FROM calls),
f AS (SELECT contig, pos, x, min((sample_name, i)) AS first_ FROM a WHERE x <> '.' AND x <> ref GROUP BY contig, pos, x)
SELECT c.contig, c.pos, any_value(c.ref) AS ref, coalesce((SELECT string_agg(x, ',' ORDER BY starts_with(x, '<'), first_) FROM f WHERE f.contig = c.contig AND f.pos = c.pos), '') AS alts, string_agg(sample_name || '=' || array_to_string(g, '/'), ';' ORDER BY sample_name) AS genotypes FROM calls c GROUP BY c.contig, c.pos""")
def vcf_merge_calls(spark, sf_dir):
    """Merged SNP sites with every sample's alleles."""
    sites = _snps(spark, sf_dir).select("contig", F.col("start_pos").alias("pos")).distinct()
    met = V.covering(sites, _vars(spark, sf_dir), "contig", "pos", "start_pos", "end_pos")
    pick = F.struct((-F.col("start_pos")).alias("s"), "variant_id")
    one = met.groupBy("contig", "pos", "sample_name").agg(F.min_by(F.struct("start_pos", "end_pos", "ref_allele", "alts", "genotype"), pick).alias("v")).select("contig", "pos", "sample_name", "v.*")
    return V.merged_calls(one, ["contig", "pos"])


@query("""WITH v AS (SELECT variant_id, contig, start_pos, lag(contig) OVER w AS c, lag(end_pos) OVER w AS e FROM simple_variant WHERE contig IS NOT NULL WINDOW w AS (PARTITION BY sample_name ORDER BY made_at, variant_id)) SELECT variant_id, contig, start_pos FROM v WHERE c = contig AND start_pos <= e""")
def vcf_validate_order(spark, sf_dir):
    """Records of a sample that start at or before the end of the record made before them on the same contig."""
    rows = table(spark, sf_dir, "simple_variant").where("contig IS NOT NULL").withColumn("place", F.struct("made_at", "variant_id"))
    return V.out_of_order(rows, "sample_name", "place", "contig", "start_pos", "end_pos").select("variant_id", "contig", "start_pos")


@query(f"""WITH {DNA}, r AS (SELECT seq_id AS variant_id, record_id, 1 + seq_id % 50 AS place, CASE WHEN seq_id % 3 = 0 THEN 'A' ELSE substr(seq, CAST(1 + seq_id % 50 AS INTEGER), 2) END AS ref_allele, seq FROM dna)
SELECT variant_id, ref_allele, substr(seq, CAST(place AS INTEGER), length(ref_allele)) AS corrected, ref_allele = substr(seq, CAST(place AS INTEGER), length(ref_allele)) AS is_valid FROM r""")
def vcf_validate_ref(spark, sf_dir):
    """REF alleles held against the reference sequence, with the corrected allele."""
    at = (F.pmod("seq_id", F.lit(50)) + 1).cast("int")
    ref = F.when(F.pmod("seq_id", F.lit(3)) == 0, "A").otherwise(F.substring("seq", at, F.lit(2)))
    rows = dna(spark, sf_dir).select(F.col("seq_id").alias("variant_id"), ref.alias("ref_allele"), F.substring(F.col("seq"), at, F.length(ref)).alias("corrected"))
    return rows.withColumn("is_valid", F.col("ref_allele") == F.col("corrected"))


# --- alignment blocks ---------------------------------------------------------------------------------------------------
_COLS = f"{ALN}, cols AS (SELECT block, contig, start0, i, substr(ref, CAST(i AS INTEGER), 1) AS r, substr(qry, CAST(i AS INTEGER), 1) AS q FROM aln, LATERAL (SELECT unnest(range(1, least(length(ref), length(qry)) + 1)) AS i)), placed AS (SELECT *, start0 + sum(CASE WHEN r <> '-' THEN 1 ELSE 0 END) OVER (PARTITION BY block ORDER BY i) AS pos FROM cols)"


def _aligned(spark, sf_dir):
    """Blocks cut to their common width (sequences made apart may differ in length at the end)."""
    n = F.least(F.length("ref"), F.length("qry"))
    rows = aln(spark, sf_dir).withColumn("_n", n)
    return rows.withColumn("ref", F.substring(F.col("ref"), F.lit(1), F.col("_n"))).withColumn("qry", F.substring(F.col("qry"), F.lit(1), F.col("_n"))).drop("_n")


@query(f"WITH {_COLS}, c AS (SELECT contig, pos, count(*) FILTER (q <> '-') AS cov, count(*) FILTER (q = r) AS ident FROM placed WHERE r <> '-' GROUP BY contig, pos) SELECT contig, CAST(cov AS BIGINT) AS depth, CAST(count(*) AS BIGINT) AS n_positions FROM c WHERE cov > 0 GROUP BY contig, cov")
def cov_pileup(spark, sf_dir):
    """Positions of each contig by the number of blocks that cover them."""
    deep = M.coverage(M.column_runs(_aligned(spark, sf_dir)), "contig")
    return deep.groupBy("contig", "depth").agg(F.sum(F.col("r_end") - F.col("r_start") + 1).alias("n_positions"))


@query(f"WITH {_COLS}, c AS (SELECT contig, pos, count(*) FILTER (q <> '-') AS cov, count(*) FILTER (q = r) AS ident FROM placed WHERE r <> '-' GROUP BY contig, pos) SELECT contig, CAST(20000 AS BIGINT) AS num_region_bps, round(count(*) FILTER (cov > 0) * 100.0 / 20000, 9) AS percent_cov, round(count(*) FILTER (ident > 0) * 100.0 / 20000, 9) AS percent_id FROM c GROUP BY contig")
def cov_identity_percent(spark, sf_dir):
    """Covered and identical share of contigs of 20,000 letters."""
    runs = cut(M.column_runs(_aligned(spark, sf_dir)).drop("c_start", "width"))
    sizes = runs.select("contig").distinct().withColumn("num_region_bps", F.lit(20_000).cast("long"))
    out = M.coverage_percent(runs, sizes, "contig")
    return out.select("contig", "num_region_bps", F.round("percent_cov", 9).alias("percent_cov"), F.round("percent_id", 9).alias("percent_id"))


@query(f"WITH {_COLS} SELECT block, CAST(pos AS BIGINT) AS pos, r AS ref, q AS alt FROM placed WHERE r <> '-' AND q <> '-' AND r <> q")
def maf_snps(spark, sf_dir):
    """Substituted letters of every block."""
    rows = _aligned(spark, sf_dir)
    runs = M.column_runs(rows).where("state = 'X'").select("block", "r_start", "c_start", "width")
    each = runs.join(rows.select("block", "ref", "qry"), "block").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
    at = (F.col("c_start") + F.col("k") + 1).cast("int")
    return each.select("block", (F.col("r_start") + F.col("k")).cast("long").alias("pos"), F.substring(F.col("ref"), at, F.lit(1)).alias("ref"), F.substring(F.col("qry"), at, F.lit(1)).alias("alt"))


@query(f"WITH {_COLS}, e AS (SELECT *, r = q AS same, lag(r = q) OVER (PARTITION BY block ORDER BY i) AS before FROM placed), g AS (SELECT *, sum(CASE WHEN same AND before THEN 0 ELSE 1 END) OVER (PARTITION BY block ORDER BY i) AS n FROM e) SELECT block, CAST(min(pos) AS BIGINT) AS b_start, CAST(max(pos) AS BIGINT) AS b_end FROM g WHERE same AND r <> '-' GROUP BY block, n")
def maf_ref_blocks(spark, sf_dir):
    """Stretches where block and reference agree."""
    return M.column_runs(_aligned(spark, sf_dir)).where("state = 'M'").select("block", F.col("r_start").cast("long").alias("b_start"), F.col("r_end").cast("long").alias("b_end"))


@query(f"WITH {_COLS}, e AS (SELECT *, CASE WHEN r = '-' AND q = '-' THEN '_' WHEN r = '-' THEN 'I' WHEN q = '-' THEN 'D' ELSE 'B' END AS s FROM placed), f AS (SELECT *, lag(s) OVER (PARTITION BY block ORDER BY i) AS before FROM e), g AS (SELECT *, sum(CASE WHEN s = before THEN 0 ELSE 1 END) OVER (PARTITION BY block ORDER BY i) AS n FROM f) SELECT block, s AS kind, CAST(count(*) AS BIGINT) AS width, CAST(min(pos) + CASE WHEN s = 'I' THEN 1 ELSE 0 END AS BIGINT) AS pos FROM g WHERE s IN ('I', 'D') GROUP BY block, n, s")
def maf_indels(spark, sf_dir):
    """Insertions (before the position) and deletions (from it) of every block."""
    runs = M.column_runs(_aligned(spark, sf_dir)).where("state IN ('I', 'D')")
    return runs.select("block", F.col("state").alias("kind"), F.col("width").cast("long").alias("width"), F.col("r_start").cast("long").alias("pos"))


@query()
def maf_calls(spark, sf_dir):
    """Reference blocks, missing blocks, SNPs and anchored indels of every block by the column walk."""
    return M.call_blocks(_aligned(spark, sf_dir), ["block", "contig"])


@query(f"""WITH {ALN}, b AS (SELECT contig, start0 + 1 AS s, start0 + length(replace(ref, '-', '')) AS e FROM aln), o AS (SELECT *, max(e) OVER (PARTITION BY contig ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM b)
SELECT contig, CAST(coalesce(r, 0) + 1 AS BIGINT) AS g_start, CAST(s - 1 AS BIGINT) AS g_end FROM o WHERE coalesce(r, 0) + 1 <= s - 1 UNION ALL SELECT contig, CAST(max(e) + 1 AS BIGINT), CAST(30000 AS BIGINT) FROM b GROUP BY contig HAVING max(e) < 30000""")
def maf_fill_gaps(spark, sf_dir):
    """What the blocks leave of contigs of 30,000 letters."""
    blocks = aln(spark, sf_dir).select("contig", (F.col("start0") + 1).cast("long").alias("g_start"), (F.col("start0") + F.length(F.replace(F.col("ref"), F.lit("-"), F.lit("")))).cast("long").alias("g_end"))
    sizes = blocks.select("contig").distinct().withColumn("size", F.lit(30_000).cast("long"))
    return M.fill_gaps(blocks, sizes, "contig", "g_start", "g_end")


@query("SELECT start_pos AS pos, CAST(sum(n) AS BIGINT) AS depth FROM (SELECT start_pos, count(*) AS n FROM gene_row WHERE start_pos IS NOT NULL GROUP BY start_pos UNION ALL SELECT end_pos, count(*) FROM gene_row WHERE end_pos IS NOT NULL GROUP BY end_pos) GROUP BY start_pos")
def wiggle_merge(spark, sf_dir):
    """Two per-position tracks added up."""
    rows = table(spark, sf_dir, "gene_row")
    track = lambda c: rows.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("pos")).agg(F.count("*").alias("n"))
    return track("start_pos").unionByName(track("end_pos")).groupBy("pos").agg(F.sum("n").alias("depth"))


# --- mutations ----------------------------------------------------------------------------------------------------------
@query()
def mutate_point(spark, sf_dir):
    return protein(spark, sf_dir).select("seq_id", mutations.point(F.col("seq"), F.col("seq_id"), 10).alias("seq"))


@query()
def mutate_delete(spark, sf_dir):
    return protein(spark, sf_dir).select("seq_id", mutations.delete(F.col("seq"), F.col("seq_id"), 5).alias("seq"))


@query()
def mutate_insert(spark, sf_dir):
    return protein(spark, sf_dir).select("seq_id", mutations.insert(F.col("seq"), F.col("seq_id"), 5).alias("seq"))


@query(f"WITH {ALN} SELECT block, replace(substr(qry, 1, least(length(ref), length(qry))), '-', '') AS seq FROM aln")
def gvcf_sequence(spark, sf_dir):
    """The query sequence of each block, spelled by its calls."""
    return M.rebuilt(M.call_blocks(_aligned(spark, sf_dir), ["block"]), "block")


@query(f"""WITH {_VARS}, r AS (SELECT variant_id, ref_allele AS ref, CASE WHEN starts_with(alts[1], '<') THEN '.' ELSE coalesce(alts[1], '.') END AS alt, len(list_filter(idx, lambda i: i < 0)) > 0 AS missing FROM vars)
SELECT variant_id, CASE WHEN alt = '.' OR alt = ref THEN ref || ',<NON_REF>' WHEN length(ref) - length(alt) > 3 THEN substr(ref, 1, 1) || ',<DEL>,<NON_REF>' ELSE ref || ',' || alt || ',<NON_REF>' END AS alleles,
CASE WHEN missing THEN '.' WHEN alt = '.' OR alt = ref THEN '0' ELSE '1' END AS gt, CAST(CASE WHEN missing THEN 0 ELSE 30 END AS INTEGER) AS dp, CASE WHEN missing THEN '0,0' WHEN alt = '.' OR alt = ref THEN '30,0' ELSE '0,30,0' END AS ad, CASE WHEN alt = '.' OR alt = ref THEN '0,90,90' ELSE '90,90,0' END AS pl FROM r""")
def vcf_rows(spark, sf_dir):
    """Allele, genotype, depth and likelihood text of every record; deletions of more than 3 letters are symbolic."""
    first = F.coalesce(F.get("alts", F.lit(0)), F.lit("."))
    alt = F.when(F.startswith(first, F.lit("<")), ".").otherwise(first)
    missing = F.exists(V.genotype_indices(F.col("genotype")), lambda i: i < 0)
    return _vars(spark, sf_dir).select("variant_id", *[c.alias(n) for n, c in M.variant_columns(F.col("ref_allele"), alt, missing, 3).items()])


@query(f"WITH {_VARS} SELECT sample_name, variant_id, start_pos, end_pos, split_part(genotype, ':', 1) AS gt FROM vars WHERE contig = 'chr1' AND start_pos <= 10000 AND end_pos >= 10000")
def vcf_at_position(spark, sf_dir):
    """Records of every sample that cover chr1:10000."""
    rows = _records(spark, sf_dir).where("contig = 'chr1' AND start_pos <= 10000 AND end_pos >= 10000")
    return rows.select("sample_name", "variant_id", "start_pos", "end_pos", F.substring_index("genotype", ":", 1).alias("gt"))


@query(f"""WITH {_SNPS}, bed AS (SELECT lower(trim(seqid, e' \\t\\r\\n')) AS seqid, start_pos AS s, end_pos AS e FROM gene_row WHERE start_pos <= end_pos AND trim(seqid, e' \\t\\r\\n') <> '')
SELECT variant_id, contig || '_' || min(s * 10000000000 + e) // 10000000000 || '-' || min(s * 10000000000 + e) % 10000000000 AS part FROM snps JOIN bed ON seqid = contig AND s <= start_pos AND e >= start_pos GROUP BY variant_id, contig""")
def vcf_by_range(spark, sf_dir):
    """The first range of genes that holds each SNP, as the name of the part it is written to."""
    from genomespark.plans.views import genes

    ranges = genes(spark, sf_dir).select(F.col("seqid").alias("bed_contig"), "gs", "ge")
    snps = _snps(spark, sf_dir).select("variant_id", F.col("contig").alias("bed_contig"), F.col("start_pos").alias("pos"))
    met = V.covering(snps, ranges, "bed_contig", "pos", "gs", "ge")
    first = met.groupBy("variant_id", "bed_contig").agg(F.min(F.struct("gs", "ge")).alias("r"))
    return first.select("variant_id", F.concat("bed_contig", F.lit("_"), F.col("r.gs").cast("string"), F.lit("-"), F.col("r.ge").cast("string")).alias("part"))


@query("""WITH o AS (SELECT sample_name, contig, variant_id, CASE WHEN lag(contig) OVER w = contig THEN 0 ELSE 1 END AS opens FROM simple_variant WHERE contig IS NOT NULL WINDOW w AS (PARTITION BY sample_name ORDER BY made_at, variant_id)), r AS (SELECT sample_name, contig, sum(opens) AS runs FROM o GROUP BY sample_name, contig)
SELECT sample_name, CAST(count(*) AS BIGINT) AS n_contigs, CAST(sum(runs) AS BIGINT) AS n_runs, CAST(count(*) FILTER (runs > 1) AS BIGINT) AS n_repeated FROM r GROUP BY sample_name""")
def vcf_contig_runs(spark, sf_dir):
    """Runs of contigs of each sample in order of making, and contigs that come more than once."""
    from pyspark.sql import Window

    order = Window.partitionBy("sample_name").orderBy("made_at", "variant_id")
    rows = table(spark, sf_dir, "simple_variant").where("contig IS NOT NULL").withColumn("opens", F.when(F.lag("contig").over(order) == F.col("contig"), 0).otherwise(1))
    runs = rows.groupBy("sample_name", "contig").agg(F.sum("opens").alias("runs"))
    return runs.groupBy("sample_name").agg(F.count("*").alias("n_contigs"), F.sum("runs").alias("n_runs"), F.count_if(F.col("runs") > 1).alias("n_repeated"))


@query(f"""WITH RECURSIVE {ALN}, b AS (SELECT contig, block, start0 + 1 AS s, start0 + length(replace(ref, '-', '')) AS e FROM aln), o AS (SELECT *, row_number() OVER (PARTITION BY contig ORDER BY s, e, block) AS n FROM b),
w AS (SELECT contig, block, n, CAST(e AS BIGINT) AS one, CAST(-1 AS BIGINT) AS two, 1 AS haplotype FROM o WHERE n = 1
  UNION ALL SELECT o.contig, o.block, o.n, CASE WHEN o.s > one THEN o.e ELSE one END, CASE WHEN o.s <= one AND o.s > two THEN o.e ELSE two END, CASE WHEN o.s > one THEN 1 WHEN o.s > two THEN 2 ELSE 0 END FROM w JOIN o ON o.contig = w.contig AND o.n = w.n + 1)
SELECT contig, block, CAST(haplotype AS INTEGER) AS haplotype FROM w""")
def maf_diploid_split(spark, sf_dir):
    """Blocks of each contig dealt to two haplotypes; 0 marks what overlaps both."""
    blocks = aln(spark, sf_dir).select("contig", "block", (F.col("start0") + 1).alias("s"), (F.col("start0") + F.length(F.replace(F.col("ref"), F.lit("-"), F.lit("")))).alias("e"))
    return M.assign_haplotypes(blocks, "contig", "s", "e", "block")


@query()
def maf_fill_haplotypes(spark, sf_dir):
    """Blocks of two haplotypes, each completed from the other; each two neighbouring blocks share a contig of their own, so
    that none is a third alignment."""
    contig = F.concat(F.lit("c"), F.floor(F.col("block") / 2).cast("string"))
    return M.fill_haplotypes(_aligned(spark, sf_dir).withColumn("contig", contig).select("contig", "block", "start0", "ref", "qry"))


@query(f"WITH {_COLS}, c AS (SELECT contig, pos, count(*) FILTER (q <> '-') AS cov, count(*) FILTER (q = r) AS ident FROM placed WHERE r <> '-' AND pos BETWEEN 500 AND 1499 GROUP BY contig, pos) SELECT contig, CAST(count(*) FILTER (cov > 0) AS DOUBLE) / 10 AS percent_cov, CAST(count(*) FILTER (ident > 0) AS DOUBLE) / 10 AS percent_id FROM c GROUP BY contig")
def cov_region_percent(spark, sf_dir):
    """Covered and identical share of positions 500 to 1,499 of each contig."""
    runs = M.column_runs(_aligned(spark, sf_dir)).where("r_end >= 500 AND r_start <= 1499 AND r_start <= r_end")
    inside = cut(runs.withColumn("r_start", F.greatest("r_start", F.lit(500))).withColumn("r_end", F.least("r_end", F.lit(1499))))
    sizes = inside.select("contig").distinct().withColumn("num_region_bps", F.lit(1000))
    return M.coverage_percent(inside, sizes, "contig").select("contig", "percent_cov", "percent_id")
