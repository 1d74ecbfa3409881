import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from genomespark.functions import alphabets as A
from genomespark.functions import kmers as K
from genomespark.functions import sequences as S
from genomespark.operators import intervals as R
from genomespark.operators import mutations, ontology
from genomespark.operators import variants as V
from genomespark.operators.alignments import call_variants, column_runs, coverage_percent, split_haplotypes
from genomespark.plans.sequence_queries import hamming_counts
from tests.helpers import rows


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).collect()[0].x


def test_codon_tables():
    assert A.codon_map(1)["ATG"] == "M" and len(A.codon_map(1)) == 64
    assert "AGA" in A.codon_map(2) and A.codon_map(2)["AGA"] == "*" and A.codon_map(2)["TGA"] == "W"
    assert A.codon_map(27)["TGA"] == "*" and A.codon_map(28)["TAA"] == "*"
    assert A.table_by_name("SGC4") == 5 and A.starts(6) == ["ATG"]
    assert A.nucleotide_weight("R") == pytest.approx((331.2218 + 347.2212) / 2) and A.nucleotide_weight("-") == -1
    with pytest.raises(KeyError):
        A.codon_map(7)


def test_translate(spark):
    s = F.col("s")
    assert one(spark, S.translate(s), s="GTGGCCATTGTAATGGGCCGCTGAAAGGGTGCCCGATAG") == "VAIVMGR*KGAR*"
    assert one(spark, S.translate(s, to_stop=True), s="GTGGCCATTGTAATGGGCCGCTGAAAGGGTGCCCGATAG") == "VAIVMGR"
    assert one(spark, S.translate(s, cds=True, table=2), s="GTGGCCATTGTAATGGGCCGCTGAAAGGGTGCCCGATAG") == "MAIVMGRWKGAR"
    assert one(spark, S.translate(s), s="AC") == "" and one(spark, S.translate(s, on_ambiguous="X"), s="ACGNNN") == "TX"
    for bad in ("ACGNNN",):
        with pytest.raises(Exception, match="ambiguous"):
            one(spark, S.translate(s), s=bad)
    with pytest.raises(Exception, match="coding"):
        one(spark, S.translate(s, cds=True), s="GGGGGG")


def test_strings(spark):
    s = F.col("s")
    assert one(spark, S.alphabet(s), s="acgu") == "RNA" and one(spark, S.alphabet(s), s="ACGT") == "DNA" and one(spark, S.alphabet(s), s="ACGN-") == "AmbiguousDNA"
    assert one(spark, S.alphabet(s), s="MKV*") == "Protein" and one(spark, S.alphabet(s), s="J!") is None
    assert one(spark, S.reverse_complement(s), s="ACGTMRWSYKVHDBXN-") == "-NXVHDBMRSWYKACGT"
    assert one(spark, S.slice_(s, -3, -1), s="ACGTT") == "GTT" and one(spark, S.slice_(s, 3, 1), s="ACGTT") is None
    assert one(spark, S.index_of(s, "GT", 3), s="GTAGT") == 3 and one(spark, S.last_index_of(s, "X"), s="AC") == -1 and one(spark, S.last_index_of(s, "GT"), s="GTAGT") == 3
    assert one(spark, S.count_overlap(s, "AA"), s="AAAA") == 3 and one(spark, S.count(s, "AA"), s="AAAAA") == 2
    assert one(spark, S.runs(s), s="NNACNG") == ["NN", "AC", "N", "G"] and len(one(spark, S.display(s), s="A" * 80)) == 60
    assert len(one(spark, S.random_sequence(F.col("s"), 30), s="7")) == 30 and one(spark, S.random_sequence(F.col("s"), 0), s="7") == ""
    assert one(spark, S.gc(s), s=None) is None


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(st.sampled_from("ACGTN"), max_size=60), min_size=1, max_size=20), st.integers(1, 6), st.integers(1, 3))
def test_windows_against_brute_force(spark, seqs, k, step):
    df = spark.createDataFrame([(s,) for s in seqs], "s string")
    got = sorted(r.kmer for r in K.windows(df, "s", k, step, piece=7).collect())
    assert got == sorted(t[i : i + k] for s in seqs for t in [s[::step]] for i in range(len(t) - k + 1) if set(t[i : i + k]) <= set("ACGT"))
    bad = [r.x for r in df.select(K.ambiguous(F.col("s"), k, keep_min_only=True).alias("x")).collect()]
    want = [sum(c == "N" or i >= k - 1 and "N" in s[i - k + 1 : i + 1] for i, c in enumerate(s)) for s in seqs]
    assert bad == want


def counts(spark, s, both):
    df = K.windows(spark.createDataFrame([(s,)], "s string"), "s", 5).select("kmer")
    if both:
        df = df.unionByName(df.select(S.reverse_complement(F.col("kmer")).alias("kmer")))
    return df.groupBy("kmer").agg(F.count("*").alias("n"))


def test_hamming_counts_published_values(spark):
    a, b = "CACCACATATATATAGGGG", "CACGACATATATATATATA"
    assert tuple(hamming_counts(counts(spark, a, True), counts(spark, b, True), 5).collect()[0]) == (20, 4, 4, 8)
    rc = a[::-1].translate(str.maketrans("ACGT", "TGCA"))
    assert tuple(hamming_counts(counts(spark, rc, False), counts(spark, b, False), 5).collect()[0]) == (6, 10, 4, 4)


def test_kmer_codes(spark):
    assert one(spark, K.encode(F.col("s")), s="ACTG") == 0b00011011
    assert one(spark, K.decode(K.encode(F.col("s")), 5), s="AACTG") == "AACTG"
    assert one(spark, K.hamming(K.encode(F.col("s")), K.encode(F.col("t"))), s="ACGTT", t="ACCTA") == 2
    assert one(spark, K.canonical(F.col("s")), s="GG") == "CC" and one(spark, K.canonical(F.col("s")), s="TA") == "TA"


def ranges(spark, *pairs, name="r"):
    return spark.createDataFrame([(name, a, b) for a, b in pairs], "seqid string, start int, end int")


def test_interval_algebra_published_values(spark):
    six = ranges(spark, (3, 13), (25, 35), (50, 60), (80, 87), (119, 122), (147, 175))
    bounds = ranges(spark, (1, 183))
    assert [r[1:] for r in rows(R.complement(bounds, six, "seqid", "start", "end").orderBy("start"))] == [(1, 2), (123, 146), (14, 24), (176, 183), (36, 49), (61, 79), (88, 118)]
    a, b = ranges(spark, (1, 20), (30, 40), (60, 79), (100, 120)), ranges(spark, (15, 25), (45, 50), (58, 65), (150, 170))
    assert [r[1:] for r in rows(R.intersections(a, b, "seqid", "start", "end", width=8))] == [(15, 20), (60, 65)]
    assert [r[1:] for r in rows(R.merge(ranges(spark, (1, 5), (6, 9), (9, 12)), ["seqid"], "start", "end"))] == [(1, 5, 1), (6, 12, 2)]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["x", "y", None]), st.integers(1, 60), st.integers(0, 25)), max_size=15), st.lists(st.tuples(st.sampled_from(["x", "y", None]), st.integers(1, 60), st.integers(0, 25)), max_size=15))
def test_interval_joins_against_brute_force(spark, a, b):
    a = [(i, q, s, s + n) for i, (q, s, n) in enumerate(a)]
    b = [(q, s, s + n) for q, s, n in b]
    left = spark.createDataFrame(a, "id int, seqid string, start int, end int")
    right = spark.createDataFrame(b, "seqid string, start int, end int")
    hit = lambda x, y: x[1] == y[0] and x[2] <= y[2] and x[3] >= y[1]
    pairs = R.overlap_join(left, right.toDF("q", "s", "e"), ("seqid", "q"), ("start", "end"), ("s", "e"), width=16)
    assert sorted(r.id for r in pairs.collect()) == sorted(x[0] for x in a for y in b if hit(x, y))
    semi = {r.id for r in R.semi_overlap(left, right, "seqid", "start", "end", width=16).collect()}
    anti = {r.id for r in R.semi_overlap(left, right, "seqid", "start", "end", width=16, anti=True).collect()}
    assert semi == {x[0] for x in a if any(hit(x, y) for y in b)} and anti == {x[0] for x in a} - semi
    rest = {(i, p) for i, _, s, e in rows(R.subtract(left.where("seqid IS NOT NULL"), right, "id", "seqid", "start", "end", width=16)) for p in range(s, e + 1)}
    assert rest == {(i, p) for i, q, s, e in a if q for p in range(s, e + 1) if not any(y[0] == q and y[1] <= p <= y[2] for y in b)}


def test_natural_order(spark):
    df = spark.createDataFrame([(x,) for x in ["chr10", "chr2", "chr1", "scaf_3", "9"]], "c string")
    assert [r.c for r in df.orderBy(R.natural_key(F.col("c"))).collect()] == ["9", "chr1", "chr2", "chr10", "scaf_3"]
    assert [r.c for r in R.custom_order(df, "c", ["scaf_3", "9"]).collect()][:2] == ["scaf_3", "9"]


def test_alignment_calls():
    text = lambda calls: [(c.start, c.end, c.ref, c.alt, c.kind) for c in calls]
    assert text(call_variants("ACGT", "ACTT", 0)) == [(1, 2, "AC", "AC", "ref"), (3, 3, "G", "T", "variant"), (4, 4, "T", "T", "ref")]
    assert text(call_variants("AC--GT", "ACTTGT", 4)) == [(5, 5, "A", "A", "ref"), (6, 6, "C", "CTT", "variant"), (7, 8, "GT", "GT", "ref")]
    assert text(call_variants("ACGGT", "AC--T", 0)) == [(1, 1, "A", "A", "ref"), (2, 4, "CGG", "C", "variant"), (5, 5, "T", "T", "ref")]
    assert text(call_variants("--AC", "GGAC", 0)) == [(1, 1, "A", "GGA", "variant"), (2, 2, "C", "C", "ref")]
    assert text(call_variants("ACNT", "NNNT", 0)) == [(1, 2, "AC", "NN", "missing"), (3, 4, "NT", "NT", "ref")]
    assert [(c.asm_start, c.asm_end) for c in call_variants("ACG", "ATG", 0, 2, "-", 10)] == [(8, 8), (7, 7), (6, 6)]
    assert split_haplotypes([(1, 5), (3, 8), (6, 9), (9, 12)]) == [1, 2, 1, 2]
    with pytest.raises(ValueError):
        split_haplotypes([(1, 9), (2, 8), (3, 7)])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ACGT-"), st.sampled_from("ACGTN-")), min_size=1, max_size=30))
def test_calls_rebuild_both_sequences(columns):
    ref, alt = "".join(r for r, _ in columns), "".join(a for _, a in columns)
    if ref.strip("-") and alt.strip("-"):
        calls = call_variants(ref, alt, 0)
        assert "".join(c.ref for c in calls) == ref.replace("-", "") and "".join(c.alt for c in calls) == alt.replace("-", "")


def test_coverage(spark):
    df = spark.createDataFrame([(1, "c", 0, "ACG-T", "A-GTA"), (2, "c", 2, "GT", "GT")], "block int, contig string, start0 int, ref string, qry string")
    sizes = spark.createDataFrame([("c", 10)], "contig string, num_region_bps long")
    assert rows(coverage_percent(column_runs(df), sizes, "contig")) == [("c", 10, 30.0, 30.0)]


def test_variants_and_files(spark):
    df = spark.createDataFrame([("A", ["C", "G", "T"], "0|3:9"), ("A", ["AT"], "1/1"), ("AC", ["A"], "./."), ("A", ["<NON_REF>"], "0")], "ref string, alts array<string>, gt string")
    kinds = V.classify(F.col("ref"), F.col("alts"), F.col("gt"))
    assert [tuple(r) for r in df.select(*[kinds[k].alias(k) for k in ("is_ref_block", "is_snp", "is_ins", "is_del")]).collect()] == [(False, True, False, False), (False, False, True, False), (False, False, False, True), (True, False, False, False)]
    alts, gt = V.reindexed(F.col("alts"), F.col("gt"))
    assert [tuple(r) for r in df.select(alts.alias("a"), gt.alias("g")).collect()] == [(["T"], "0|1"), (["AT"], "1/1"), ([], "./."), ([], "0")]
    assert V.valid_files({"a": ["1", "2", "3"], "b": ["1", "3"]}) == {"a": True, "b": True}
    assert V.valid_files({"a": ["1", "2", "1"]}) == {"a": False}


def test_mutations(spark):
    df = spark.createDataFrame([(i, "ACDEFGHIKL" * i) for i in range(0, 9)], "id int, s string")
    got = df.select("s", mutations.point(F.col("s"), F.col("id"), 5).alias("p"), mutations.delete(F.col("s"), F.col("id"), 3).alias("d"), mutations.insert(F.col("s"), F.col("id"), 4).alias("i")).collect()
    for r in got:
        assert len(r.p) == len(r.s) and sum(x != y for x, y in zip(r.p, r.s)) == (5 if r.s else 0)
        assert len(r.i) == len(r.s) + 4 and len(r.d) == (len(r.s) - 3 if len(r.s) > 3 else len(r.s))


def test_ontology(spark):
    onto = ontology.tables(spark)
    part = set(rows(ontology.part_of(onto)))
    assert ("SO:0000316", "SO:0000704") in part and ("SO:0000704", "SO:0000316") not in part


def test_tree_edits(spark):
    from genomespark.operators import features as G

    nodes = spark.createDataFrame([("a",), ("b",)], "node string")
    edges = spark.createDataFrame([("b", "a")], "node string, parent string")
    new = spark.createDataFrame([("c", "b"), ("d", "c"), ("e", None)], "node string, parent string")
    n, e = G.insert_features(nodes, edges, new)
    assert rows(n) == [(x,) for x in "abcde"] and rows(e) == [("b", "a"), ("c", "b"), ("d", "c")]
    with pytest.raises(Exception, match="id exists"):
        G.insert_features(nodes, edges, spark.createDataFrame([("a", None)], "node string, parent string"))[0].collect()
    m = spark.createDataFrame([({"x": ["1"]}, ["p", "q"])], "m map<string,array<string>>, ps array<string>")
    got = m.select(G.add_attribute(F.col("m"), "x", F.lit("2")).alias("a"), G.set_attribute(F.col("m"), "y", ["3"]).alias("s"), G.clear_attribute(F.col("m"), "x").alias("c"), G.resolve_parents(F.col("ps")).alias("l"), G.resolve_parents(F.col("ps"), "right").alias("r")).collect()[0]
    assert (got.a, got.s, got.c, got.l, got.r) == ({"x": ["1", "2"]}, {"x": ["1"], "y": ["3"]}, {}, "p", "q")


def test_ontology_edits(spark):
    onto = ontology.define(ontology.tables(spark), "X:1", "toy", is_a_of="SO:0000704", synonyms=("plaything",))
    assert ("X:1", "SO:0000001") in {r[:2] for r in rows(ontology.is_a(onto))}
    assert any("X:1" in r.line for r in ontology.graph_text(onto).collect())
    for bad in (("X:2", "gene", None), ("X:3", "x", "lost"), ("X:4", "self", "X:4")):
        with pytest.raises(ValueError):
            ontology.define(onto, bad[0], bad[1], is_a_of=bad[2])


def test_names():
    from genomespark.sources import text as T

    assert T.two_names("a.g.vcf") == ("a_1.g.vcf", "a_2.g.vcf") and T.two_names("x, y") == ("x", "y") and T.two_names("z") == ("z_1", "z_2")
    assert T.contig_headers([("c", 5)]) == ["##contig=<ID=c,length=5>"] and T.VCF_HEADERS[0].startswith("##fileformat")


def test_haplotypes(spark):
    from genomespark.operators.alignments import fill_haplotypes, sub_block

    assert sub_block("AC--GT", "ACTTG-", 4, 6, 7) == ("C--G", "CTTG", 5)
    assert sub_block("AC--GT", "ACTTG-", 4, 5, 6) == ("AC", "AC", 4)
    data = [("c", 1, 0, "ACGTAC", "ACGTAC"), ("c", 2, 4, "ACGG", "AC-G"), ("c", 3, 20, "TT", "TA")]
    df = spark.createDataFrame(data, "contig string, block int, start0 int, ref string, qry string")
    got = {(r.haplotype, r.block, r.start0, r.ref, r.qry) for r in fill_haplotypes(df).collect()}
    assert got == {(1, 1, 0, "ACGTAC", "ACGTAC"), (1, 3, 20, "TT", "TA"), (1, 2, 6, "GG", "-G"), (2, 2, 4, "ACGG", "AC-G"), (2, 1, 0, "ACGT", "ACGT"), (2, 3, 20, "TT", "TA")}
