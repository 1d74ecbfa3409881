"""Alignments, records, positions, feature edits, mutations within ranges, long k-mers and distance matrices."""

import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from genomespark.functions import alphabets, positions
from genomespark.functions import kmers as K
from genomespark.operators import features as G
from genomespark.operators import msa, mutations, ontology, records
from genomespark.plans.sequence_queries import distance_matrices
from tests.helpers import rows


@pytest.fixture(scope="module")
def aln(spark):
    data = [("x", i, f"s{i}", s) for i, s in enumerate(["ACGT-A", "ACGTTA", "TC--TA", "ACGTTG"])] + [("y", 0, "s0", "AC"), (None, 0, "n", "GG")]
    return spark.createDataFrame(data, "aln string, idx int, id string, seq string")


def test_samples(aln):
    got = lambda *a, **k: [(r.aln, r.idx) for r in msa.samples(aln, "aln", "idx", *a, **k).collect()]
    assert got([0, -1, 0]) == [(None, 0), ("x", 0), ("x", 3), ("y", 0)]
    assert got(range(1, 3)) == [("x", 1), ("x", 2)]
    assert got(["s3", "s0"]) == [("x", 0), ("x", 3), ("y", 0)]
    assert got(where=lambda name, i: F.startswith(name, F.lit("s")) & (i > 1)) == [("x", 2), ("x", 3)]
    with pytest.raises(KeyError):
        got(["s9"])
    with pytest.raises(TypeError):
        got(["s0", 1])
    assert msa.display(aln, "aln", "idx", 2).count() == 4
    assert msa.checked(aln, "aln").count() == 6
    with pytest.raises(Exception, match="unlike length"):
        msa.checked(aln.withColumn("aln", F.lit("one")), "aln").collect()


def test_sites(spark):
    df = spark.createDataFrame([("ACGTN",), ("AC",), ("",), (None,)], "seq string")
    s = F.col("seq")
    got = df.select(msa.sites(s, [4, 0, 0, -1]).alias("a"), msa.sites(s, range(1, 3)).alias("b"), msa.sites_where(s, lambda i: i % 2 == 0).alias("c")).collect()
    assert [tuple(r) for r in got] == [("AN", "CG", "AGN"), ("AC", "C", "A"), ("", "", ""), (None, None, None)]


def test_records(spark):
    df = spark.createDataFrame([("r", "n", "d", "ACGTR", {"k": "v"}, "IIIII")], "id string, name string, description string, seq string, annotations map<string,string>, quality string")
    one = records.reverse_complemented(df, id="new").first()
    assert one.asDict() == {"id": "new", "name": "n", "description": "d", "seq": "YACGT", "annotations": {"k": "v"}}
    assert records.complemented(df).first().seq == "TGCAY" and records.shown(df).first().shown == "Id: r\nName: n\nDescription: d\nSequence: ACGTR"


def test_positions(spark):
    df = spark.createDataFrame([("chr1:1,234",), ("a:b:7",), ("chr1",), ("x:0",), (None,)], "t string")
    p = positions.parse_position(F.col("t"))
    assert [r.p and tuple(r.p) for r in df.select(p.alias("p")).collect()] == [("chr1", 1234), ("a:b", 7), None, None, None]
    row = df.limit(1).select(positions.show_position(F.lit("c"), F.lit(12345)).alias("a"), positions.minus(F.lit(3), 9).alias("b"), positions.plus(F.lit(3), 9, F.lit(10)).alias("c"), *[c.alias(n) for n, c in positions.range_text(F.lit(None).cast("string"), F.lit(1), F.lit(2)).items()]).first()
    assert tuple(row) == ("c:12,345", 1, None, "NONE", 1, 2, "1..2")


def test_feature_edits(spark):
    df = G.empty_genome(spark).unionByName(spark.createDataFrame([("c1", "s", "src", "CDS", 5, 9, None, "+", "0", ["m"], None), ("g1", "s", "src", "gene", 1, 20, 1.5, "-", ".", None, None)], G.FEATURE_SCHEMA))
    is_cds = F.col("feature_id") == "c1"
    assert G.set_fields(df, is_cds, start_pos=6, phase="2").where(is_cds).select("start_pos", "phase").first() == (6, "2")
    for bad in ({"start_pos": 10}, {"phase": "."}, {"strand": "x"}):
        with pytest.raises(Exception, match="feature c1"):
            G.set_fields(df, is_cds, **bad).collect()
    more = G.add_discontinuity(df, "c1", 12, 14, "1")
    assert rows(more.where("feature_type = 'CDS'").select("start_pos", "end_pos", "phase")) == [(12, 14, "1"), (5, 9, "0")]
    assert G.remove_discontinuity(more, "c1", 5, 9).count() == 2
    assert [tuple(r) for r in df.select(G.strand_name(F.col("strand")).alias("a"), G.phase_name(F.col("phase")).alias("b")).collect()] == [("PLUS", "ZERO"), ("MINUS", "UNSPECIFIED")]
    assert G.column_names({"gene": df.select("seqid", "strand")}, "gene") == "seqid,strand" and G.column_names({}, "gene") == ""
    edges = spark.createDataFrame([("b", "p", 2), ("a", "p", 9), ("c", "q", 1)], "node string, parent string, v int")
    assert {(r.node, r.place) for r in G.ordered_children(edges, [F.col("v")]).collect()} == {("b", 1), ("a", 2), ("c", 1)}


def test_ontology_from_a_file(spark, tmp_path):
    (tmp_path / "o.obo").write_text(ontology.MINI)
    onto = ontology.read_tables(spark, str(tmp_path / "o.obo"))
    assert onto["types"].count() == ontology.tables(spark)["types"].count()
    assert ontology.contains(onto, "messenger RNA") and not ontology.contains(onto, "coding_sequence")


def test_mutations_within_ranges(spark):
    seqs = [("a", "ACDEFGHIKLMNPQRSTVWY" * 3), ("b", "ACDEFGHIKL"), ("c", ""), ("d", None), ("e", "AC")]
    df = spark.createDataFrame(seqs, "id string, seq string")
    bed = spark.createDataFrame([("a", 11, 15), ("a", 14, 18), ("a", 58, 900), ("b", 1, 3), ("e", 2, 1)], "id string, start_pos int, end_pos int")
    allowed = {"a": {*range(11, 19), *range(58, 61)}, "b": {1, 2, 3}}
    for seed, avoid in product(range(3), (False, True)):
        free = lambda k, n: set(range(1, n + 1)) - allowed.get(k, set()) if avoid else allowed.get(k, set())
        for r in df.withColumnRenamed("seq", "old").withColumn("seq", F.col("old")).transform(lambda d: mutations.mutate(d, "point", 6, seed=seed, ranges=bed, avoid=avoid)).collect():
            if r.old is None:
                assert r.seq is None
                continue
            changed = {i for i, (x, y) in enumerate(zip(r.old, r.seq), 1) if x != y}
            may = free(r.id, len(r.old))
            assert len(r.seq) == len(r.old) and changed <= may and len(changed) == min(6, len(may))
        for r in df.withColumnRenamed("seq", "old").withColumn("seq", F.col("old")).transform(lambda d: mutations.mutate(d, "deletion", 3, seed=seed, ranges=bed, avoid=avoid)).where("old IS NOT NULL").collect():
            may = free(r.id, len(r.old))
            spots = [i for i in range(1, len(r.old) - 1) if {i, i + 1, i + 2} <= may] if len(r.old) > 3 else []
            assert r.seq in {r.old[: i - 1] + r.old[i + 2 :] for i in spots} if spots else r.seq == r.old
        for r in df.withColumnRenamed("seq", "old").withColumn("seq", F.col("old")).transform(lambda d: mutations.mutate(d, "insertion", 4, seed=seed, ranges=bed, avoid=avoid)).where("old IS NOT NULL").collect():
            may = free(r.id, len(r.old))
            assert any(r.seq[: i - 1] + r.seq[i + 3 :] == r.old for i in may) if may else r.seq == r.old


def test_kmers_of_32_letters(spark):
    words = ["A" * 32, "G" * 32, "T" * 16 + "C" * 16, "ACTG" * 8, "G" * 31, "C"]
    df = spark.createDataFrame([(w, len(w)) for w in words], "w string, k int")
    code = K.encode(F.col("w"))
    got = {r.w: r for r in df.select("w", code.alias("c"), K.unsigned_order(code).alias("o"), *[K.decode(code, k).alias(f"d{k}") for k in (1, 31, 32)]).collect()}
    want = {w: int("".join(str("ACTG".index(x)) for x in w), 4) for w in words}
    assert all(r.c % 2**64 == want[w] and r[f"d{len(w)}"] == w for w, r in got.items())
    assert sorted(words, key=lambda w: got[w].o) == sorted(words, key=want.get)


def test_codon_grid():
    grid = alphabets.codon_grid(1)
    assert "ATG M(s)" in grid and "TAA Stop" in grid and len(grid.splitlines()) == 19


def test_distance_matrices_against_brute_force(spark):
    r = random.Random(2)
    data = [(f"i{i}", "".join(r.choices("ACGT", k=r.choice([9, 25, 60])))) for i in range(5)] + [("short", "AC"), ("i0", "ACGTN")]
    k, seqs = 4, {}
    for i, s in data:
        seqs.setdefault(i, []).append(s)
    bags = {i: {} for i in seqs}
    for i, ss in seqs.items():
        for s in ss:
            for a in range(len(s) - k + 1):
                if "N" not in s[a : a + k]:
                    bags[i][s[a : a + k]] = bags[i].get(s[a : a + k], 0) + 1
    near = lambda x, bag: min((sum(p != q for p, q in zip(x, y)) for y in bag), default=9)
    want = {}
    for a, b in product(bags, bags):
        if a != b and bags[a] and bags[b]:
            d = [near(x, bags[b]) for x in bags[a]] + [near(x, bags[a]) for x in bags[b]]
            both = set(bags[a]) & set(bags[b])
            mean = (sum(map(len, seqs[a])) + sum(map(len, seqs[b]))) / 2
            want[a, b] = [v / mean for v in (d.count(1), sum(x > 1 for x in d), 2 * sum(bags[a][x] != bags[b][x] for x in both), sum(abs(bags[a][x] - bags[b][x]) for x in both))]
    got = {(x.id_a, x.id_b): [x.h1, x.h_many, x.copy_count, x.copy_difference] for x in distance_matrices(spark.createDataFrame(data, "id string, seq string"), "id", "seq", k).collect()}
    assert got.keys() == want.keys() and all(got[p] == pytest.approx(want[p]) for p in want)
