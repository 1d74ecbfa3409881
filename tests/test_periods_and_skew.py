import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from genomespark.operators.alignments import fill_gaps
from genomespark.operators.intervals import complement, depth, merge
from genomespark.operators.periods import Spans, merge_tree, periods
from genomespark.operators.skew import dominant_keys, heavy_counts, heavy_keys, join_skewed, profile_by_key
from tests.helpers import rows


def brute(data):
    out = []
    groups = {}
    for k, s, e in data:
        if k is not None and s is not None and e is not None and s <= e:
            groups.setdefault(k, []).append((s, e))
    for k, v in groups.items():
        done = []
        for s, e in sorted(v):
            if done and s <= done[-1][1]:
                done[-1][1] = max(done[-1][1], e)
            else:
                if done and s > done[-1][1] + 1:
                    out.append((k, "gap", done[-1][1] + 1, s - 1))
                done.append([s, e])
        out += [(k, "covered", s, e) for s, e in done]
    return sorted(out)


@pytest.mark.parametrize("size", [10**6, 700, 40])
def test_periods_with_a_heavy_group(spark, size):
    r = random.Random(7)
    data = [("hot" if r.random() < 0.6 else f"k{r.randrange(30)}", s := r.randrange(1, 30_000), s + r.choice([0, 1, 5, 40, -3, 300])) for _ in range(1500)]
    data += [("hot", 500, 2900), ("hot", 20_000, 24_000)] * 2 + [(None, 1, 2), ("k1", None, 4), ("k1", 4, None), ("t", 1, 5), ("t", 6, 9), ("t", 11, 11)]
    df = spark.createDataFrame(data, "k string, start_pos int, end_pos int").withColumn("_chunk", F.lit("x"))
    assert sorted(rows(periods(df, ["k"], rows=size))) == brute(data)
    assert periods(df.limit(0), ["k"]).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_one_entity_over_many_nodes(spark, seed):
    """Nine rows of ten belong to one entity, with long intervals that reach over whole nodes."""
    r = random.Random(seed)
    data = [("hot" if r.random() < 0.9 else "cold", s := r.randrange(1, 20_000), s + r.choice([0, 2, 3, 900 * (r.random() < 0.05)])) for _ in range(800)]
    df = spark.createDataFrame(data, "k string, start_pos int, end_pos int")
    assert sorted(rows(periods(df, ["k"], rows=25))) == brute(data)


def test_spans_merge_in_a_tree():
    r = random.Random(3)
    data = [(r.randrange(3), s := r.randrange(200), s + r.randrange(6)) for _ in range(120)]
    lists = [Spans.of(*[np.array(x) for x in zip(*data[i : i + 7])]) for i in range(0, len(data), 7)]
    whole = merge_tree(iter(lists))
    got = [(f"e{e}", "covered", int(a % 2**33), int(b % 2**33)) for e, a, b in zip(whole.entity(), whole.start, whole.end)]
    gaps = whole.gaps()
    got += [(f"e{e}", "gap", int(a % 2**33), int(b % 2**33)) for e, a, b in zip(gaps.entity(), gaps.start, gaps.end)]
    assert sorted(got) == brute([(f"e{e}", a, b) for e, a, b in data])
    assert merge_tree(iter([])) is None


@pytest.mark.parametrize("size", [10**6, 30])
def test_interval_operators_do_not_hang_on_one_seqid(spark, size):
    r = random.Random(11)
    data = [(r.choice(["hot"] * 9 + [None]), s := r.randrange(1, 4000), s + r.choice([0, 3, 9, -2, 200])) for _ in range(600)]
    df = spark.createDataFrame(data, "seqid string, s int, e int")
    covered = {}
    for q, a, b in data:
        for x in range(a, b + 1):
            covered[q, x] = covered.get((q, x), 0) + 1
    deep = {(row.seqid, x): row.depth for row in depth(df, ["seqid"], "s", "e", size).collect() for x in range(row.s, row.e + 1)}
    assert deep == covered
    for within in (0, 1, 20):
        islands = []
        for q, a, b in sorted((x for x in data if x[1] <= x[2]), key=lambda x: (x[0] or "", *x[1:])):
            if islands and islands[-1][0] == q and a <= islands[-1][2] + within:
                islands[-1][2:] = [max(islands[-1][2], b), islands[-1][3] + 1]
            else:
                islands.append([q, a, b, 1])
        assert rows(merge(df, ["seqid"], "s", "e", within, size)) == rows(spark.createDataFrame(islands, "seqid string, s int, e int, n long"))
    bounds = spark.createDataFrame([("hot", 100, 3000), (None, 1, 4300), ("bare", 5, 9)], "seqid string, s int, e int")
    left = {(row.seqid, x) for row in complement(bounds, df, "seqid", "s", "e", size).collect() for x in range(row.s, row.e + 1)}
    assert left == {(q, x) for q, a, b in (("hot", 100, 3000), (None, 1, 4300), ("bare", 5, 9)) for x in range(a, b + 1) if (q, x) not in covered}
    sizes = spark.createDataFrame([("hot", 9000)], "seqid string, size int")
    filled = {x for row in fill_gaps(df.where("seqid = 'hot' AND s <= e"), sizes, "seqid", "s", "e", size).collect() for x in range(row.s, row.e + 1)}
    assert filled == {x for x in range(1, 9001) if ("hot", x) not in covered}


def test_heavy_keys_and_profiles(spark):
    data = [("hot", i % 700) for i in range(3000)] + [(f"k{i % 400}", i) for i in range(2000)] + [(None, 1)] * 50
    df = spark.createDataFrame(data, "key string, v int").withColumn("__h1", F.xxhash64("v")).withColumn("n_rows", F.lit(1))
    assert rows(heavy_keys(df, "key", 0.05)) == [("hot",)]
    got = {r.key: (r.n_rows, r.total) for r in profile_by_key(df, "key", ["__h1"], {"total": (F.col("v").cast("long"), "sum")}).collect()}
    want = {}
    for k, v in set(data):
        if k is not None:
            n, t = want.get(k, (0, 0))
            want[k] = (n + 1, t + v)
    assert got == want
    counts = spark.createDataFrame([("a", 5), ("b", 95)], "key string, n_rows long")
    assert rows(dominant_keys(counts, "key", 0.05)) == [("a",), ("b",)]
    empty = df.limit(0)
    assert heavy_keys(empty, "key", 0.05).count() == 0 and profile_by_key(empty, "key", ["__h1"], {}).count() == 0
    for n in (100, 999):  # the heavy key in many parts
        assert {r.key: (r.n_rows, r.total) for r in profile_by_key(df, "key", ["__h1"], {"total": (F.col("v").cast("long"), "sum")}, n).collect()} == want
    small = spark.createDataFrame([("hot", "x"), ("k3", "y")], "key string, w string")
    assert join_skewed(df.select("key", "v"), small, "key").count() == df.join(small, "key").count()
    spread = join_skewed(df.select("key", "v"), small, "key", rows=100)
    assert rows(spread.select("key", "v", "w")) == rows(df.join(small, "key").select("key", "v", "w"))


def test_a_heavy_key_is_cut_into_parts(spark):
    df = spark.range(4000).select(F.when(F.col("id") % 4 > 0, "hot").otherwise(F.col("id").cast("string")).alias("key"), F.xxhash64("id").alias("__h1"))
    assert {r.key: r.n_rows for r in heavy_counts(df, "key", 500).collect()} == {"hot": 3000}
    plan = profile_by_key(df, "key", ["__h1"], {}, 500)
    assert {r.key: r.n_rows for r in plan.collect()}["hot"] == 3000 and plan.count() == 1001
