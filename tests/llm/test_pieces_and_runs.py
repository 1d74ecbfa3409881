import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from genomespark.llm import pieces as P
from genomespark.llm.runs import collapse_runs, is_ref_block
from tests.helpers import rows


def brute_pieces(seq):
    s = "".join(seq.split())
    ends = [i for i in range(10, len(s) + 1) if set(s[i - 10 : i].upper()) <= {"N", "X"} and (i == len(s) or s[i].upper() not in "NX")]
    out, start = [], 1
    while len(s) - start + 1 > 2000:
        fit = [e for e in ends if 200 <= e - start + 1 <= 2000]
        out.append((start, fit[-1] if fit else start + 1999))
        start = out[-1][1] - 99
    return [*out, (start, len(s))]


def made(r, n):
    out = ""
    while len(out) < n:
        out += "".join(r.choices("ACGTacgt\n", k=r.randrange(1, 900))) + r.choice(["N", "n", "X", "nX"]) * r.randrange(0, 30)
    return out


def test_against_brute_force(spark):
    r = random.Random(3)
    t = datetime(2024, 1, 1)
    data = [(i, f"c{i}", made(r, r.choice([100, 1999, 2500, 9000, 60_000])), t) for i in range(30)]
    data += [(100, "c3", data[3][2], t + timedelta(1)), (101, "n", None, t), (102, "e", "", t), (103, None, "A" * 5000, t), (104, "c5", None, t + timedelta(9)), (105, "exact", "A" * 2000, t), (106, "one", "A" * 2001, t)]
    df = spark.createDataFrame(data, "rec_key long, record_id string, seq string, loaded_at timestamp").withColumn("piece_no", F.lit("x"))
    got, silent = P.split_records(df, "record_id", "seq", ["loaded_at", "rec_key"])
    want = [(i, k + 1, a, b) for i, s in {d[1]: d[2] for d in data if d[1] and d[2]}.items() if len("".join(s.split())) > 2000 for k, (a, b) in enumerate(brute_pieces(s))]
    assert sorted(rows(got)) == sorted(want)
    assert rows(silent) == [("n",)]
    assert P.split_records(df.limit(0), "record_id", "seq", ["loaded_at", "rec_key"])[0].count() == 0


def test_pieces_of_lengths(spark):
    df = spark.createDataFrame([("a", 2000), ("b", 2001), ("c", 3900), ("d", 3901), ("e", None), ("f", 123_456)], "k string, n int")
    got = {}
    for k, _, a, b in sorted(rows(P.pieces_of_lengths(df, "k", "n"))):
        got.setdefault(k, []).append((a, b))
    assert got == {k: P.forward_pieces(n, []) for k, n in (("b", 2001), ("c", 3900), ("d", 3901), ("f", 123_456))}


@pytest.mark.parametrize("n", [1, 2000, 2001, 7777, 300_000])
def test_bisection_covers_and_overlaps(n):
    r = random.Random(n)
    ends = sorted(r.sample(range(1, n + 1), min(n, 40)))
    out = P.bisect_pieces(n, ends)
    assert out[0][0] == 1 and out[-1][1] == n and all(b - a + 1 <= 2000 for a, b in out)
    assert all(x[1] - y[0] + 1 == 100 for x, y in zip(out, out[1:]))


def brute_runs(data):
    out = []
    for key in {d[:2] for d in data if d[0] is not None and d[1] is not None}:
        run = None
        for _, _, s, e, _, m in sorted((d for d in data if d[:2] == key and d[2] is not None), key=lambda d: d[2:5]):
            if m and run and s - run[1] - 1 <= 10:
                run = [run[0], max(run[1], e), run[2] + 1]
            else:
                if run and run[2] > 1:
                    out.append((*key, *run))
                run = [s, e, 1] if m else None
        if run and run[2] > 1:
            out.append((*key, *run))
    return sorted(out)


@pytest.mark.parametrize("seed, size", [(0, 10**6), (1, 300), (2, 25)])
def test_runs_with_heavy_groups(spark, seed, size):
    r = random.Random(seed)
    data = []
    for i in range(2500):
        key = ("hot", "c") if r.random() < 0.5 else (f"s{r.randrange(9)}", r.choice(["c", "d", None]))
        s = r.randrange(1, 40_000)
        data.append((*key, s, s + r.choice([0, 3, 9, 30, 200, 900]), i, r.random() < 0.9))
    # a long streak over whole chunks, under one block that reaches over all of it, and runs that open at one place
    data += [("long", "c", 1, 90_000, 10_000, True), *[("long", "c", 50 + 40 * i, 60 + 40 * i, 10_001 + i, True) for i in range(120)]]
    data += [("tie", "c", 5, 5, 20_000, True), ("tie", "c", 5, 6, 20_001, True), ("tie", "c", 5, 7, 20_002, False), ("tie", "c", 5, 8, 20_003, True), ("tie", "c", 6, 8, 20_004, True)]
    data.append(("hot", "c", None, 5, 9999, True))
    df = spark.createDataFrame(data, "a string, b string, start_pos int, end_pos int, vid int, m boolean").withColumn("_chunk", F.lit(1))
    got = collapse_runs(df, ["a", "b"], "start_pos", "end_pos", "vid", F.col("m"), 10, rows=size)
    assert sorted(rows(got)) == brute_runs(data)
    assert collapse_runs(df.limit(0), ["a", "b"], "start_pos", "end_pos", "vid", F.col("m"), 10).count() == 0


def test_ref_block(spark):
    data = [(True, "1/1", True), (False, "0/0", False), (None, "0/0:3", True), (None, "0", True), (None, "0|0/0", True), (None, "./0", False), (None, None, False), (None, "0/1", False), (None, "", False)]
    df = spark.createDataFrame(data, "f boolean, g string, want boolean")
    assert df.where(is_ref_block("f", "g") != F.col("want")).count() == 0
