import random

import pytest

from genomespark.operators.hierarchy import descendants, expand_hierarchy, links
from tests.helpers import rows


def brute(data):
    def name(x):
        x = (x or "").strip()
        for p in ("gene:", "transcript:", "CDS:"):
            if x.startswith(p):
                x = x[len(p) :].strip()
                break
        return x or None

    up = {}
    for i, ps in data:
        if name(i):
            up.setdefault(name(i), set()).update(name(p) for p in ps or [])
    up = {n: {p for p in ps if p in up} for n, ps in up.items()}

    def above(n):
        seen, todo = {}, [(p, 1) for p in up[n]]
        while todo:
            p, d = todo.pop(0)
            if p not in seen:
                seen[p] = d
                todo += [(q, d + 1) for q in up[p]]
        return seen

    anc = {n: above(n) for n in up}
    circle = {n for n in up if n in anc[n]}
    found, pairs = [], []
    for n in up:
        if n in circle:
            found.append((n, "#cycle", -1))
        elif circle & set(anc[n]):
            found.append((n, "#below_cycle", -1))
        else:
            found += [(r, q, d) for r, q, d in [(n, a, d) for a, d in ({n: 0} | anc[n]).items()] if not up[q]]
        pairs += [(a, n, d) for a, d in anc[n].items() if a != n]
    return found, pairs


@pytest.mark.parametrize("seed", range(4))
def test_random_graphs(spark, seed):
    r = random.Random(seed)
    names = [f"n{i}" for i in range(60)]
    data = []
    for i, n in enumerate(names):
        ps = [r.choice(names[: max(1, i // 2)]) for _ in range(r.choice([0, 1, 1, 1, 2]))]
        if r.random() < 0.08:
            ps.append(r.choice(names))
        data.append((r.choice([n, f" {n}", f"gene:{n}", f"transcript:{n} "]), r.choice([ps, [*ps, None, "", "lost"]])))
    data += [(None, ["n1"]), ("", ["n2"]), data[3]]
    df = spark.createDataFrame(data, "feature_id string, parents array<string>").withColumnRenamed("x", "node")
    nodes, edges = links(df, "feature_id", "parents")
    found, pairs = brute(data)
    assert rows(expand_hierarchy(nodes, edges)) == sorted(found, key=str) or sorted(rows(expand_hierarchy(nodes, edges))) == sorted(found)
    assert sorted(rows(descendants(nodes, edges))) == sorted(pairs)


def test_two_circles_joined_by_a_way_and_a_long_chain(spark):
    data = [("a", ["b"]), ("b", ["a"]), ("m", ["a"]), ("c", ["d", "m"]), ("d", ["c"]), ("s", ["s"]), ("z", ["d", "k0"])]
    data += [("k0", [])] + [(f"k{i}", [f"k{i - 1}"]) for i in range(1, 37)]
    nodes, edges = links(spark.createDataFrame(data, "feature_id string, parents array<string>"), "feature_id", "parents")
    got = {r.node: (r.root, r.depth) for r in expand_hierarchy(nodes, edges).collect()}
    assert {n for n, (x, _) in got.items() if x == "#cycle"} == {"a", "b", "c", "d", "s"}
    assert {n for n, (x, _) in got.items() if x == "#below_cycle"} == {"m", "z"}
    assert got["k36"] == ("k0", 36)
    path = expand_hierarchy(nodes, edges, with_path=True).where("node = 'k3'").collect()[0].path
    assert path == ["k0", "k1", "k2", "k3"]


def test_empty(spark):
    nodes, edges = links(spark.createDataFrame([], "feature_id string, parents array<string>"), "feature_id", "parents")
    assert expand_hierarchy(nodes, edges).count() == 0


def test_rows_are_linear_below_a_circle(spark):
    """A circle of two with a long chain below it, and a leaf on each node of the chain: no state of all pairs."""
    from genomespark.operators.hierarchy import double

    n = 150
    data = [("a", ["b"]), ("b", ["a"]), ("c0", ["a"]), *[(f"c{i}", [f"c{i - 1}"]) for i in range(1, n)], *[(f"l{i}", [f"c{i}"]) for i in range(n)]]
    nodes, edges = links(spark.createDataFrame(data, "feature_id string, parents array<string>"), "feature_id", "parents")
    settled, pointers, still, _ = double(nodes, edges)
    assert still == 2 * n + 2 and settled.count() == 0 and pointers.count() == 2 * n + 2
    got = expand_hierarchy(nodes, edges).groupBy("root").count().collect()
    assert {r.root: r["count"] for r in got} == {"#cycle": 2, "#below_cycle": 2 * n}


def test_hot_parents_are_cut_into_parts(spark, monkeypatch):
    from genomespark.operators import hierarchy
    from genomespark.operators.skew import join_skewed

    monkeypatch.setattr(hierarchy, "join_skewed", lambda left, right, key, size=None: join_skewed(left, right, key, size, rows=50))
    data = [("top", None), ("mid", ["top"]), *[(f"n{i}", ["mid"]) for i in range(400)], *[(f"m{i}", [f"n{i}"]) for i in range(40)]]
    nodes, edges = links(spark.createDataFrame(data, "feature_id string, parents array<string>"), "feature_id", "parents")
    got = sorted(rows(expand_hierarchy(nodes, edges)))
    assert got == sorted([("top", "top", 0), ("mid", "top", 1), *[(f"n{i}", "top", 2) for i in range(400)], *[(f"m{i}", "top", 3) for i in range(40)]])
