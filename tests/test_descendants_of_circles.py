import random

from genomespark.operators.features import delete_subtrees
from genomespark.operators.hierarchy import descendants, links
from tests.helpers import rows


def reachable(data):
    """(ancestor, node, links) by breadth-first search, circles included."""
    down, out = {}, []
    for n, ps in data:
        for p in ps:
            down.setdefault(p, set()).add(n)
    for a in down:
        seen, todo = {a: 0}, [a]
        for x in todo:
            new = sorted(down.get(x, set()) - set(seen))
            seen.update(dict.fromkeys(new, seen[x] + 1))
            todo += new
        out += [(a, n, d) for n, d in seen.items() if n != a]
    return sorted(out)


def test_circles_hide_no_descendants(spark):
    # root > x > y > x is a circle below a sound root; z hangs below it
    data = [("root", []), ("x", ["root", "y"]), ("y", ["x"]), ("z", ["y", "z"]), ("other", ["root"])]
    nodes, edges = links(spark.createDataFrame(data, "feature_id string, parents array<string>"), "feature_id", "parents")
    pairs = descendants(nodes, edges)
    assert sorted(rows(pairs)) == reachable(data)
    assert ("root", "z", 3) in rows(pairs)
    doomed = spark.createDataFrame([("x",)], "node string")
    assert rows(delete_subtrees(edges, doomed)) == [("other", "root")]


def test_random_links(spark):
    r = random.Random(5)
    names = [f"n{i}" for i in range(40)]
    data = [(n, r.sample(names, r.choice([0, 1, 1, 2]))) for n in names]
    nodes, edges = links(spark.createDataFrame(data, "feature_id string, parents array<string>"), "feature_id", "parents")
    assert sorted(rows(descendants(nodes, edges))) == reachable(data)
