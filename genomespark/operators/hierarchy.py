"""Parent-child links to full hierarchies by pointer doubling.

Every node holds pointers to the ancestors that lie exactly ``2^k`` links above it.  One join of the pointers with
themselves doubles the distance, so a hierarchy of depth ``d`` takes ``log2(d)`` rounds.  What reaches a root on the way
is written down once and met by later pointers, but never worked again.  The nodes that still hold a pointer after round
``k`` are those with an upward walk of ``2^k`` links.  A longest walk of finite length shortens by exactly one at each
step, so when a round settles no further node, every node left has a circle above it and the rounds end.  In the same way
the places pointed at are the nodes with a downward walk of ``2^k`` links; when they become no fewer, they are the circles
and the ways between circles.

A node with one parent holds one pointer in each round, so the rows of a round are linear in the links.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genomespark.operators.skew import join_skewed
from genomespark.runtime import clean, counted_cut, cut

CYCLE, BELOW_CYCLE = "#cycle", "#below_cycle"


def feature_name(c: Column | str) -> Column:
    """An id without surrounding white space and without a leading ``gene:``, ``transcript:`` or ``CDS:``."""
    return clean(F.regexp_replace(clean(c), r"^(?:gene|transcript|CDS):", ""))


def links(df: DataFrame, node: str, parents: str, name=feature_name) -> tuple[DataFrame, DataFrame]:
    """Distinct nodes (node), and distinct links (node, parent) between nodes that exist.

    Null and empty ids are no nodes; null, empty and repeated parent entries, and parents that are no nodes, are
    ignored.  A node that names itself keeps the link (a circle of one).
    """
    rows = df.select(name(F.col(node)).alias("node"), F.col(parents).alias("_p")).where("node IS NOT NULL")
    nodes = cut(rows.select("node").distinct())
    named = rows.select("node", F.explode("_p").alias("_p")).select("node", name(F.col("_p")).alias("parent")).where("parent IS NOT NULL")
    pairs, n = counted_cut(named.distinct())
    # one parent may hold a large share of the links
    return nodes, cut(join_skewed(pairs, nodes.withColumnRenamed("node", "parent"), "parent", n).select("node", "parent"))


def _best(rows: DataFrame, with_path: bool, keys: list[str]) -> DataFrame:
    """The row with the smallest distance for each key (of several the one with the first path)."""
    if with_path:
        return rows.groupBy(*keys).agg(F.min(F.struct("dist", "path")).alias("b")).select(*keys, "b.dist", "b.path")
    return rows.groupBy(*keys).agg(F.min("dist").alias("dist"))


def double(nodes: DataFrame, edges: DataFrame, with_path: bool = False, max_rounds: int = 64) -> tuple[DataFrame, DataFrame, int, int]:
    """(settled, open, still, distance) when no further node settles.

    ``settled`` (node, ptr, dist[, path]) has each root that a node reaches by a walk that was followed to its end, with
    the smallest number of links.  ``open`` (node, ptr) are the pointers over ``distance`` links of the ``still`` nodes
    that have a circle above them.
    """
    path = ["path"] if with_path else []
    first = lambda *c: [F.array(*c).alias("path")] if with_path else []
    roots = nodes.join(edges, "node", "left_anti").select("node", F.col("node").alias("ptr"), F.lit(0).alias("dist"), *first(F.col("node")))
    settled = [cut(roots)]
    open_, size = counted_cut(edges.select("node", F.col("parent").alias("ptr"), *first(F.col("node"))))
    distance, still = 1, open_.select("node").distinct().count()
    for _ in range(max_rounds):
        if not still:
            break
        todo = open_.withColumnRenamed("ptr", "at")
        up = lambda df: df.withColumnsRenamed({"node": "at", "path": "_up"})
        joined = [F.concat("_up", "path").alias("path")] if with_path else []
        ends = up(settled[0])
        for part in settled[1:]:
            ends = ends.unionByName(up(part))
        met = join_skewed(todo, ends, "at", size).select("node", "ptr", (F.col("dist") + distance).alias("dist"), *joined)
        settled.append(cut(_best(met, with_path, ["node", "ptr"])))
        far = join_skewed(todo, up(open_), "at", size).select("node", "ptr", *joined)
        open_, size = counted_cut(far.groupBy("node", "ptr").agg(F.min("path").alias("path")) if with_path else far.distinct())
        distance *= 2
        before, still = still, open_.select("node").distinct().count()
        if still == before:
            break
    whole = settled[0]
    for part in settled[1:]:
        whole = whole.unionByName(part)
    # a later round finds longer walks only, so the first row of a pair is the nearest
    return (_best(whole, with_path, ["node", "ptr"]) if len(settled) > 2 else whole), open_.select("node", "ptr"), still, distance


def closure(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, ancestor, dist) of all ancestors, the node itself with 0; circles are followed once around.

    Round ``k`` joins the pointers over exactly ``2^k`` links (few, in a hierarchy that is not deep) with all pairs that
    are at most that far apart, so a pair is made about once.  A round without a new pair is the last: a nearest way
    of more links would have a nearest way of fewer links inside it.
    """
    reach, size = counted_cut(edges.select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("dist")))
    exact, n, links_ = edges.select("node", F.col("parent").alias("at")), size, 1
    while n:
        step = reach.select(F.col("node").alias("at"), "ancestor", "dist")
        more = join_skewed(exact, step, "at", n).select("node", "ancestor", (F.col("dist") + links_).alias("dist"))
        before = size
        reach, size = counted_cut(reach.unionByName(more).groupBy("node", "ancestor").agg(F.min("dist").alias("dist")))
        if size == before:
            break
        far = exact.select(F.col("node").alias("at"), F.col("at").alias("to"))
        exact, n = counted_cut(join_skewed(exact, far, "at", n).select("node", F.col("to").alias("at")).distinct())
        links_ *= 2
    own = nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("dist"))
    return own.unionByName(reach)


def subtree(edges: DataFrame, tops: DataFrame) -> DataFrame:
    """(node) of ``tops`` and all nodes below them, each once; circles are no trouble.

    Marks spread along pointers over ``2^k`` links, so after round ``k`` every node less than ``2^k`` links below a top has
    one.  A round that marks no further node is the last.  No pairs are made.
    """
    marked, size = counted_cut(tops.select("node").distinct())
    exact, n = counted_cut(edges.select("node", F.col("parent").alias("at")).distinct())
    while n and size:
        more = join_skewed(exact, marked.withColumnRenamed("node", "at"), "at", n).select("node")
        before = size
        marked, size = counted_cut(marked.unionByName(more).distinct())
        if size == before:
            break
        far = exact.select(F.col("node").alias("at"), F.col("at").alias("to"))
        exact, n = counted_cut(join_skewed(exact, far, "at", n).select("node", F.col("to").alias("at")).distinct())
    return marked


def _on_circles(open_nodes: DataFrame, pointers: DataFrame, edges: DataFrame) -> DataFrame:
    """Of nodes below circles, those that are their own ancestor.

    The places pointed at are the nodes with a walk of that many links below them.  The pointers go on doubling until these
    become no fewer: then they are circles and the ways between circles.  Where no node has two parents there, all of it
    is circles; else the closure of this remainder (and of nothing more) tells.
    """
    place = open_nodes.withColumnRenamed("node", "ptr")
    # above a node without a circle above it there is none either, so only pointers between open nodes matter
    exact, n = counted_cut(pointers.join(place, "ptr", "left_semi").select("node", "ptr"))
    core, size = counted_cut(exact.select(F.col("ptr").alias("node")).distinct())
    while size:
        far = exact.withColumnRenamed("node", "at")
        exact, n = counted_cut(join_skewed(exact.withColumnRenamed("ptr", "at"), far, "at", n).select("node", "ptr").distinct())
        before = size
        core, size = counted_cut(exact.select(F.col("ptr").alias("node")).distinct())
        if size == before:
            break
    inside = cut(edges.join(core, "node", "left_semi").join(core.withColumnRenamed("node", "parent"), "parent", "left_semi").select("node", "parent"))
    if inside.groupBy("node").count().where("count > 1").isEmpty():
        return core
    return closure(core, inside).where("node = ancestor AND dist > 0").select("node").distinct()


def expand_hierarchy(nodes: DataFrame, edges: DataFrame, with_path: bool = False) -> DataFrame:
    """(node, root, depth[, path]) of a graph of parent links.

    A node on a circle gives one row (``#cycle``, -1), a node below a circle one row (``#below_cycle``, -1) even if it
    also has a root; every other node gives a row for each root, with the smallest number of links.  ``path`` is the
    array of node names from the root down to the node along such a way (of several, the first in order); it is null
    for circles.  An empty table of nodes gives no rows.  ``nodes`` and ``edges`` are those of :func:`links`.
    """
    settled, pointers, still, _ = double(nodes, edges, with_path)
    out = settled.select("node", F.col("ptr").alias("root"), F.col("dist").alias("depth"), *(["path"] if with_path else []))
    if not still:
        return out
    pointers = cut(pointers)
    open_nodes = cut(pointers.select("node").distinct())
    circles = cut(_on_circles(open_nodes, pointers, edges))
    extra = [F.lit(None).cast("array<string>").alias("path")] if with_path else []
    mark = lambda df, tag: df.select("node", F.lit(tag).alias("root"), F.lit(-1).alias("depth"), *extra)
    rest = open_nodes.join(circles, "node", "left_anti")
    return out.join(open_nodes, "node", "left_anti").unionByName(mark(circles, CYCLE)).unionByName(mark(rest, BELOW_CYCLE))


def descendants(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(ancestor, node, dist) of all pairs of different nodes, those on and below circles too."""
    return closure(nodes, edges).where("node <> ancestor").select("ancestor", "node", "dist")
