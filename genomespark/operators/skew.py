"""Per-key work where a few keys hold most rows.

Heavy keys are found with a mergeable frequent-items sketch in one narrow pass over the key column.  The sketch names at
most ``TRACKED`` candidates whatever the size of the input, so the table of heavy keys may always be broadcast.  Into how
many parts a key is cut follows from its number of rows: no part holds much more than ``ROWS``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genomespark.runtime import cut

#: Items the sketch tracks.  Its counts are too high by at most 3.5/TRACKED of all rows.
TRACKED = 4096
#: Rows that one task may well work by itself.
ROWS = 1_000_000


def heavy_counts(df: DataFrame, key: str, rows: int | None = None, share: float = 0.0) -> DataFrame:
    """(key, n_rows, total) of the keys that may hold more than ``rows`` rows and at least ``share`` of all.

    ``n_rows`` is never too small, and too large by at most 3.5/TRACKED of ``total``, the number of rows with a key.
    Without ``rows``, it is what one of twice as many tasks as there are cores would hold, but at most ``ROWS``.  No such
    key is missed unless it holds less than 3.5/TRACKED of the rows.  An empty table gives no rows.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    sketch = df.where(F.col(key).isNotNull()).agg(F.expr(f"approx_top_k(`{key}`, {TRACKED}, {TRACKED})").alias("top"), F.count("*").alias("total"))
    least = F.least(F.lit(ROWS), F.ceil(F.col("total") / (2 * cores))) if rows is None else F.lit(rows)
    each = sketch.select(F.explode("top").alias("t"), "total", least.cast("long").alias("part_rows"))
    found = each.where((F.col("t.count") > F.col("part_rows")) & (F.col("t.count") >= F.lit(share) * F.col("total")))
    return found.select(F.col("t.item").alias(key), F.col("t.count").alias("n_rows"), "total", "part_rows")


def heavy_keys(df: DataFrame, key: str, share: float) -> DataFrame:
    """The keys that may hold at least ``share`` of the rows; a key slightly below it may come along."""
    return heavy_counts(df, key, 1, max(share, 3.5 / TRACKED)).select(key)


def profile_by_key(df: DataFrame, key: str, row_hash: list[str], aggregates: dict[str, tuple[Column, str]], rows: int | None = None) -> DataFrame:
    """Per-key results over distinct rows, evenly worked.

    ``row_hash`` names the columns that tell rows apart: rows that agree in them and in the key count once.
    ``aggregates`` maps an output name to (expression, how), where how is ``sum``, ``min`` or ``max``; ``n_rows`` is
    always added.  Rows with a null key are left out.  The result has one row per key.

    Rows meet a broadcast of the heavy keys, which deals those of a heavy key to as many parts as its size asks for (rows
    that may be equal to the same part), and leaves all others in one.  One exchange by (key, part) then serves the
    distinct step and the results of the parts.  Light keys are done there; the parts of heavy keys, a row each, take a
    second step, and the two are put together with a union.
    """
    values = [e.alias(f"_v{i}") for i, (e, _) in enumerate(aggregates.values())]
    once = [F.first(f"_v{i}").alias(f"_v{i}") for i in range(len(values))]
    fold = {"sum": F.sum, "min": F.min, "max": F.max}
    first = [fold[how](f"_v{i}").alias(name) for i, (name, (_, how)) in enumerate(aggregates.items())]
    again = [fold[how](name).alias(name) for name, (_, how) in aggregates.items()]

    parts = heavy_counts(df, key, rows).select(key, F.ceil(F.col("n_rows") / F.col("part_rows")).cast("int").alias("_parts"))
    heavy = cut(parts)  # two runs of a sketch may differ
    dealt = df.where(F.col(key).isNotNull()).select(key, *row_hash, *values).join(F.broadcast(heavy), key, "left")
    dealt = dealt.withColumn("_part", F.when(F.col("_parts").isNull(), -1).otherwise(F.pmod(F.xxhash64(*row_hash), F.col("_parts")))).drop("_parts")
    spread = dealt.repartition(key, "_part")
    distinct = spread.groupBy(key, "_part", *row_hash).agg(*once) if once else spread.select(key, "_part", *row_hash).distinct()
    done = cut(distinct.groupBy(key, "_part").agg(F.count("*").alias("n_rows"), *first))
    of_heavy = done.where("_part >= 0").groupBy(key).agg(F.sum("n_rows").alias("n_rows"), *again)
    return of_heavy.unionByName(done.where("_part < 0").drop("_part"))


def dominant_keys(counts: DataFrame, key: str, share: float) -> DataFrame:
    """The keys of a table (key, n_rows) that hold at least ``share`` of the sum of n_rows."""
    total = counts.agg(F.sum("n_rows").alias("_total"))
    return counts.join(F.broadcast(total), F.col("n_rows") / F.col("_total") >= share).select(key)


def join_skewed(left: DataFrame, right: DataFrame, key: str, size: int | None = None, rows: int = ROWS) -> DataFrame:
    """Inner join where some keys hold very many rows of ``left``; ``size`` is the number of rows of ``left``, if known.

    A key with more than ``rows`` rows is cut into as many parts as it has times ``rows`` rows, and its rows of ``right``
    are copied to each part: both sides are shuffled, nothing but the keys' names (at most ``TRACKED``) is broadcast.  A
    table of at most ``rows`` rows has no such key and is joined as it is.
    """
    size = left.count() if size is None else size
    if size <= rows:
        return left.join(right, key)
    hot = cut(heavy_counts(left, key, rows).select(key, F.ceil(F.col("n_rows") / rows).cast("int").alias("_parts")))  # small, and read on both sides
    parts = F.coalesce("_parts", F.lit(1))
    spread = left.join(F.broadcast(hot), key, "left").withColumn("_part", F.pmod(F.xxhash64(*left.columns), parts)).drop("_parts")
    copies = right.join(F.broadcast(hot), key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).withColumn("_part", F.col("_part").cast("long")).drop("_parts")
    return spread.join(copies, [key, "_part"]).drop("_part")
