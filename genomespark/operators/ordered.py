"""Cutting ordered rows into chunks of bounded size, so that no group has to pass through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genomespark.operators.skew import ROWS
from genomespark.runtime import counted_cut, cut


class Chunks:
    """Rows with a column ``_chunk``; chunks are ordered as the rows are, and windows within (keys, _chunk) are bounded.

    A table of at most ``rows`` rows is one chunk: none of its groups is larger.  A larger one is cut by range of (keys,
    order) into chunks of about ``rows`` rows, whatever the sizes of the groups; rows that are equal in all of ``order``
    stay together.  What a chunk must know of those before it are carries: since chunks are ranges, a chunk can go on with
    one group only, so there are no more carries than chunks, and they are broadcast.
    """

    def __init__(self, df: DataFrame, keys: list[str], order: list[str], rows: int = ROWS) -> None:
        self.keys, self.group = keys, [*keys, "_chunk"]
        settled, n = counted_cut(df)
        self.one = n <= rows
        if self.one:
            self.df = settled.withColumn("_chunk", F.lit(0))
        else:
            parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // rows))
            # where the ranges end comes from a sample, so the chunks are settled once
            self.df = cut(settled.repartitionByRange(parts, *keys, *order).withColumn("_chunk", F.spark_partition_id()))
        self.here = Window.partitionBy(*self.group).orderBy(*order)
        self.upto = self.here.rowsBetween(Window.unboundedPreceding, 0)
        self.before = self.here.rowsBetween(Window.unboundedPreceding, -1)

    def carried(self, df: DataFrame, summary: dict[str, Column], carry: dict[str, Column], steps: list[dict[str, Column]] = []) -> DataFrame:
        """``df`` with the columns of ``carry`` for its chunk.

        ``summary`` sums a chunk of a group up in one row; ``carry`` are expressions over windows of these rows (see
        :attr:`earlier`), ``steps`` columns that they build on.  In the first chunk of a group the carries are null.
        """
        sums = df.groupBy(*self.group).agg(*[c.alias(n) for n, c in summary.items()])
        for step in steps:
            sums = sums.withColumns(step)
        if self.one:
            kinds = sums.select(*[c.alias(n) for n, c in carry.items()]).schema
            return df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in kinds])
        late = sums.select(*self.group, *[c.alias(n) for n, c in carry.items()], F.lag("_chunk").over(self.order).alias("_chunk_before")).where("_chunk_before IS NOT NULL").drop("_chunk_before")
        late = cut(late).withColumnsRenamed({k: f"_own_{k}" for k in self.group})
        same = [F.col(k).eqNullSafe(F.col(f"_own_{k}")) for k in self.keys]
        return df.join(F.broadcast(late), [F.col("_chunk") == F.col("_own__chunk"), *same], "left").drop(*[f"_own_{k}" for k in self.group])

    @property
    def earlier(self) -> Window:
        """The chunks of the group before this one."""
        return self.order.rowsBetween(Window.unboundedPreceding, -1)

    @property
    def order(self) -> Window:
        """The chunks of the group in order."""
        return Window.partitionBy(*self.keys).orderBy("_chunk")
