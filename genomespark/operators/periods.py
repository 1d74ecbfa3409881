"""Overlapping, nested and gapped intervals of an entity: covered stretches and the gaps between them.

The work is a mergeable aggregate, :class:`Spans`: sorted disjoint intervals of many entities.  Two of them are merged in
one linear pass, and the complement of one is its gaps.  They form a reduction tree.  A leaf is a batch of rows, merged
where it is read.  The partial lists are dealt by range of (entity, start) to nodes of bounded size, and each node merges
its lists in pairs of like size, as a binary counter does.  At the top a node must know only how far the nodes before it
reach into the entity it begins with: one row a node.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from genomespark.operators.skew import ROWS
from genomespark.runtime import counted_cut, cut

_STRIDE = np.int64(1) << 33  # positions are 32-bit; each entity gets its own stretch of the number line
BATCH = 65_536


@dataclass
class Spans:
    """Disjoint intervals of entities 0, 1, ... as places on one number line, in order."""

    start: np.ndarray
    end: np.ndarray

    @classmethod
    def of(cls, entity: np.ndarray, start: np.ndarray, end: np.ndarray) -> Spans:
        """The spans of intervals in any order."""
        lift = entity.astype(np.int64) * _STRIDE
        order = np.argsort(start + lift, kind="stable")
        return cls._joined((start + lift)[order], (end + lift)[order])

    @classmethod
    def _joined(cls, start: np.ndarray, end: np.ndarray) -> Spans:
        """One linear pass over intervals in order of start: those that share a position become one."""
        if not len(start):
            return cls(start, end)
        reach = np.maximum.accumulate(end)
        opens = np.flatnonzero(np.append(True, start[1:] > reach[:-1]))
        return cls(start[opens], reach[np.append(opens[1:], len(start)) - 1])

    def merge(self, other: Spans) -> Spans:
        """The union of two lists, by a linear merge (a stable sort of two runs merges them)."""
        start = np.concatenate((self.start, other.start))
        order = np.argsort(start, kind="stable")
        return self._joined(start[order], np.concatenate((self.end, other.end))[order])

    def entity(self) -> np.ndarray:
        return self.start // _STRIDE

    def gaps(self) -> Spans:
        """The complement between the intervals of each entity; two that only touch leave none."""
        entity = self.entity()
        after = np.flatnonzero((entity[1:] == entity[:-1]) & (self.start[1:] > self.end[:-1] + 1))
        return Spans(self.end[after] + 1, self.start[after + 1] - 1)


def merge_tree(lists: Iterator[Spans]) -> Spans | None:
    """All lists merged in pairs of like size: level ``i`` holds the merge of ``2^i`` lists."""
    levels: list[Spans | None] = []
    for one in lists:
        for i in range(len(levels) + 1):
            if i == len(levels):
                levels.append(None)
            if levels[i] is None:
                levels[i] = one
                break
            one, levels[i] = levels[i].merge(one), None
    whole = None
    for one in levels:
        whole = one if whole is None else whole if one is None else whole.merge(one)
    return whole


def _codes(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """(first row of each entity, entity of each row) of a batch."""
    code = np.zeros(len(columns[0]), dtype=np.int64)
    for c in columns:
        i = c.dictionary_encode()
        code = np.unique(code * len(i.dictionary) + np.asarray(i.indices), return_inverse=True)[1]
    return np.unique(code, return_index=True)[1], code


def partial_lists(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """The leaves: per batch of rows and entity, sorted disjoint intervals (keys, start, end); no null keys."""
    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField(start, T.LongType()), T.StructField(end, T.LongType())])

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            first, entity = _codes(batch.columns[: len(keys)])
            spans = Spans.of(entity, *[c.to_numpy(zero_copy_only=False) for c in batch.columns[len(keys) :]])
            rows = pa.array(first[spans.entity()])
            ends = [pa.array(x % _STRIDE) for x in (spans.start, spans.end)]
            yield pa.RecordBatch.from_arrays([*[c.take(rows) for c in batch.columns[: len(keys)]], *ends], names=[f.name for f in schema])

    return df.select(*keys, F.col(start).cast("long").alias(start), F.col(end).cast("long").alias(end)).mapInArrow(leaf, schema)


def _nodes(dealt: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """(keys, span_kind, start, end, _node): the stretches of each node and the gaps between them."""
    from pyspark.sql.pandas.types import to_arrow_type

    schema = T.StructType([*[dealt.schema[k] for k in keys], T.StructField("span_kind", T.StringType()), *[T.StructField(c, T.LongType()) for c in (start, end)], T.StructField("_node", T.IntegerType())])
    kinds = [to_arrow_type(dealt.schema[k].dataType) for k in keys]

    def node(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[tuple, int] = {}
        at = [-1]

        def lists() -> Iterator[Spans]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                at[0] = batch.column(len(keys) + 2)[0].as_py()
                first, entity = _codes(batch.columns[: len(keys)])
                heads = zip(*[c.take(pa.array(first)).to_pylist() for c in batch.columns[: len(keys)]])
                number = np.array([names.setdefault(h, len(names)) for h in heads], dtype=np.int64)
                yield Spans.of(number[entity], *[c.to_numpy(zero_copy_only=False) for c in batch.columns[len(keys) : len(keys) + 2]])

        spans = merge_tree(lists())
        if spans is None:
            return
        heads = [pa.array(list(c), kind) for c, kind in zip(zip(*names), kinds)]
        for kind, part in (("covered", spans), ("gap", spans.gaps())):
            for i in range(0, len(part.start), BATCH):
                a, b = part.start[i : i + BATCH], part.end[i : i + BATCH]
                rows = pa.array(a // _STRIDE)
                own = [pa.array([kind] * len(a), pa.string()), pa.array(a % _STRIDE), pa.array(b % _STRIDE), pa.array(np.full(len(a), at[0], np.int32))]
                yield pa.RecordBatch.from_arrays([*[h.take(rows) for h in heads], *own], names=[f.name for f in schema])

    return dealt.select(*keys, start, end, "_node").mapInArrow(node, schema)


def periods(df: DataFrame, keys: list[str], start: str = "start_pos", end: str = "end_pos", rows: int = ROWS) -> DataFrame:
    """(keys, span_kind, start, end): ``covered`` stretches and the ``gap`` rows between them.

    Positions are closed, from 0 to 2^32.  Intervals that share a position are joined; intervals that only touch stay apart
    without a gap row.  Rows with a null key or position, or with start above end, are left out.  Repeated rows change
    nothing.  An empty table gives no rows.  ``rows`` is about the number of intervals of a node.
    """
    sound = df.where(F.col(start) <= F.col(end)).dropna(subset=keys)
    lists, n = counted_cut(partial_lists(sound, keys, start, end))
    shown = [*keys, "span_kind", F.col(start).cast("int").alias(start), F.col(end).cast("int").alias(end)]
    if n <= rows:  # no entity is larger than a node
        return _nodes(lists.repartition(*keys).withColumn("_node", F.lit(-1)), keys, start, end).select(*shown)
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // rows))
    # where the ranges end comes from a sample, so the nodes are settled once
    found = cut(_nodes(cut(lists.repartitionByRange(parts, *keys, start).withColumn("_node", F.spark_partition_id())), keys, start, end))
    covered, gaps = found.where("span_kind = 'covered'"), found.where("span_kind = 'gap'")

    # the last stretch of each node; only the first entity of a node goes on from the node before: one carry a node
    order = Window.partitionBy(*keys).orderBy("_node")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    edges = covered.groupBy(*keys, "_node").agg(F.min(start).alias("_first"), F.max(start).alias("_a"), F.max(end).alias("_b"))
    reach = edges.withColumn("_to", F.max("_b").over(earlier))
    opened = F.when(F.col("_to").isNull() | (F.col("_a") > F.col("_to")), F.col("_a"))
    carry = cut(reach.withColumn("_from", F.max(opened).over(earlier)).where("_to IS NOT NULL").select(*keys, "_node", "_first", "_from", "_to"))
    met = lambda df: df.join(F.broadcast(carry), [*keys, "_node"], "left")

    taken = F.col(start) <= F.col("_to")  # belongs to the stretch that earlier nodes left open
    ends = met(covered).select(*keys, "span_kind", F.when(taken, F.col("_from")).otherwise(F.col(start)).alias(start), F.when(taken, F.greatest(end, "_to")).otherwise(F.col(end)).alias(end))
    joined = ends.groupBy(*keys, "span_kind", start).agg(F.max(end).alias(end))
    inner = met(gaps).select(*keys, "span_kind", F.greatest(F.col(start), F.col("_to") + 1).alias(start), end)
    between = carry.where(F.col("_first") > F.col("_to") + 1).select(*keys, F.lit("gap").alias("span_kind"), (F.col("_to") + 1).alias(start), (F.col("_first") - 1).alias(end))
    return joined.unionByName(inner.where(F.col(start) <= F.col(end))).unionByName(between).select(*shown)
