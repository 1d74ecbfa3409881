"""Splitting oversized items at natural boundaries.

Two ways of cutting.  ``bisect_pieces`` halves an item at the strongest boundary near its middle until every part is
small enough, then lengthens the parts by the overlap.  ``forward_pieces`` cuts as late as the limit allows, from left
to right.  Which cuts are made depends on the way, and the required result of contigs is the forward one (see README).
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMIT, OVERLAP, LEAST = 2_000, 100, 200
_SPACE = re.compile(r"\s+")
_UNKNOWN = re.compile(r"[NnXx]{10,}")


def unknown_runs(letters: str) -> list[int]:
    """The last positions (from 1) of unbroken runs of 10 or more unknown letters."""
    return [m.end() for m in _UNKNOWN.finditer(letters)]


def measured_runs(letters: str) -> list[tuple[int, int]]:
    """As ``unknown_runs``, with the number of letters of each run."""
    return [(m.end(), m.end() - m.start()) for m in _UNKNOWN.finditer(letters)]


def forward_pieces(length: int, boundaries: Sequence[int], limit: int = LIMIT, overlap: int = OVERLAP, least: int = LEAST) -> list[tuple[int, int]]:
    """Closed pieces from left to right; each but the last ends at the last boundary that leaves it ``least`` to
    ``limit`` letters, else at ``limit`` letters; each begins ``overlap`` letters before the end of the one before."""
    out, start = [], 1
    while length - start + 1 > limit:
        i = bisect_right(boundaries, start + limit - 1)
        end = boundaries[i - 1] if i and boundaries[i - 1] >= start + least - 1 else start + limit - 1
        out.append((start, end))
        start = end - overlap + 1
    return [*out, (start, length)] if length > 0 else []


def bisect_pieces(length: int, boundaries: Sequence[int | tuple[int, int]], limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Closed pieces by halving: cut after the strongest boundary in the middle half (of equal ones the nearest to the
    middle), without one at the middle; go on with halves above ``limit - overlap``; then lengthen each piece but the
    first by ``overlap`` to the left.  Boundaries are (end, strength), or ends of equal strength, in order.  No recursion
    on the stack, so the length does not matter."""
    marks = [(x, 1) if isinstance(x, int) else x for x in boundaries]
    ends = [x for x, _ in marks]
    parts, todo = [], [(1, length)] if length > 0 else []
    while todo:
        a, b = todo.pop()
        if b - a + 1 <= (limit if a == 1 else limit - overlap):
            parts.append((a, b))
            continue
        mid, quarter = (a + b) // 2, (b - a + 1) // 4
        inner = marks[bisect_left(ends, max(a, mid - quarter)) : bisect_right(ends, min(b - 1, mid + quarter))]
        at = min(inner, key=lambda m: (-m[1], abs(m[0] - mid)))[0] if inner else mid
        todo += [(at + 1, b), (a, at)]
    return [(a if a == 1 else a - overlap, b) for a, b in parts]


def split_records(
    df: DataFrame, key: str, text: str, order: list[str], limit: int = LIMIT, cut: Callable[[int, Sequence], list[tuple[int, int]]] = forward_pieces, boundaries: Callable[[str], Sequence] = unknown_runs
) -> tuple[DataFrame, DataFrame]:
    """The pieces of records longer than ``limit``, and the keys of records that have no text.

    The letters of a record are those of ``text`` without white space.  A key counts once: rows with text go before
    rows without, then the row that is last by ``order`` counts.  Rows with a null key are left out.  Pieces are
    (key, piece_no, piece_start, piece_end); texts never leave the task that read them, only cuts are shuffled.
    """
    schema = T.StructType([df.schema[key], *[df.schema[c] for c in order], T.StructField("_has", T.BooleanType()), T.StructField("_starts", T.ArrayType(T.IntegerType())), T.StructField("_ends", T.ArrayType(T.IntegerType()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            has, starts, ends = [], [], []
            for seq in batch.column(batch.num_columns - 1).to_pylist():
                letters = _SPACE.sub("", seq) if seq is not None else ""
                found = cut(len(letters), boundaries(letters)) if len(letters) > limit else []
                has.append(seq is not None)
                starts.append([a for a, _ in found])
                ends.append([b for _, b in found])
            lists = [pa.array(x, pa.list_(pa.int32())) for x in (starts, ends)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(has, pa.bool_()), *lists], names=[f.name for f in schema])

    rows = df.where(F.col(key).isNotNull()).select(key, *order, text).mapInArrow(work, schema)
    one = rows.groupBy(key).agg(F.max_by(F.struct("_has", "_starts", "_ends"), F.struct("_has", *order)).alias("r"))
    pieces = one.where("r._has").select(key, F.posexplode(F.arrays_zip("r._starts", "r._ends")).alias("n", "p"))
    return pieces.select(key, (F.col("n") + 1).alias("piece_no"), F.col("p._starts").alias("piece_start"), F.col("p._ends").alias("piece_end")), one.where("NOT r._has").select(key)


def pieces_of_lengths(df: DataFrame, key: str, length: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of records of which only the length is known; null lengths and lengths up to ``limit`` give none."""
    step = limit - overlap
    n = F.ceil((F.col(length) - limit) / step).cast("int")
    rows = df.where(F.col(length) > limit).select(key, length, F.explode(F.sequence(F.lit(0), n)).alias("i"))
    start = F.col("i") * step + 1
    return rows.select(key, (F.col("i") + 1).alias("piece_no"), start.alias("piece_start"), F.least(start + limit - 1, F.col(length)).alias("piece_end"))


def bisected_lengths(df: DataFrame, key: str, length: str, limit: int = LIMIT) -> DataFrame:
    """Pieces by ``bisect_pieces`` without boundaries of records of which only the length is known."""
    schema = T.StructType([df.schema[key], *[T.StructField(c, T.IntegerType()) for c in ("piece_no", "piece_start", "piece_end")]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, n in zip(batch.column(0), batch.column(1).to_pylist()):  # a batch for each record: one may have many pieces
                found = bisect_pieces(n, [], limit)
                columns = [range(1, len(found) + 1), [a for a, _ in found], [b for _, b in found]]
                yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * len(found), batch.schema.field(0).type), *[pa.array(c, pa.int32()) for c in columns]], names=[f.name for f in schema])

    return df.where(F.col(length) > limit).select(key, length).mapInArrow(work, schema)


def latest_rows(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key that is last by ``order``, as columns; ties go to the larger row."""
    rest = [c for c in df.columns if c != key]
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(order, *[c for c in rest if c != order])).alias("r")).select(key, "r.*")


