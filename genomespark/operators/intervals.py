"""Interval algebra on (seqid, start, end) rows, positions 1-based and closed.

Null seqids match null seqids.  Rows with a null or reversed range match nothing and are dropped by set operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genomespark.operators.ordered import Chunks
from genomespark.operators.skew import ROWS

#: Width of a bin of the overlap join; about the usual length of an interval works best.
BIN = 4096


def _bins(df: DataFrame, start: str, end: str, width: int, name: str) -> DataFrame:
    sound = df.where(F.col(start) <= F.col(end))
    return sound.withColumn(name, F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))


def overlap_join(a: DataFrame, b: DataFrame, seqid: tuple[str, str], a_range: tuple[str, str], b_range: tuple[str, str], width: int = BIN) -> DataFrame:
    """All pairs of rows of ``a`` and ``b`` on one seqid that share a position; columns must not clash.

    Both sides are cut into bins and joined on (seqid, bin): an equi-join that shuffles by place, not by seqid alone, so a
    seqid with most rows is spread over its bins.  A pair comes out in the first bin the two have in common, once.
    """
    left, right = _bins(a, *a_range, width, "_bin_a"), _bins(b, *b_range, width, "_bin_b")
    same = F.col(seqid[0]).eqNullSafe(F.col(seqid[1])) & (F.col("_bin_a") == F.col("_bin_b"))
    touch = (F.col(a_range[0]) <= F.col(b_range[1])) & (F.col(a_range[1]) >= F.col(b_range[0]))
    once = F.floor(F.greatest(F.col(a_range[0]), F.col(b_range[0])) / width) == F.col("_bin_a")
    return left.join(right, same & touch & once).drop("_bin_a", "_bin_b")


def semi_overlap(a: DataFrame, b: DataFrame, seqid: str, start: str, end: str, width: int = BIN, anti: bool = False) -> DataFrame:
    """The rows of ``a`` that share a position with some row of ``b`` (or with none, ``anti``); same column names."""
    marked = a.withColumn("_row", F.monotonically_increasing_id())
    other = b.select(F.col(seqid).alias("_q"), F.col(start).alias("_s"), F.col(end).alias("_e"))
    if anti:
        # an anti join per bin would keep a row for each bin without a match; a left join and a count decide per row
        binned = marked.withColumn("_bin", F.explode(F.when(F.col(start) <= F.col(end), F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))).otherwise(F.array(F.lit(-1).cast("bigint")))))
        theirs = _bins(other, "_s", "_e", width, "_bin_b")
        met = binned.join(theirs, F.col(seqid).eqNullSafe(F.col("_q")) & (F.col("_bin") == F.col("_bin_b")) & (F.col(start) <= F.col("_e")) & (F.col(end) >= F.col("_s")), "left")
        first = [F.first(c).alias(c) for c in a.columns]
        return met.groupBy("_row").agg(F.count("_s").alias("_n"), *first).where("_n = 0").select(*a.columns)
    theirs = _bins(other, "_s", "_e", width, "_bin_b")
    mine = _bins(marked, start, end, width, "_bin")
    met = mine.join(theirs, F.col(seqid).eqNullSafe(F.col("_q")) & (F.col("_bin") == F.col("_bin_b")) & (F.col(start) <= F.col("_e")) & (F.col(end) >= F.col("_s")), "left_semi")
    return met.dropDuplicates(["_row"]).select(*a.columns)


def intersections(a: DataFrame, b: DataFrame, seqid: str, start: str, end: str, width: int = BIN) -> DataFrame:
    """The distinct overlaps (seqid, start, end) of two sets of ranges."""
    other = b.select(F.col(seqid).alias("_q"), F.col(start).alias("_s"), F.col(end).alias("_e"))
    met = overlap_join(a.select(seqid, start, end), other, (seqid, "_q"), (start, end), ("_s", "_e"), width)
    return met.select(seqid, F.greatest(start, "_s").alias(start), F.least(end, "_e").alias(end)).distinct()


def with_stretch(df: DataFrame, seqid: list[str], start: str, end: str, within: int = 0, rows: int = ROWS) -> DataFrame:
    """Sound ranges with ``_stretch``, the first position of the stretch of ranges that a range belongs to.

    A range goes on with the stretch before if it starts at most ``within`` beyond the end reached.  Ordered chunks of
    bounded size are worked by themselves; how far earlier chunks reach, and which stretch they leave open, are carries.
    """
    sound = df.where(F.col(start) <= F.col(end))
    c = Chunks(sound, seqid, [start, end], rows)
    reach = c.carried(c.df, {"_e": F.max(end)}, {"_to": F.max("_e").over(c.earlier)}).withColumn("_reach", F.greatest(F.max(end).over(c.before), "_to"))
    opens = F.col("_reach").isNull() | (F.col(start) > F.col("_reach") + within)
    first = reach.withColumn("_first", F.max(F.when(opens, F.col(start))).over(c.upto))
    known = c.carried(first, {"_f": F.max("_first")}, {"_from": F.max("_f").over(c.earlier)})
    return known.withColumn("_stretch", F.coalesce("_first", "_from")).select(*df.columns, "_stretch")


def merge(df: DataFrame, seqid: list[str], start: str, end: str, within: int = 0, rows: int = ROWS) -> DataFrame:
    """Ranges joined where the next starts at most ``within`` beyond the end reached: (seqid, start, end, n_ranges)."""
    each = with_stretch(df.select(*seqid, start, end), seqid, start, end, within, rows)
    whole = each.groupBy(*seqid, "_stretch").agg(F.max(end).alias("_end"), F.count("*").alias("n_ranges"))
    return whole.select(*seqid, F.col("_stretch").alias(start), F.col("_end").alias(end), "n_ranges")


def complement(bounds: DataFrame, df: DataFrame, seqid: str, start: str, end: str, rows: int = ROWS) -> DataFrame:
    """What the ranges leave uncovered of each bound (seqid, start, end); one bound per seqid."""
    limit = bounds.select(F.col(seqid).alias("_q"), F.col(start).alias("_lo"), F.col(end).alias("_hi"))
    c = Chunks(merge(df, [seqid], start, end, 1, rows).drop("n_ranges"), [seqid], [start], rows)
    whole = c.carried(c.df, {"_e": F.max(end)}, {"_to": F.max("_e").over(c.earlier)}).withColumn("_was", F.coalesce(F.lag(end).over(c.here), "_to"))
    same = F.col("_q").eqNullSafe(F.col(seqid))
    before = limit.join(whole, same).select("_q", F.greatest("_lo", F.col("_was") + 1).alias("a"), F.least(F.col(start) - 1, "_hi").alias("b"))
    last = c.df.groupBy(seqid).agg(F.max(end).alias("_last"))
    after = limit.join(last, same, "left").select("_q", F.greatest("_lo", F.col("_last") + 1).alias("a"), F.col("_hi").alias("b"))
    return before.unionByName(after).where("a <= b").select(F.col("_q").alias(seqid), F.col("a").alias(start), F.col("b").alias(end))


def subtract(a: DataFrame, b: DataFrame, key: str, seqid: str, start: str, end: str, width: int = BIN) -> DataFrame:
    """Each range of ``a`` (named by ``key``) without the positions that ``b`` covers."""
    other = merge(b, [seqid], start, end, 1).select(F.col(seqid).alias("_q"), F.col(start).alias("_s"), F.col(end).alias("_e"))
    met = overlap_join(a.select(key, seqid, start, end), other, (seqid, "_q"), (start, end), ("_s", "_e"), width)
    order = Window.partitionBy(key).orderBy("_s")
    spans = met.select(key, seqid, start, end, "_s", "_e", F.coalesce(F.lag("_e").over(order) + 1, F.col(start)).alias("_from"), F.lead("_s").over(order).alias("_next"))
    left = spans.select(key, seqid, F.col("_from").alias("a"), (F.col("_s") - 1).alias("b"))
    right = spans.where(F.col("_next").isNull()).select(key, seqid, (F.col("_e") + 1).alias("a"), F.col(end).alias("b"))
    rest = a.where(F.col(start) <= F.col(end)).select(key, seqid, F.col(start).alias("a"), F.col(end).alias("b")).join(met.select(key).distinct(), key, "left_anti")
    return left.unionByName(right).unionByName(rest).where("a <= b").select(key, seqid, F.col("a").alias(start), F.col("b").alias(end))


def flank_left(start: Column, end: Column, n: int) -> tuple[Column, Column]:
    """The ``n`` positions before a range, as far as there are any (null at the edge)."""
    return F.when(start > 1, F.greatest(start - n, F.lit(1))), F.when(start > 1, start - 1)


def flank_right(start: Column, end: Column, n: int, size: Column) -> tuple[Column, Column]:
    """The ``n`` positions after a range within a sequence of ``size`` (null at the edge)."""
    return F.when(end < size, end + 1), F.when(end < size, F.least(end + n, size))


def shift(start: Column, end: Column, n: int, size: Column) -> tuple[Column, Column]:
    """Both ends moved by ``n``, kept within 1 and ``size``."""
    move = lambda c: F.least(F.greatest(c + n, F.lit(1)), size)
    return move(start), move(end)


def enlarge(start: Column, end: Column, n: int) -> tuple[Column, Column]:
    """A range padded on both sides, from 1 on."""
    return F.greatest(start - n, F.lit(1)), end + n


def windows_of(df: DataFrame, start: str, end: str, length: int, step: int = 1) -> DataFrame:
    """Sliding windows of ``length`` from start to ``end - length``: columns ``w_start`` and ``w_end`` are added."""
    rows = df.where(F.col(start) <= F.col(end) - length)
    return rows.withColumn("w_start", F.explode(F.sequence(F.col(start), F.col(end) - length, F.lit(step)))).withColumn("w_end", F.col("w_start") + length - 1)


def depth(df: DataFrame, keys: list[str], start: str, end: str, rows: int = ROWS) -> DataFrame:
    """(keys, start, end, depth): maximal stretches covered by the same number of ranges, from changes at the edges."""
    sound = df.where(F.col(start) <= F.col(end))
    change = sound.select(*keys, F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("d")), F.struct((F.col(end) + 1).alias("at"), F.lit(-1).alias("d")))).alias("c")).select(*keys, "c.at", "c.d")
    c = Chunks(change.groupBy(*keys, "at").agg(F.sum("d").alias("d")).where("d <> 0"), keys, ["at"], rows)
    known = c.carried(c.df, {"_d": F.sum("d"), "_last": F.max("at")}, {"_base": F.sum("_d").over(c.earlier), "_was": F.max("_last").over(c.earlier)})
    # each change ends the stretch since the change before it
    deep = F.coalesce(F.sum("d").over(c.before), F.lit(0)) + F.coalesce("_base", F.lit(0))
    run = known.select(*keys, F.coalesce(F.lag("at").over(c.here), "_was").alias(start), (F.col("at") - 1).alias(end), deep.alias("depth"))
    return run.where("depth > 0")


def natural_key(c: Column, letters_first: bool = False, width: int = 12) -> Column:
    """A sort key under which runs of digits order as numbers, before letters (or after them); punctuation is skipped."""
    tokens = F.regexp_extract_all(c, F.lit(r"\d+|[A-Za-z]"), F.lit(0))
    pad = "~" if letters_first else ""
    return F.array_join(F.transform(tokens, lambda t: F.when(t.rlike("^[0-9]"), F.concat(F.lit(pad), F.lpad(t, width, "0"))).otherwise(t)), "")


def numeric_or_text_key(c: Column) -> list[Column]:
    """Order contigs as numbers where they are numbers, else as text after them."""
    return [c.try_cast("int").isNull(), c.try_cast("int"), c]


def custom_order(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """Sorted by the place of ``column`` in a given list, unknown values last."""
    at = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(column))
    return df.orderBy(F.when(at == 0, 2**31 - 1).otherwise(at), column)
