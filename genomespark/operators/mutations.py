"""Reproducible point, deletion and insertion mutations of proteins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genomespark.functions.sequences import random_sequence

# The residues that mutations draw from.
RESIDUES = "ACDEFGHIKLMNPQRSTVWY"


def _draw(seed: Column, salt: int, n: Column) -> Column:
    """A number from 0 to n - 1."""
    return F.pmod(F.xxhash64(F.lit(salt), seed), F.greatest(n, F.lit(1))).cast("int")


def eligible(length: Column, ranges: Column | None = None, avoid: bool = False) -> Column:
    """Sorted disjoint closed ranges (start, end) of a sequence that may change: all of it, those of ``ranges`` (an array of
    structs of 1-based closed ranges, in any order), or with ``avoid`` what these leave.  Ranges are cut at the ends."""
    whole = F.array(F.struct(F.lit(1).alias("start"), length.alias("end")))
    if ranges is None:
        return F.filter(whole, lambda r: r["start"] <= r["end"])
    kind = "array<struct<start:int,end:int>>"
    clipped = F.filter(F.transform(ranges, lambda r: F.struct(F.greatest(r["start"], F.lit(1)).alias("start"), F.least(r["end"], length).alias("end"))), lambda r: r["start"] <= r["end"])
    last = lambda done: F.element_at(done, -1)
    merged = F.aggregate(
        F.array_sort(clipped).cast(kind), F.array().cast(kind),
        lambda done, r: F.when((F.size(done) > 0) & (r["start"] <= F.coalesce(F.try_element_at(done, F.lit(-1))["end"], F.lit(-1)) + 1), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(done, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(done, F.lit(-1))["end"], r["end"]).alias("end")))).cast(kind)).otherwise(F.concat(done, F.array(r)).cast(kind)),
    )
    if not avoid:
        return F.coalesce(merged, F.array().cast(kind))
    ends = F.concat(F.array(F.lit(0)), F.transform(merged, lambda r: r["end"]))
    begins = F.concat(F.transform(merged, lambda r: r["start"]), F.array(length + 1))
    left = F.zip_with(ends, begins, lambda e, b: F.struct((e + 1).alias("start"), (b - 1).alias("end")))
    return F.filter(F.coalesce(left.cast(kind), whole.cast(kind)), lambda r: r["start"] <= r["end"])


def _size(r: Column) -> Column:
    return r["end"] - r["start"] + 1


def _total(ranges: Column) -> Column:
    return F.aggregate(ranges, F.lit(0), lambda n, r: n + _size(r))


def _place(ranges: Column, i: Column) -> Column:
    """The place (from 1) of the i-th eligible letter (from 0)."""
    state = F.struct(i.cast("int").alias("left"), F.lit(None).cast("int").alias("at"))
    step = lambda s, r: F.struct(
        F.when(s["at"].isNull(), s["left"] - _size(r)).otherwise(s["left"]).cast("int").alias("left"),
        F.when(s["at"].isNull() & (s["left"] < _size(r)), r["start"] + s["left"]).otherwise(s["at"]).cast("int").alias("at"),
    )
    return F.aggregate(ranges, state, step)["at"]


def delete_within(seq: Column, seed: Column, length: int, ranges: Column) -> Column:
    """Without ``length`` residues from a drawn place at which they lie in one eligible range; else as it is."""
    starts = F.transform(F.filter(ranges, lambda r: _size(r) >= length), lambda r: F.struct(r["start"].alias("start"), (r["end"] - (length - 1)).alias("end")))
    at = _place(starts, _draw(seed, 1, _total(starts)))
    return F.when(at.isNotNull() & (F.length(seq) > length), F.concat(F.substring(seq, F.lit(1), at - 1), F.substring(seq, at + length, F.length(seq)))).otherwise(seq)


def insert_within(seq: Column, seed: Column, length: int, ranges: Column) -> Column:
    """With ``length`` drawn residues put in before a drawn eligible place; without one as it is."""
    at = _place(ranges, _draw(seed, 2, _total(ranges)))
    return F.when(at.isNotNull(), F.concat(F.substring(seq, F.lit(1), at - 1), random_sequence(seed, length, RESIDUES), F.substring(seq, at, F.length(seq)))).otherwise(seq)


def point_within(seq: Column, seed: Column, n: int, ranges: Column) -> Column:
    """With ``n`` distinct eligible residues changed (all, if there are fewer), each to a different residue.

    The places are drawn without repeats, every set of them alike: the j-th draw takes a place up to the j-th last one,
    or that one itself where the place is taken.  Letters that are no residues stay.
    """
    k = len(RESIDUES)
    total = _total(ranges)
    first = F.greatest(total - n, F.lit(0))
    draws = F.when(total > 0, F.sequence(first, total - 1)).otherwise(F.array().cast("array<int>"))
    pick = lambda j: F.pmod(F.xxhash64(F.lit(3), seed, j), j + 1).cast("int")
    chosen = F.aggregate(draws, F.array().cast("array<int>"), lambda s, j: F.concat(s, F.array(F.when(F.array_contains(s, pick(j)), j).otherwise(pick(j)).cast("int"))))
    places = F.array_sort(F.transform(chosen, lambda i: _place(ranges, i)))
    befores = F.concat(F.array(F.lit(0)), places)

    def changed(at: Column) -> Column:
        old = F.substring(seq, at, F.lit(1))
        place = F.instr(F.lit(RESIDUES), old) - 1
        new = F.substring(F.lit(RESIDUES), F.pmod(place + 1 + F.pmod(F.xxhash64(F.lit(4), seed, at), F.lit(k - 1)).cast("int"), F.lit(k)) + 1, F.lit(1))
        return F.when(place >= 0, new).otherwise(old)

    parts = F.transform(places, lambda at, i: F.concat(F.substring(seq, F.get(befores, i) + 1, at - F.get(befores, i) - 1), changed(at)))
    tail = F.substring(seq, F.element_at(befores, -1) + 1, F.length(seq))
    return F.concat(F.array_join(parts, ""), tail)


def mutate(df: DataFrame, kind: str, n: int, seq: str = "seq", key: str = "id", seed: int = 0, ranges: DataFrame | None = None, avoid: bool = False) -> DataFrame:
    """The proteins with point mutations, a deletion or an insertion (``kind``) of ``n`` residues.

    ``ranges`` (key, start_pos, end_pos), 1-based and closed, are where residues may change, or with ``avoid`` may not;
    proteins without a range may change nowhere, or with ``avoid`` anywhere.  Results depend on ``seed`` and the key alone.
    Null sequences stay null.
    """
    change = {"point": point_within, "deletion": delete_within, "insertion": insert_within}[kind]
    out = df
    bounds = None
    if ranges is not None:
        lists = ranges.where("start_pos <= end_pos").groupBy(F.col(key).alias("_key")).agg(F.collect_list(F.struct(F.col("start_pos").cast("int").alias("start"), F.col("end_pos").cast("int").alias("end"))).alias("_ranges"))
        out = df.join(lists, F.col(key) == F.col("_key"), "left").drop("_key")
        bounds = F.coalesce("_ranges", F.array().cast("array<struct<start:int,end:int>>"))
    out = out.withColumn("_eligible", eligible(F.length(seq), bounds, avoid)).withColumn("_seed", F.xxhash64(F.lit(seed), key))
    return out.withColumn(seq, F.when(F.col(seq).isNotNull(), change(F.col(seq), F.col("_seed"), n, F.col("_eligible")))).drop("_ranges", "_eligible", "_seed")


def delete(seq: Column, seed: Column, length: int) -> Column:
    """Without ``length`` residues from a drawn place; sequences that are not longer stay as they are."""
    return delete_within(seq, seed, length, eligible(F.length(seq)))


def insert(seq: Column, seed: Column, length: int) -> Column:
    """With ``length`` drawn residues put in at a drawn place, the end too."""
    at = _draw(seed, 2, F.length(seq) + 1)
    return F.concat(F.substring(seq, F.lit(1), at), random_sequence(seed, length, RESIDUES), F.substring(seq, at + 1, F.length(seq)))


def point(seq: Column, seed: Column, n: int) -> Column:
    """With ``n`` distinct residues changed, each to a different residue."""
    return point_within(seq, seed, n, eligible(F.length(seq)))
