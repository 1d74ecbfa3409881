"""Read alignments: flags, CIGAR sums and alignment shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bits of the flag.
PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, SECONDARY = 0x1, 0x2, 0x4, 0x8, 0x10, 0x100


def _bit(flag: Column, bit: int, on: bool = True) -> Column:
    return (flag.bitwiseAND(F.lit(bit)) == bit) if on else (flag.bitwiseAND(F.lit(bit)) == 0)


FILTERS = {
    "paired": (PAIRED, True), "mapped_proper_pair": (PROPER, True), "unmapped": (UNMAPPED, True), "mapped": (UNMAPPED, False),
    "mate_unmapped": (MATE_UNMAPPED, True), "mate_mapped": (MATE_UNMAPPED, False), "primary": (SECONDARY, False), "not_primary": (SECONDARY, True),
}


def matches(flag: Column, name: str) -> Column:
    """Whether a flag passes one of :data:`FILTERS`; null flags pass none."""
    return _bit(flag, *FILTERS[name])


def strand(flag: Column) -> Column:
    return F.when(_bit(flag, REVERSE), "-").otherwise("+")


def cigar_sum(cigar: Column, op: str) -> Column:
    """Letters of one operation of a CIGAR string."""
    lengths = F.regexp_extract_all(cigar, F.lit(rf"(\d+){op}"), F.lit(1))
    return F.aggregate(lengths, F.lit(0), lambda a, x: a + x.cast("int"))


def aligned_shares(df: DataFrame) -> DataFrame:
    """Adds ``p_align_id`` (edit distance by aligned letters) and ``p_align`` (matched letters by read length)."""
    return df.withColumn("p_align_id", F.try_divide(F.col("nm").cast("double"), F.col("num_m") + F.col("num_d") + F.col("num_i"))).withColumn("p_align", F.try_divide(F.col("num_m").cast("double"), F.col("query_length")))
