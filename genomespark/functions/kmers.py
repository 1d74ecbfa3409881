"""k-mers: 2-bit codes with the order A < C < T < G, strands and distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genomespark.functions.sequences import reverse_complement

_EVEN, _ODD = 0x3333333333333333, 0x0CCCCCCCCCCCCCCC
_LOW = 0x5555555555555555


def digits(kmer: Column) -> Column:
    """The k-mer in base-4 digits: A 0, C 1, T (U) 2, G 3; strings of one length order as the codes do."""
    return F.translate(kmer, "ACTUG", "01223")


def from_digits(d: Column) -> Column:
    return F.translate(d, "0123", "ACTG")


def encode(kmer: Column) -> Column:
    """The 2-bit code of a k-mer of at most 32 letters; with 32 the code is negative where the first letter is T or G."""
    d = digits(kmer)
    part = lambda x: F.conv(x, 4, 10).cast("long")
    low = part(F.right(d, F.lit(16)))
    high = F.when(F.length(d) > 16, part(F.substring(d, F.lit(1), F.length(d) - 16))).otherwise(F.lit(0).cast("long"))
    return F.shiftleft(high, 32).bitwiseOR(low)


def unsigned_order(code: Column) -> Column:
    """A sort key under which codes of 32 letters order as unsigned numbers."""
    return code.bitwiseXOR(F.lit(-(1 << 63)))


def decode(code: Column, k: int) -> Column:
    half = lambda x: F.lpad(F.conv(x.cast("string"), 10, 4), 16, "0")
    both = F.concat(half(F.shiftrightunsigned(code, 32)), half(code.bitwiseAND(F.lit((1 << 32) - 1))))
    return from_digits(F.right(both, F.lit(k)))


def canonical(kmer: Column) -> Column:
    """The smaller of a k-mer and its reverse complement, by code."""
    return from_digits(F.least(digits(kmer), digits(reverse_complement(kmer))))


def hamming(a: Column, b: Column) -> Column:
    """Differing letters of two codes."""
    x = a.bitwiseXOR(b)
    return F.bit_count((x.bitwiseOR(F.shiftrightunsigned(x, 1))).bitwiseAND(F.lit(_LOW)))


def buckets(code: Column) -> Column:
    """Two bucket keys (even and odd letters): codes that differ in at most one letter share one of them."""
    return F.array(F.struct(F.lit(0).alias("side"), code.bitwiseAND(F.lit(_EVEN)).alias("part")), F.struct(F.lit(1).alias("side"), code.bitwiseAND(F.lit(_ODD)).alias("part")))


def blanked(code: Column, k: int) -> Column:
    """``k`` keys of a code, each with one letter blanked: codes share a key if they differ in that letter at most."""
    return F.array(*[F.struct(F.lit(i).alias("at"), code.bitwiseAND(F.lit(((1 << 2 * k) - 1) & ~(3 << 2 * i))).alias("rest")) for i in range(k)])


def spaced(s: Column, step: int) -> Column:
    """Every ``step``-th letter from the first on."""
    return s if step == 1 else F.regexp_replace(s, f"(?s)(.).{{0,{step - 1}}}", "$1")


def windows(df: DataFrame, seq: str, k: int, step: int = 1, name: str = "kmer", piece: int = 4096) -> DataFrame:
    """A row for each window of ``k`` unambiguous letters; sequences shorter than ``k`` give none.

    Each sequence is read once from left to right, first into pieces that overlap by ``k - 1`` and then into windows, so
    no array of a whole chromosome's windows is built.  The order of the rows is not defined.
    """
    letters = F.translate(spaced(F.col(seq), step), "U", "T")
    parts = F.regexp_extract_all(letters, F.lit(f"(?s)(?=(.{{1,{piece + k - 1}}})).{{1,{piece}}}"), F.lit(1))
    each = F.regexp_extract_all("_part", F.lit(f"(?=([ACGT]{{{k}}}))"), F.lit(1))
    rest = [c for c in df.columns if c != name]
    return df.select(*rest, F.explode(parts).alias("_part")).select(*rest, F.explode(each).alias(name))


def ambiguous(s: Column, k: int, keep_min_only: bool = False) -> Column:
    """Letters at which no k-mer ends because of an ambiguous letter: such letters themselves, and later letters whose
    window of ``k`` holds one; doubled unless only the smaller strand is kept."""
    bad = F.length(F.regexp_replace(s, "[ACGTU]", ""))
    # of each run of valid letters the first k-1 count, but not those before place k-1 of the sequence
    runs = F.regexp_extract_all(s, F.lit("[ACGTU]+"), F.lit(0))
    short = F.aggregate(runs, F.lit(0), lambda a, r: a + F.least(F.length(r), F.lit(k - 1)))
    early = F.length(F.regexp_replace(F.substring(s, 1, k - 1), "[^ACGTU]", ""))
    return ((bad + short - early) * (1 if keep_min_only else 2)).cast("long")
