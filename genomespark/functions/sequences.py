"""Column-to-column functions on biological sequences.

Every function takes and gives Columns of built-in expressions.  Null input gives null.  Positions are 0-based and ranges
inclusive where the name says ``slice``; negative positions count from the end.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from genomespark.functions.alphabets import ALPHABETS, COMPLEMENT_FROM, COMPLEMENT_TO, codon_map, literal_map, starts


def nucleotides(*parts: Column) -> Column:
    """One nucleotide sequence from parts: upper case, U as T and X as N."""
    return F.translate(F.upper(F.concat(*parts)), "UX", "TN")


def alphabet(s: Column) -> Column:
    """The first alphabet that holds all letters, in the order DNA, RNA, ambiguous DNA and RNA, protein; else null."""
    out = F.lit(None).cast("string")
    for name, letters in reversed(ALPHABETS.items()):
        out = F.when(F.upper(s).rlike(f"^[{letters.replace('-', '').replace('*', '')}{'*' if '*' in letters else ''}{'-' if '-' in letters else ''}]*$"), name).otherwise(out)
    return F.when(s.isNotNull(), out)


def complement(s: Column) -> Column:
    """The complement by letter, ambiguity codes included."""
    return F.translate(s, COMPLEMENT_FROM, COMPLEMENT_TO)


def reverse_complement(s: Column) -> Column:
    return F.reverse(complement(s))


def transcribe(s: Column) -> Column:
    return F.translate(s, "T", "U")


def back_transcribe(s: Column) -> Column:
    return F.translate(s, "U", "T")


def ungap(s: Column) -> Column:
    return F.replace(s, F.lit("-"), F.lit(""))


def gc(s: Column) -> Column:
    """The number (not the share) of G and C."""
    return (F.length(s) - F.length(F.translate(s, "GC", ""))).cast("long")


def count_letter(s: Column, letter: str) -> Column:
    """Occurrences of a letter; U counts T."""
    letter = "T" if letter == "U" else letter
    return (F.length(s) - F.length(F.replace(s, F.lit(letter), F.lit("")))).cast("long")


def count(s: Column, query: str) -> Column:
    """Occurrences of a query that do not overlap."""
    return F.floor((F.length(s) - F.length(F.replace(s, F.lit(query), F.lit("")))) / len(query)).cast("long")


def count_overlap(s: Column, query: str) -> Column:
    """Occurrences of a query, overlapping ones too."""
    return F.regexp_count(s, F.lit(f"(?={query})")).cast("long")


def index_of(s: Column, query: str, start: int = 0) -> Column:
    """0-based place of the first occurrence from ``start`` on, or -1."""
    return (F.locate(query, s, start + 1) - 1).cast("long")


def last_index_of(s: Column, query: str) -> Column:
    """0-based place of the last occurrence, or -1."""
    at = F.locate(query[::-1], F.reverse(s))
    return F.when(at == 0, -1).otherwise(F.length(s) - len(query) - at + 1).cast("long")


def slice_(s: Column, first: int, last: int) -> Column:
    """Letters ``first`` to ``last``, inclusive; negative places count from the end; a descending range gives null."""
    at = lambda i: F.lit(i) if i >= 0 else F.length(s) + i
    a, b = at(first), at(last)
    return F.when((a >= 0) & (b >= a), F.substring(s, a + 1, b - a + 1))


def display(s: Column) -> Column:
    """The sequence, or its first 54 and last 3 letters if it has 60 or more."""
    return F.when(F.length(s) >= 60, F.concat(F.substring(s, 1, 54), F.lit("..."), F.right(s, F.lit(3)))).otherwise(s)


def codons(s: Column) -> Column:
    """The codons of frame 0; letters beyond the last whole codon are left out."""
    return F.regexp_extract_all(s, F.lit("(?s).{3}"), F.lit(0))


def translate(s: Column, table: int = 1, to_stop: bool = False, cds: bool = False, on_ambiguous: str | None = None) -> Column:
    """Protein of frame 0, stops as ``*``.

    ``to_stop`` cuts before the first stop.  ``cds`` demands whole codons, a start codon (which becomes M) and a stop at
    the end, else raises.  Codons with ambiguity letters raise, or give ``on_ambiguous``.
    """
    known = literal_map(codon_map(table))
    unknown = F.raise_error(F.lit("ambiguous codon")).cast("string") if on_ambiguous is None else F.lit(on_ambiguous)
    protein = F.array_join(F.transform(codons(F.translate(s, "U", "T")), lambda c: F.coalesce(F.element_at(known, c), unknown)), "")
    if cds:
        good = (F.length(s) % 3 == 0) & F.substring(F.translate(s, "U", "T"), 1, 3).isin(*starts(table)) & (F.right(protein, F.lit(1)) == "*")
        protein = F.when(good, F.concat(F.lit("M"), F.substring(protein, F.lit(2), F.length(protein)))).otherwise(F.raise_error(F.lit("not a coding sequence")).cast("string"))
    return F.substring_index(protein, "*", 1) if to_stop or cds else protein


def runs(s: Column, letters: str = "N") -> Column:
    """Array of the maximal runs of given letters and of other letters, in order."""
    return F.regexp_extract_all(s, F.lit(f"[{letters}]+|[^{letters}]+"), F.lit(0))


def weight(s: Column, weights: dict[str, float]) -> Column:
    """Sum of the letters' weights; letters without one count nothing."""
    table = literal_map({k: float(v) for k, v in weights.items()})
    return F.aggregate(F.split(s, ""), F.lit(0.0), lambda a, c: a + F.coalesce(F.element_at(table, c), F.lit(0.0)))


def random_sequence(seed: Column, length: Column | int, letters: str = "ACGT") -> Column:
    """A reproducible sequence of uniform letters for each seed."""
    n = F.lit(length) if isinstance(length, int) else length
    pick = lambda i: F.substring(F.lit(letters), F.pmod(F.xxhash64(seed, i), F.lit(len(letters))).cast("int") + 1, F.lit(1))
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), n), pick), "")).otherwise("")
