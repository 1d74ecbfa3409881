"""Multiple alignments: rows of (alignment, place, id, seq); samples are rows, sites are columns of letters."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def checked(df: DataFrame, alignment: str, seq: str = "seq") -> DataFrame:
    """The rows; one whose length is not that of its alignment's longest row raises when it is read."""
    longest = F.max(F.length(seq)).over(Window.partitionBy(alignment))
    wrong = F.raise_error(F.concat(F.lit("unlike length in alignment "), F.coalesce(F.col(alignment).cast("string"), F.lit("?")))).cast("string")
    return df.withColumn(seq, F.when(F.length(seq) == longest, F.col(seq)).otherwise(wrong))


def samples(
    df: DataFrame, alignment: str, place: str, picks: Sequence[int | str] | range = (), name: str = "id", where: Callable[[Column, Column], Column] | None = None
) -> DataFrame:
    """The samples of each alignment at the places (from 0, negative ones from the end) or with the names of ``picks``, or
    those for which ``where`` (name, place) holds, in order of place.

    Places and names may not be mixed; a sample picked twice comes once.  A place beyond an alignment picks nothing there;
    a name that is in no alignment raises.
    """
    if where is not None:
        return df.where(where(F.col(name), F.col(place))).orderBy(alignment, place)
    picks = list(picks)
    kinds = {type(p) for p in picks}
    if len(kinds) > 1:
        raise TypeError("places and names are not picked together")
    if kinds == {str}:
        missing = set(picks) - {r[0] for r in df.where(F.col(name).isin(picks)).select(name).distinct().collect()}  # no more than picked
        if missing:
            raise KeyError(f"no sample {sorted(missing)[0]}")
        return df.where(F.col(name).isin(picks)).orderBy(alignment, place)
    # the number of samples of an alignment is one row for each: no window over a large alignment
    sizes = df.groupBy(F.col(alignment).alias("_a")).agg(F.max(place).alias("_last"))
    met = df.join(sizes, F.col(alignment).eqNullSafe(F.col("_a")))
    return met.where(F.col(place).isin(picks) | (F.col(place) - F.col("_last") - 1).isin(picks)).drop("_a", "_last").orderBy(alignment, place)


def sites(seq: Column, picks: Sequence[int] | range) -> Column:
    """The letters of a row at the places of ``picks`` (from 0, negative ones from the end), each once, in their order along
    the row; a range takes the stretch.  Places beyond the row give nothing."""
    if isinstance(picks, range) and picks.step == 1 and picks.start >= 0 <= picks.stop:
        return F.substring(seq, F.lit(picks.start + 1), F.lit(max(len(picks), 0)))
    n = F.length(seq)
    at = F.array(*[F.lit(p) if p >= 0 else n + p for p in picks]).cast("array<int>")
    inside = F.array_sort(F.array_distinct(F.filter(at, lambda i: (i >= 0) & (i < n))))
    return F.when(seq.isNotNull(), F.array_join(F.transform(inside, lambda i: F.substring(seq, i + 1, F.lit(1))), ""))


def sites_where(seq: Column, keep: Callable[[Column], Column]) -> Column:
    """The letters of a row whose place (a column, from 0) ``keep`` accepts."""
    letters = F.split(seq, "")
    return F.when(F.length(seq) > 0, F.array_join(F.filter(letters, lambda _, i: keep(i)), "")).otherwise(seq)


def display(df: DataFrame, alignment: str, place: str, first: int = 50) -> DataFrame:
    """The first rows of each alignment, as a reader is shown them."""
    return df.where(F.col(place) < first).orderBy(alignment, place)
