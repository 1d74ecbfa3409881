"""Sequence records as rows (id, name, description, seq, annotations, ...): operations that make a new record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genomespark.functions.sequences import complement, reverse_complement

#: Columns that say something of each letter; they do not outlive a change of the sequence.
BY_LETTER = ("letter_annotations", "quality")


def _changed(df: DataFrame, seq: str, change, **fields: str | None) -> DataFrame:
    out = df.withColumn(seq, change(F.col(seq)))
    for name, value in fields.items():
        if value is not None:
            out = out.withColumn(name, F.lit(value))
    return out.drop(*BY_LETTER)


def complemented(df: DataFrame, seq: str = "seq", **fields: str | None) -> DataFrame:
    """The records with complemented sequences; id, name, description and annotations are kept unless given anew."""
    return _changed(df, seq, complement, **fields)


def reverse_complemented(df: DataFrame, seq: str = "seq", **fields: str | None) -> DataFrame:
    """The records with reverse-complemented sequences; fields as in :func:`complemented`."""
    return _changed(df, seq, reverse_complement, **fields)


def shown(df: DataFrame, seq: str = "seq") -> DataFrame:
    """The records with a column ``shown``: the fields that are there, a line each, and the sequence."""
    fields = [c for c in ("id", "name", "description") if c in df.columns]
    lines = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c.title()}: "), F.col(c))) for c in fields]
    return df.withColumn("shown", F.concat_ws("\n", *lines, F.concat(F.lit("Sequence: "), F.col(seq))))
