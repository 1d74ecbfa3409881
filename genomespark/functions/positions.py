"""Positions on sequences as text, ``id:1,234``, and moved along them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_position(text: Column) -> Column:
    """(seqid, site) of ``id:1,234``; null where the text has no such form or the site is not above 0."""
    site = F.replace(F.regexp_extract(text, r":([0-9][0-9,]*)\s*\z", 1), F.lit(",")).try_cast("int")
    name = F.regexp_extract(text, r"\A(.*):[0-9,]+\s*\z", 1)
    return F.when(site > 0, F.struct(name.alias("seqid"), site.alias("site")))


def show_position(seqid: Column, site: Column) -> Column:
    """``id:1,234``; a null id shows the site alone."""
    number = F.format_number(site, 0)
    return F.when(seqid.isNull(), number).otherwise(F.concat(seqid, F.lit(":"), number))


def plus(site: Column, n: int, size: Column | None = None) -> Column:
    """A site moved to the right; null beyond ``size``."""
    moved = site + n
    return moved if size is None else F.when(size.isNull() | (moved <= size), moved)


def minus(site: Column, n: int) -> Column:
    """A site moved to the left, to 1 at most."""
    return F.greatest(site - n, F.lit(1))


def range_text(seqid: Column, start: Column, end: Column) -> dict[str, Column]:
    """Columns ID (``NONE`` without a seqid), start, end and range of a table of ranges."""
    return {"ID": F.coalesce(seqid, F.lit("NONE")), "start": start, "end": end, "range": F.concat(start.cast("string"), F.lit(".."), end.cast("string"))}
