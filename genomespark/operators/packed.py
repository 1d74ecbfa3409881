"""Several values packed in one field: one row per value, with its place.

The fields are read by small parsing expression grammars.  Alternatives are tried in order (quoted, bracketed, bare);
a double quote that opens no whole quoted part makes the first alternative fail, the parser goes back and takes the
quote as an ordinary letter, and the value is flagged.

    field  <- item (SEP item)*            item  <- TAG BLANK* '=' values / TAG BLANK values
    values <- value (',' value)*          value <- (QUOTED / BARE / STRAY)+
    allele <- QUOTED / SYMBOLIC / WORD    QUOTED <- '"' ('""' / [^"])* '"'
    alleles <- '[' allele* ']' / allele*
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: (tag, value, malformed, first code point, end) of a value as it stands in its field, quotes included
Item = tuple[str, str, bool, int, int]

_QUOTED = re.compile(r'"(?:[^"]|"")*"')
# letters that neither open a quotation nor end what is read
_IN_ITEM, _IN_TAG, _IN_VALUE = (re.compile(rf'[^{stop}"]+') for stop in (";|&", "=", ","))
_ALLELE = re.compile(rf'{_QUOTED.pattern}|<[^<>]*>|[^\s,;|/"<]+|["<]')


def _reach(text: str, at: int, end: int, bare: re.Pattern) -> int:
    """Where (QUOTED / BARE / STRAY)* from ``at`` ends: at a letter that stops it, or at ``end``."""
    while at < end:
        if text[at] == '"':
            whole = _QUOTED.match(text, at, end)
            at = whole.end() if whole else at + 1
        elif m := bare.match(text, at, end):
            at = m.end()
        else:
            return at
    return end


def _trimmed(text: str, at: int, end: int) -> tuple[int, int]:
    while at < end and text[at].isspace():
        at += 1
    while end > at and text[end - 1].isspace():
        end -= 1
    return at, end


def _value(text: str, at: int, end: int) -> tuple[str, bool]:
    """A value without its enclosing quotes, and whether a quote in it is stray."""
    raw = text[at:end]
    if '"' not in raw:
        return raw, False
    if raw[0] == '"' and (m := _QUOTED.match(raw)) and m.end() == len(raw):
        return raw[1:-1].replace('""', '"').strip(), False
    return raw, '"' in _QUOTED.sub("", raw)


def parse_attributes(field: str | None) -> list[Item]:
    """The values of an attribute field in order; empty items are dropped."""
    if field is None:
        return []
    at, end = _trimmed(field, 0, len(field))
    if field[at:end] in ("", "."):
        return []
    out: list[Item] = []
    while at < end:
        stop = _reach(field, at, end, _IN_ITEM)
        a, b = _trimmed(field, at, stop)
        at = stop + 1
        if a == b:
            continue
        # TAG BLANK* '=' values, or else TAG BLANK values
        first = _reach(field, a, b, _IN_TAG)
        if first == b:
            first = next((i for i in range(a, b) if field[i] in " \t"), b)
        tag = field[a:first].strip()
        v = first + 1
        while v <= b:
            to = _reach(field, v, b, _IN_VALUE)
            x, y = _trimmed(field, v, to)
            value, stray = _value(field, x, y)
            if value:
                out.append((tag, value, stray, x, y))
            v = to + 1
    return out


@lru_cache(maxsize=65_536)
def parse_alleles(field: str | None) -> tuple[Item, ...]:
    """The alleles of a field in order; a square bracket around the whole field is no part of it."""
    if field is None:
        return ()
    at, end = _trimmed(field, 0, len(field))
    if field[at:end] in ("", "."):
        return ()
    if field[at] == "[" and field[end - 1] == "]":
        at, end = at + 1, end - 1
    out: list[Item] = []
    glue = -1  # a stray sign starts or continues a bare word
    for m in _ALLELE.finditer(field, at, max(at, end)):
        text = m.group()
        stray = text in ('"', "<")
        value = text[1:-1].replace('""', '"').strip() if len(text) > 1 and text[0] == '"' else text
        if stray or glue == m.start():
            if glue == m.start() and out:
                out[-1] = ("", out[-1][1] + value, True, out[-1][3], m.end())
            else:
                out.append(("", value, True, m.start(), m.end()))
            glue = m.end()
        elif value:
            out.append(("", value, False, m.start(), m.end()))
    return tuple(out)


PARSERS = {"attributes": parse_attributes, "alleles": parse_alleles}


def explode_packed(df: DataFrame, key: str, field: str, grammar: str, least: int = 1) -> DataFrame:
    """(key, item_no, item_tag, item_value, malformed, item_start, item_end): a row for each value of ``field``.

    ``item_no`` counts from 1 in order of appearance.  Fields that are null, empty, blank or ``.`` hold no value, and
    fields with fewer than ``least`` values give no rows.  Repeated rows are worked each.  ``malformed`` is true where a
    quote or angle bracket is not closed.  The place of the value as written, quotes included, is counted in code points
    from 0, the end exclusive.
    """
    parse = PARSERS[grammar]
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("item_no", T.IntegerType()), *[T.StructField(n, T.StringType()) for n in ("item_tag", "item_value")], T.StructField("malformed", T.BooleanType()), T.StructField("item_start", T.IntegerType()), T.StructField("item_end", T.IntegerType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, no, found = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                items = parse(text)
                if len(items) >= least:
                    at += [i] * len(items)
                    no += range(1, len(items) + 1)
                    found += items
            columns = list(zip(*found)) if found else [()] * 5
            kinds = (pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.int32())
            keys = batch.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(no, pa.int32()), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=[f.name for f in schema])

    return df.select(key, field).mapInArrow(work, schema)


def with_alleles(df: DataFrame, field: str, name: str) -> DataFrame:
    """All rows with the alleles of ``field`` as an array; null, empty and ``.`` fields give an empty array."""
    schema = T.StructType([*df.schema, T.StructField(name, T.ArrayType(T.StringType()))])
    at = df.columns.index(field)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [[item[1] for item in parse_alleles(text)] for text in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.string()))], names=[f.name for f in schema])

    return df.mapInArrow(work, schema)
