"""Lines of nine-column feature files: valid features, and rejected lines with the reason.

Structure (quotes, number of columns) is judged line by line.  Values are judged once each: the distinct values of a
column are cast in one pass, those that fail form a dictionary of invalid values with reasons, and the dictionary is
joined back to the lines.  A value that many lines hold is dealt to parts by their number, so that it is no hot group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genomespark.operators.skew import ROWS
from genomespark.runtime import cut

#: The reasons in their order; the first that applies is reported.
REASONS = ["quoting", "columns", "coordinates", "score", "strand", "phase", "attributes"]
#: The nine columns of a feature line.
FIELDS = ["seqid", "feature_source", "feature_type", "start_text", "end_text", "score_text", "strand", "phase", "attributes"]
_TAB, _SEMI, _EQ, _COMMA = "\x01", "\x02", "\x03", "\x04"


def _mask(text: Column) -> Column:
    """Separators inside double quotes become control characters, one for one; other control characters of that kind
    outside quotes are left (they separate nothing)."""
    parts = F.split(text, '"', -1)
    masked = F.array_join(F.transform(parts, lambda x, i: F.when(i % 2 == 1, F.translate(x, "\t;=,", _TAB + _SEMI + _EQ + _COMMA)).otherwise(x)), '"')
    return F.when(F.contains(text, F.lit('"')), masked).otherwise(text)


def split_lines(lines: DataFrame, text: str = "line_text") -> DataFrame:
    """The lines that are judged, with the structural reason (or null), a masked copy of each field and the raw fields.

    Null lines, lines of white space only and lines that start with ``#`` are left out: they are neither valid nor
    rejected.  One trailing carriage return is no part of a line.  Adds ``_structure`` (0 quoting, 1 columns, null),
    ``_masked`` (array of fields) and ``_fields`` (array of raw fields).
    """
    body = F.regexp_replace(F.col(text), r"\r\z", "")
    judged = lines.withColumn("_body", body).where(F.col(text).isNotNull() & F.col("_body").rlike(r"(?U)\S") & ~F.startswith("_body", F.lit("#")))
    quotes = F.length("_body") - F.length(F.replace(F.col("_body"), F.lit('"'), F.lit("")))
    masked = F.split(_mask(F.col("_body")), "\t", -1)
    out = judged.withColumn("_masked", masked)
    structure = F.when(quotes % 2 == 1, 0).when(F.size("_masked") != 9, 1)
    ends = F.transform(F.col("_masked"), lambda x, i: F.aggregate(F.slice(F.col("_masked"), 1, i), F.lit(1), lambda a, y: a + F.length(y) + 1))
    raw = F.when(structure.isNull(), F.zip_with(F.col("_masked"), ends, lambda x, at: F.substring(F.col("_body"), at, F.length(x))))
    return out.withColumn("_structure", structure).withColumn("_fields", raw)




def invalid_values(judged: DataFrame) -> DataFrame:
    """The dictionary of invalid values: (column_no, value, reason_no, n_cells), each distinct value judged once.

    ``judged`` has column_no and the masked value; ``n_cells`` is how many of its rows hold the value.
    """
    distinct = judged.groupBy("column_no", "value").agg(F.count("*").alias("n_cells"))
    value, at = F.col("value"), F.col("column_no")
    number = F.when(value.rlike(r"\A[0-9]+\z"), F.expr("try_cast(value AS INT)"))
    parts = F.split(F.regexp_replace(value, r";\z", ""), ";", -1)
    whole = F.forall(parts, lambda p: F.length(p) - F.length(F.replace(p, F.lit("="), F.lit(""))) == 1)
    tags = F.transform(parts, lambda p: F.btrim(F.substring_index(p, "=", 1)))
    twice = F.size(F.array_distinct(tags)) < F.size(tags)
    ids = F.exists(parts, lambda p: (F.btrim(F.substring_index(p, "=", 1)) == "ID") & F.contains(F.substring_index(p, "=", -1), F.lit(",")))
    bad = (
        F.when(at.isin(2, 3), F.coalesce(number, F.lit(0)) < 1)
        .when(at == 4, ~((value == ".") | value.rlike(r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z")))
        .when(at == 5, ~value.isin("+", "-", ".", "?"))
        .when(at == 6, ~value.isin("0", "1", "2", "."))
        .otherwise(~whole | twice | ids)
    )
    reason = F.when(at.isin(2, 3), 2).otherwise(at - 1)
    return distinct.where(bad).select("column_no", "value", reason.cast("int").alias("reason_no"), "n_cells")


def reject_lines(lines: DataFrame, key: str = "line_key", text: str = "line_text") -> DataFrame:
    """(key, reason) of each rejected line; ``key`` must be unique, rows with a null key share one row.

    See TESTDATA for the reasons; they are tried in the order of :data:`REASONS`.
    """
    split = split_lines(lines, text).select(key, "_structure", "_masked")
    field = lambda i: F.get(F.col("_masked"), F.lit(i))
    first = split.where(F.col("_structure").isNotNull()).select(key, F.col("_structure").cast("int").alias("reason_no"))
    sound = split.where(F.col("_structure").isNull())
    start, end = [F.when(field(i).rlike(r"\A[0-9]+\z"), field(i)).try_cast("bigint") for i in (3, 4)]
    across = F.when(start > end, 2).when((field(7) == ".") & (field(2) == "CDS"), 5)
    between = sound.select(key, across.cast("int").alias("reason_no")).where("reason_no IS NOT NULL")

    columns = [F.struct(F.lit(n).alias("column_no"), field(i).alias("value")) for n, i in ((2, 3), (3, 4), (4, 5), (5, 6), (6, 7), (7, 8))]
    values = sound.select(key, F.explode(F.array(*columns)).alias("v")).select(key, "v.column_no", "v.value")
    # the dictionary knows how many cells hold each invalid value: those of a hot one are dealt to as many parts as it has
    # times ROWS cells; there are at most as many hot values as all cells have times ROWS cells
    dictionary = cut(invalid_values(values))
    hot = dictionary.where(F.col("n_cells") > ROWS).select("column_no", "value", F.ceil(F.col("n_cells") / ROWS).alias("_parts"))
    parts = F.coalesce("_parts", F.lit(1))
    dealt = values.join(F.broadcast(hot), ["column_no", "value"], "left").withColumn("_part", F.pmod(F.xxhash64(key), parts))
    copies = dictionary.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n_cells") / ROWS) - 1)))
    by_value = dealt.join(copies, ["column_no", "value", "_part"]).select(key, "reason_no")

    names = F.array(*[F.lit(r) for r in REASONS])
    found = first.unionByName(between).unionByName(by_value).groupBy(key).agg(F.min("reason_no").alias("n"))
    return found.select(key, F.get(names, F.col("n")).alias("reason"))


def valid_lines(lines: DataFrame, key: str = "line_key", text: str = "line_text") -> DataFrame:
    """The valid lines as typed features, with the columns of ``lines`` but the text."""
    rest = [c for c in lines.columns if c != text and c not in (*FIELDS, "start_pos", "end_pos", "score")]
    split = split_lines(lines, text).where("_structure IS NULL")
    raw = split.select(*rest, *[F.get("_fields", F.lit(i)).alias(n) for i, n in enumerate(FIELDS)])
    typed = raw.select(
        *rest, "seqid", "feature_source", "feature_type",
        F.col("start_text").try_cast("int").alias("start_pos"), F.col("end_text").try_cast("int").alias("end_pos"),
        F.when(F.col("score_text") != ".", F.col("score_text").try_cast("double")).alias("score"), "strand", "phase", "attributes",
    )
    return typed.join(reject_lines(lines, key, text).select(key), key, "left_anti")
