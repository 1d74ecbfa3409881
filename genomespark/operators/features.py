"""Feature tables: attributes, typed tables, range and transcript queries, GFF text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genomespark.operators.hierarchy import subtree

# Feature types and the name under which range queries report them.
REPORTED = {"exon": "exon", "CDS": "cds", "five_prime_UTR": "five_prime_UTR", "three_prime_UTR": "three_prime_UTR", "gene": "gene", "mRNA": "transcript"}
# Characters that GFF text escapes.
_ESCAPED = {"%": "%25", "\t": "%09", "\n": "%0A", "\r": "%0D", ";": "%3B", "=": "%3D", "&": "%26", ",": "%2C"}


def attribute(attributes: Column, tag: str, missing: str | None = "NONE") -> Column:
    """The value of a tag in ``tag=value;...`` text without known prefixes, or ``missing``."""
    value = F.regexp_extract(attributes, rf"(?:^|;)\s*{tag}=([^;]*)", 1)
    bare = F.regexp_replace(value, "^(gene:|transcript:|CDS:)", "")
    return F.when(bare != "", bare).otherwise(F.lit(missing))


def typed(df: DataFrame, feature_type: str) -> DataFrame:
    """The table of one feature type."""
    return df.where(F.col("feature_type") == feature_type)


def features_by_range(df: DataFrame, seqid: str, first: int, last: int, types: list[str] | None = None) -> DataFrame:
    """Features of the reported types that touch ``first`` to ``last``; chromosomes are left out."""
    names = F.create_map(*[F.lit(x) for kv in REPORTED.items() for x in kv])
    kind = F.element_at(names, F.col("feature_type"))
    rows = df.where((F.col("seqid") == seqid) & (F.col("start_pos") <= last) & (F.col("end_pos") >= first) & F.col("feature_type").isin(*REPORTED))
    rows = rows.withColumn("kind", kind)
    return rows.where(F.col("kind").isin(*types)) if types and "ALL" not in types else rows


def percent_encode(c: Column) -> Column:
    for k, v in _ESCAPED.items():
        c = F.replace(c, F.lit(k), F.lit(v))
    return c


def percent_decode(c: Column) -> Column:
    for k, v in reversed(_ESCAPED.items()):
        c = F.replace(c, F.lit(v), F.lit(k))
    return c


def as_row() -> Column:
    """The nine-column text of a feature row."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    return F.concat_ws("\t", text("seqid"), text("feature_source"), text("feature_type"), text("start_pos"), text("end_pos"), text("score"), text("strand"), text("phase"), F.concat(F.lit("ID="), percent_encode(F.coalesce("feature_id", F.lit("")))))


def discontinuous(df: DataFrame, key: str) -> DataFrame:
    """One row per id with several lines: (key, multiplicity, first, last, length, spans)."""
    spans = F.array_sort(F.collect_set(F.struct("start_pos", "end_pos")))
    rows = df.where(F.col(key).isNotNull()).groupBy(key).agg(spans.alias("s"))
    length = F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x["end_pos"] - x["start_pos"] + 1)
    text = F.array_join(F.transform("s", lambda x: F.concat(x["start_pos"].cast("string"), F.lit(".."), x["end_pos"].cast("string"))), ",")
    return rows.where(F.size("s") > 1).select(key, F.size("s").cast("long").alias("multiplicity"), F.get("s", F.lit(0))["start_pos"].alias("first"), F.array_max(F.transform("s", lambda x: x["end_pos"])).alias("last"), length.alias("length"), text.alias("spans"))


def delete_subtrees(edges: DataFrame, doomed: DataFrame) -> DataFrame:
    """Links (node, parent) that are left when nodes and all their descendants are deleted."""
    gone = subtree(edges, doomed)
    return edges.join(gone, "node", "left_anti").join(gone.withColumnRenamed("node", "parent"), "parent", "left_anti").select("node", "parent")


def add_attribute(attributes: Column, tag: str, value: Column) -> Column:
    """A map of tags to arrays of values with one more value under ``tag``."""
    old = F.coalesce(F.element_at(attributes, F.lit(tag)), F.array().cast("array<string>"))
    return F.map_concat(clear_attribute(attributes, tag), F.create_map(F.lit(tag), F.concat(old, F.array(value))))


def set_attribute(attributes: Column, tag: str, values: list[str]) -> Column:
    """A map of tags to arrays of values with the values of ``tag`` replaced."""
    return F.map_concat(clear_attribute(attributes, tag), F.create_map(F.lit(tag), F.array(*[F.lit(v) for v in values])))


def clear_attribute(attributes: Column, tag: str) -> Column:
    """A map of tags without ``tag``."""
    return F.map_filter(attributes, lambda k, _: k != tag)


def insert_features(nodes: DataFrame, edges: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and links with new (node, parent) rows; a node that exists already, or a parent that does not, raises."""
    known = nodes.withColumn("_known", F.lit(True))
    fresh = new.join(known, "node", "left").join(nodes.unionByName(new.select("node")).distinct().select(F.col("node").alias("parent"), F.lit(True).alias("_parent")), "parent", "left")
    wrong = F.when(F.col("_known"), F.raise_error(F.concat(F.lit("id exists: "), F.col("node")))).when(F.col("parent").isNotNull() & F.col("_parent").isNull(), F.raise_error(F.concat(F.lit("no parent: "), F.col("parent"))))
    checked = fresh.where(wrong.cast("string").isNull())
    return nodes.unionByName(checked.select("node")).distinct(), edges.unionByName(checked.where("parent IS NOT NULL").select("node", "parent")).distinct()


def resolve_parents(parents: Column, which: str = "left", prefer: Column | None = None) -> Column:
    """One parent of several: the first, the last, or ``prefer`` where it is not null (with ``which`` as fallback)."""
    end = F.element_at(F.when(F.size(parents) > 0, parents), -1 if which == "right" else 1)
    return end if prefer is None else F.coalesce(prefer, end)


# Names of strands and phases in feature text.
STRANDS = {"+": "PLUS", "-": "MINUS", ".": "NOSTRAND", "?": "UNKNOWN"}
PHASES = {"0": "ZERO", "1": "ONE", "2": "TWO", ".": "UNSPECIFIED"}


def _decoded(c: Column, names: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), c)


def strand_name(c: Column) -> Column:
    """The strand's name; null for other signs."""
    return _decoded(c, STRANDS)


def phase_name(c: Column) -> Column:
    """The phase's name, of text or a number; null for others."""
    return _decoded(c.cast("string"), PHASES)


def column_names(tables: dict[str, DataFrame], feature_type: str) -> str:
    """The columns of the table of a type as a comma list; empty for a type without one."""
    return ",".join(tables[feature_type].columns) if feature_type in tables else ""


# The columns of a feature row.
FEATURE_SCHEMA = "feature_id string, seqid string, feature_source string, feature_type string, start_pos int, end_pos int, score double, strand string, phase string, parents array<string>, attributes map<string,array<string>>"


def empty_genome(spark) -> DataFrame:
    """A table of features without a row."""
    return spark.createDataFrame([], FEATURE_SCHEMA)


def set_fields(df: DataFrame, chosen: Column, **values: Column | str | int | float | None) -> DataFrame:
    """Features with fields of the chosen rows set; what would break a feature raises when the rows are read.

    A start above the end or below 1, a CDS without a phase, another type with one that is no phase, and an unknown strand
    break a feature.
    """
    out = df
    for name, value in values.items():
        new = value if isinstance(value, Column) else F.lit(value)
        out = out.withColumn(name, F.when(chosen, new).otherwise(F.col(name)).cast(df.schema[name].dataType))
    wrong = (
        F.when((F.col("start_pos") > F.col("end_pos")) | (F.col("start_pos") < 1), "range")
        .when((F.col("feature_type") == "CDS") & ~F.coalesce(F.col("phase").isin("0", "1", "2"), F.lit(False)), "phase of a CDS")
        .when(F.coalesce(~F.col("phase").isin(*PHASES), F.lit(False)), "phase")
        .when(F.coalesce(~F.col("strand").isin(*STRANDS), F.lit(False)), "strand")
    )
    stop = F.raise_error(F.concat(F.lit("feature "), F.coalesce("feature_id", F.lit("?")), F.lit(": "), wrong)).cast("string")
    return out.withColumn("feature_id", F.when(chosen & wrong.isNotNull(), stop).otherwise(F.col("feature_id")))


def add_discontinuity(df: DataFrame, feature_id: str, start_pos: int, end_pos: int, phase: str | None = None) -> DataFrame:
    """Features with one more part of the feature with this id: a row like its first one, with another place."""
    first = df.where(F.col("feature_id") == feature_id).orderBy("start_pos", "end_pos").limit(1)
    part = first.withColumn("start_pos", F.lit(start_pos)).withColumn("end_pos", F.lit(end_pos))
    part = part.withColumn("phase", F.lit(phase)) if phase is not None else part
    return df.unionByName(set_fields(part, F.lit(True)))


def remove_discontinuity(df: DataFrame, feature_id: str, start_pos: int, end_pos: int) -> DataFrame:
    """Features without one part of a feature."""
    return df.where(~((F.col("feature_id") == feature_id) & (F.col("start_pos") == start_pos) & (F.col("end_pos") == end_pos)) | F.col("feature_id").isNull())


def ordered_children(edges: DataFrame, order: list[Column]) -> DataFrame:
    """Links (node, parent, ...) with ``place``, that of the child among its parent's children (from 1)."""
    return edges.withColumn("place", F.row_number().over(Window.partitionBy("parent").orderBy(*order, "node")))


def descendants_of_type(pairs: DataFrame, types: DataFrame, feature_type: str | None = None) -> DataFrame:
    """Pairs (ancestor, node, dist) whose node is of a type; ``types`` is (node, feature_type), distinct."""
    return pairs if feature_type is None else pairs.join(types.where(F.col("feature_type") == feature_type).select("node").distinct(), "node", "left_semi").select(*pairs.columns)


def depth_first(paths: DataFrame) -> DataFrame:
    """Rows with ``path`` (names from the root down) in the order of a walk that takes each subtree before the next."""
    return paths.orderBy("path")
