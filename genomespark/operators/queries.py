"""The named queries of the training-data operators of the core."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genomespark.operators.hierarchy import descendants, expand_hierarchy, links
from genomespark.operators.packed import explode_packed
from genomespark.operators.periods import periods
from genomespark.operators.rejects import reject_lines, valid_lines
from genomespark.operators.skew import dominant_keys, profile_by_key
from genomespark.runtime import clean, fingerprint, table, without_redeliveries


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reject_lines(table(spark, sf_dir, "gff_line").select("line_key", "line_text"))


def p2_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid lines as typed features."""
    return valid_lines(table(spark, sf_dir, "gff_line").select("line_key", "file_name", "line_number", "line_text"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = links(table(spark, sf_dir, "gff_feature"), "feature_id", "parents")
    return expand_hierarchy(nodes, edges).select(F.col("node").alias("feature_id"), F.col("root").alias("root_id"), F.col("depth").alias("node_depth"))


def p3_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As p3_found, with the path from the root down."""
    nodes, edges = links(table(spark, sf_dir, "gff_feature"), "feature_id", "parents")
    out = expand_hierarchy(nodes, edges, with_path=True)
    return out.select(F.col("node").alias("feature_id"), F.col("root").alias("root_id"), F.col("depth").alias("node_depth"), F.array_join("path", " > ").alias("node_path"))


def p3_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a feature and a feature below it, with the smallest number of links."""
    nodes, edges = links(table(spark, sf_dir, "gff_feature"), "feature_id", "parents")
    return descendants(nodes, edges).select(F.col("ancestor").alias("feature_id"), F.col("node").alias("descendant_id"), F.col("dist").alias("n_links"))


def _profile(df: DataFrame, name: str, row_key: str, aggregates: dict) -> DataFrame:
    same = without_redeliveries(df, [row_key, "loaded_at"])
    key = clean(name)
    rows = df.withColumn("_key", F.when(key != "*", key)).where("_key IS NOT NULL").select("*", *fingerprint(same))
    return profile_by_key(rows, "_key", ["__h1", "__h2"], aggregates)


def p4_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per target: distinct reads, the stretch they cover and their aligned letters."""
    reads = table(spark, sf_dir, "sam_record")
    letters = F.col("num_m") + F.col("num_eq") + F.col("num_x")
    out = _profile(reads, "target_name", "record_id", {"first_start": (F.col("target_start"), "min"), "last_end": (F.col("target_end"), "max"), "n_letters": (letters.cast("long"), "sum")})
    return out.withColumnRenamed("_key", "target_name")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for name, column, key in (("sam_record", "target_name", "record_id"), ("simple_variant", "contig", "variant_id")):
        counts = _profile(table(spark, sf_dir, name), column, key, {})
        parts.append(dominant_keys(counts, "_key", 0.05).select(F.lit(f"{name}.{column}").alias("field_name"), F.col("_key").alias("key_value")))
    return parts[0].unionByName(parts[1])


def _packed(spark: SparkSession, sf_dir: str, least: int) -> DataFrame:
    features, variants = table(spark, sf_dir, "gff_feature"), table(spark, sf_dir, "simple_variant")
    parts = [
        explode_packed(features, "row_id", "attributes", "attributes", least).withColumn("field_name", F.lit("attributes")),
        explode_packed(variants.select(F.col("variant_id").alias("row_id"), "alt_alleles"), "row_id", "alt_alleles", "alleles", least).withColumn("field_name", F.lit("alt_alleles")),
    ]
    return parts[0].unionByName(parts[1])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir, 2).select("field_name", "row_id", "item_no", "item_tag", "item_value")


def p5_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value, those alone in their field too, with its place in the field and whether it is malformed."""
    return _packed(spark, sf_dir, 1).select("field_name", "row_id", "item_no", "item_tag", "item_value", "item_start", "item_end", "malformed")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    genes = table(spark, sf_dir, "gene_row")
    return periods(genes.select("assembly_id", F.lower(clean("seqid")).alias("seqid"), "start_pos", "end_pos"), ["assembly_id", "seqid"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p2_found": p2_found,
    "p2_valid": p2_valid,
    "p3_found": p3_found,
    "p3_paths": p3_paths,
    "p3_descendants": p3_descendants,
    "p4_found": p4_found,
    "p4_targets": p4_targets,
    "p5_found": p5_found,
    "p5_places": p5_places,
    "p7_found": p7_found,
}
