"""Structured Streaming over folders that feature and read files arrive in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genomespark.operators.rejects import split_lines


def stream_lines(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """(file, value): lines of files as they arrive."""
    return spark.readStream.option("maxFilesPerTrigger", max_files).text(folder).select(F.col("_metadata.file_path").alias("file"), "value")


def stream_structure(lines: DataFrame, text: str = "value") -> DataFrame:
    """Lines of a stream with their structural reason (quoting, columns) or null; no state is kept."""
    names = F.array(F.lit("quoting"), F.lit("columns"))
    return split_lines(lines, text).select(*lines.columns, F.when(F.col("_structure").isNotNull(), F.get(names, F.col("_structure"))).alias("reason"))


def stream_counts(rows: DataFrame, time: str, keys: list[str], width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Rows per window of event time and keys; rows later than ``late`` behind the watermark are ignored."""
    return rows.withWatermark(time, late).groupBy(F.window(time, width), *keys).count()
