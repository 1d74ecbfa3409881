"""Session helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder in ``spark.checkpoint.dir``; a local master may do without one, a cluster may not.

    Files of checkpoints go with their tables where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="genomespark-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, which survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def counted_cut(df: DataFrame) -> tuple[DataFrame, int]:
    """As :func:`cut`, with the number of rows, counted while they are written."""
    seen = Observation()
    done = cut(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return done, seen.get["n"]


def small_side(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """The table, counted, for a join: marked for broadcast if it has at most ``rows`` rows, else as it is."""
    done, n = counted_cut(df)
    return F.broadcast(done) if n <= rows else done


def clean(text: Column | str) -> Column:
    """The text without surrounding white space; null where nothing is left."""
    text = F.col(text) if isinstance(text, str) else text
    bare = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(bare != "", bare)


def fingerprint(columns: list[str]) -> list[Column]:
    """Two 64-bit hashes over the columns, nulls included, as ``__h1`` and ``__h2``.

    The hash function skips nulls, so a bit string of the null places goes in first; the two hashes start from
    different literals and are in practice a 128-bit fingerprint.
    """
    nulls = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in columns])
    return [F.xxhash64(F.lit(seed), nulls, *columns).alias(name) for seed, name in ((17, "__h1"), (7_919, "__h2"))]


def without_redeliveries(df: DataFrame, ignoring: list[str]) -> list[str]:
    """The columns in which a redelivered row repeats an earlier one."""
    return [c for c in df.columns if c not in ignoring]
