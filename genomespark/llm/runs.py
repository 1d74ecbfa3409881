"""Runs of consecutive events collapsed into one, by boundary-only rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genomespark.operators.ordered import Chunks
from genomespark.operators.skew import ROWS


def is_ref_block(flag: str, genotype: str) -> Column:
    """What the flag says; where it is null, whether every allele index of the genotype's first token is 0."""
    first = F.substring_index(genotype, ":", 1)
    return F.coalesce(F.col(flag), F.btrim(first).rlike(r"\A0([/|]0)*\z"), F.lit(False))


def collapse_runs(df: DataFrame, keys: list[str], start: str, end: str, tie: str, member: Column, max_gap: int, least: int = 2, rows: int = ROWS) -> DataFrame:
    """(keys, first_start, last_end, n_records): a row per run of at least ``least`` members.

    Rows of a key are ordered by start, end, tie.  A member continues the run if the row before it belongs to the run
    and at most ``max_gap`` uncovered positions lie between the run's furthest end and its start.  Rows with a null key
    or position are left out; an end before its start counts as the start.  An empty table gives no rows.

    Within a chunk of about ``rows`` rows only boundary rows are kept: rows that open a run, that go on with the run of the
    chunk before, or that end one.  ``lead`` over their row numbers gives the counts, and the furthest end seen before the
    next boundary gives the stretch.  What a chunk must know of those before it are carries of one row a chunk: how far
    the open streak reaches, and how many runs were opened.
    """
    each = df.dropna(subset=[*keys, start, end]).select(*keys, F.col(start).alias("_s"), F.greatest(start, end).alias("_e"), F.col(tie).alias("_t"), member.alias("_m"))
    c = Chunks(each, keys, ["_s", "_e", "_t"], rows)
    whole = Window.partitionBy(*c.group)

    # members of one streak share the number of strangers before them; starts ascend, so ends of earlier runs do not matter
    ends = F.when(F.col("_m"), F.struct("_k", "_e"))
    streak = c.df.withColumn("_k", F.sum(F.when(F.col("_m"), 0).otherwise(1)).over(c.upto))
    # the streak that is open when a chunk begins: of the chunks since the last stranger, each of which leaves it open
    summary = {"_strangers": F.max("_k"), "_end": F.max(ends)}
    upto = c.order.rowsBetween(Window.unboundedPreceding, 0)
    since = Window.partitionBy(*keys, "_total").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, 0)
    left_open = F.when(F.col("_end._k") == F.col("_strangers"), F.col("_end._e"))
    steps = [{"_total": F.sum("_strangers").over(upto), "_open": left_open}, {"_reach": F.max("_open").over(since)}]
    known = c.carried(streak, summary, {"_far0": F.lag("_reach").over(c.order)}, steps)
    reach = known.withColumn("_n", F.row_number().over(c.here)).withColumn("_far", F.max(ends).over(c.before)).withColumn("_stretch_end", F.max(ends).over(c.upto))
    own = F.when(F.col("_far._k") == F.col("_k"), F.col("_far._e"))
    far = F.when(F.col("_k") == 0, F.greatest(own, "_far0")).otherwise(own)
    linked = F.coalesce(F.col("_s") - far - 1 <= max_gap, F.lit(False))
    edge = reach.withColumn("_o", F.col("_m") & ~linked).withColumn("_was", F.lag("_m").over(c.here)).withColumn("_prev", F.lag("_stretch_end").over(c.here))
    edge = edge.withColumn("_j", F.sum(F.col("_o").cast("int")).over(c.upto)).withColumn("_last", F.max(ends).over(whole)).withColumn("_all", F.count("*").over(whole))
    bounds = edge.where(F.col("_o") | (F.col("_m") & (F.col("_n") == 1)) | (~F.col("_m") & F.col("_was")))
    parts = bounds.withColumn("_next", F.lead("_n").over(c.here)).withColumn("_to", F.lead("_prev").over(c.here)).where("_m")
    parts = parts.select(*c.group, "_j", F.col("_s").alias("first_start"), F.coalesce("_to._e", "_last._e").alias("last_end"), (F.coalesce(F.col("_next"), F.col("_all") + 1) - F.col("_n")).alias("n"))
    # a part without an opener goes on with the last run that was opened in the chunks before
    numbered = c.carried(parts, {"_opened": F.max("_j")}, {"_offset": F.sum("_opened").over(c.earlier)})
    run = F.coalesce("_offset", F.lit(0)) + F.col("_j")
    runs = numbered.groupBy(*keys, run.alias("_run")).agg(F.min("first_start").alias("first_start"), F.max("last_end").alias("last_end"), F.sum("n").alias("n"))
    return runs.where(F.col("n") >= least).select(*keys, "first_start", "last_end", F.col("n").cast("int").alias("n_records"))
