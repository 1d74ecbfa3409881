"""The named queries of the training-data operators in this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genomespark.llm.leaks import proximity_matches, shared_passages
from genomespark.llm.pieces import bisect_pieces, bisected_lengths, forward_pieces, latest_rows, measured_runs, pieces_of_lengths, split_records, unknown_runs
from genomespark.llm.runs import collapse_runs, is_ref_block
from genomespark.llm.sentences import sentence_units
from genomespark.llm.tokens import encode_corpus
from genomespark.runtime import fingerprint, table, without_redeliveries


def _pieces(spark: SparkSession, sf_dir: str, cut, boundaries, of_lengths) -> DataFrame:
    """The pieces of all records; of records without text the latest known length counts."""
    records, stats = table(spark, sf_dir, "seq_record"), table(spark, sf_dir, "chrom_stats")
    pieces, silent = split_records(records, "record_id", "seq", ["loaded_at", "rec_key"], cut=cut, boundaries=boundaries)
    last = latest_rows(stats.select(F.col("contig").alias("record_id"), "num_region_bps", "loaded_at", "stats_id"), "record_id", "loaded_at")
    known = of_lengths(silent.join(last, "record_id").select("record_id", "num_region_bps"), "record_id", "num_region_bps")
    out = pieces.unionByName(known)
    return out.select("record_id", *[F.col(c).cast("int").alias(c) for c in ("piece_no", "piece_start", "piece_end")])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir, forward_pieces, unknown_runs, pieces_of_lengths)


def p1_bisected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same records by recursive bisection (other cuts than p1_found's, see README)."""
    return _pieces(spark, sf_dir, bisect_pieces, measured_runs, bisected_lengths)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "simple_variant").where("contig IS NOT NULL")
    same = without_redeliveries(rows, ["variant_id", "loaded_at"])
    needed = ["sample_name", "contig", "start_pos", "end_pos", "is_ref_block", "genotype"]
    once = (
        rows.select(*fingerprint(same), "variant_id", "loaded_at", *needed)
        .groupBy("__h1", "__h2")
        .agg(F.min_by(F.struct("variant_id", *needed), F.struct("loaded_at", "variant_id")).alias("r"))
        .select("r.*")
    )
    return collapse_runs(once, ["sample_name", "contig"], "start_pos", "end_pos", "variant_id", is_ref_block("is_ref_block", "genotype"), max_gap=10)


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and items with the longest shared run and the number of the item's words that were found."""
    return shared_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_passages(spark, sf_dir).select("doc_id", "item_id")


def p9_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and items of which 20 of some 25 consecutive words stand in the document at one offset."""
    return proximity_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_units(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_bisected": p1_bisected,
    "p6_found": p6_found,
    "p8_ids": p8_ids,
    "p9_found": p9_found,
    "p9_passages": p9_passages,
    "p9_proximity": p9_proximity,
    "p10_found": p10_found,
}
