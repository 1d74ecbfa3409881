"""Derived views over the tables, once per dialect: Spark functions and SQL common table expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genomespark.functions import sequences as S
from genomespark.runtime import clean, table

Query = Callable[[SparkSession, str], DataFrame]


class Book:
    """A collection of named queries with their SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable[[Query], Query]:
        """Register a function under its name."""

        def add(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return add


def dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_id, record_id, seq): all delivered sequences without white space, upper case, U as T and X as N."""
    s = F.regexp_replace("seq", r"\s", "")
    return table(spark, sf_dir, "seq_record").where("seq IS NOT NULL").select(F.col("rec_key").alias("seq_id"), "record_id", S.nucleotides(s).alias("seq"))


DNA = r"dna AS (SELECT rec_key AS seq_id, record_id, translate(upper(regexp_replace(seq, '\s', '', 'g')), 'UX', 'TN') AS seq FROM seq_record WHERE seq IS NOT NULL)"

_LETTERS, _RESIDUES = "abcdefghijklmnopqrstuvwxyz", "ARNDCQEGHILKMFPSTWYVARNDCQ"


def protein(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_id, seq): residues made from the Latin letters of every document."""
    letters = F.regexp_replace(F.lower("text"), "[^a-z]", "")
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("seq_id"), F.translate(letters, _LETTERS, _RESIDUES).alias("seq"))


PROTEIN = f"protein AS (SELECT doc_id AS seq_id, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), '{_LETTERS}', '{_RESIDUES}') AS seq FROM documents WHERE text IS NOT NULL)"


def msa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(aln_id, sample_idx, seq): the reads of 40 letters of each read group as an alignment, N as gap."""
    from pyspark.sql import Window

    reads = table(spark, sf_dir, "sam_record").where((F.length("read_seq") == 40) & F.col("read_group").isNotNull())
    idx = F.row_number().over(Window.partitionBy("read_group").orderBy("record_id")) - 1
    return reads.select(F.col("read_group").alias("aln_id"), "record_id", F.translate("read_seq", "N", "-").alias("seq")).withColumnRenamed("aln_id", "read_group").withColumn("sample_idx", idx).select(F.col("read_group").alias("aln_id"), "sample_idx", "seq")


MSA = "msa AS (SELECT read_group AS aln_id, CAST(row_number() OVER (PARTITION BY read_group ORDER BY record_id) - 1 AS INTEGER) AS sample_idx, translate(read_seq, 'N', '-') AS seq FROM sam_record WHERE length(read_seq) = 40 AND read_group IS NOT NULL)"


def aln(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(block, contig, start0, ref, qry): alignment blocks with gaps on either side, made from the sequences."""
    d = dna(spark, sf_dir)
    ref = F.replace(F.col("seq"), F.lit("GGCA"), F.lit("G--A"))
    qry = F.replace(F.replace(F.col("seq"), F.lit("TACG"), F.lit("T-CG")), F.lit("TTA"), F.lit("TCA"))
    return d.select(F.col("seq_id").alias("block"), F.concat(F.lit("c"), F.pmod(F.col("seq_id"), F.lit(5)).cast("string")).alias("contig"), (F.pmod(F.col("seq_id"), F.lit(7)) * 100).alias("start0"), ref.alias("ref"), qry.alias("qry"))


ALN = DNA + ", aln AS (SELECT seq_id AS block, 'c' || CAST(seq_id % 5 AS VARCHAR) AS contig, (seq_id % 7) * 100 AS start0, replace(seq, 'GGCA', 'G--A') AS ref, replace(replace(seq, 'TACG', 'T-CG'), 'TTA', 'TCA') AS qry FROM dna)"


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gene_key, seqid, gs, ge): genes with sound positions, seqid cleaned."""
    return table(spark, sf_dir, "gene_row").where("start_pos <= end_pos").select("gene_key", F.lower(clean("seqid")).alias("seqid"), F.col("start_pos").alias("gs"), F.col("end_pos").alias("ge")).where("seqid IS NOT NULL")


GENES = r"genes AS (SELECT gene_key, lower(trim(seqid, e' \t\r\n')) AS seqid, start_pos AS gs, end_pos AS ge FROM gene_row WHERE start_pos <= end_pos AND trim(seqid, e' \t\r\n') <> '')"


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, fseq, fs, fe, feature_type): features with sound positions."""
    return table(spark, sf_dir, "gff_feature").where("start_pos <= end_pos AND seqid IS NOT NULL").select("row_id", F.col("seqid").alias("fseq"), F.col("start_pos").alias("fs"), F.col("end_pos").alias("fe"), "feature_type")


FEATURES = "features AS (SELECT row_id, seqid AS fseq, start_pos AS fs, end_pos AS fe, feature_type FROM gff_feature WHERE start_pos <= end_pos AND seqid IS NOT NULL)"
