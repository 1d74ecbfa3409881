"""Readers and writers of the usual text formats.

Line formats are split by Spark; records of several lines are found by a record separator (FASTA, MAF) or by the number of
the line in its file (FASTQ).  Compressed files are read by their suffix, one task a file.  ``path`` may be a file, a
folder or a glob.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from genomespark.operators.rejects import FIELDS, reject_lines, valid_lines
from genomespark.runtime import small_side

# File suffixes of sequence formats.
SUFFIXES = {"fasta": ("fa", "fasta", "fas", "fna", "ffn", "faa", "mpfa", "frn"), "fastq": ("fq", "fastq")}


def format_of(path: str) -> str:
    """The sequence format by suffix, with or without ``.gz``."""
    suffix = path.lower().removesuffix(".gz").rpartition(".")[2]
    for name, suffixes in SUFFIXES.items():
        if suffix in suffixes:
            return name
    raise ValueError(f"no sequence format for {path!r}")


def read_sequences(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """FASTA or FASTQ, by the format given or the suffix."""
    return {"fasta": read_fasta, "fastq": read_fastq}[fmt or format_of(path)](spark, path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value): lines with their number in the file, from 0, without bringing a file into one task.

    Lines are counted per block of a file first; the number is the place in the block plus the lines of the blocks before.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    blocks = raw.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    return raw.join(small_side(blocks.withColumn("before", F.coalesce(before, F.lit(0)))), ["file", "block"]).select("file", (F.col("before") + F.col("id") - F.col("first")).alias("line_no"), "value")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(id, description, seq): the id is the first word after ``>``, the description the whole header with ``>``; lines
    that start with ``;`` are comments; white space in bodies is dropped.  A record without a body has an empty sequence.
    Text before the first header is no record (see :func:`rejected_lines`, which names repeated ids too)."""
    text = spark.read.option("lineSep", "\n>").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    starts = text.where("block = 0").groupBy("file").agg(F.min("id").alias("first")).withColumnRenamed("file", "_file")
    # only the first record of a file still has its sign
    bare = F.regexp_replace("value", r"\A(\s*;[^\n]*\n|\s*\n)*", "")
    placed = text.withColumn("r", bare).join(small_side(starts), (F.col("file") == F.col("_file")) & (F.col("id") == F.col("first")), "left")
    raw = placed.where(F.col("first").isNull() | F.startswith("r", F.lit(">"))).withColumn("r", F.regexp_replace("r", r"\A>", ""))
    header = F.regexp_replace(F.regexp_extract("r", r"\A([^\n]*)", 1), r"\r\z", "")
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace("r", r"\A[^\n]*\n?", ""), r"(?m)^;[^\n]*$", ""), r"\s", "")
    return raw.where(F.col("r").rlike(r"\S")).select(F.regexp_extract(header, r"\A\s*(\S+)", 1).alias("id"), F.concat(F.lit(">"), header).alias("description"), body.alias("seq"))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(id, seq, quality) of strict four-line records; a record whose third line is neither ``+`` nor ``+id``, or whose
    lengths differ, raises."""
    lines = numbered_lines(spark, path).withColumn("rec", F.floor(F.col("line_no") / 4)).withColumn("part", F.pmod("line_no", F.lit(4)))
    at = lambda i: F.max(F.when(F.col("part") == i, F.regexp_replace("value", r"\r\z", "")))
    rows = lines.groupBy("file", "rec").agg(*[at(i).alias(f"l{i}") for i in range(4)]).where("l0 IS NOT NULL AND l0 <> ''")
    name = F.substring("l0", 2, 1_000_000)
    good = F.startswith("l0", F.lit("@")) & ((F.col("l2") == "+") | (F.col("l2") == F.concat(F.lit("+"), name))) & (F.length("l1") == F.length("l3"))
    check = lambda c: F.when(good, F.col(c)).otherwise(F.raise_error(F.concat(F.lit("no FASTQ record: "), F.col("l0"))).cast("string"))
    return rows.select(name.alias("id"), check("l1").alias("seq"), F.col("l3").alias("quality"))


def read_gff(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Valid features, and (file, line_no, line_text, reason) of rejected lines."""
    lines = numbered_lines(spark, path).select("file", "line_no", F.col("value").alias("line_text"), F.concat_ws("#", "file", "line_no").alias("line_key"))
    bad = reject_lines(lines)
    return valid_lines(lines).drop("line_key"), lines.join(bad, "line_key").select("file", "line_no", "line_text", "reason")


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Read alignments of SAM text: the eleven fixed columns, the edit distance and letters by CIGAR operation."""
    from genomespark.operators import reads

    cells = spark.read.text(path).where(~F.startswith("value", F.lit("@"))).select(F.split("value", "\t").alias("c"), "value").where(F.size("c") >= 11)
    cell = lambda i: F.get("c", F.lit(i))
    cigar, flag = cell(5), cell(1).try_cast("int")
    sums = {n: reads.cigar_sum(cigar, op) for n, op in (("num_m", "M"), ("num_eq", "="), ("num_x", "X"), ("num_i", "I"), ("num_d", "D"), ("num_h", "H"), ("num_s", "S"))}
    span = sums["num_m"] + sums["num_eq"] + sums["num_x"] + sums["num_d"] + reads.cigar_sum(cigar, "N")
    nm = F.coalesce(F.regexp_extract("value", r"\tNM:i:(\d+)", 1).try_cast("int"), F.lit(0))
    start = cell(3).try_cast("int")
    cells = cells.where(flag.isNotNull() & start.isNotNull() & cell(4).try_cast("int").isNotNull())
    return cells.select(cell(0).alias("query_name"), flag.alias("flag"), F.when(cell(9) == "*", 0).otherwise(F.length(cell(9))).alias("query_length"), reads.strand(flag).alias("strand"), cell(2).alias("target_name"), start.alias("target_start"), F.when(start > 0, start + span - 1).otherwise(0).alias("target_end"), cell(4).cast("int").alias("map_q"), nm.alias("nm"), *[c.alias(n) for n, c in sums.items()], cell(9).alias("read_seq"))


def read_maf(spark: SparkSession, path: str) -> DataFrame:
    """(score, ref_contig, contig, start0, strand, ref, qry_name, qry_start0, qry_strand, qry_size, qry): the first two
    sequence lines of each alignment block; starts are 0-based."""
    blocks = spark.read.option("lineSep", "\na").text(path).select(F.regexp_replace("value", r"\A(?s)(#[^\n]*\n|\s*\n)*a?", "").alias("b")).where(F.contains("b", F.lit("\ns")))
    lines = F.regexp_extract_all("b", F.lit(r"(?m)^s\s+(.*\S)\s*$"), F.lit(1))
    part = lambda i, k: F.get(F.split(F.get("l", F.lit(i)), r"\s+"), F.lit(k))
    rows = blocks.select(F.regexp_extract("b", r"score=([-+0-9.eE]+)", 1).try_cast("double").alias("score"), lines.alias("l")).where(F.size("l") >= 2)
    return rows.select("score", part(0, 0).alias("ref_contig"), F.regexp_extract(part(0, 0), r"([^.]*)\z", 1).alias("contig"), part(0, 1).cast("long").alias("start0"), part(0, 3).alias("strand"), part(0, 5).alias("ref"), part(1, 0).alias("qry_name"), part(1, 1).cast("long").alias("qry_start0"), part(1, 3).alias("qry_strand"), part(1, 4).cast("long").alias("qry_size"), part(1, 5).alias("qry"))


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """(file, contig, start_pos, end_pos, id, ref_allele, alts, qual, filter, info, samples): a row a record; ``samples``
    are the genotype columns in the order of the file.  END of INFO gives the end, else the length of REF."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value").where(~F.startswith("value", F.lit("#")))
    cells = raw.select("file", F.split("value", "\t").alias("c")).where(F.size("c") >= 8)
    cell = lambda i: F.get("c", F.lit(i))
    start = cell(1).try_cast("int")
    cells = cells.where(start.isNotNull())
    end = F.coalesce(F.regexp_extract(cell(7), r"(?:^|;)END=(\d+)", 1).try_cast("int"), start + F.length(cell(3)) - 1)
    return cells.select("file", cell(0).alias("contig"), start.alias("start_pos"), end.alias("end_pos"), cell(2).alias("id"), cell(3).alias("ref_allele"), F.split(cell(4), ",").alias("alts"), cell(5).alias("qual"), cell(6).alias("filter"), cell(7).alias("info"), F.slice("c", 10, F.greatest(F.size("c") - 9, F.lit(0))).alias("samples"))


def read_alt_headers(spark: SparkSession, path: str) -> DataFrame:
    """Haplotype headers ``##ALT=<...>``: id, description, source, sample, checksums and regions (contig, start, end)."""
    rows = spark.read.text(path).where(F.startswith("value", F.lit("##ALT=<")))
    key = lambda k: F.nullif(F.regexp_extract("value", rf'[<,]{k}=(?:"([^"]*)"|([^,>]*))', 1), F.lit(""))
    bare = lambda k: F.coalesce(key(k), F.nullif(F.regexp_extract("value", rf"[<,]{k}=([^,>\"]*)", 1), F.lit("")))
    region = lambda r: F.struct(F.regexp_extract(r, "^(.*):", 1).alias("contig"), F.regexp_extract(r, r":(\d+)-", 1).try_cast("int").alias("start"), F.regexp_extract(r, r"-(\d+)$", 1).try_cast("int").alias("end"))
    return rows.select(bare("ID").alias("id"), bare("Description").alias("description"), bare("Source").alias("source"), bare("SampleName").alias("sample"), bare("Checksum").alias("checksum"), bare("RefRange").alias("ref_range"), bare("RefChecksum").alias("ref_checksum"), F.transform(F.split(bare("Regions"), ","), region).alias("regions"))


def vcf_samples(spark: SparkSession, path: str) -> DataFrame:
    """(file, samples): the names of each file's sample columns, from its header line."""
    head = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value").where(F.startswith("value", F.lit("#CHROM")))
    return head.select("file", F.split(F.regexp_replace("value", r"\r\z", ""), "\t").alias("c")).select("file", F.slice("c", 10, F.greatest(F.size("c") - 9, F.lit(0))).alias("samples"))


def read_vcf_calls(spark: SparkSession, path: str) -> DataFrame:
    """(file, sample_name, contig, start_pos, end_pos, ref_allele, alts, genotype): a row for each sample of each record.

    Alternatives are those that some genotype of the record uses, and the genotypes count over them; an alternative ``N``
    becomes ``.`` and ``*`` becomes ``<DEL>``.  A record whose columns are not nine and one for each sample is no record: it
    comes out of :func:`rejected_lines`.
    """
    from genomespark.operators.variants import genotype_indices, used_alleles

    names = vcf_samples(spark, path).withColumnRenamed("samples", "names")
    rows = read_vcf(spark, path).join(names, "file").where(F.size("samples") == F.size("names"))
    plain = F.transform("alts", lambda a: F.when(a == "N", ".").when(a == "*", "<DEL>").otherwise(a))
    rows = rows.withColumn("_used", used_alleles(F.transform("samples", genotype_indices))).withColumn("_alts", F.filter(plain, lambda a: a != "."))
    each = rows.withColumn("_at", F.explode(F.sequence(F.lit(0), F.size("names") - 1)))
    text = F.substring_index(F.get("samples", F.col("_at")), ":", 1)
    new = F.transform(genotype_indices(text), lambda i: F.when(i < 0, ".").when(i == 0, "0").otherwise(F.array_position("_used", i).cast("string")))
    genotype = F.when(F.contains(text, F.lit("|")), F.array_join(new, "|")).otherwise(F.array_join(new, "/"))
    alts = F.transform("_used", lambda i: F.coalesce(F.get(plain, i - 1), F.lit(".")))
    return each.select("file", F.get("names", F.col("_at")).alias("sample_name"), "contig", "start_pos", "end_pos", "ref_allele", alts.alias("alts"), genotype.alias("genotype"))


def rejected_lines(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """(file, line_no, line_text, reason) of the lines that the reader of ``sam``, ``vcf``, ``bed`` or ``fasta`` leaves out.

    ``columns``: fewer columns than the format has (in ``vcf`` also not nine and one for each sample, where the header names
    samples); ``position``: no whole number where the format has a position; ``header``: FASTA text before the first
    header; ``duplicate``: a FASTA header whose id came before.
    """
    lines = numbered_lines(spark, path).withColumn("value", F.regexp_replace("value", r"\r\z", ""))
    out = lambda df: df.where("reason IS NOT NULL").select("file", "line_no", F.col("value").alias("line_text"), "reason")
    if fmt == "fasta":
        heads = lines.where(F.startswith("value", F.lit(">")))
        first = heads.groupBy("file").agg(F.min("line_no").alias("_first"))
        body = lines.where(F.col("value").rlike(r"^[^>;\s]|^\s+[^;\s]")).join(first, "file", "left")
        early = body.withColumn("reason", F.when(F.col("_first").isNull() | (F.col("line_no") < F.col("_first")), "header"))
        name = F.regexp_extract("value", r"\A>\s*(\S+)", 1)
        again = heads.withColumn("_id", name).withColumn("_no", F.row_number().over(Window.partitionBy("_id").orderBy("file", "line_no"))).withColumn("reason", F.when(F.col("_no") > 1, "duplicate"))
        return out(early).unionByName(out(again))
    least, places, skip = {"sam": (11, (1, 3, 4), "^@"), "vcf": (8, (1,), "^#"), "bed": (3, (1, 2), r"^(#|track|browser|\s*$)")}[fmt]
    cells = lines.where(~F.col("value").rlike(skip)).withColumn("c", F.split("value", "\t"))
    wrong = F.size("c") < least
    if fmt == "vcf":
        cells = cells.join(vcf_samples(spark, path), "file", "left")
        wrong = wrong | ((F.size("samples") > 0) & (F.size("c") != F.size("samples") + 9))
    no_number = F.lit(False)
    for i in places:
        no_number = no_number | ~F.coalesce(F.get("c", F.lit(i)).rlike(r"\A[0-9]{1,10}\z"), F.lit(False))
    return out(cells.withColumn("reason", F.when(wrong, "columns").when(no_number, "position")))


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, start_pos, end_pos, name, score): 0-based half-open rows as 1-based closed ranges."""
    cells = spark.read.text(path).where(~F.col("value").rlike(r"^(#|track|browser|\s*$)")).select(F.split("value", "\t").alias("c"))
    cell = lambda i: F.get("c", F.lit(i))
    sound = cells.where((F.size("c") >= 3) & cell(1).try_cast("int").isNotNull() & cell(2).try_cast("int").isNotNull())
    return sound.select(cell(0).alias("chrom"), (cell(1).cast("int") + 1).alias("start_pos"), cell(2).cast("int").alias("end_pos"), cell(3).alias("name"), cell(4).try_cast("double").alias("score"))


def read_kmers(spark: SparkSession, path: str) -> DataFrame:
    """(kmer, n) of k-mer text; rows without a count count once."""
    cells = spark.read.text(path).where(~F.startswith("value", F.lit("#"))).select(F.split("value", "\t").alias("c"))
    return cells.where(F.get("c", F.lit(0)) != "").select(F.get("c", F.lit(0)).alias("kmer"), F.coalesce(F.get("c", F.lit(1)).try_cast("long"), F.lit(1)).alias("n"))


def read_kmer_header(spark: SparkSession, path: str) -> dict[str, str]:
    """The key:value pairs of the header line."""
    first = spark.read.text(path).where(F.startswith("value", F.lit("#"))).limit(1).collect()
    return dict(x.split(":", 1) for x in first[0].value[1:].split(",")) if first else {}


def _write(lines: Column, df: DataFrame, path: str, compression: str | None, mode: str) -> None:
    writer = df.select(lines.alias("value")).write.mode(mode)
    (writer.option("compression", compression) if compression else writer).text(path)


def wrapped(c: Column, width: int = 60) -> Column:
    """Text with a line break after every ``width`` letters."""
    return F.regexp_replace(F.regexp_replace(c, f"(.{{{width}}})", "$1\n"), r"\n\z", "")


def write_fasta(df: DataFrame, path: str, width: int | None = 60, compression: str | None = None, mode: str = "errorifexists") -> None:
    """id and seq as FASTA, wrapped unless ``width`` is None."""
    body = wrapped(F.col("seq"), width) if width else F.col("seq")
    _write(F.concat(F.lit(">"), F.col("id"), F.lit("\n"), body), df, path, compression, mode)


def write_fastq(df: DataFrame, path: str, compression: str | None = None, mode: str = "errorifexists") -> None:
    """id, seq and quality as FASTQ."""
    _write(F.concat(F.lit("@"), F.col("id"), F.lit("\n"), F.col("seq"), F.lit("\n+\n"), F.col("quality")), df, path, compression, mode)


def write_bed(df: DataFrame, path: str, compression: str | None = None, mode: str = "errorifexists") -> None:
    """chrom, start_pos, end_pos (1-based closed) and name as BED."""
    _write(F.concat_ws("\t", "chrom", (F.col("start_pos") - 1).cast("string"), F.col("end_pos").cast("string"), "name"), df, path, compression, mode)


def write_gff(df: DataFrame, path: str, compression: str | None = None, mode: str = "errorifexists") -> None:
    """Features with the columns of :func:`read_gff` as GFF text."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    names = ["seqid", "feature_source", "feature_type", "start_pos", "end_pos", "score", "strand", "phase", "attributes"]
    assert len(names) == len(FIELDS)
    _write(F.concat_ws("\t", *[text(c) for c in names]), df, path, compression, mode)


def write_vcf(df: DataFrame, path: str, samples: list[str], headers: list[str] | None = None, compression: str | None = None, mode: str = "errorifexists") -> None:
    """Records as VCF text, sorted; every part of the output begins with the header lines.

    Columns ``info`` and ``format`` are written where there are any, else the end of the record and ``GT``.
    """
    head = "\n".join([*(headers or ["##fileformat=VCFv4.2"]), "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples])])
    info = F.col("info") if "info" in df.columns else F.concat(F.lit("END="), F.col("end_pos").cast("string"))
    fmt = F.col("format") if "format" in df.columns else F.lit("GT")
    line = F.concat_ws("\t", "contig", F.col("start_pos").cast("string"), F.lit("."), "ref_allele", F.array_join("alts", ","), F.lit("."), F.lit("."), info, fmt, F.array_join("genotypes", "\t"))
    body = df.repartitionByRange("contig", "start_pos").sortWithinPartitions("contig", "start_pos").select(line.alias("value"), F.monotonically_increasing_id().alias("i"))
    first = F.pmod("i", F.lit(1 << 33)) == 0
    _write(F.when(first, F.concat(F.lit(head + "\n"), F.col("value"))).otherwise(F.col("value")), body, path, compression, mode)


def write_wiggle(df: DataFrame, path: str, compression: str | None = None, mode: str = "errorifexists") -> None:
    """(chrom, pos, value) as fixed-step tracks, a file part per range of chromosomes; positions count from 1."""
    order = Window.partitionBy("chrom").orderBy("pos")
    opens = F.coalesce(F.col("pos") != F.lag("pos").over(order) + 1, F.lit(True))
    rows = df.withColumn("line", F.when(opens, F.concat(F.lit("fixedStep chrom="), F.col("chrom"), F.lit(" start="), F.col("pos").cast("string"), F.lit(" step=1\n"), F.col("value").cast("string"))).otherwise(F.col("value").cast("string")))
    _write(F.col("line"), rows.repartitionByRange("chrom", "pos").sortWithinPartitions("chrom", "pos"), path, compression, mode)


def write_kmers(df: DataFrame, path: str, header: dict[str, str], compression: str | None = None, mode: str = "errorifexists") -> None:
    """(kmer, n) in the order of the codes, each part with the header line."""
    from genomespark.functions.kmers import digits

    rows = df.repartitionByRange(digits(F.col("kmer"))).sortWithinPartitions(digits(F.col("kmer"))).withColumn("i", F.monotonically_increasing_id())
    head = "#" + ",".join(f"{k}:{v}" for k, v in header.items()) + "\n"
    line = F.concat("kmer", F.lit("\t"), F.col("n").cast("string"))
    _write(F.when(F.pmod("i", F.lit(1 << 33)) == 0, F.concat(F.lit(head), line)).otherwise(line), rows, path, compression, mode)


# The FORMAT and INFO lines of generated variant files.
VCF_HEADERS = [
    "##fileformat=VCFv4.2",
    '##FORMAT=<ID=AD,Number=3,Type=Integer,Description="Allelic depths for the ref and alt alleles in the order listed">',
    '##FORMAT=<ID=DP,Number=1,Type=Integer,Description="Read Depth (only filtered reads used for calling)">',
    '##FORMAT=<ID=GQ,Number=1,Type=Integer,Description="Genotype Quality">',
    '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">',
    '##FORMAT=<ID=PL,Number=3,Type=Integer,Description="Normalized, Phred-scaled likelihoods for genotypes">',
    '##INFO=<ID=DP,Number=1,Type=Integer,Description="Total Depth">',
    '##INFO=<ID=NS,Number=1,Type=Integer,Description="Number of Samples With Data">',
    '##INFO=<ID=AF,Number=3,Type=Integer,Description="Allele Frequency">',
    '##INFO=<ID=END,Number=1,Type=Integer,Description="Stop position of the interval">',
    '##INFO=<ID=ASM_Chr,Number=1,Type=String,Description="Assembly chromosome">',
    '##INFO=<ID=ASM_Start,Number=1,Type=Integer,Description="Assembly start position">',
    '##INFO=<ID=ASM_End,Number=1,Type=Integer,Description="Assembly end position">',
    '##INFO=<ID=ASM_Strand,Number=1,Type=String,Description="Assembly strand">',
]


def contig_headers(sizes: list[tuple[str, int]]) -> list[str]:
    """``##contig`` lines of a sequence dictionary."""
    return [f"##contig=<ID={name},length={length}>" for name, length in sizes]


def two_names(name: str) -> tuple[str, str]:
    """Two output names: those of a comma list, or the name with ``_1`` and ``_2`` before its suffix."""
    if "," in name:
        first, second = name.split(",", 1)
        return first.strip(), second.strip()
    for suffix in (".g.vcf.gz", ".g.vcf", ".gvcf", ".vcf.gz", ".vcf"):
        if name.endswith(suffix):
            return name.removesuffix(suffix) + "_1" + suffix, name.removesuffix(suffix) + "_2" + suffix
    return f"{name}_1", f"{name}_2"


def write_matrix(df: DataFrame, row: str, column: str, value: str, path: str, names: list[str], mode: str = "errorifexists") -> None:
    """A long table of pairs as a tab-separated matrix; ``names`` are the columns in their order."""
    df.groupBy(row).pivot(column, names).agg(F.first(value)).write.mode(mode).option("sep", "\t").option("header", True).csv(path)


def write_parts(df: DataFrame, part: str, lines: Column, path: str, mode: str = "errorifexists") -> None:
    """Lines in one folder per value of ``part`` (such as a BED range); a part is written by many tasks if it is large."""
    df.select(part, lines.alias("value")).write.mode(mode).partitionBy(part).text(path)


def ranges_of_known_contigs(bed: DataFrame, sequences: DataFrame) -> DataFrame:
    """BED ranges whose contig is among the sequences (id, seq), with the letters they span."""
    met = bed.join(sequences.select(F.col("id").alias("chrom"), "seq"), "chrom")
    return met.where(F.col("end_pos") <= F.length("seq")).withColumn("seq", F.substring(F.col("seq"), F.col("start_pos"), F.col("end_pos") - F.col("start_pos") + 1))
