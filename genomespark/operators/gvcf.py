"""From alignment blocks to variant records, and from the variant files of many samples to one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genomespark.operators import alignments as M
from genomespark.operators import variants as V
from genomespark.sources import text

#: Columns of :func:`variant_records`.
COLUMNS = ["contig", "start_pos", "end_pos", "ref_allele", "alts", "info", "format", "genotypes", "kind", "asm_chr", "asm_start", "asm_end", "asm_strand"]


def variant_records(
    blocks: DataFrame, reference: DataFrame, fill_gaps: bool = False, output: str = "gvcf", just_gt: bool = False, symbolic_deletions: bool = False, max_deletion: int | None = None
) -> DataFrame:
    """The records of one sample from its alignment blocks, with :data:`COLUMNS`.

    ``blocks`` are those of ``read_maf``; ``reference`` is (contig, seq).  Reference blocks and blocks of unknown letters
    are one record each, ``output='vcf'`` leaves them out.  ``fill_gaps`` adds missing records for what no block covers.
    Deletions become symbolic if ``symbolic_deletions`` says so, or where more than ``max_deletion`` letters go.
    ``just_gt`` leaves depths and likelihoods out.  Blocks on contigs that the reference lacks give no record; an empty
    table gives none.
    """
    name = F.regexp_extract("qry_name", r"([^.]*)\z", 1)
    placed = blocks.withColumn("asm_chr", name)
    letter = lambda at: F.upper(F.substring(F.col("seq"), at.cast("int"), F.lit(1)))
    known = placed.join(reference.select("contig", "seq"), "contig").withColumn("_before", F.when(F.col("start0") > 0, letter(F.col("start0"))).otherwise("")).drop("seq")
    calls = M.call_blocks(known, ["contig", "asm_chr", "qry_strand"], assembly=("qry_start0", "qry_strand", "qry_size"), base_before="_before")
    rows = calls.select("contig", F.col("v_start").alias("start_pos"), F.col("v_end").alias("end_pos"), "ref", "alt", "kind", "asm_chr", "asm_start", "asm_end", F.col("qry_strand").alias("asm_strand"))
    if fill_gaps:
        ends = rows.select("contig", F.col("start_pos").alias("v_start"), F.col("end_pos").alias("v_end"))
        sizes = reference.select("contig", F.length("seq").alias("size"))
        bare = M.fill_gaps(ends, sizes, "contig").join(reference.select("contig", "seq"), "contig")
        empty = [F.lit(None).cast(t).alias(n) for n, t in (("asm_chr", "string"), ("asm_start", "int"), ("asm_end", "int"), ("asm_strand", "string"))]
        gaps = bare.select("contig", F.col("v_start").cast("int").alias("start_pos"), F.col("v_end").cast("int").alias("end_pos"), letter(F.col("v_start")).alias("ref"), F.lit("N").alias("alt"), F.lit("missing").alias("kind"), *empty)
        rows = rows.unionByName(gaps)
    if output == "vcf":
        rows = rows.where("kind = 'variant'")
    block = F.col("kind") != "variant"
    ref, missing = F.when(block, F.substring("ref", 1, 1)).otherwise(F.col("ref")), F.col("kind") == "missing"
    long = 0 if symbolic_deletions else max_deletion
    shown = M.variant_columns(ref, F.when(block, ".").otherwise(F.col("alt")), missing, long)
    alleles = F.split(shown["alleles"], ",")
    asm = F.concat(F.lit("ASM_Chr="), "asm_chr", F.lit(";ASM_End="), F.col("asm_end").cast("string"), F.lit(";ASM_Start="), F.col("asm_start").cast("string"), F.lit(";ASM_Strand="), "asm_strand")
    info = F.concat_ws(";", asm, F.concat(F.lit("END="), F.col("end_pos").cast("string")))
    parts = [shown["gt"]] if just_gt else [shown["gt"], shown["ad"], shown["dp"].cast("string"), shown["pl"]]
    return rows.withColumn("ref_allele", F.get(alleles, F.lit(0))).withColumn("alts", F.slice(alleles, 2, 3)).withColumn("info", info).withColumn("format", F.lit("GT" if just_gt else "GT:AD:DP:PL")).withColumn("genotypes", F.array(F.concat_ws(":", *parts))).select(*COLUMNS)


def maf_to_variants(spark: SparkSession, maf: str, reference: str, sample: str, out: str, two_files: bool = False, **options) -> list[str]:
    """A MAF file (or folder) as a variant file of one sample; the paths written.  ``options`` are those of
    :func:`variant_records`.

    ``two_files`` deals the alignments of a diploid assembly to two haplotypes, each completed by the other, and writes
    ``sample_1`` and ``sample_2``.  A third alignment over a place raises.
    """
    blocks = text.read_maf(spark, maf)
    letters = text.read_fasta(spark, reference).select(F.col("id").alias("contig"), "seq")
    contigs = [(r.contig, r.n) for r in letters.select("contig", F.length("seq").alias("n")).orderBy("contig").collect()]  # a header line each
    head = [*text.VCF_HEADERS, *text.contig_headers(contigs)]
    if not two_files:
        text.write_vcf(variant_records(blocks, letters, **options), out, [sample], head)
        return [out]
    named = blocks.withColumn("block", F.xxhash64(*blocks.columns))
    dealt = M.fill_haplotypes(named.select("contig", "block", "start0", "ref", "qry"))
    if not dealt.where("haplotype = 0").isEmpty():
        raise ValueError("more than two alignments overlap")
    whole = named.drop("contig", "start0", "ref", "qry").dropDuplicates(["block"])
    written = []
    for i, (path, name) in enumerate(zip(text.two_names(out), (f"{sample}_1", f"{sample}_2")), 1):
        side = dealt.where(F.col("haplotype") == i).join(whole, "block")
        text.write_vcf(variant_records(side, letters, **options), path, [name], head)
        written.append(path)
    return written


def merged_records(calls: DataFrame, all_samples: DataFrame) -> DataFrame:
    """(contig, pos, ref, alts, genotypes): SNP sites over the calls of :func:`genomespark.sources.text.read_vcf_calls`.

    ``genotypes`` has an entry ``sample=alleles`` for every name of ``all_samples`` (sample_name), in order; ``.`` where the
    sample has no record there.
    """
    kinds = V.classify(F.col("ref_allele"), F.col("alts"), F.col("genotype"))
    sites = calls.where(kinds["is_snp"]).select("contig", F.col("start_pos").alias("pos")).distinct()
    met = V.covering(sites, calls, "contig", "pos", "start_pos", "end_pos")
    pick = F.struct((-F.col("start_pos")).alias("s"), "end_pos", "ref_allele")
    one = met.groupBy("contig", "pos", "sample_name").agg(F.min_by(F.struct("start_pos", "end_pos", "ref_allele", "alts", "genotype"), pick).alias("v")).select("contig", "pos", "sample_name", "v.*")
    merged = V.merged_calls(one, ["contig", "pos"])
    names = all_samples.agg(F.array_sort(F.collect_set("sample_name")).alias("_names"))  # as many as columns of the result
    shown = F.str_to_map("genotypes", F.lit(";"), F.lit("="))
    full = F.transform("_names", lambda n: F.concat(n, F.lit("="), F.coalesce(F.element_at(shown, n), F.lit("."))))
    return merged.join(F.broadcast(names)).withColumn("genotypes", full).drop("_names")


def merge_variant_files(spark: SparkSession, paths: str, out: str, bed: str | None = None) -> list[str]:
    """The variant files of single samples as one file of SNP sites; the names of its samples.

    A file with another number of samples than one, a name that comes twice, or a file whose positions overlap within a
    contig raises.  With ``bed``, sites go to a folder for each range of it that holds them.
    """
    named = text.vcf_samples(spark, paths)
    wrong = named.where(F.size("samples") != 1).select("file").take(1)
    if wrong:
        raise ValueError(f"not one sample in {wrong[0].file}")
    each = named.select(F.get("samples", F.lit(0)).alias("sample_name"))
    twice = each.groupBy("sample_name").count().where("count > 1").take(1)
    if twice:
        raise ValueError(f"sample {twice[0].sample_name} comes twice")
    disorder = unordered_records(spark, paths).take(1)
    if disorder:
        raise ValueError(f"positions overlap in {disorder[0].file}: {disorder[0].contig}:{disorder[0].start_pos}")
    samples = [r.sample_name for r in each.orderBy("sample_name").collect()]  # the columns of the header
    sites = merged_records(text.read_vcf_calls(spark, paths), each)
    sites = sites.withColumnsRenamed({"alts": "_alts", "genotypes": "_calls"})
    order = F.split("_alts", ",")
    alleles = F.filter(F.concat(F.array("ref"), order), lambda a: a != "")
    number = lambda a: F.when(a == ".", ".").otherwise((F.array_position(alleles, a) - 1).cast("string"))
    shown = F.transform("_calls", lambda g: F.array_join(F.transform(F.split(F.substring_index(g, "=", -1), "/"), number), "/"))
    rows = sites.select("contig", F.col("pos").alias("start_pos"), F.col("pos").alias("end_pos"), F.col("ref").alias("ref_allele"), F.when(F.col("_alts") == "", F.array(F.lit("."))).otherwise(order).alias("alts"), shown.alias("genotypes"))
    if bed is None:
        text.write_vcf(rows, out, samples)
        return samples
    ranges = text.read_bed(spark, bed).select(F.col("chrom").alias("_chrom"), F.col("start_pos").alias("_a"), F.col("end_pos").alias("_b"))
    met = V.covering(rows, ranges.withColumnRenamed("_chrom", "contig"), "contig", "start_pos", "_a", "_b")
    part = F.concat("contig", F.lit("_"), F.col("_a").cast("string"), F.lit("-"), F.col("_b").cast("string"))
    line = F.concat_ws("\t", "contig", F.col("start_pos").cast("string"), F.lit("."), "ref_allele", F.array_join("alts", ","), F.lit("."), F.lit("."), F.lit("."), F.lit("GT"), F.array_join("genotypes", "\t"))
    text.write_parts(met.withColumn("part", part), "part", line, out)
    return samples


def unordered_records(spark: SparkSession, paths: str) -> DataFrame:
    """(file, line_no, contig, start_pos): records that start at or before the end of the record above them in the file."""
    from pyspark.sql import Window

    lines = text.numbered_lines(spark, paths).where(~F.startswith("value", F.lit("#"))).select("file", "line_no", F.split("value", "\t").alias("c")).where(F.size("c") >= 8)
    cell = lambda i: F.get("c", F.lit(i))
    start = cell(1).try_cast("int")
    end = F.coalesce(F.regexp_extract(cell(7), r"(?:^|;)END=(\d+)", 1).try_cast("int"), start + F.length(cell(3)) - 1)
    rows = lines.select("file", "line_no", cell(0).alias("contig"), start.alias("start_pos"), end.alias("end_pos"))
    # contigs of a file are worked by themselves: only neighbours on one contig matter
    above = Window.partitionBy("file", "contig").orderBy("line_no")
    return rows.withColumn("_e", F.lag("end_pos").over(above)).where("start_pos <= _e").drop("_e", "end_pos")


def checked_references(records: DataFrame, reference: DataFrame, correct: bool = False) -> DataFrame:
    """Records (contig, start_pos, ref_allele, ...) whose REF is what the reference (contig, seq) has there; the others are
    left out, or with ``correct`` come with the reference's letters.  Records beyond the reference are left out."""
    there = F.upper(F.substring(F.col("seq"), F.col("start_pos"), F.length("ref_allele")))
    met = records.join(reference.select("contig", "seq"), "contig").withColumn("_there", there).drop("seq").where(F.length("_there") == F.length("ref_allele"))
    if correct:
        return met.withColumn("ref_allele", F.col("_there")).drop("_there")
    return met.where(F.upper("ref_allele") == F.col("_there")).drop("_there")
