"""Variant files: from alignment blocks, merged, checked, and what readers leave out."""

import pytest

from genomespark.operators import gvcf
from genomespark.sources import text

HEAD = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT"


def put(folder, name, body):
    path = folder / name
    path.write_text(body)
    return str(path)


def lines_of(path):
    from pathlib import Path

    return [x for p in sorted(Path(path).glob("part-*")) for x in p.read_text().splitlines() if not x.startswith("#")]


def vcf(folder, name, sample, *records):
    return put(folder, name, f"{HEAD}\t{sample}\n" + "".join("\t".join(r) + "\n" for r in records))


def record(pos, ref, alt, gt, info="."):
    return ("chr1", str(pos), ".", ref, alt, ".", ".", info, "GT", gt)


@pytest.fixture
def genome(tmp_path):
    fasta = put(tmp_path, "ref.fa", ">chr1 x\nACGTACGTAC\nGTACGTACGT\n>chr2\nTTTT\n")
    maf = put(tmp_path, "a.maf", "##maf version=1\na score=9\ns ref.chr1 2 6 + 20 GTAC--GT\ns asm.q1 4 8 + 30 GTTCAAGT\n\na score=3\ns ref.chr1 12 5 + 20 ACGTA\ns asm.q1 3 3 - 30 A--TN\n\n")
    return fasta, maf


def test_maf_to_variants(spark, tmp_path, genome):
    fasta, maf = genome
    out = str(tmp_path / "one.vcf")
    assert gvcf.maf_to_variants(spark, maf, fasta, "s1", out) == [out]
    got = [x.split("\t") for x in lines_of(out)]
    assert [(x[1], x[3], x[4], x[9].split(":")[0]) for x in got] == [("3", "G", "<NON_REF>", "0"), ("5", "A", "T,<NON_REF>", "1"), ("6", "C", "CAA,<NON_REF>", "1"), ("7", "G", "<NON_REF>", "0"), ("13", "ACG", "A,<NON_REF>", "1"), ("16", "T", "<NON_REF>", "0"), ("17", "A", "<NON_REF>", ".")]
    assert got[0][7] == "ASM_Chr=q1;ASM_End=6;ASM_Start=5;ASM_Strand=+;END=4" and got[4][7].startswith("ASM_Chr=q1;ASM_End=27;ASM_Start=27;ASM_Strand=-")
    assert got[0][8] == "GT:AD:DP:PL" and got[0][9] == "0:30,0:30:0,90,90"


def test_options(spark, genome):
    fasta, maf = genome
    blocks, letters = text.read_maf(spark, maf), text.read_fasta(spark, fasta).selectExpr("id AS contig", "seq")
    run = lambda **o: sorted((r.contig, r.start_pos, r.end_pos, r.ref_allele, ",".join(r.alts), r.genotypes[0]) for r in gvcf.variant_records(blocks, letters, just_gt=True, **o).collect())
    assert [x[1] for x in run(output="vcf")] == [5, 6, 13]
    assert ("chr1", 13, 15, "A", "<DEL>,<NON_REF>", "1") in run(symbolic_deletions=True)
    assert ("chr1", 13, 15, "ACG", "A,<NON_REF>", "1") in run(max_deletion=2) and ("chr1", 13, 15, "A", "<DEL>,<NON_REF>", "1") in run(max_deletion=1)
    gaps = [x for x in run(fill_gaps=True) if x not in run()]
    assert gaps == [("chr1", 1, 2, "A", "<NON_REF>", "."), ("chr1", 9, 12, "A", "<NON_REF>", "."), ("chr1", 18, 20, "C", "<NON_REF>", ".")]
    assert gvcf.variant_records(blocks.limit(0), letters).count() == 0


def test_two_files_of_a_diploid(spark, tmp_path, genome):
    fasta, _ = genome
    maf = put(tmp_path, "d.maf", "a score=9\ns ref.chr1 0 8 + 20 ACGTACGT\ns asm.q1 0 8 + 30 ACGTACGT\n\na score=3\ns ref.chr1 4 8 + 20 ACGTACGT\ns asm.q2 0 8 + 30 ATGTACGT\n\n")
    out = gvcf.maf_to_variants(spark, maf, fasta, "s", str(tmp_path / "d.g.vcf"), two_files=True)
    assert [p.rpartition("/")[2] for p in out] == ["d_1.g.vcf", "d_2.g.vcf"]
    first, second = [{(x.split("\t")[1], x.split("\t")[4]) for x in lines_of(p)} for p in out]
    assert ("6", "T,<NON_REF>") in second and ("6", "T,<NON_REF>") not in first and ("1", "<NON_REF>") in second


def test_merge_of_files(spark, tmp_path):
    vcf(tmp_path, "a.vcf", "sB", record(5, "A", "T,G", "2"), record(8, "C", "N", "0"))
    vcf(tmp_path, "b.vcf", "sA", record(2, "G", "<NON_REF>", "0", "END=7"), record(8, "C", "CAA", "1"), record(9, "G", "T", "1"))
    vcf(tmp_path, "c.vcf", "sC", record(5, "A", "*,C", "1/2"))
    out = str(tmp_path / "merged")
    assert gvcf.merge_variant_files(spark, f"{tmp_path}/*.vcf", out) == ["sA", "sB", "sC"]
    assert [x.split("\t") for x in lines_of(out)] == [["chr1", "5", ".", "A", "G,C,<DEL>", ".", ".", "END=5", "GT", "0", "1", "3/2"], ["chr1", "9", ".", "G", "T", ".", ".", "END=9", "GT", "1", ".", "."]]
    calls = {(r.sample_name, r.start_pos): (r.alts, r.genotype) for r in text.read_vcf_calls(spark, f"{tmp_path}/*.vcf").collect()}
    assert calls["sB", 5] == (["G"], "1") and calls["sC", 5] == (["<DEL>", "C"], "1/2") and calls["sB", 8] == ([], "0")


def test_merge_refuses(spark, tmp_path):
    one = vcf(tmp_path, "a.vcf", "s", record(5, "A", "T", "1"))
    vcf(tmp_path, "b.vcf", "s", record(9, "A", "T", "1"))
    with pytest.raises(ValueError, match="twice"):
        gvcf.merge_variant_files(spark, f"{tmp_path}/*.vcf", str(tmp_path / "o"))
    two = vcf(tmp_path, "two.vcf", "s\tt", (*record(5, "A", "T", "1"), "0"))
    with pytest.raises(ValueError, match="not one sample"):
        gvcf.merge_variant_files(spark, two, str(tmp_path / "o"))
    mess = vcf(tmp_path, "mess.vcf", "u", record(9, "ACG", "A", "1"), record(10, "C", "T", "1"), record(30, "C", "T", "1"), record(20, "C", "T", "1"))
    with pytest.raises(ValueError, match="overlap"):
        gvcf.merge_variant_files(spark, mess, str(tmp_path / "o"))
    assert [r.start_pos for r in gvcf.unordered_records(spark, mess).orderBy("line_no").collect()] == [10, 20]
    assert gvcf.unordered_records(spark, one).count() == 0


def test_references_are_checked_or_corrected(spark):
    reference = spark.createDataFrame([("c", "ACGTAC")], "contig string, seq string")
    rows = spark.createDataFrame([("c", 2, "CG"), ("c", 2, "ct"), ("c", 6, "CA"), ("x", 1, "A"), ("c", 3, "A")], "contig string, start_pos int, ref_allele string")
    assert [(r.start_pos, r.ref_allele) for r in gvcf.checked_references(rows, reference).collect()] == [(2, "CG")]
    assert sorted((r.start_pos, r.ref_allele) for r in gvcf.checked_references(rows, reference, correct=True).collect()) == [(2, "CG"), (2, "CG"), (3, "G")]


def test_rejected_lines(spark, tmp_path):
    sam = put(tmp_path, "x.sam", "@HD\n" + "\t".join("q 0 c 5 60 3M * 0 0 ACG *".split()) + "\nshort\t1\n" + "\t".join("q x c 5 60 3M * 0 0 ACG *".split()) + "\n")
    assert [(r.line_no, r.reason) for r in text.rejected_lines(spark, sam, "sam").orderBy("line_no").collect()] == [(2, "columns"), (3, "position")]
    assert text.read_sam(spark, sam).count() == 1
    bad = vcf(tmp_path, "x.vcf", "s", record(5, "A", "T", "1"), record("x", "A", "T", "1"), ("chr1", "9"), (*record(7, "A", "T", "1"), "extra"))
    assert [(r.line_no, r.reason) for r in text.rejected_lines(spark, bad, "vcf").orderBy("line_no").collect()] == [(3, "position"), (4, "columns"), (5, "columns")]
    assert [r.start_pos for r in text.read_vcf_calls(spark, bad).collect()] == [5]
    bed = put(tmp_path, "x.bed", "track\nc\t1\t5\nc\t1\nc\tx\t9\n")
    assert [(r.line_no, r.reason) for r in text.rejected_lines(spark, bed, "bed").orderBy("line_no").collect()] == [(2, "columns"), (3, "position")]
    assert text.read_bed(spark, bed).count() == 1
    fasta = put(tmp_path, "x.fa", "; note\ngarbage\nACGT\n>a one\nAC\n>b\nGG\n>a two\nTT\n")
    assert [(r.line_no, r.reason) for r in text.rejected_lines(spark, fasta, "fasta").orderBy("line_no").collect()] == [(1, "header"), (2, "header"), (7, "duplicate")]
    assert sorted((r.id, r.seq) for r in text.read_fasta(spark, fasta).collect()) == [("a", "AC"), ("a", "TT"), ("b", "GG")]
