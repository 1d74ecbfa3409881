from pathlib import Path

import pytest
from tests.helpers import rows

from genomespark.sources import text as S
from genomespark.streaming.lines import stream_lines, stream_structure


def put(tmp_path: Path, name: str, body: str) -> str:
    p = tmp_path / name
    p.write_bytes(body.encode())
    return str(p)


def test_fasta(spark, tmp_path):
    p = put(tmp_path, "a.fa", ">s1 first one\nACGT\nAC\n>s2\n;comment\nGG\r\n> s3 x\n\n")
    assert rows(S.read_fasta(spark, p)) == [("s1", ">s1 first one", "ACGTAC"), ("s2", ">s2", "GG"), ("s3", "> s3 x", "")]
    assert S.read_sequences(spark, p).count() == 3
    with pytest.raises(ValueError):
        S.format_of("x.txt")


def test_fasta_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", "ACGT" * 40), ("b", "A" * 60), ("c", "")], "id string, seq string")
    S.write_fasta(df, str(tmp_path / "o"), compression="gzip")
    assert rows(S.read_fasta(spark, str(tmp_path / "o")).select("id", "seq")) == rows(df)


def test_fastq_with_at_sign_in_quality(spark, tmp_path):
    p = put(tmp_path, "a.fq", "@r1 x\nACGT\n+\n@@II\n@r2\n\n+r2\n\n")
    assert rows(S.read_fastq(spark, p)) == [("r1 x", "ACGT", "@@II"), ("r2", "", "")]
    df = spark.createDataFrame([(f"r{i}", "ACGT", "@III") for i in range(500)], "id string, seq string, quality string").repartition(3)
    S.write_fastq(df, str(tmp_path / "o"))
    assert rows(S.read_fastq(spark, str(tmp_path / "o"))) == rows(df)


def test_numbered_lines_over_blocks(spark, tmp_path):
    p = put(tmp_path, "n.txt", "".join(f"{i}\n" for i in range(20_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        assert all(r.line_no == int(r.value) for r in S.numbered_lines(spark, p).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_gff(spark, tmp_path):
    p = put(tmp_path, "a.gff3", '##gff\nchr1\ts\tgene\t1\t9\t.\t+\t.\tID=g;Note="a;b"\nchr1\ts\tCDS\t5\t2\t.\t+\t0\tID=c\n')
    good, bad = S.read_gff(spark, p)
    assert [(r.seqid, r.start_pos, r.end_pos, r.attributes) for r in good.collect()] == [("chr1", 1, 9, 'ID=g;Note="a;b"')]
    assert [(r.line_no, r.reason) for r in bad.collect()] == [(2, "coordinates")]
    S.write_gff(good, str(tmp_path / "o"))
    assert S.read_gff(spark, str(tmp_path / "o"))[0].count() == 1


def test_sam_maf_vcf_bed_kmers(spark, tmp_path):
    p = put(tmp_path, "a.sam", "@HD\tVN:1\nq1\t16\tchr1\t10\t60\t3S5M1I2D4M\t*\t0\t0\tACGTACGTACGTA\t*\tNM:i:3\nq2\t4\t*\t0\t0\t*\t*\t0\t0\tAC\t*\n")
    a, b = S.read_sam(spark, p).orderBy("query_name").collect()
    assert (a.strand, a.num_m, a.num_i, a.num_d, a.num_s, a.nm, a.target_end) == ("-", 9, 1, 2, 3, 3, 20)
    assert (b.target_name, b.nm, b.target_end) == ("*", 0, 0)
    p = put(tmp_path, "a.maf", "##maf version=1\n\na score=12.5\ns B.chr1 3 5 + 100 AC-GT\ns T.chr2 0 4 - 50 ACCG-\n\na\ns B.chr1 9 1 + 100 A\ns T.x 0 1 + 5 A\n")
    got = S.read_maf(spark, p).orderBy("start0").collect()
    assert [(r.score, r.contig, r.start0, r.ref, r.qry_name, r.qry_strand, r.qry) for r in got] == [(12.5, "chr1", 3, "AC-GT", "T.chr2", "-", "ACCG-"), (None, "chr1", 9, "A", "T.x", "+", "A")]
    p = put(tmp_path, "a.vcf", '##ALT=<ID=h1,Description="a b",SampleName=S,Regions="c:1-5,c:9-12">\n#CHROM\nc\t5\t.\tA\tG,<NON_REF>\t.\t.\tEND=9;DP=1\tGT:DP\t0/1:3\nc\t7\t.\tAT\tA\t.\t.\t.\tGT\t1\n')
    got = S.read_vcf(spark, p).orderBy("start_pos").collect()
    assert [(r.start_pos, r.end_pos, list(r.alts), list(r.samples)) for r in got] == [(5, 9, ["G", "<NON_REF>"], ["0/1:3"]), (7, 8, ["A"], ["1"])]
    h = S.read_alt_headers(spark, p).collect()[0]
    assert (h.id, h.description, h.sample, [tuple(x) for x in h.regions]) == ("h1", "a b", "S", [("c", 1, 5), ("c", 9, 12)])
    p = put(tmp_path, "a.bed", "chr1\t0\t10\tx\t3.5\n#c\nchr2\t5\t6\n")
    assert rows(S.read_bed(spark, p)) == [("chr1", 1, 10, "x", 3.5), ("chr2", 6, 6, None, None)]
    S.write_kmers(spark.createDataFrame([("ACG", 2), ("TTT", 1)], "kmer string, n long"), str(tmp_path / "k"), {"kmerSize": "3"})
    assert rows(S.read_kmers(spark, str(tmp_path / "k"))) == [("ACG", 2), ("TTT", 1)]
    assert S.read_kmer_header(spark, str(tmp_path / "k")) == {"kmerSize": "3"}
    S.write_wiggle(spark.createDataFrame([("c", 1, 4), ("c", 2, 5), ("c", 9, 1)], "chrom string, pos int, value int").coalesce(1), str(tmp_path / "w"))
    assert "fixedStep chrom=c start=9 step=1" in [r.value for r in spark.read.text(str(tmp_path / "w")).collect()]
    S.write_vcf(spark.createDataFrame([("c", 5, 5, "A", ["G"], ["0/1"])], "contig string, start_pos int, end_pos int, ref_allele string, alts array<string>, genotypes array<string>"), str(tmp_path / "v"), ["S"])
    assert S.read_vcf(spark, str(tmp_path / "v")).count() == 1


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.gff").write_text('# c\na\tb\nx"\n')
    q = stream_structure(stream_lines(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("s1").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.reason for r in spark.table("s1").collect()) == ["columns", "quoting"]
