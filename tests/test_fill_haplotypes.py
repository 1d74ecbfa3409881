from genomespark.operators.alignments import fill_haplotypes
from genomespark.plans.variant_queries import BOOK
from tests.helpers import rows


def test_third_alignments_come_back_marked(spark):
    data = [("c", 1, 0, "ACGTACGT", "ACGTACGT"), ("c", 2, 2, "GTAC", "GTAC"), ("c", 3, 3, "T-ACGTAA", "TGACGTAA")]
    df = spark.createDataFrame(data, "contig string, block long, start0 long, ref string, qry string")
    got = {(r.haplotype, r.block, r.start0, r.ref, r.qry) for r in fill_haplotypes(df).collect()}
    assert got == {(1, 1, 0, "ACGTACGT", "ACGTACGT"), (2, 2, 2, "GTAC", "GTAC"), (2, 1, 0, "AC", "AC"), (2, 1, 6, "GT", "GT"), (0, 3, 3, "T-ACGTAA", "TGACGTAA")}


def test_no_block_of_the_query_is_lost(spark, tmp_path):
    records = [(i, f"r{i}", "ACGTTTACGA" * 90) for i in range(40)]
    spark.createDataFrame(records, "rec_key long, record_id string, seq string").write.parquet(f"{tmp_path}/seq_record.parquet")
    got = rows(BOOK.queries["maf_fill_haplotypes"](spark, str(tmp_path)).select("block", "haplotype"))
    assert {b for b, _ in got} == set(range(40)) and {h for _, h in got} == {1, 2}
