from datetime import datetime, timedelta

from genomespark.llm import pieces as P
from genomespark.llm.queries import p1_bisected, p1_found
from tests.helpers import rows


def test_records_without_text_are_cut_too(spark, tmp_path):
    t = datetime(2024, 1, 1)
    records = [(1, "text", "A" * 5000, t), (2, "silent", None, t), (3, "short", None, t), (4, "unknown", None, t)]
    stats = [(1, "silent", 100, t), (2, "silent", 7777, t + timedelta(1)), (3, "short", 2000, t), (4, "text", 9999, t)]
    spark.createDataFrame(records, "rec_key long, record_id string, seq string, loaded_at timestamp").write.parquet(f"{tmp_path}/seq_record.parquet")
    spark.createDataFrame(stats, "stats_id long, contig string, num_region_bps long, loaded_at timestamp").write.parquet(f"{tmp_path}/chrom_stats.parquet")
    want = [(k, i, a, b) for k, n in (("text", 5000), ("silent", 7777)) for i, (a, b) in enumerate(P.bisect_pieces(n, []), 1)]
    assert sorted(rows(p1_bisected(spark, str(tmp_path)))) == sorted(want)
    assert {r[0] for r in rows(p1_found(spark, str(tmp_path)))} == {"text", "silent"}


def test_the_longest_run_in_the_middle_half_wins():
    letters = "A" * 1000 + "N" * 300 + "A" * 190 + "N" * 10 + "A" * 1500  # the short run ends at the middle
    assert P.measured_runs(letters) == [(1300, 300), (1500, 10)]
    assert P.bisect_pieces(3000, P.measured_runs(letters)) == [(1, 1300), (1201, 3000)]
    assert P.bisect_pieces(3000, [(1100, 20), (1600, 20), (2400, 900)])[0] == (1, 1600)  # 2,400 is outside the middle half
