"""The vcf queries over records whose alternatives are missing or packed in one of the many habits."""

import pytest

from genomespark.plans.variant_queries import BOOK

#: variant_id, sample_name, start_pos, end_pos, ref_allele, alt_alleles, genotype
DATA = [
    (1, "s1", 10_000, 10_000, "A", "G", "0/1"),
    (2, "s2", 9_990, 10_010, "A", ".", "0/0"),
    (3, "s3", 9_995, 10_010, "A", None, "0|0:3"),
    (4, "s4", 10_000, 10_000, "A", "", "0"),
    (5, "s5", 10_000, 10_000, "A", "G;T", "1/2"),
    (6, "s6", 10_000, 10_000, "A", '"<INS:ME>"', "1"),
    (7, "s7", 20_000, 20_000, "C", " T", "1|1"),
    (8, "s8", 20_000, 20_000, "C", "[G|T]", "0/2"),
    (9, "s9", 20_000, 20_000, "G", ".", "0/0"),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("variants")
    rows = [(i, s, "chr1", a, b, r, t, g) for i, s, a, b, r, t, g in DATA]
    spark.createDataFrame(rows, "variant_id long, sample_name string, contig string, start_pos int, end_pos int, ref_allele string, alt_alleles string, genotype string").write.parquet(f"{path}/simple_variant.parquet")
    genes = spark.createDataFrame([(1, "chr1", 9_000, 11_000), (2, "chr1", 19_000, 21_000)], "gene_key long, seqid string, start_pos int, end_pos int")
    genes.write.parquet(f"{path}/gene_row.parquet")
    return str(path)


def test_every_record_counts(spark, folder):
    run = lambda name: BOOK.queries[name](spark, folder).collect()
    assert sorted(r.variant_id for r in run("vcf_at_position")) == [1, 2, 3, 4, 5, 6]
    kinds = {r.variant_id: (r.is_ref_block, r.is_snp, r.is_del, r.is_ins) for r in run("vcf_classify")}
    ref, snp = (True, False, False, False), (False, True, False, False)
    assert kinds == {1: snp, 2: ref, 3: ref, 4: ref, 5: snp, 6: snp, 7: snp, 8: snp, 9: ref}
    assert {r.variant_id: (r.alts, r.gt) for r in run("vcf_reindex_alts")} == {
        1: ("G", "0/1"), 2: ("", "0/0"), 3: ("", "0|0"), 4: ("", "0"), 5: ("G,T", "1/2"), 6: ("<INS:ME>", "1"), 7: ("T", "1|1"), 8: ("T", "0/1"), 9: ("", "0/0")
    }
    lines = {r.variant_id: (r.alleles, r.gt) for r in run("vcf_rows")}
    assert len(lines) == 9 and lines[2] == lines[3] == lines[4] == lines[6] == ("A,<NON_REF>", "0") and lines[8] == ("C,G,<NON_REF>", "1")
    assert {r.variant_id: r.part for r in run("vcf_by_range")} == {**dict.fromkeys((1, 5, 6), "chr1_9000-11000"), **dict.fromkeys((7, 8), "chr1_19000-21000")}


def test_samples_of_merged_sites(spark, folder):
    run = lambda name: {r.pos: r for r in BOOK.queries[name](spark, folder).collect()}
    merged = run("vcf_positional_merge")
    assert {p: r.n_samples for p, r in merged.items()} == {10_000: 6, 20_000: 3}
    assert merged[20_000].genotypes == "s7=1|1;s8=0/2;s9=0/0"
    sites = run("vcf_merge_snp")
    assert {p: (r.ref, r.n_calls) for p, r in sites.items()} == {10_000: ("A", 6)}  # s9 has another base at 20,000
    calls = run("vcf_merge_calls")
    assert {p: (r.ref, r.alts) for p, r in calls.items()} == {10_000: ("A", "G,T,<INS:ME>")}
    assert calls[10_000].genotypes == "s1=A/G;s2=A/A;s3=A/A;s4=A;s5=G/T;s6=<INS:ME>"
