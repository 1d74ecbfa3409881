"""SQL that gives the same rows as queries of this package, where SQL can."""

P6_FOUND = """
WITH v AS (SELECT min_by(variant_id, (loaded_at, variant_id)) AS variant_id, sample_name, contig, start_pos, end_pos, is_ref_block, genotype
  FROM simple_variant WHERE contig IS NOT NULL AND sample_name IS NOT NULL AND start_pos IS NOT NULL AND end_pos IS NOT NULL
  GROUP BY sample_name, contig, start_pos, end_pos, is_ref_block, genotype, ref_allele, alt_alleles, producer, made_at),
m AS (SELECT *, greatest(start_pos, end_pos) AS e, coalesce(is_ref_block, regexp_full_match(trim(split_part(genotype, ':', 1)), '0([/|]0)*'), false) AS ref FROM v),
k AS (SELECT *, sum(CASE WHEN ref THEN 0 ELSE 1 END) OVER (PARTITION BY sample_name, contig ORDER BY start_pos, e, variant_id ROWS UNBOUNDED PRECEDING) AS streak FROM m),
f AS (SELECT *, max(e) OVER (PARTITION BY sample_name, contig, streak ORDER BY start_pos, e, variant_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM k WHERE ref),
r AS (SELECT *, sum(CASE WHEN start_pos - far - 1 <= 10 THEN 0 ELSE 1 END) OVER (PARTITION BY sample_name, contig ORDER BY start_pos, e, variant_id ROWS UNBOUNDED PRECEDING) AS run FROM f)
SELECT sample_name, contig, CAST(min(start_pos) AS INTEGER) AS first_start, CAST(max(e) AS INTEGER) AS last_end, CAST(count(*) AS INTEGER) AS n_records
FROM r GROUP BY sample_name, contig, run HAVING count(*) >= 2"""

P1_FOUND = r"""
WITH RECURSIVE texts AS (SELECT record_id, arg_max(regexp_replace(seq, '\s', '', 'g'), (loaded_at, rec_key)) FILTER (seq IS NOT NULL) AS s FROM seq_record WHERE record_id IS NOT NULL GROUP BY record_id),
stats AS (SELECT contig, arg_max(coalesce(num_region_bps, -1), (loaded_at, num_region_bps, stats_id)) AS n FROM chrom_stats GROUP BY contig),
r AS (SELECT record_id, coalesce(length(s), n) AS n, s FROM texts LEFT JOIN stats ON contig = record_id),
big AS (SELECT record_id, n, CASE WHEN s IS NULL THEN CAST([] AS BIGINT[]) ELSE list_filter(range(10, n + 1), lambda i: contains('NnXx', substr(s, CAST(i AS INTEGER), 1)) AND NOT regexp_matches(substr(s, CAST(i + 1 AS INTEGER), 1), '[NnXx]') AND regexp_full_match(substr(s, CAST(i - 9 AS INTEGER), 10), '[NnXx]{10}')) END AS b FROM r WHERE n > 2000),
w AS (SELECT record_id, n, b, 1 AS no, 1 AS a, coalesce(list_max(list_filter(b, lambda x: x BETWEEN 200 AND 2000)), 2000) AS e FROM big
  UNION ALL SELECT record_id, n, b, no + 1, CAST(e - 99 AS INTEGER), CASE WHEN n - (e - 99) + 1 <= 2000 THEN n ELSE coalesce(list_max(list_filter(b, lambda x: x BETWEEN e - 99 + 199 AND e - 99 + 1999)), e - 99 + 1999) END FROM w WHERE e < n)
SELECT record_id, no AS piece_no, a AS piece_start, CAST(e AS INTEGER) AS piece_end FROM w"""

SQL = {"p1_found": P1_FOUND, "p6_found": P6_FOUND}
