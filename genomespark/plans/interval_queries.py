"""Queries on intervals, orders and coverage."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from genomespark.operators import intervals as R
from genomespark.plans.views import FEATURES, GENES, Book, features, genes
from genomespark.runtime import table

BOOK = Book()
query = BOOK.query
_OVERLAP = "seqid = fseq AND gs <= fe AND ge >= fs"


def _plain(df, prefix):
    return df.select(F.col("seqid" if prefix == "g" else "fseq").alias("seqid"), F.col(f"{prefix}s").alias("start"), F.col(f"{prefix}e").alias("end"))


def _sized(spark, sf_dir):
    """Genes with the length of their sequence, where it is known."""
    sizes = table(spark, sf_dir, "chrom_row").where("chrom_len IS NOT NULL").groupBy("seqid").agg(F.max("chrom_len").alias("size"))
    return genes(spark, sf_dir).join(sizes, "seqid")


_SIZED = f"{GENES}, sized AS (SELECT g.*, c.size FROM genes g JOIN (SELECT seqid, max(chrom_len) AS size FROM chrom_row WHERE chrom_len IS NOT NULL GROUP BY seqid) c USING (seqid))"


@query(f"WITH {GENES}, {FEATURES} SELECT gene_key, row_id, greatest(gs, fs) AS ov_start, least(ge, fe) AS ov_end FROM genes JOIN features ON {_OVERLAP}")
def range_overlap_join(spark, sf_dir):
    """Genes and features that share a position, with the shared stretch."""
    met = R.overlap_join(genes(spark, sf_dir), features(spark, sf_dir), ("seqid", "fseq"), ("gs", "ge"), ("fs", "fe"))
    return met.select("gene_key", "row_id", F.greatest("gs", "fs").alias("ov_start"), F.least("ge", "fe").alias("ov_end"))


@query(f"WITH {GENES}, {FEATURES} SELECT * FROM genes WHERE EXISTS (SELECT 1 FROM features WHERE {_OVERLAP})")
def range_semi(spark, sf_dir):
    other = features(spark, sf_dir).select(F.col("fseq").alias("seqid"), F.col("fs").alias("gs"), F.col("fe").alias("ge"))
    return R.semi_overlap(genes(spark, sf_dir), other, "seqid", "gs", "ge")


@query(f"WITH {GENES}, {FEATURES} SELECT * FROM genes WHERE NOT EXISTS (SELECT 1 FROM features WHERE {_OVERLAP})")
def range_anti(spark, sf_dir):
    other = features(spark, sf_dir).select(F.col("fseq").alias("seqid"), F.col("fs").alias("gs"), F.col("fe").alias("ge"))
    return R.semi_overlap(genes(spark, sf_dir), other, "seqid", "gs", "ge", anti=True)


@query(f"WITH {GENES}, {FEATURES} SELECT DISTINCT seqid, greatest(gs, fs) AS ov_start, least(ge, fe) AS ov_end FROM genes JOIN features ON {_OVERLAP}")
def range_intersect(spark, sf_dir):
    a, b = _plain(genes(spark, sf_dir), "g"), _plain(features(spark, sf_dir), "f")
    return R.intersections(a, b, "seqid", "start", "end").toDF("seqid", "ov_start", "ov_end")


def _merged(src: str, within: int) -> str:
    return f"""o AS (SELECT *, max(e) OVER (PARTITION BY seqid ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {src}),
i AS (SELECT *, sum(CASE WHEN s <= reach + {within} THEN 0 ELSE 1 END) OVER (PARTITION BY seqid ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS n FROM o),
merged AS (SELECT seqid, min(s) AS m_start, max(e) AS m_end, CAST(count(*) AS BIGINT) AS n_ranges FROM i GROUP BY seqid, n)"""


_FROM_GENES = f"{GENES}, src AS (SELECT seqid, gs AS s, ge AS e FROM genes)"


@query(f"WITH {_FROM_GENES}, {_merged('src', 0)} SELECT * FROM merged")
def range_merge(spark, sf_dir):
    return R.merge(_plain(genes(spark, sf_dir), "g"), ["seqid"], "start", "end").select("seqid", F.col("start").alias("m_start"), F.col("end").alias("m_end"), "n_ranges")


@query(f"WITH {_FROM_GENES}, {_merged('src', 500)} SELECT * FROM merged")
def range_merge_gap(spark, sf_dir):
    return R.merge(_plain(genes(spark, sf_dir), "g"), ["seqid"], "start", "end", 500).select("seqid", F.col("start").alias("m_start"), F.col("end").alias("m_end"), "n_ranges")


@query(f"""WITH {GENES}, {FEATURES}, src AS (SELECT fseq AS seqid, fs AS s, fe AS e FROM features), {_merged('src', 1)},
p AS (SELECT gene_key, g.seqid, gs, ge, m_start, m_end, lag(m_end) OVER w AS prev, lead(m_start) OVER w AS next FROM genes g LEFT JOIN merged m ON g.seqid = m.seqid AND gs <= m_end AND ge >= m_start WINDOW w AS (PARTITION BY gene_key ORDER BY m_start)),
q AS (SELECT gene_key, seqid, coalesce(prev + 1, gs) AS a, coalesce(m_start - 1, ge) AS b FROM p UNION ALL SELECT gene_key, seqid, m_end + 1, ge FROM p WHERE next IS NULL AND m_end IS NOT NULL)
SELECT gene_key, seqid, a AS r_start, b AS r_end FROM q WHERE a <= b""")
def range_subtract(spark, sf_dir):
    """What features leave uncovered of each gene."""
    a = genes(spark, sf_dir).select("gene_key", "seqid", F.col("gs").alias("start"), F.col("ge").alias("end"))
    return R.subtract(a, _plain(features(spark, sf_dir), "f"), "gene_key", "seqid", "start", "end").toDF("gene_key", "seqid", "r_start", "r_end")


@query(f"""WITH {_FROM_GENES}, {_merged('src', 1)}, b AS (SELECT seqid, 1 AS lo, max(chrom_len) AS hi FROM chrom_row WHERE chrom_len IS NOT NULL GROUP BY seqid),
p AS (SELECT b.seqid, lo, hi, m_start, m_end, lag(m_end) OVER w AS prev, lead(m_start) OVER w AS next FROM b LEFT JOIN merged m ON b.seqid = m.seqid AND m_start <= hi AND m_end >= lo WINDOW w AS (PARTITION BY b.seqid ORDER BY m_start)),
q AS (SELECT seqid, coalesce(prev + 1, lo) AS a, coalesce(m_start - 1, hi) AS b FROM p UNION ALL SELECT seqid, m_end + 1, hi FROM p WHERE next IS NULL AND m_end IS NOT NULL)
SELECT seqid, a AS r_start, b AS r_end FROM q WHERE a <= b""")
def range_complement(spark, sf_dir):
    """What genes leave uncovered of each chromosome."""
    bounds = table(spark, sf_dir, "chrom_row").where("chrom_len IS NOT NULL").groupBy("seqid").agg(F.max("chrom_len").alias("end")).withColumn("start", F.lit(1))
    return R.complement(bounds, _plain(genes(spark, sf_dir), "g"), "seqid", "start", "end").toDF("seqid", "r_start", "r_end")


@query(f"""WITH {_SIZED} SELECT gene_key, 'left' AS side, greatest(gs - 100, 1) AS f_start, gs - 1 AS f_end FROM sized WHERE gs > 1
UNION ALL SELECT gene_key, 'right', ge + 1, least(ge + 100, size) FROM sized WHERE ge < size""")
def range_flanks(spark, sf_dir):
    """100 positions left and right of each gene, cut at the ends of the chromosome."""
    rows = _sized(spark, sf_dir)
    left, right = R.flank_left(F.col("gs"), F.col("ge"), 100), R.flank_right(F.col("gs"), F.col("ge"), 100, F.col("size"))
    sides = F.array(*[F.struct(F.lit(n).alias("side"), a.alias("f_start"), b.alias("f_end")) for n, (a, b) in (("left", left), ("right", right))])
    return rows.select("gene_key", F.explode(sides).alias("f")).select("gene_key", "f.*").where("f_start IS NOT NULL")


@query(f"WITH {_SIZED} SELECT gene_key, least(greatest(gs - 5000, 1), size) AS s_start, least(greatest(ge - 5000, 1), size) AS s_end, greatest(gs - 50, 1) AS l_start, ge + 50 AS l_end FROM sized")
def range_shift_enlarge(spark, sf_dir):
    s, e = F.col("gs"), F.col("ge")
    moved, wide = R.shift(s, e, -5000, F.col("size")), R.enlarge(s, e, 50)
    return _sized(spark, sf_dir).select("gene_key", moved[0].alias("s_start"), moved[1].alias("s_end"), wide[0].alias("l_start"), wide[1].alias("l_end"))


def _sets(spark, sf_dir):
    return _plain(genes(spark, sf_dir), "g").distinct(), _plain(features(spark, sf_dir), "f").distinct()


_SETS = f"WITH {GENES}, {FEATURES}, a AS (SELECT DISTINCT seqid, gs AS r_start, ge AS r_end FROM genes), b AS (SELECT DISTINCT fseq AS seqid, fs AS r_start, fe AS r_end FROM features)"


@query(f"{_SETS} SELECT * FROM a UNION SELECT * FROM b")
def range_union(spark, sf_dir):
    a, b = _sets(spark, sf_dir)
    return a.union(b).distinct().toDF("seqid", "r_start", "r_end")


@query(f"{_SETS} SELECT * FROM a EXCEPT SELECT * FROM b")
def range_except(spark, sf_dir):
    a, b = _sets(spark, sf_dir)
    return a.subtract(b).toDF("seqid", "r_start", "r_end")


@query(f"{_SETS} SELECT * FROM a INTERSECT SELECT * FROM b")
def range_set_intersect(spark, sf_dir):
    a, b = _sets(spark, sf_dir)
    return a.intersect(b).toDF("seqid", "r_start", "r_end")


@query(f"WITH {GENES} SELECT gene_key, greatest(gs, 1) AS w_first, CAST(count(*) AS BIGINT) AS n_windows FROM (SELECT gene_key, gs, unnest(range(gs, ge - 500 + 1, 250)) AS w FROM genes WHERE gs <= ge - 500) GROUP BY gene_key, gs")
def range_windows(spark, sf_dir):
    """Windows of 500 positions in steps of 250, counted by gene."""
    rows = R.windows_of(genes(spark, sf_dir), "gs", "ge", 500, 250)
    return rows.groupBy("gene_key", "gs").agg(F.count("*").alias("n_windows")).select("gene_key", F.greatest("gs", F.lit(1)).alias("w_first"), "n_windows")


@query(f"""WITH {GENES}, o AS (SELECT gene_key, seqid, CAST(row_number() OVER (ORDER BY (CASE WHEN regexp_matches(seqid, '^scaf') THEN 1 ELSE 0 END), CAST(regexp_extract(seqid, '\\d+') AS INTEGER), gs, ge, gene_key) AS BIGINT) AS place FROM genes) SELECT * FROM o""")
def range_natural_sort(spark, sf_dir):
    """Place of each gene when seqids order naturally (chr2 before chr10) and positions after them.

    The place within a seqid and the number of rows before the seqid give it; no window spans all rows.
    """
    rows = genes(spark, sf_dir).withColumn("k", R.natural_key(F.col("seqid")))
    counts = rows.groupBy("k").agg(F.count("*").alias("n"))
    before = counts.select("k", (F.sum("n").over(Window.orderBy("k")) - F.col("n")).alias("before"))  # one row a seqid name
    place = F.row_number().over(Window.partitionBy("k").orderBy("gs", "ge", "gene_key"))
    return rows.withColumn("at", place).join(before, "k").select("gene_key", "seqid", (F.col("at") + F.col("before")).alias("place"))


@query(f"WITH {GENES} SELECT gene_key, gs, ge, (gs + ge) // 2 AS mid FROM genes ORDER BY ge - gs DESC, gene_key LIMIT 25")
def range_topk(spark, sf_dir):
    """The 25 longest genes (a top-k report)."""
    return genes(spark, sf_dir).orderBy((F.col("ge") - F.col("gs")).desc(), "gene_key").limit(25).select("gene_key", "gs", "ge", F.expr("(gs + ge) div 2").cast("int").alias("mid"))


_DEPTH = """c AS (SELECT seqid, place, sum(d) AS d FROM (SELECT seqid, gs AS place, 1 AS d FROM genes UNION ALL SELECT seqid, ge + 1, -1 FROM genes) GROUP BY seqid, place HAVING sum(d) <> 0),
deep AS (SELECT seqid, place AS d_start, lead(place) OVER w - 1 AS d_end, CAST(sum(d) OVER (PARTITION BY seqid ORDER BY place) AS BIGINT) AS depth FROM c WINDOW w AS (PARTITION BY seqid ORDER BY place))"""


@query(f"WITH {GENES}, {_DEPTH} SELECT * FROM deep WHERE depth > 0")
def cov_depth(spark, sf_dir):
    """Stretches of equal depth of genes."""
    return R.depth(genes(spark, sf_dir), ["seqid"], "gs", "ge").select("seqid", F.col("gs").alias("d_start"), F.col("ge").alias("d_end"), "depth")


@query(f"""WITH {GENES}, {_DEPTH}, hit AS (SELECT *, d_start - 1 AS before FROM deep WHERE depth >= 2),
o AS (SELECT *, CASE WHEN lag(d_end) OVER (PARTITION BY seqid ORDER BY d_start) = before THEN 0 ELSE 1 END AS opens FROM hit), i AS (SELECT *, sum(opens) OVER (PARTITION BY seqid ORDER BY d_start) AS n FROM o)
SELECT seqid, min(d_start) - 1 AS bed_start, max(d_end) AS bed_end, seqid || '_' || CAST(n AS INTEGER) AS name FROM i GROUP BY seqid, n""")
def cov_bed_runs(spark, sf_dir):
    """Runs with a depth of two or more as BED rows (0-based, half-open) with names."""
    deep = R.depth(genes(spark, sf_dir), ["seqid"], "gs", "ge").where("depth >= 2")
    runs = R.merge(deep, ["seqid"], "gs", "ge", 1)
    n = F.row_number().over(Window.partitionBy("seqid").orderBy("gs"))
    return runs.select("seqid", (F.col("gs") - 1).alias("bed_start"), F.col("ge").alias("bed_end"), F.concat("seqid", F.lit("_"), n.cast("string")).alias("name"))


@query(f"WITH {GENES}, {_DEPTH}, b AS (SELECT seqid, max(chrom_len) AS size FROM chrom_row WHERE chrom_len IS NOT NULL GROUP BY seqid) SELECT seqid, CAST(any_value(size) AS BIGINT) AS size, round(100.0 * sum(d_end - d_start + 1) / any_value(size), 9) AS percent_cov FROM deep JOIN b USING (seqid) WHERE depth > 0 GROUP BY seqid")
def cov_percent(spark, sf_dir):
    """Share of each chromosome that genes cover."""
    sizes = table(spark, sf_dir, "chrom_row").where("chrom_len IS NOT NULL").groupBy("seqid").agg(F.max("chrom_len").cast("long").alias("size"))
    covered = R.depth(genes(spark, sf_dir), ["seqid"], "gs", "ge").groupBy("seqid").agg(F.sum(F.col("ge") - F.col("gs") + 1).alias("n"))
    return covered.join(sizes, "seqid").select("seqid", "size", F.round(F.lit(100.0) * F.col("n") / F.col("size"), 9).alias("percent_cov"))


@query(f"WITH {GENES} SELECT gene_key, (gs + ge) // 2 AS mid, CAST(row_number() OVER (PARTITION BY seqid ORDER BY gs + ge, gene_key) AS INTEGER) AS by_middle, CAST(row_number() OVER (PARTITION BY seqid ORDER BY ge, gs, gene_key) AS INTEGER) AS by_right FROM genes")
def range_middle_sort(spark, sf_dir):
    """Place of each gene on its sequence by its middle, and by its right edge."""
    place = lambda *o: F.row_number().over(Window.partitionBy("seqid").orderBy(*o))
    return genes(spark, sf_dir).select("gene_key", F.expr("(gs + ge) div 2").cast("int").alias("mid"), place(F.col("gs") + F.col("ge"), "gene_key").alias("by_middle"), place("ge", "gs", "gene_key").alias("by_right"))


@query(f"""WITH {GENES}, n AS (SELECT gene_key, seqid, gs, ge, lead(gene_key) OVER w AS other, lead(gs) OVER w AS os, lead(ge) OVER w AS oe FROM genes WINDOW w AS (PARTITION BY seqid ORDER BY gs, ge, gene_key))
SELECT gene_key, other, CAST(os - ge - 1 AS INTEGER) AS gap FROM n WHERE other IS NOT NULL AND os > ge AND abs((oe - os) - (ge - gs)) <= 200""")
def range_find_pair(spark, sf_dir):
    """Each gene with the next one if they are apart and of like length (a pairing condition as a column)."""
    order = Window.partitionBy("seqid").orderBy("gs", "ge", "gene_key")
    rows = genes(spark, sf_dir).select("*", F.lead("gene_key").over(order).alias("other"), F.lead("gs").over(order).alias("os"), F.lead("ge").over(order).alias("oe"))
    alike = F.abs((F.col("oe") - F.col("os")) - (F.col("ge") - F.col("gs"))) <= 200
    return rows.where(F.col("other").isNotNull() & (F.col("os") > F.col("ge")) & alike).select("gene_key", "other", (F.col("os") - F.col("ge") - 1).cast("int").alias("gap"))
