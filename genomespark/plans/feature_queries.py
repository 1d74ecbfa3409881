"""Queries on feature tables, feature trees and type ontologies."""

from __future__ import annotations

from pyspark.sql import functions as F

from genomespark.operators import features as G
from genomespark.operators import ontology
from genomespark.operators.hierarchy import descendants, feature_name, links
from genomespark.operators.sql import _LINKS, _NAME, _WAYS
from genomespark.plans.views import Book
from genomespark.runtime import table

BOOK = Book()
query = BOOK.query


def _features(spark, sf_dir):
    return table(spark, sf_dir, "gff_feature")


@query("SELECT row_id, CASE feature_type WHEN 'CDS' THEN 'cds' WHEN 'mRNA' THEN 'transcript' ELSE feature_type END AS kind, start_pos, end_pos FROM gff_feature WHERE seqid = 'chr1' AND start_pos <= 900000 AND end_pos >= 100000 AND feature_type IN ('exon', 'CDS', 'five_prime_UTR', 'three_prime_UTR', 'gene', 'mRNA')")
def gff_by_range(spark, sf_dir):
    """Features of chr1 that touch 100,000 to 900,000."""
    return G.features_by_range(_features(spark, sf_dir), "chr1", 100_000, 900_000).select("row_id", "kind", "start_pos", "end_pos")


@query(f"SELECT DISTINCT {_NAME.format(c='p')} AS transcript, row_id, feature_type FROM (SELECT row_id, feature_type, unnest(parents) AS p FROM gff_feature) WHERE {_NAME.format(c='p')} IS NOT NULL")
def gff_with_transcript(spark, sf_dir):
    """Each feature with every parent named in its row."""
    rows = _features(spark, sf_dir).select("row_id", "feature_type", F.explode("parents").alias("p"))
    return rows.select(feature_name("p").alias("transcript"), "row_id", "feature_type").where("transcript IS NOT NULL").distinct()


@query(r"""SELECT row_id, coalesce(nullif(regexp_replace(regexp_extract(attributes, '(?:^|;)\s*ID=([^;]*)', 1), '^(gene:|transcript:|CDS:)', ''), ''), 'NONE') AS id, coalesce(nullif(regexp_extract(attributes, '(?:^|;)\s*biotype=([^;]*)', 1), ''), 'NONE') AS biotype, coalesce(nullif(regexp_extract(attributes, '(?:^|;)\s*rank=([^;]*)', 1), ''), '0') AS rank FROM gff_feature WHERE attributes IS NOT NULL""")
def gff_attributes(spark, sf_dir):
    a = F.col("attributes")
    return _features(spark, sf_dir).where("attributes IS NOT NULL").select("row_id", G.attribute(a, "ID").alias("id"), G.attribute(a, "biotype").alias("biotype"), G.attribute(a, "rank", "0").alias("rank"))


@query("SELECT feature_type, CAST(count(*) AS BIGINT) AS n, CAST(sum(end_pos - start_pos + 1) AS BIGINT) AS letters, min(start_pos) AS first_start FROM gff_feature GROUP BY feature_type")
def gff_types(spark, sf_dir):
    """Rows and letters of each feature type."""
    return _features(spark, sf_dir).groupBy("feature_type").agg(F.count("*").alias("n"), F.sum(F.col("end_pos") - F.col("start_pos") + 1).alias("letters"), F.min("start_pos").alias("first_start"))


@query("SELECT row_id, concat_ws(chr(9), coalesce(seqid, '.'), coalesce(feature_source, '.'), coalesce(feature_type, '.'), coalesce(CAST(start_pos AS VARCHAR), '.'), coalesce(CAST(end_pos AS VARCHAR), '.'), '.', coalesce(strand, '.'), coalesce(phase, '.'), 'ID=' || replace(replace(replace(replace(replace(coalesce(feature_id, ''), '%', '%25'), ';', '%3B'), '=', '%3D'), '&', '%26'), ',', '%2C')) AS line FROM gff_feature")
def gff_as_row(spark, sf_dir):
    """GFF text of every feature, without scores."""
    return _features(spark, sf_dir).withColumn("score", F.lit(None).cast("double")).select("row_id", G.as_row().alias("line"))


@query("SELECT feature_id, CAST(count(*) AS BIGINT) AS multiplicity, min(start_pos) AS first, max(end_pos) AS last, CAST(sum(end_pos - start_pos + 1) AS BIGINT) AS length, string_agg(start_pos || '..' || end_pos, ',' ORDER BY start_pos, end_pos) AS spans FROM (SELECT DISTINCT feature_id, start_pos, end_pos FROM gff_feature WHERE feature_id IS NOT NULL) GROUP BY feature_id HAVING count(*) > 1")
def tree_discontinuous(spark, sf_dir):
    return G.discontinuous(_features(spark, sf_dir), "feature_id")


@query(f"WITH RECURSIVE {_LINKS} SELECT parent, node AS child FROM edges")
def tree_children(spark, sf_dir):
    _, edges = links(_features(spark, sf_dir), "feature_id", "parents")
    return edges.select("parent", F.col("node").alias("child"))


@query(f"WITH RECURSIVE {_WAYS} SELECT node, CAST(count(DISTINCT anc) AS BIGINT) AS n_ancestors, CAST(max(d) AS INTEGER) AS farthest FROM (SELECT node, anc, min(d) AS d FROM ways GROUP BY node, anc) GROUP BY node")
def tree_ancestors(spark, sf_dir):
    nodes, edges = links(_features(spark, sf_dir), "feature_id", "parents")
    return descendants(nodes, edges).groupBy("node").agg(F.count("*").alias("n_ancestors"), F.max("dist").alias("farthest"))


@query(f"""WITH RECURSIVE {_LINKS}, doomed AS (SELECT DISTINCT {_NAME.format(c='feature_id')} AS node FROM gff_feature WHERE feature_type = 'gene' AND strand = '-' AND {_NAME.format(c='feature_id')} IS NOT NULL),
gone AS (SELECT node FROM doomed UNION SELECT node FROM reach WHERE anc IN (SELECT node FROM doomed)) SELECT node, parent FROM edges WHERE node NOT IN (SELECT node FROM gone) AND parent NOT IN (SELECT node FROM gone)""")
def tree_cascade_delete(spark, sf_dir):
    """Links that are left when all genes of the minus strand go with their subtrees."""
    rows = _features(spark, sf_dir)
    _, edges = links(rows, "feature_id", "parents")
    doomed = rows.where("feature_type = 'gene' AND strand = '-'").select(feature_name("feature_id").alias("node")).where("node IS NOT NULL").distinct()
    return G.delete_subtrees(edges, doomed)


_ONTO = ontology.parse(ontology.MINI)
_rows = lambda name: ", ".join("(" + ", ".join("'" + str(x).replace("'", "''") + "'" if not isinstance(x, bool) else str(x).lower() for x in r) + ")" for r in _ONTO[name])
_ONTO_SQL = f"""types(id, name) AS (VALUES {_rows('types')}), syn(id, name, exact) AS (VALUES {_rows('synonyms')}), isa(node, parent) AS (VALUES {_rows('is_a')}), partof(node, parent) AS (VALUES {_rows('part_of')}),
sup AS (SELECT id AS node, id AS anc, 0 AS d FROM types UNION SELECT s.node, i.parent, s.d + 1 FROM sup s JOIN isa i ON i.node = s.anc),
reach AS (SELECT id AS node, id AS anc FROM types UNION SELECT r.node, e.parent FROM reach r JOIN (SELECT * FROM isa UNION SELECT * FROM partof) e ON e.node = r.anc)"""


@query(f"WITH RECURSIVE {_ONTO_SQL} SELECT node, anc AS ancestor, CAST(min(d) AS INTEGER) AS dist FROM sup GROUP BY node, anc")
def ontology_is_a(spark, sf_dir):
    return ontology.is_a(ontology.tables(spark))


@query(f"WITH RECURSIVE {_ONTO_SQL} SELECT DISTINCT r.node, g.node AS goal FROM reach r JOIN partof p ON p.node = r.anc JOIN sup g ON g.anc = p.parent")
def ontology_part_of(spark, sf_dir):
    return ontology.part_of(ontology.tables(spark))


@query(f"WITH RECURSIVE {_ONTO_SQL} SELECT feature_type, syn.id, CAST(count(*) AS BIGINT) AS n FROM gff_feature JOIN syn ON syn.name = feature_type AND exact GROUP BY ALL")
def ontology_synonyms(spark, sf_dir):
    """Feature types resolved through exact synonyms."""
    synonyms = ontology.tables(spark)["synonyms"].where("exact").withColumnRenamed("name", "feature_type")
    return _features(spark, sf_dir).groupBy("feature_type").agg(F.count("*").alias("n")).join(F.broadcast(synonyms), "feature_type").select("feature_type", "id", "n")
