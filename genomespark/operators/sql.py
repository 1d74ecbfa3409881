"""SQL that gives the same rows as the queries beside it, for a single-node checker."""

_NAME = r"""nullif(trim(regexp_replace(trim({c}, e' \t\r\n'), '^(gene|transcript|CDS):', ''), e' \t\r\n'), '')"""
_LINKS = f"""
ids AS (SELECT DISTINCT {_NAME.format(c="feature_id")} AS node FROM gff_feature WHERE {_NAME.format(c="feature_id")} IS NOT NULL),
raw AS (SELECT {_NAME.format(c="feature_id")} AS node, unnest(parents) AS p FROM gff_feature),
edges AS (SELECT DISTINCT node, {_NAME.format(c="p")} AS parent FROM raw
          WHERE node IS NOT NULL AND {_NAME.format(c="p")} IN (SELECT node FROM ids)),
reach AS (SELECT node, parent AS anc FROM edges UNION SELECT r.node, e.parent FROM reach r JOIN edges e ON e.node = r.anc),
circle AS (SELECT node FROM reach WHERE node = anc),
below AS (SELECT DISTINCT node FROM reach WHERE anc IN (SELECT node FROM circle) AND node NOT IN (SELECT node FROM circle)),
free AS (SELECT node FROM ids WHERE node NOT IN (SELECT node FROM circle) AND node NOT IN (SELECT node FROM below)),
walk AS (SELECT node, node AS anc, 0 AS d FROM free UNION SELECT w.node, e.parent, w.d + 1 FROM walk w JOIN edges e ON e.node = w.anc)
"""
# ways without a node twice, from every node: the shortest way to each ancestor is among them, on circles too
_WAYS = f"""{_LINKS.rstrip()},
ways AS (SELECT node, parent AS anc, 1 AS d, [node, parent] AS seen FROM edges WHERE node <> parent
         UNION ALL SELECT w.node, e.parent, w.d + 1, list_append(w.seen, e.parent) FROM ways w JOIN edges e ON e.node = w.anc WHERE NOT list_contains(w.seen, e.parent))
"""

P3_FOUND = f"""WITH RECURSIVE {_LINKS}
SELECT node AS feature_id, '#cycle' AS root_id, CAST(-1 AS INTEGER) AS node_depth FROM (SELECT DISTINCT node FROM circle)
UNION ALL SELECT node, '#below_cycle', CAST(-1 AS INTEGER) FROM below
UNION ALL SELECT node, anc, CAST(min(d) AS INTEGER) FROM walk WHERE anc NOT IN (SELECT node FROM edges) GROUP BY node, anc"""

P3_DESCENDANTS = f"""WITH RECURSIVE {_WAYS}
SELECT anc AS feature_id, node AS descendant_id, CAST(min(d) AS INTEGER) AS n_links FROM ways GROUP BY anc, node"""

P3_PATHS = f"""WITH RECURSIVE {_LINKS},
named AS (SELECT node, node AS anc, 0 AS d, [node] AS path FROM free
          UNION SELECT w.node, e.parent, w.d + 1, list_prepend(e.parent, w.path) FROM named w JOIN edges e ON e.node = w.anc),
best AS (SELECT node, anc, d, path, row_number() OVER (PARTITION BY node, anc ORDER BY d, path) AS n FROM named
         WHERE anc NOT IN (SELECT node FROM edges))
SELECT node AS feature_id, anc AS root_id, CAST(d AS INTEGER) AS node_depth, array_to_string(path, ' > ') AS node_path FROM best WHERE n = 1
UNION ALL SELECT DISTINCT node, '#cycle', CAST(-1 AS INTEGER), NULL FROM circle
UNION ALL SELECT node, '#below_cycle', CAST(-1 AS INTEGER), NULL FROM below"""

_TRIM = r"nullif(nullif(trim({c}, e' \t\r\n'), ''), '*')"
P4_FOUND = f"""
WITH a AS (SELECT {_TRIM.format(c="target_name")} AS k FROM (SELECT DISTINCT * EXCLUDE (record_id, loaded_at) FROM sam_record)),
b AS (SELECT {_TRIM.format(c="contig")} AS k FROM (SELECT DISTINCT * EXCLUDE (variant_id, loaded_at) FROM simple_variant))
SELECT 'sam_record.target_name' AS field_name, k AS key_value FROM a WHERE k IS NOT NULL GROUP BY k
HAVING count(*) * 20 >= (SELECT count(k) FROM a)
UNION ALL SELECT 'simple_variant.contig', k FROM b WHERE k IS NOT NULL GROUP BY k HAVING count(*) * 20 >= (SELECT count(k) FROM b)"""

P4_TARGETS = f"""
WITH a AS (SELECT *, {_TRIM.format(c="target_name")} AS k FROM (SELECT DISTINCT * EXCLUDE (record_id, loaded_at) FROM sam_record))
SELECT k AS target_name, count(*) AS n_rows, min(target_start) AS first_start, max(target_end) AS last_end,
       CAST(sum(num_m + num_eq + num_x) AS BIGINT) AS n_letters
FROM a WHERE k IS NOT NULL GROUP BY k"""

P7_FOUND = r"""
WITH g AS (SELECT assembly_id, lower(trim(seqid, e' \t\r\n')) AS seqid, start_pos, end_pos FROM gene_row
           WHERE start_pos <= end_pos AND assembly_id IS NOT NULL AND trim(seqid, e' \t\r\n') <> ''),
r AS (SELECT *, max(end_pos) OVER (PARTITION BY assembly_id, seqid ORDER BY start_pos, end_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM g),
o AS (SELECT *, sum(CASE WHEN reach >= start_pos THEN 0 ELSE 1 END) OVER (PARTITION BY assembly_id, seqid ORDER BY start_pos, end_pos ROWS UNBOUNDED PRECEDING) AS n FROM r)
SELECT assembly_id, seqid, 'covered' AS span_kind, CAST(min(start_pos) AS INTEGER) AS start_pos, CAST(max(end_pos) AS INTEGER) AS end_pos FROM o GROUP BY assembly_id, seqid, n
UNION ALL SELECT assembly_id, seqid, 'gap', CAST(reach + 1 AS INTEGER), CAST(start_pos - 1 AS INTEGER) FROM r WHERE start_pos > reach + 1"""

_P2 = r"""
WITH body AS (SELECT line_key, regexp_replace(line_text, '\r\z', '') AS b FROM gff_line WHERE line_text IS NOT NULL),
judged AS (SELECT line_key, b, length(b) - length(replace(b, '"', '')) AS quotes FROM body WHERE regexp_matches(b, '\S') AND NOT starts_with(b, '#')),
parts AS (SELECT *, list_transform(string_split(b, '"'), lambda x, i: CASE WHEN i % 2 = 0 THEN translate(x, chr(9) || ';=,', chr(1) || chr(2) || chr(3) || chr(4)) ELSE x END) AS p FROM judged),
cells AS (SELECT line_key, quotes, string_split(array_to_string(p, '"'), chr(9)) AS c FROM parts),
vals AS (SELECT *, CASE WHEN regexp_full_match(c[4], '[0-9]+') THEN TRY_CAST(c[4] AS INTEGER) END AS s, CASE WHEN regexp_full_match(c[5], '[0-9]+') THEN TRY_CAST(c[5] AS INTEGER) END AS e,
         string_split(regexp_replace(c[9], ';\z', ''), ';') AS a FROM cells),
why AS (SELECT line_key, CASE WHEN quotes % 2 = 1 THEN 'quoting' WHEN len(c) <> 9 THEN 'columns'
  WHEN s IS NULL OR e IS NULL OR s < 1 OR e < 1 OR s > e THEN 'coordinates'
  WHEN NOT (c[6] = '.' OR regexp_full_match(c[6], '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?')) THEN 'score'
  WHEN c[7] NOT IN ('+', '-', '.', '?') THEN 'strand'
  WHEN c[8] NOT IN ('0', '1', '2', '.') OR (c[8] = '.' AND c[3] = 'CDS') THEN 'phase'
  WHEN len(list_filter(a, lambda x: length(x) - length(replace(x, '=', '')) <> 1)) > 0
    OR len(list_distinct(list_transform(a, lambda x: trim(split_part(x, '=', 1))))) < len(a)
    OR len(list_filter(a, lambda x: trim(split_part(x, '=', 1)) = 'ID' AND contains(split_part(x, '=', 2), ','))) > 0 THEN 'attributes' END AS reason, * EXCLUDE (line_key) FROM vals)
"""
P2_FOUND = _P2 + "SELECT line_key, reason FROM why WHERE reason IS NOT NULL"

_RAW = "translate(c[{i}], chr(1) || chr(2) || chr(3) || chr(4), chr(9) || ';=,')"
P2_VALID = _P2 + f"""SELECT w.line_key, l.file_name, l.line_number, {", ".join(f"{_RAW.format(i=i)} AS {n}" for i, n in ((1, "seqid"), (2, "feature_source"), (3, "feature_type"), (7, "strand"), (8, "phase"), (9, "attributes")))},
  s AS start_pos, e AS end_pos, CASE WHEN c[6] <> '.' THEN TRY_CAST(c[6] AS DOUBLE) END AS score FROM why w JOIN gff_line l USING (line_key) WHERE reason IS NULL"""

SQL = {"p2_valid": P2_VALID, "p2_found": P2_FOUND, "p3_found": P3_FOUND, "p3_paths": P3_PATHS, "p3_descendants": P3_DESCENDANTS, "p4_found": P4_FOUND, "p4_targets": P4_TARGETS, "p7_found": P7_FOUND}
