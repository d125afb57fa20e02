"""Queries of the general data problems (p1, p3, p5, p7) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guideloom.operators.hierarchy import descendant_pairs, hierarchy
from guideloom.operators.intervals import spans_and_gaps
from guideloom.operators.tree_aggregate import count_of, heavy_keys, max_of, min_of, stacked_keys, sum_of, tree_aggregate
from guideloom.sources.annotation_lines import loaded, parse_annotation_lines, rejects
from guideloom.tables import Query, table

KEY_FIELDS = ["query_name", "target_name"]
FEATURE_ORDER = ["loaded_at", "row_id"]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Values of both name columns that hold at least 2 % of all hits."""
    return heavy_keys(table(spark, d, "search_hits"), KEY_FIELDS, per=50)


def p1_key_totals(spark: SparkSession, d: str) -> DataFrame:
    """Results for each query and each target: hits, kinds of hits and distances."""
    hits = table(spark, d, "search_hits")
    rows = stacked_keys(hits, KEY_FIELDS, ["distance", "search_type"])
    kind = F.col("search_type")
    return tree_aggregate(
        rows,
        ["key_field", "key_value"],
        [
            count_of("n_hits"),
            count_of("n_exact", kind == "Exact"),
            count_of("n_indel", kind == "Indel"),
            min_of("best_distance", F.col("distance")),
            max_of("worst_distance", F.col("distance")),
            sum_of("sum_distance", F.col("distance").cast("long")),
        ],
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Annotation lines that do not parse, with the reason."""
    return rejects(parse_annotation_lines(table(spark, d, "raw_annotation"))).select("line_no", "reason")


def p3_loaded(spark: SparkSession, d: str) -> DataFrame:
    """The records of the other annotation lines."""
    return loaded(parse_annotation_lines(table(spark, d, "raw_annotation")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Root and depth of every feature; features caught in circular links apart."""
    nodes = hierarchy(table(spark, d, "annotation_features"), "id", "parent", FEATURE_ORDER)
    return nodes.select("id", "root_id", "node_depth")


def p5_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """Path, depth, root and number of descendants of every feature."""
    nodes = hierarchy(table(spark, d, "annotation_features"), "id", "parent", FEATURE_ORDER, paths=True)
    return nodes.select("id", "root_id", "node_depth", F.array_join("path", "/").alias("path"), "descendants")


def p5_descendants(spark: SparkSession, d: str) -> DataFrame:
    """The descendants of every feature, with their distance; features caught in circular links have none."""
    return descendant_pairs(hierarchy(table(spark, d, "annotation_features"), "id", "parent", FEATURE_ORDER, paths=True))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Continuous spans of each transcript's segments and the gaps between them."""
    return spans_and_gaps(table(spark, d, "plan_segments"), "transcript_id", "start_1based", "end_1based")


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_key_totals, p3_found, p3_loaded, p5_found, p5_hierarchy, p5_descendants, p7_found)}

_STACKED = """SELECT 'query_name' AS key_field, query_name AS key_value, distance, search_type FROM search_hits
UNION ALL SELECT 'target_name', target_name, distance, search_type FROM search_hits"""

# The nine columns of a record line; c9 with escaped quotes masked.
RECORD_LINES = r"""WITH t AS (
  SELECT line_no, file_name, regexp_replace(line, '\r$', '') AS s FROM raw_annotation WHERE line IS NOT NULL),
r AS (
  SELECT line_no, file_name, s, string_split(s, chr(9)) AS f FROM t WHERE regexp_matches(s, '[^ \t\r\n\v\f]') AND s NOT LIKE '#%'),
k AS (
  SELECT *, len(f) = 9 AS nine, lower(f[3]) AS feat, replace(f[9], '\"', '\' || chr(1)) AS m FROM r),
a AS (
  SELECT *, list_filter(regexp_extract_all(m, '(?:[^;"]|"[^"]*")+'), lambda x: regexp_matches(x, '^\s*ID([=\s]|$)'))[1] AS first_id FROM k),
j AS (
  SELECT *, CASE
    WHEN NOT nine THEN 'columns'
    WHEN (length(m) - length(replace(m, '"', ''))) % 2 = 1 THEN 'quoting'
    WHEN NOT regexp_full_match(f[4], '[0-9]+') OR NOT regexp_full_match(f[5], '[0-9]+')
      OR NOT TRY_CAST(f[4] AS DECIMAL(38, 0)) BETWEEN 1 AND 4294967295 OR NOT TRY_CAST(f[5] AS DECIMAL(38, 0)) BETWEEN 1 AND 4294967295
      OR TRY_CAST(f[4] AS DECIMAL(38, 0)) > TRY_CAST(f[5] AS DECIMAL(38, 0)) THEN 'coordinates'
    WHEN NOT (f[8] IN ('0', '1', '2') OR (f[8] = '.' AND feat <> 'cds')) THEN 'phase'
    WHEN feat IN ('gene', 'mrna', 'transcript')
      AND (first_id IS NULL OR regexp_replace(regexp_replace(first_id, '^\s*ID[=\s]?', ''), '[\s"]', '', 'g') = '') THEN 'id'
  END AS reason FROM a)
"""

_LINKS = r"""latest AS (
  SELECT id, nullif(trim(parent, chr(32) || chr(9) || chr(13) || chr(10)), '') AS p FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC NULLS LAST, row_id DESC) AS rn FROM annotation_features WHERE id IS NOT NULL)
  WHERE rn = 1),
links AS (SELECT l.id, q.id AS p FROM latest l LEFT JOIN latest q ON l.p = q.id),
walk AS (
  SELECT id, id AS root_id, 0 AS node_depth, id AS path FROM links WHERE p IS NULL
  UNION ALL SELECT l.id, w.root_id, w.node_depth + 1, w.path || '/' || l.id FROM links l JOIN walk w ON l.p = w.id)
"""

SQL = {
    "p1_found": """SELECT key_field, key_value FROM (
  SELECT 'query_name' AS key_field, query_name AS key_value FROM search_hits UNION ALL SELECT 'target_name', target_name FROM search_hits)
WHERE key_value IS NOT NULL GROUP BY ALL HAVING count(*) * 50 >= (SELECT count(*) FROM search_hits)""",
    "p1_key_totals": f"""SELECT key_field, key_value, count(*) AS n_hits,
  count(*) FILTER (WHERE search_type = 'Exact') AS n_exact, count(*) FILTER (WHERE search_type = 'Indel') AS n_indel,
  min(distance) AS best_distance, max(distance) AS worst_distance, CAST(sum(distance) AS BIGINT) AS sum_distance
FROM ({_STACKED}) GROUP BY ALL""",
    "p3_found": f"{RECORD_LINES} SELECT line_no, reason FROM j WHERE reason IS NOT NULL",
    "p3_loaded": f"""{RECORD_LINES} SELECT line_no, f[1] AS seqid, f[2] AS source, f[3] AS feature, CAST(f[4] AS BIGINT) AS start_1based,
  CAST(f[5] AS BIGINT) AS end_1based, f[6] AS score, f[7] AS strand, CAST(nullif(f[8], '.') AS INTEGER) AS phase, f[9] AS attributes, file_name
FROM j WHERE reason IS NULL""",
    "p5_found": f"""WITH RECURSIVE {_LINKS}
SELECT l.id, coalesce(w.root_id, 'cycle') AS root_id, coalesce(w.node_depth, -1) AS node_depth FROM links l LEFT JOIN walk w ON l.id = w.id""",
    "p5_hierarchy": f"""WITH RECURSIVE {_LINKS},
below AS (SELECT u.up AS id, count(*) - 1 AS n FROM (SELECT unnest(string_split(path, '/')) AS up FROM walk) u GROUP BY u.up)
SELECT l.id, coalesce(w.root_id, 'cycle') AS root_id, coalesce(w.node_depth, -1) AS node_depth, w.path, CASE WHEN w.id IS NOT NULL THEN b.n END AS descendants
FROM links l LEFT JOIN walk w ON l.id = w.id LEFT JOIN below b ON l.id = b.id""",
    "p5_descendants": f"""WITH RECURSIVE {_LINKS},
up AS (
  SELECT l.p AS ancestor_id, l.id, 1 AS distance FROM links l JOIN walk w ON l.id = w.id WHERE l.p IS NOT NULL
  UNION ALL SELECT l.p, u.id, u.distance + 1 FROM up u JOIN links l ON u.ancestor_id = l.id WHERE l.p IS NOT NULL)
SELECT ancestor_id, id, distance FROM up""",
    "p7_found": """WITH s AS (
  SELECT DISTINCT transcript_id, start_1based AS lo, end_1based AS hi FROM plan_segments WHERE start_1based <= end_1based),
m AS (
  SELECT *, max(hi) OVER (PARTITION BY transcript_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM s),
g AS (
  SELECT *, sum(CASE WHEN upto IS NULL OR lo > upto + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY transcript_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT transcript_id, 'merged' AS span_kind, min(lo) AS start_1based, max(hi) AS end_1based FROM g GROUP BY transcript_id, island
UNION ALL SELECT transcript_id, 'gap', upto + 1, lo - 1 FROM g WHERE lo > upto + 1""",
}
