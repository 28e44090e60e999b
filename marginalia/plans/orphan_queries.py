"""Queries of problem 5, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.orphans import COLUMNS, orphan_report, orphans
from ..sources.tables import table


def _found(spark: SparkSession, folder: str) -> DataFrame:
    return orphans(*(table(spark, folder, name) for name in ("notes", "common_notes", "feedback")))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _found(spark, folder).where("depth = 0").select(*COLUMNS)


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    return orphan_report(_found(spark, folder))


QUERIES = {"p5_found": p5_found, "p5_report": p5_report}

_REFS = r"""
WITH RECURSIVE targets AS (
  SELECT path, fields['name'] AS name, added_at FROM notes WHERE deleted_at IS NULL AND path IS NOT NULL
  UNION ALL SELECT path, fields['name'], added_at FROM common_notes WHERE path IS NOT NULL),
carried AS (
  SELECT path, lower(regexp_replace(name, '[^\p{L}\p{N}]', '', 'g')) AS target, false AS by_path, added_at FROM targets WHERE name IS NOT NULL
  UNION SELECT path, lower(regexp_replace(regexp_replace(regexp_extract(path, '[^/]*$'), '(.)\.[^.]*$', '\1'), '[^\p{L}\p{N}]', '', 'g')), false, added_at FROM targets
  UNION SELECT path, path, true, added_at FROM targets),
since AS (SELECT target, by_path, min(added_at) AS added_at FROM carried GROUP BY target, by_path),
raw AS (
  SELECT 'body' AS ref_field, path, modified_at, unnest(regexp_extract_all(body, '(?s)\[\[(.*?)\]\]', 1)) AS link FROM notes WHERE path IS NOT NULL
  UNION ALL SELECT 'fields', path, modified_at, fields['superseded_by'] FROM notes WHERE path IS NOT NULL AND fields['superseded_by'] IS NOT NULL),
refs AS (
  SELECT DISTINCT 'notes' AS ref_table, ref_field, path AS ref_key, lower(regexp_replace(regexp_extract(link, '^([^|#]*)', 1), '[^\p{L}\p{N}]', '', 'g')) AS target,
    false AS by_path, modified_at AS until, strftime(modified_at, '%Y-%m') AS period FROM raw
  UNION ALL SELECT DISTINCT 'feedback', 'path', CAST(pair_id AS VARCHAR), path, true,
    CAST(date '1970-01-01' + CAST(last_day AS INTEGER) + 1 AS TIMESTAMP) - INTERVAL 1 MICROSECOND, strftime(date '1970-01-01' + CAST(last_day AS INTEGER), '%Y-%m') FROM feedback WHERE path IS NOT NULL),
judged AS (
  SELECT r.*, coalesce(s.added_at <= r.until, false) AS met FROM refs r LEFT JOIN since s ON r.target = s.target AND r.by_path = s.by_path WHERE r.target <> '' OR r.by_path)
"""

SQL = {
    "p5_found": _REFS + "SELECT ref_table, ref_field, ref_key, target, period FROM judged WHERE NOT met",
    "p5_report": _REFS
    + """,
edges AS (SELECT DISTINCT j.ref_table, j.ref_key, c.path AS parent FROM judged j JOIN (SELECT DISTINCT path, target, by_path FROM carried) c ON j.target = c.target AND j.by_path = c.by_path WHERE j.met),
bad AS (
  SELECT DISTINCT ref_table, ref_key, 0 AS depth FROM judged WHERE NOT met
  UNION SELECT DISTINCT e.ref_table, e.ref_key, b.depth + 1 FROM bad b JOIN edges e ON b.ref_table = 'notes' AND b.ref_key = e.parent
  WHERE b.depth < 40),
first AS (SELECT ref_table, ref_key, min(depth) AS depth FROM bad GROUP BY ref_table, ref_key),
inherited AS (
  SELECT DISTINCT j.ref_table, j.ref_field, j.ref_key, j.target, j.period FROM judged j JOIN first f ON j.ref_table = f.ref_table AND j.ref_key = f.ref_key AND f.depth > 0
  JOIN (SELECT DISTINCT path, target, by_path FROM carried) c ON j.target = c.target AND j.by_path = c.by_path
  JOIN first p ON p.ref_table = 'notes' AND p.ref_key = c.path AND p.depth = f.depth - 1 WHERE j.met)
SELECT ref_table, period, CAST(sum(direct) AS BIGINT) AS direct, CAST(sum(inherited) AS BIGINT) AS inherited FROM (
  SELECT ref_table, period, CASE WHEN met THEN 0 ELSE 1 END AS direct, 0 AS inherited FROM judged WHERE NOT met
  UNION ALL SELECT ref_table, period, 0, 1 FROM inherited) GROUP BY ref_table, period""",
}
