"""What the queries share: their query sets, and the form of their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import usable
from ..sources.tables import table

#: The day from which ages are counted, and the same in days since 1970 and in seconds.
TODAY, TODAY_DAYS, NOW = "2026-12-31", 20818, 1798675200


def plain(df: DataFrame) -> DataFrame:
    """Integers as bigint, doubles rounded to six places."""
    kind = dict(df.dtypes)
    return df.select(*[F.col(c).cast("bigint").alias(c) if kind[c] in ("int", "smallint", "tinyint") else F.round(F.col(c).cast("double"), 6).alias(c) if kind[c] in ("double", "float") else F.col(c) for c in df.columns])


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "vectors")


def query_vectors(spark: SparkSession, folder: str, where: str = "true") -> DataFrame:
    """Every vector whose id is divisible by 100 is a query."""
    rows = vectors(spark, folder).where("vec_id % 100 = 0").where(where).where(usable())
    return rows.groupBy(F.col("vec_id").alias("qid")).agg(F.max("embedding").alias("embedding"), F.max("path").alias("own_path"), F.max("ordinal").alias("own_ordinal"))


def query_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Every search whose id is divisible by 100 is a query."""
    return table(spark, folder, "search_log").where("search_id % 100 = 0 and query is not null").groupBy(F.col("search_id").alias("qid")).agg(F.max("query").alias("query"), F.max(F.try_element_at("shown", F.lit(1))).alias("expected"))


V_SQL = """
v AS (SELECT DISTINCT vec_id, path, ordinal, question_no, CAST(embedding AS DOUBLE[]) AS e FROM vectors
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
q AS (SELECT DISTINCT vec_id AS qid, path AS own_path, ordinal AS own_ordinal, e AS qe FROM v WHERE vec_id % 100 = 0),
s AS (SELECT qid, path, ordinal, question_no, list_cosine_similarity(e, qe) AS score FROM v, q WHERE path IS NOT NULL),
best AS (SELECT qid, path, score, coalesce(ordinal, 0) AS ordinal FROM s
  QUALIFY row_number() OVER (PARTITION BY qid, path ORDER BY score DESC, coalesce(ordinal, 0), coalesce(question_no, -1)) = 1)"""
N_SQL = """
n AS (SELECT DISTINCT path, fields, body, added_at, modified_at, deleted_at FROM notes WHERE path IS NOT NULL)"""
T_SQL = """
tq AS (SELECT search_id AS qid, max(query) AS query, max(shown[1]) AS expected FROM search_log WHERE search_id % 100 = 0 AND query IS NOT NULL GROUP BY search_id)"""
IDS_SQL = r"""
ids AS (SELECT DISTINCT qid, t AS identifier FROM (SELECT qid, CASE WHEN regexp_matches(w, '\.(md|sh)$') THEN w ELSE regexp_replace(w, '^\.+|\.+$', '', 'g') END AS t
  FROM (SELECT qid, unnest(string_split_regex(query, '[\s,;()«»"''?!:]+')) AS w FROM tq)) WHERE length(t) >= 3 AND regexp_matches(t, '[\p{L}\p{N}]') AND (regexp_matches(t, '^[A-Z]{2,}-[0-9]+$') OR contains(t, '_')
  OR regexp_matches(t, '\.(md|sh|rs|php|dart|json|yml|yaml|toml|sql|py|ts|js)$')
  OR (regexp_matches(t, '^[\p{L}\p{N}]+$') AND regexp_matches(t, '[a-z]') AND regexp_matches(t, '^.[^A-Z]*[A-Z]')) OR (regexp_matches(t, '[0-9]') AND regexp_matches(t, '\p{L}')))),
raw AS (SELECT path, coalesce(array_to_string(list_transform(map_entries(fields), lambda x: x.key || ': ' || x.value), chr(10)) || chr(10), '') || coalesce(body, '') AS raw FROM n),
lex AS (SELECT qid, path, least(count(*), 2) * 0.04 AS bonus FROM raw, ids WHERE contains(raw, identifier) GROUP BY qid, path)"""
