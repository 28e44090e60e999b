"""Queries of the problems, over whole tables with production parameters; SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import alike
from ..sources.tables import table
from .knn import nearest_vectors, neighbour_pairs
from .leak import leaks, verbatim
from .markup import clean_markup, markup_found
from .mix import mix, shares
from .nearest_time import nearest_in_time
from .neardup import near_duplicates, near_pairs, note_texts
from .residue import residue
from .split import split_oversized


def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return split_oversized(table(spark, folder, "chunks"), table(spark, folder, "notes"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return p1_pieces(spark, folder).where("piece = 0").select("path", "ordinal")


def p2_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return nearest_vectors(table(spark, folder, "vectors"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return neighbour_pairs(p2_neighbours(spark, folder))


def p2_recall(spark: SparkSession, folder: str) -> DataFrame:
    """One row: of the 5 most similar of every vector whose id is divisible by 100, by a scan of all rows, how many the index found."""
    rows = table(spark, folder, "vectors")
    asked = rows.where("vec_id % 100 = 0").groupBy(F.col("vec_id").alias("qid")).agg(F.max("embedding").alias("embedding"))
    near = alike(rows.select(F.col("vec_id").alias("key"), "embedding"), asked, keep=6).where("key <> qid").distinct()
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("sim"), "key"))
    exact = near.withColumn("place", place).where("place <= 5").select(F.col("qid").alias("vec_a"), F.col("key").alias("vec_b"))
    found = p2_neighbours(spark, folder).select("vec_a", "vec_b", F.lit(True).alias("found"))
    joined = exact.join(found, ["vec_a", "vec_b"], "left")
    return joined.agg(F.count("*").alias("wanted"), F.count("found").alias("found"), F.try_divide(F.count("found"), F.count("*")).alias("recall"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return markup_found(table(spark, folder, "notes"))


def p3_clean_notes(spark: SparkSession, folder: str) -> DataFrame:
    return clean_markup(table(spark, folder, "notes").select("path", "body").distinct()).drop("body")


def p3_clean_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return clean_markup(table(spark, folder, "chunks").select("path", "ordinal", "text").distinct(), "text").drop("text")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return nearest_in_time(table(spark, folder, "read_log"), table(spark, folder, "search_log")).select("read_id", "search_id")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    found = near_duplicates(note_texts(table(spark, folder, "notes")), threshold=0.5, n=3)
    return near_pairs(found).select(F.col("key_a").alias("path_a"), F.col("key_b").alias("path_b"))


def p6_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate documents: each one's class of equal fingerprints, and how many other classes it is close to."""
    found = near_duplicates(table(spark, folder, "documents").select(F.col("doc_id").alias("key"), "text"))
    ends = found.pairs.select(F.explode(F.array("class_a", "class_b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("links"))
    return found.members.join(ends, "class_id", "left").select(F.col("key").alias("doc_id"), "class_id", F.coalesce("links", F.lit(0)).alias("links"))


def p7_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return verbatim(p7_leaks(spark, folder))


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    targets = table(spark, folder, "mix_targets")
    return shares(mix(table(spark, folder, "documents"), targets), targets)


def p8_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return residue(table(spark, folder, "documents")).select("doc_id")


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_pieces, p2_found, p2_neighbours, p2_recall, p3_found, p3_clean_notes, p3_clean_chunks, p4_found, p6_found, p6_groups, p7_found, p7_leaks, p8_shares, p8_mixture, p9_found)
}

SQL = {
    "p1_found": "SELECT DISTINCT path, ordinal FROM chunks WHERE strlen(text) // 3 + 1 > 450",
    "p4_found": """
WITH r AS (SELECT DISTINCT read_id, secs, path FROM read_log WHERE read_id IS NOT NULL AND secs IS NOT NULL AND path IS NOT NULL),
s AS (SELECT path, secs, min(search_id) AS search_id FROM (SELECT search_id, secs, unnest(shown) AS path FROM search_log) WHERE secs IS NOT NULL AND path IS NOT NULL GROUP BY path, secs),
b AS (SELECT r.read_id, r.secs, s.secs AS other, s.search_id FROM r ASOF JOIN s ON r.path = s.path AND r.secs >= s.secs),
a AS (SELECT r.read_id, r.secs, s.secs AS other, s.search_id FROM r ASOF JOIN s ON r.path = s.path AND r.secs <= s.secs),
u AS (SELECT read_id, search_id, abs(secs - other) AS gap, other FROM b UNION ALL SELECT read_id, search_id, abs(secs - other), other FROM a)
SELECT read_id, arg_min(search_id, (gap, other)) AS search_id FROM u WHERE gap <= 600 GROUP BY read_id""",
    "p6_found": r"""
WITH t AS (SELECT path, min(coalesce(fields['description'], '') || chr(10) || coalesce(body, '')) AS text FROM notes WHERE path IS NOT NULL GROUP BY path),
w AS (SELECT path, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS words FROM t),
g AS (SELECT DISTINCT path, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS triple FROM (SELECT path, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
n AS (SELECT path, count(*) AS n FROM g GROUP BY path),
c AS (SELECT a.path AS path_a, b.path AS path_b, count(*) AS common FROM g a JOIN g b ON a.triple = b.triple AND a.path < b.path GROUP BY a.path, b.path)
SELECT path_a, path_b FROM c JOIN n x ON x.path = path_a JOIN n y ON y.path = path_b WHERE 2 * common >= x.n + y.n - common""",
    "p7_found": r"""
WITH texts AS (SELECT DISTINCT 'd' AS kind, doc_id AS id, text FROM documents UNION SELECT DISTINCT 'i', item_id, text FROM eval_items),
w AS (SELECT kind, id, regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+') AS words FROM texts),
g AS (SELECT DISTINCT kind, id, array_to_string(words[i:i + 12], ' ') AS passage FROM (SELECT kind, id, words, unnest(range(1, len(words) - 11)) AS i FROM w))
SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM g d JOIN g i ON d.passage = i.passage AND d.kind = 'd' AND i.kind = 'i'""",
}
