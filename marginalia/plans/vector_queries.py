"""Queries over vectors, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import alike, usable
from ..operators import measure, ranking
from ..operators.duplicates import near_notes
from ..operators.feedback import learned_bonus, sum_bonuses, within_window
from ..operators.lexical import lexical_bonus
from ..session import materialize
from ..sources.tables import table
from .common import IDS_SQL, N_SQL, T_SQL, TODAY_DAYS, V_SQL, plain, query_texts, query_vectors, vectors


def v02_vec_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest vectors of each query vector, by scan."""
    rows = vectors(spark, folder).where("vec_id is not null").select(F.col("vec_id").alias("key"), "embedding")
    pairs = alike(rows, query_vectors(spark, folder), keep=11).where("key <> qid").distinct()  # ten, and the query itself
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("sim"), "key"))
    return plain(pairs.withColumn("place", place).where("place <= 10").select("qid", F.col("key").alias("vec_id"), "sim", "place"))


def v04_note_rank_max(spark: SparkSession, folder: str) -> DataFrame:
    return plain(ranking.rank_notes(vectors(spark, folder), query_vectors(spark, folder), 5))


def _pair_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Stand-ins for the encoded queries of the learned pairs: the vector whose id is the query's first pair id."""
    first = table(spark, folder, "feedback").where("query is not null").groupBy("query").agg(F.min("pair_id").alias("vec_id"))
    return vectors(spark, folder).where(usable()).groupBy("vec_id").agg(F.max("embedding").alias("embedding")).join(first, "vec_id")


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "feedback").select("pair_id", "query", "path", "source", "count", "last_day").distinct()


def _learned(spark: SparkSession, folder: str, asked: DataFrame | None = None) -> DataFrame:
    return learned_bonus(_pairs(spark, folder), _pair_vectors(spark, folder), asked if asked is not None else query_vectors(spark, folder), TODAY_DAYS)


def v06_learned_bonus(spark: SparkSession, folder: str) -> DataFrame:
    return plain(_learned(spark, folder))


def _base(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.rank_notes(vectors(spark, folder), query_vectors(spark, folder), 50)


def v08_learned_window(spark: SparkSession, folder: str) -> DataFrame:
    return plain(within_window(_learned(spark, folder), _base(spark, folder)))


def _boosted(spark: SparkSession, folder: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The query vectors; the ranking without bonuses, and both bonuses together. The text of a query vector is that of the search with its number, if
    there is one."""
    asked = materialize(query_vectors(spark, folder))
    base = materialize(ranking.rank_notes(vectors(spark, folder), asked, 50))
    texts = query_texts(spark, folder).join(asked.select("qid"), "qid", "left_semi")
    learned = within_window(_learned(spark, folder, asked), base)
    return asked, {"base": base, "bonus": materialize(sum_bonuses(lexical_bonus(table(spark, folder, "notes"), texts), learned))}


def v09_note_rank_bonus(spark: SparkSession, folder: str) -> DataFrame:
    asked, given = _boosted(spark, folder)
    return plain(ranking.rank_notes(vectors(spark, folder), asked, 5, **given))


def v10_search(spark: SparkSession, folder: str) -> DataFrame:
    asked, given = _boosted(spark, folder)
    found = ranking.search(vectors(spark, folder), asked, table(spark, folder, "notes"), **given)
    return plain(found.select("qid", "path", "score", "place", "hidden"))


def _passages(spark: SparkSession, folder: str, f) -> DataFrame:
    asked, given = _boosted(spark, folder)
    return f(vectors(spark, folder), asked, table(spark, folder, "notes"), table(spark, folder, "chunks"), **given)


def v11_answer(spark: SparkSession, folder: str) -> DataFrame:
    return plain(_passages(spark, folder, ranking.answer).select("qid", "path", "score", "text"))


def v13_hook(spark: SparkSession, folder: str) -> DataFrame:
    return plain(_passages(spark, folder, ranking.hook).select("qid", "path", "score", "text"))


def v16_nearest_active(spark: SparkSession, folder: str) -> DataFrame:
    return plain(ranking.nearest_active_note(vectors(spark, folder), query_vectors(spark, folder), table(spark, folder, "notes")))


def v17_near_note_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return plain(near_notes(vectors(spark, folder), table(spark, folder, "notes"), 0.97))


def v17_near_note_pairs_90(spark: SparkSession, folder: str) -> DataFrame:
    """The same at the engine's own threshold, which very many pairs of the test vectors pass."""
    return plain(near_notes(vectors(spark, folder), table(spark, folder, "notes")))


def v18_recentred_rank(spark: SparkSession, folder: str) -> DataFrame:
    once = vectors(spark, folder).where(usable()).groupBy("vec_id").agg(F.max(F.struct("path", "ordinal", "question_no", "embedding")).alias("v")).select("vec_id", "v.*")
    moved = ranking.recenter(once)
    asked = moved.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    return plain(ranking.rank_notes(moved, asked, 5).select("qid", "path", "score", "place"))


def v19_mmr(spark: SparkSession, folder: str) -> DataFrame:
    return plain(ranking.mmr(vectors(spark, folder), query_vectors(spark, folder)))


def _cases(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    asked = query_vectors(spark, folder, "question_no is not null")
    return asked, asked.select("qid", F.substring_index("own_path", "/", 1).alias("family"), F.col("own_path").alias("expected"), F.col("own_ordinal").alias("ordinal"))


def b01_bench_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """How often a question's own note and passage come back, by text vectors alone."""
    asked, cases = _cases(spark, folder)
    ranked = ranking.rank_notes(vectors(spark, folder).where("question_no is null"), asked, 5)
    return plain(measure.hit_rates(ranked, cases))


def b07_diagnose(spark: SparkSession, folder: str) -> DataFrame:
    asked, cases = _cases(spark, folder)
    return plain(measure.diagnose(vectors(spark, folder).where("question_no is null"), asked, cases))


def b03_passage_cost(spark: SparkSession, folder: str) -> DataFrame:
    """The cost of reading passages in place of whole notes, for the questions' own notes."""
    asked, cases = _cases(spark, folder)
    found = ranking.answer(vectors(spark, folder).where("question_no is null"), asked, table(spark, folder, "notes"), table(spark, folder, "chunks"))
    return plain(measure.passage_cost(found, cases))


def b02_leave_one_out(spark: SparkSession, folder: str) -> DataFrame:
    """Learned bonuses for the learned queries themselves, each without the pairs of its own text."""
    known = _pair_vectors(spark, folder)
    asked = known.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "query", "embedding")
    return plain(learned_bonus(_pairs(spark, folder), known, asked, TODAY_DAYS, skip_own=True))


def b05_q8_fidelity(spark: SparkSession, folder: str) -> DataFrame:
    return plain(measure.fidelity(vectors(spark, folder), table(spark, folder, "chunks")))


QUERIES = {
    f.__name__: f
    for f in (
        v02_vec_topk, v04_note_rank_max, v06_learned_bonus, v08_learned_window, v09_note_rank_bonus, v10_search, v11_answer, v13_hook,
        v16_nearest_active, v17_near_note_pairs, v17_near_note_pairs_90, v18_recentred_rank, v19_mmr, b01_bench_metrics, b02_leave_one_out, b03_passage_cost, b07_diagnose, b05_q8_fidelity,
    )
}

_PLACED = f"WITH {V_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, path) AS place FROM best)"
_HEAD = "h AS (SELECT path, fields['status'] AS status, fields['name'] AS name, fields['verified'] AS verified FROM n)"
_HEADS = f"{N_SQL}, {_HEAD}"
_LEARNED = f"""{_PLACED},
fb AS (SELECT DISTINCT pair_id, query, path, source, count, last_day FROM feedback),
fv AS (SELECT query, e FROM (SELECT query, min(pair_id) AS vec_id FROM feedback WHERE query IS NOT NULL GROUP BY query) JOIN (SELECT DISTINCT vec_id, e FROM v) USING (vec_id)),
sims AS (SELECT query, qid, list_cosine_similarity(e, qe) AS sim FROM fv, q),
learned AS (SELECT qid, path, least(sum(0.03 * sim * least(coalesce(count, 0), 3) / 3 * pow(0.5, greatest({TODAY_DAYS} - last_day, 0) / 60.0)), 0.05) AS bonus
  FROM fb JOIN sims USING (query) WHERE sim >= 0.85 AND path IS NOT NULL GROUP BY qid, path),
base AS (SELECT *, max(score) OVER (PARTITION BY qid) AS top FROM ranked WHERE place <= 50),
windowed AS (SELECT l.* FROM learned l JOIN base b ON l.qid = b.qid AND l.path = b.path WHERE top - score <= 0.10)"""
_BOOSTED = f"""{_LEARNED}, {_HEADS}, {T_SQL}, {IDS_SQL},
bonus AS (SELECT qid, path, sum(bonus) AS bonus FROM (SELECT qid, path, bonus FROM windowed UNION ALL SELECT qid, path, bonus FROM lex) GROUP BY qid, path),
boosted AS (SELECT qid, path, total AS score, ordinal, row_number() OVER (PARTITION BY qid ORDER BY total DESC, path) AS place FROM (SELECT b.qid, b.path, ordinal, score + coalesce(bonus, 0) AS total FROM best b LEFT JOIN bonus w ON b.qid = w.qid AND b.path = w.path))"""
_TEXT_BEST = """tbest AS (SELECT qid, path, score, coalesce(ordinal, 0) AS ordinal FROM s WHERE question_no IS NULL
  QUALIFY row_number() OVER (PARTITION BY qid, path ORDER BY score DESC, coalesce(ordinal, 0)) = 1),
tranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, path) AS place FROM tbest)"""
_CASES = "cases AS (SELECT DISTINCT vec_id AS qid, split_part(path, '/', 1) AS family, path AS expected, ordinal FROM v WHERE vec_id % 100 = 0 AND question_no IS NOT NULL)"


def _walk_sql(ranked: str, n: int, chars: int) -> str:
    return f"""c AS (SELECT path, ordinal, max(text) AS text FROM chunks GROUP BY path, ordinal),
live AS (SELECT qid, r.path, score, text, row_number() OVER (PARTITION BY qid ORDER BY place) AS k FROM {ranked} r JOIN h ON r.path = h.path JOIN c ON c.path = r.path AND c.ordinal = r.ordinal
  WHERE place <= 25 AND status IS DISTINCT FROM 'archived'),
walk AS (SELECT qid, path, score, left(text, {chars}) AS text, k, length(left(text, {chars})) AS used FROM live WHERE k = 1
  UNION ALL SELECT l.qid, l.path, l.score, left(l.text, {chars} - w.used), l.k, w.used + length(left(l.text, {chars} - w.used)) FROM walk w JOIN live l ON l.qid = w.qid AND l.k = w.k + 1
  WHERE {chars} - w.used >= 200 AND w.k < {n})"""


def _passages_sql(n: int, chars: int, least: str) -> str:
    return f"{_BOOSTED.replace('WITH', 'WITH RECURSIVE', 1)}, {_walk_sql('boosted', n, chars)} SELECT qid, path, round(score, 6) AS score, text FROM walk WHERE {least}"


def _near_sql(least: float) -> str:
    return f"""WITH {V_SQL}, {_HEADS}, a AS (SELECT DISTINCT v.path, e FROM v JOIN h ON v.path = h.path WHERE question_no IS NULL AND status IS DISTINCT FROM 'archived')
SELECT path_a, path_b, round(max(sim), 6) AS score FROM (SELECT x.path AS path_a, y.path AS path_b, list_cosine_similarity(x.e, y.e) AS sim FROM a x JOIN a y ON x.path < y.path) WHERE sim >= {least} GROUP BY path_a, path_b"""


SQL = {
    "v02_vec_topk": f"WITH {V_SQL} SELECT qid, vec_id, round(sim, 6) AS sim, place FROM (SELECT qid, vec_id, sim, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, vec_id) AS place FROM (SELECT DISTINCT qid, vec_id, list_cosine_similarity(e, qe) AS sim FROM v, q WHERE vec_id <> qid)) WHERE place <= 10",
    "v04_note_rank_max": f"{_PLACED} SELECT qid, path, round(score, 6) AS score, CAST(ordinal AS BIGINT) AS ordinal, place FROM ranked WHERE place <= 5",
    "v06_learned_bonus": f"{_LEARNED} SELECT qid, path, round(bonus, 6) AS bonus FROM learned",
    "v08_learned_window": f"{_LEARNED} SELECT qid, path, round(bonus, 6) AS bonus FROM windowed",
    "v09_note_rank_bonus": f"{_BOOSTED} SELECT qid, path, round(score, 6) AS score, CAST(ordinal AS BIGINT) AS ordinal, place FROM boosted WHERE place <= 5",
    "v10_search": f"""{_BOOSTED},
seen AS (SELECT r.*, status IS DISTINCT FROM 'archived' AS active FROM boosted r LEFT JOIN h ON r.path = h.path WHERE place <= 25),
run AS (SELECT *, sum(CASE WHEN active THEN 1 ELSE 0 END) OVER (PARTITION BY qid ORDER BY place) AS k FROM seen),
hid AS (SELECT *, sum(CASE WHEN NOT active AND k < 5 THEN 1 ELSE 0 END) OVER (PARTITION BY qid) AS hidden FROM run)
SELECT qid, path, round(score, 6) AS score, CAST(k AS BIGINT) AS place, CAST(hidden AS BIGINT) AS hidden FROM hid WHERE active AND k <= 5""",
    "v11_answer": _passages_sql(5, 4000, "true"),
    "v13_hook": _passages_sql(2, 700, "score >= 0.60"),
    "v16_nearest_active": f"""WITH {V_SQL}, {_TEXT_BEST}, {_HEADS} SELECT qid, path, round(score, 6) AS score FROM (SELECT qid, t.path, score, row_number() OVER (PARTITION BY qid ORDER BY place) AS k
  FROM tranked t JOIN h ON t.path = h.path WHERE place <= 5 AND status IS DISTINCT FROM 'archived') WHERE k = 1 AND score >= 0.90""",
    "v17_near_note_pairs": _near_sql(0.97),
    "v17_near_note_pairs_90": _near_sql(0.90),
    "v18_recentred_rank": f"""WITH {V_SQL}, m AS (SELECT list(a ORDER BY i) AS mean FROM (SELECT i, avg(e[i]) AS a FROM (SELECT DISTINCT vec_id, e FROM v), range(1, 65) r(i) GROUP BY i)),
c AS (SELECT vec_id, path, list_transform(list_zip(e, mean), lambda x: x[1] - x[2]) AS d FROM v, m),
sc AS (SELECT y.vec_id AS qid, x.path, max(list_cosine_similarity(x.d, y.d)) AS score FROM c x, c y WHERE y.vec_id % 100 = 0 AND x.path IS NOT NULL GROUP BY y.vec_id, x.path)
SELECT qid, path, round(score, 6) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, path) AS place FROM sc) WHERE place <= 5""",
    "v19_mmr": f"""{_PLACED.replace('WITH', 'WITH RECURSIVE', 1)},
own AS (SELECT path, ordinal, max(e) AS e FROM v WHERE question_no IS NULL GROUP BY path, ordinal),
pool AS (SELECT qid, r.path, score, place, e FROM ranked r JOIN own o ON o.path = r.path AND o.ordinal = r.ordinal WHERE place <= 20),
pick AS (SELECT qid, 1 AS step, [arg_min(path, place)] AS chosen FROM pool GROUP BY qid
  UNION ALL SELECT qid, step + 1, list_append(chosen, path) FROM (
    SELECT k.qid, step, chosen, p.path, row_number() OVER (PARTITION BY k.qid ORDER BY 0.7 * p.score - 0.3 * (SELECT greatest(max(list_cosine_similarity(p.e, c.e)), 0) FROM pool c WHERE c.qid = k.qid AND list_contains(chosen, c.path)) DESC, p.place) AS best
    FROM pick k JOIN pool p ON p.qid = k.qid AND NOT list_contains(chosen, p.path) WHERE step < 5) WHERE best = 1),
last AS (SELECT qid, arg_max(chosen, step) AS chosen FROM pick GROUP BY qid)
SELECT p.qid, p.path, CAST(list_position(chosen, p.path) AS BIGINT) AS place, round(p.score, 6) AS score FROM last l JOIN pool p ON p.qid = l.qid AND list_contains(chosen, p.path)""",
    "b01_bench_metrics": f"""WITH {V_SQL}, {_TEXT_BEST}, {_CASES} SELECT family, count(*) AS cases, round(avg(CASE WHEN place = 1 THEN 1.0 ELSE 0.0 END), 6) AS top1, round(avg(CASE WHEN place IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS top5,
  round(avg(CASE WHEN place IS NOT NULL AND t.ordinal = c.ordinal THEN 1.0 ELSE 0.0 END), 6) AS right_passage FROM cases c LEFT JOIN tranked t ON t.qid = c.qid AND t.path = c.expected AND t.place <= 5 GROUP BY family""",
    "b02_leave_one_out": f"""{_LEARNED}, own AS (SELECT query, vec_id AS qid, e AS qe FROM (SELECT query, min(pair_id) AS vec_id FROM feedback WHERE query IS NOT NULL GROUP BY query) JOIN (SELECT DISTINCT vec_id, e FROM v) USING (vec_id) WHERE vec_id % 100 = 0),
sim2 AS (SELECT fv.query, qid, list_cosine_similarity(e, qe) AS sim FROM fv JOIN own ON fv.query <> own.query)
SELECT qid, path, round(least(sum(0.03 * sim * least(coalesce(count, 0), 3) / 3 * pow(0.5, greatest({TODAY_DAYS} - last_day, 0) / 60.0)), 0.05), 6) AS bonus FROM fb JOIN sim2 USING (query) WHERE sim >= 0.85 AND path IS NOT NULL GROUP BY qid, path""",
    "b03_passage_cost": f"""WITH RECURSIVE {V_SQL}, {_TEXT_BEST}, {_HEADS}, {_CASES}, {_walk_sql('tranked', 5, 4000)}
SELECT c.qid, count(w.path) AS passages, CAST(coalesce(sum(ceil(strlen(w.text) / 4.0)), 0) AS BIGINT) AS tokens, coalesce(bool_or(w.path = c.expected), false) AS reached FROM cases c LEFT JOIN walk w ON w.qid = c.qid GROUP BY c.qid""",
    "b07_diagnose": f"""WITH {V_SQL}, {_TEXT_BEST}, {_CASES} SELECT c.qid, round(t.score, 6) AS target_score, round(m.top, 6) AS top_score, round(m.top - t.score, 6) AS gap FROM cases c JOIN tbest t ON t.qid = c.qid AND t.path = c.expected
  JOIN (SELECT qid, max(score) AS top FROM tbest GROUP BY qid) m ON m.qid = c.qid""",
    "b05_q8_fidelity": f"""WITH {V_SQL}, w AS (SELECT DISTINCT vec_id, path, ordinal, e FROM v WHERE question_no IS NULL),
d AS (SELECT vec_id, path, ordinal, e, list_aggregate(list_transform(e[1:32], lambda x: abs(x)), 'max') / 127 AS s1, list_aggregate(list_transform(e[33:64], lambda x: abs(x)), 'max') / 127 AS s2 FROM w),
f AS (SELECT vec_id, path, ordinal, list_cosine_similarity(e, list_concat(list_transform(e[1:32], lambda x: CASE WHEN s1 > 0 THEN round_even(x / s1, 0) * s1 ELSE 0 END), list_transform(e[33:64], lambda x: CASE WHEN s2 > 0 THEN round_even(x / s2, 0) * s2 ELSE 0 END))) AS sim FROM d),
z AS (SELECT path, ordinal, max(strlen(text) // 3 + 1) AS tokens FROM chunks GROUP BY path, ordinal),
g AS (SELECT CAST(tokens // 100 * 100 AS BIGINT) AS bucket, sim, row_number() OVER (PARTITION BY tokens // 100 ORDER BY sim, vec_id) AS k, count(*) OVER (PARTITION BY tokens // 100) AS n FROM f JOIN z USING (path, ordinal))
SELECT bucket, count(*) AS vectors, round(min(sim), 6) AS least, round(max(CASE WHEN k = n // 2 + 1 THEN sim END), 6) AS median, round(avg(sim), 6) AS mean FROM g GROUP BY bucket""",
}
