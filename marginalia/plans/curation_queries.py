"""Queries of curation, indexes, learning and maintenance, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import family
from ..operators import curation, feedback, hot, index, links
from ..operators.questions import clean
from ..sources.tables import table
from .common import N_SQL, NOW, TODAY, TODAY_DAYS, plain

#: A small bound, so that the compaction has work at every size of the test tables.
SMALL = 4000


def _notes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "notes")


def c01_stale(spark: SparkSession, folder: str) -> DataFrame:
    return plain(curation.stale(_notes(spark, folder), TODAY))


def c02_long(spark: SparkSession, folder: str) -> DataFrame:
    return plain(curation.long_notes(_notes(spark, folder)))


def c02_long_700(spark: SparkSession, folder: str) -> DataFrame:
    """The same at a bound that the test notes pass."""
    return plain(curation.long_notes(_notes(spark, folder), 700))


def c03_undated(spark: SparkSession, folder: str) -> DataFrame:
    return curation.undated(_notes(spark, folder))


def a02_per_project(spark: SparkSession, folder: str) -> DataFrame:
    return plain(curation.per_project(_notes(spark, folder)))


def _listed(spark: SparkSession, folder: str) -> DataFrame:
    """What an index lists: the notes, and the families' common ones."""
    both = [table(spark, folder, name).select("path", "fields", "body", "modified_at") for name in ("notes", "common_notes")]
    return both[0].unionByName(both[1])


def h01_strata(spark: SparkSession, folder: str) -> DataFrame:
    return plain(hot.strata(hot.lines(_listed(spark, folder))))


def h02_compaction(spark: SparkSession, folder: str) -> DataFrame:
    return plain(hot.compaction(hot.lines(_listed(spark, folder))))


def h02_compaction_4000(spark: SparkSession, folder: str) -> DataFrame:
    """The same at a bound that many of the test projects pass."""
    return plain(hot.compaction(hot.lines(_listed(spark, folder)), SMALL))


def h01_render(spark: SparkSession, folder: str) -> DataFrame:
    return hot.render(_listed(spark, folder))


def h01_render_4000(spark: SparkSession, folder: str) -> DataFrame:
    return hot.render(_listed(spark, folder), SMALL)


def b04_index_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return plain(hot.sizes(_listed(spark, folder)))


def _missed(spark: SparkSession, folder: str) -> DataFrame:
    return feedback.missed_pairs(table(spark, folder, "search_log"), table(spark, folder, "read_log"))


def j01_missed_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return plain(_missed(spark, folder).select("read_id", "query", "path", "day"))


def a04_fold(spark: SparkSession, folder: str) -> DataFrame:
    return plain(feedback.fold(_missed(spark, folder)))


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    """The learned pairs, once each; a null count is none."""
    return table(spark, folder, "feedback").withColumn("count", F.coalesce("count", F.lit(0))).distinct()


def a05_forget(spark: SparkSession, folder: str) -> DataFrame:
    """The pairs left when the queries of one text are forgotten."""
    return plain(feedback.forget(_pairs(spark, folder), " OPX-1835 rollback "))


def a06_pairs_report(spark: SparkSession, folder: str) -> DataFrame:
    return plain(feedback.pairs_report(_pairs(spark, folder), TODAY_DAYS))


def a07_usage(spark: SparkSession, folder: str) -> DataFrame:
    return plain(feedback.usage_report(table(spark, folder, "search_log"), NOW))


def _wanted(spark: SparkSession, folder: str) -> DataFrame:
    return index.expected(_notes(spark, folder), table(spark, folder, "chunks"))


def _have(spark: SparkSession, folder: str) -> DataFrame:
    """An earlier index: the vectors as they are, with the fingerprints of notes not modified since January 2026."""
    prints = index.fingerprints(_notes(spark, folder).where("modified_at < timestamp_ntz'2026-01-01'")).withColumnRenamed("note_hash", "fingerprint")
    rows = table(spark, folder, "vectors").select("path", "ordinal", "question_no").distinct()
    return rows.join(prints, "path", "left")


def i02_stale_keys(spark: SparkSession, folder: str) -> DataFrame:
    return plain(index.stale(_wanted(spark, folder), _have(spark, folder)).select("path", "ordinal"))


def i04_ghost_keys(spark: SparkSession, folder: str) -> DataFrame:
    """The vectors whose chunk is gone, where archived and deleted notes want none."""
    live = _notes(spark, folder).where("deleted_at is null")
    chunks = table(spark, folder, "chunks").join(live.select("path").distinct(), "path", "left_semi")
    return plain(index.ghosts(index.expected(live, chunks), _have(spark, folder).where("question_no is null")).select("path", "ordinal"))


def _questions(spark: SparkSession, folder: str) -> DataFrame:
    """A cache of questions for the chunks that have question vectors."""
    asked = table(spark, folder, "vectors").where("question_no is not null").select("path", "ordinal").distinct()
    texts = table(spark, folder, "chunks").select("path", "ordinal", "text").distinct()
    return texts.join(asked, ["path", "ordinal"]).select(F.md5("text").alias("chunk_hash")).distinct()


def i06_pending_questions(spark: SparkSession, folder: str) -> DataFrame:
    return plain(index.pending_questions(table(spark, folder, "chunks"), _questions(spark, folder)).select("path", "ordinal"))


def i07_pruned_questions(spark: SparkSession, folder: str) -> DataFrame:
    """What stays cached when only the chunks of living notes count."""
    live = _notes(spark, folder).where("deleted_at is null").select("path").distinct()
    return index.prune_questions(_questions(spark, folder), table(spark, folder, "chunks").join(live, "path", "left_semi"))


def i09_missing_queries(spark: SparkSession, folder: str) -> DataFrame:
    """Queries of learned pairs that were never searched."""
    return feedback.missing_queries(table(spark, folder, "feedback"), table(spark, folder, "search_log").where("query is not null").select("query").distinct())


def i10_refresh_stats(spark: SparkSession, folder: str) -> DataFrame:
    """A whole pass with the hashing encoder over an index that lacks the notes modified since."""
    have = _have(spark, folder).where("question_no is null").withColumn("embedding", F.array().cast("array<float>")).withColumn("truncated", F.lit(False))
    return plain(index.refresh(_notes(spark, folder), table(spark, folder, "chunks"), have)[1])


def j10_tolerated(spark: SparkSession, folder: str) -> DataFrame:
    notes = _notes(spark, folder)
    cases = table(spark, folder, "search_log").where("search_id % 100 = 0").select(F.col("search_id").alias("qid"), F.try_element_at("shown", F.lit(1)).alias("expected")).where("expected is not null and expected <> ''").distinct()
    return links.tolerated(notes, cases)


def e10_clean_questions(spark: SparkSession, folder: str) -> DataFrame:
    """The searches of each family's notes as the output of a question command, cleaned."""
    raw = table(spark, folder, "search_log").where("query is not null").select("search_id", "query").distinct()
    return raw.select("search_id", F.explode(clean(F.concat(F.lit("> banner\n1. "), F.col("query"), F.lit("\n- "), F.col("query")))).alias("question"))


def j05_family_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Scored hits by family: how many, how many without a usable score, the best."""
    hits = table(spark, folder, "note_hits").distinct()
    ok = F.col("score").isNotNull() & ~F.isnan("score")
    return plain(hits.where("path is not null").groupBy(family(F.col("path")).alias("family")).agg(F.count("*").alias("hits"), F.count_if(~ok).alias("unscored"), F.max(F.when(ok, F.col("score"))).alias("best")))


QUERIES = {
    f.__name__: f
    for f in (
        c01_stale, c02_long, c02_long_700, c03_undated, a02_per_project, h01_strata, h02_compaction, h02_compaction_4000, h01_render, h01_render_4000, b04_index_sizes, j01_missed_pairs, a04_fold, a05_forget, a06_pairs_report, a07_usage, i02_stale_keys,
        i04_ghost_keys, i06_pending_questions, i07_pruned_questions, i09_missing_queries, i10_refresh_stats, j10_tolerated, e10_clean_questions, j05_family_hits,
    )
}

_STEM = r"regexp_replace(regexp_extract(path, '[^/]*$'), '(.)\.[^.]*$', '\1')"
_LINES = rf"""l0 AS (SELECT DISTINCT path, fields, body, modified_at FROM (SELECT path, fields, body, modified_at FROM notes UNION ALL SELECT path, fields, body, modified_at FROM common_notes) WHERE path IS NOT NULL),
l AS (SELECT split_part(path, '/', 1) AS family, split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS project, path, coalesce(fields['name'], {_STEM}) AS name, regexp_replace(path, '^[^/]*/[^/]*/', '') AS rel, trim(coalesce(fields['description'], '')) AS description,
  coalesce(fields['type'], 'project') AS stratum, coalesce(fields['status'] = 'archived', false) AS archived, coalesce(fields['verified'], fields['modified'], strftime(modified_at, '%Y-%m-%d'), '') AS date, body FROM l0),
live AS (SELECT *, '- [' || name || '](' || rel || ')' || CASE WHEN description <> '' THEN ': ' || description ELSE '' END AS line, row_number() OVER (PARTITION BY project, stratum ORDER BY date, name, path) AS age FROM l WHERE NOT archived),
shared AS (SELECT family, '## Shared by ' || family || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY line) AS block FROM (SELECT family, '- [' || name || '](../common/' || rel || ')' || CASE WHEN description <> '' THEN ': ' || description ELSE '' END AS line FROM live WHERE split_part(project, '/', 2) = 'common') GROUP BY family),
old AS (SELECT project, family, count(*) FILTER (WHERE archived) AS archived FROM l GROUP BY project, family)"""


def _rendered(cut: str, name: str) -> str:
    """The whole texts, with as many of the oldest project notes left out as ``cut(project, k)`` says."""
    return f"""{name}_blocks AS (
  SELECT project, -1 AS pos, '' AS stratum, '# Memory index, ' || project AS block FROM old
  UNION ALL SELECT project, CASE stratum WHEN 'reference' THEN 0 WHEN 'feedback' THEN 1 WHEN 'user' THEN 2 WHEN 'project' THEN 3 ELSE 4 END, stratum,
    '## ' || CASE stratum WHEN 'reference' THEN 'Durable knowledge' WHEN 'feedback' THEN 'Ways of working' WHEN 'user' THEN 'About the user' WHEN 'project' THEN 'Projects' ELSE stratum END || chr(10) || chr(10)
    || concat_ws(chr(10), string_agg(line, chr(10) ORDER BY name, rel, description, date) FILTER (WHERE stratum <> 'project' OR age > k), CASE WHEN stratum = 'project' AND max(k) > 0 THEN '- ' || max(k) || ' older project notes left out of the hot index, search finds them' END)
    FROM live JOIN {cut} USING (project) GROUP BY project, stratum
  UNION ALL SELECT project, 1000, '', block FROM old JOIN shared USING (family) WHERE split_part(project, '/', 2) <> 'common'
  UNION ALL SELECT project, 2000, '', '<!-- ' || archived || ' archived note(s), outside the index, reachable by a search of the archives -->' FROM old WHERE archived > 0),
{name} AS (SELECT project, string_agg(block, chr(10) || chr(10) ORDER BY pos, stratum) || chr(10) AS text FROM {name}_blocks GROUP BY project)"""


def _compact(limit: int) -> str:
    """How many must leave, and the size of what is left, measured on the text."""
    return f"""{_LINES}, zero AS (SELECT project, 0 AS k FROM old), {_rendered('zero', 'whole')},
total AS (SELECT project, CAST(strlen(text) AS BIGINT) AS full_bytes FROM whole),
g AS (SELECT project, age AS k, sum(strlen(line) + 1) OVER (PARTITION BY project ORDER BY age ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS gone FROM live WHERE stratum = 'project'),
f AS (SELECT project, k, full_bytes - gone + strlen('- ' || k || ' older project notes left out of the hot index, search finds them') + 1 AS bytes FROM g JOIN total USING (project)),
fits AS (SELECT project, min(k) FILTER (WHERE bytes <= {limit}) AS least, max(k) AS most FROM f GROUP BY project),
cut AS (SELECT project, CAST(CASE WHEN full_bytes <= {limit} THEN 0 ELSE coalesce(least, most, 0) END AS BIGINT) AS k FROM total LEFT JOIN fits USING (project)), {_rendered('cut', 'bounded')},
compacted AS (SELECT project, full_bytes, k AS left_out, CAST(strlen(text) AS BIGINT) AS bytes, text FROM total JOIN cut USING (project) JOIN bounded USING (project))"""


_HASH = f"""{N_SQL}, fp AS (SELECT path, modified_at, deleted_at, md5(array_to_string(list_sort(list_transform(map_entries(fields), lambda x: x.key || '=' || x.value)), chr(10)) || chr(10) || coalesce(body, '')) AS h FROM n),
ch AS (SELECT DISTINCT path, ordinal, text FROM chunks), have AS (SELECT DISTINCT v.path, ordinal, question_no, CASE WHEN modified_at < TIMESTAMP '2026-01-01' THEN h END AS had FROM vectors v LEFT JOIN fp ON v.path = fp.path)"""
_PLAIN_KEY = r"lower(regexp_replace(regexp_extract({}, '^([^|#]*)', 1), '[^\p{{L}}\p{{N}}]', '', 'g'))"
_TOLERATED = rf"""{N_SQL}, cases AS (SELECT DISTINCT search_id AS qid, shown[1] AS expected FROM search_log WHERE search_id % 100 = 0 AND shown[1] IS NOT NULL AND shown[1] <> ''),
named AS (SELECT key, max(path) AS path FROM (SELECT path, {_PLAIN_KEY.format("fields['name']")} AS key FROM n WHERE fields['name'] IS NOT NULL UNION ALL SELECT path, {_PLAIN_KEY.format(_STEM)} FROM n) WHERE key <> '' GROUP BY key),
said AS (SELECT path, unnest(regexp_extract_all(line, '\[\[(.*?)\]\]', 1)) AS link FROM (SELECT path, unnest(regexp_extract_all(body, '(?m)^.*(?:See also|Voir aussi).*$')) AS line FROM n) UNION ALL SELECT path, fields['superseded_by'] FROM n WHERE fields['superseded_by'] IS NOT NULL)"""
_EDGE = r"[\s\v\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_BOTH_ENDS = rf"'^{_EDGE}+|{_EDGE}+$', '', 'g'"
_QUESTIONS = rf"""q AS (SELECT DISTINCT search_id, query FROM search_log WHERE query IS NOT NULL),
lines AS (SELECT search_id, regexp_replace(unnest([regexp_replace('1. ' || query, {_BOTH_ENDS}), regexp_replace('- ' || query, {_BOTH_ENDS})]), '^[\p{{Nd}}.)\-*•]+', '') AS x FROM q),
bare AS (SELECT search_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '^([\p{{Nd}}.)\-*•]|{_EDGE})+', ''), {_BOTH_ENDS}), '^["''«“]+\s*|\s*["''»”]+$', '', 'g'), {_BOTH_ENDS}) AS question FROM lines)"""
_MISSED = """s AS (SELECT 1 AS one, secs, arg_max(query, search_id) AS query, arg_max(coalesce(shown, []), search_id) AS shown FROM (SELECT search_id, secs, query, shown FROM search_log WHERE secs IS NOT NULL) GROUP BY secs),
r AS (SELECT DISTINCT 1 AS one, read_id, secs, path FROM read_log WHERE secs IS NOT NULL AND path IS NOT NULL),
m AS (SELECT r.read_id, s.query, r.path, CAST(r.secs // 86400 AS BIGINT) AS day FROM r ASOF JOIN s ON r.one = s.one AND r.secs >= s.secs WHERE r.secs - s.secs <= 600 AND NOT coalesce(list_contains(s.shown, r.path), false))"""

SQL = {
    "c01_stale": f"WITH {N_SQL} SELECT path, CAST(DATE '{TODAY}' - TRY_CAST(fields['verified'] AS DATE) AS BIGINT) AS age FROM n WHERE regexp_matches(fields['verified'], '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') AND fields['status'] IS DISTINCT FROM 'archived' AND coalesce(fields['type'], 'project') = 'project' AND DATE '{TODAY}' - TRY_CAST(fields['verified'] AS DATE) > 60",
    "c02_long": f"WITH {N_SQL} SELECT path, length(body) // 4 AS tokens FROM n WHERE length(body) // 4 > 2000",
    "c02_long_700": f"WITH {N_SQL} SELECT path, length(body) // 4 AS tokens FROM n WHERE length(body) // 4 > 700",
    "c03_undated": f"WITH {N_SQL} SELECT path FROM n WHERE fields['status'] IS DISTINCT FROM 'archived' AND fields['verified'] IS NULL",
    "a02_per_project": f"WITH {N_SQL} SELECT split_part(path, '/', 1) AS family, split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS project, count(*) AS notes FROM n GROUP BY ALL",
    "h01_strata": f"WITH {_LINES} SELECT project, stratum, row_number() OVER (PARTITION BY project ORDER BY coalesce(list_position(['reference', 'feedback', 'user', 'project'], stratum), 9), stratum) AS position, notes, bytes FROM (SELECT project, stratum, count(*) AS notes, CAST(sum(strlen(line) + 1) AS BIGINT) AS bytes FROM live GROUP BY project, stratum)",
    "h02_compaction": f"WITH {_compact(17408)} SELECT project, full_bytes, left_out, bytes FROM compacted",
    "h02_compaction_4000": f"WITH {_compact(4000)} SELECT project, full_bytes, left_out, bytes FROM compacted",
    "h01_render": f"WITH {_compact(17408)} SELECT project, text FROM compacted",
    "h01_render_4000": f"WITH {_compact(4000)} SELECT project, text FROM compacted",
    "b04_index_sizes": f"WITH {_compact(17408)}, w AS (SELECT project, CAST(sum(strlen(body)) AS BIGINT) AS all_notes FROM l GROUP BY project) SELECT project, bytes AS bounded, full_bytes AS unbounded, all_notes FROM compacted LEFT JOIN w USING (project)",
    "j01_missed_pairs": f"WITH {_MISSED} SELECT read_id, query, path, day FROM m",
    "a04_fold": f"WITH {_MISSED} SELECT query, path, 'missed' AS source, count(DISTINCT day) AS count, max(day) AS last_day FROM m GROUP BY query, path",
    "a05_forget": "SELECT DISTINCT pair_id, query, path, source, coalesce(CAST(count AS BIGINT), 0) AS count, last_day FROM feedback WHERE query IS DISTINCT FROM 'OPX-1835 rollback'",
    "a06_pairs_report": f"SELECT query, path, source, coalesce(CAST(count AS BIGINT), 0) AS count, last_day, round(pow(0.5, greatest({TODAY_DAYS} - last_day, 0) / 60.0), 6) AS weight FROM (SELECT DISTINCT * FROM feedback)",
    "a07_usage": f"WITH o AS (SELECT search_id, max(secs) AS secs, max(coalesce(len(shown), 0)) AS n FROM search_log GROUP BY search_id) SELECT count(*) AS total, CAST(sum(CASE WHEN secs > {NOW} - 86400 AND secs <= {NOW} THEN 1 ELSE 0 END) AS BIGINT) AS last_day, list_sort(list(n))[len(list(n)) // 2 + 1] AS median_shown FROM o",
    "i02_stale_keys": f"WITH {_HASH} SELECT path, CAST(ordinal AS BIGINT) AS ordinal FROM ch JOIN fp USING (path) WHERE NOT EXISTS (SELECT 1 FROM have v WHERE v.path = ch.path AND v.ordinal = ch.ordinal AND v.question_no IS NULL AND v.had = fp.h)",
    "i04_ghost_keys": f"WITH {_HASH} SELECT path, CAST(ordinal AS BIGINT) AS ordinal FROM have v WHERE question_no IS NULL AND NOT EXISTS (SELECT 1 FROM ch JOIN fp USING (path) WHERE fp.deleted_at IS NULL AND ch.path = v.path AND ch.ordinal = v.ordinal)",
    "i06_pending_questions": "WITH c AS (SELECT DISTINCT path, ordinal, text FROM chunks), k AS (SELECT text FROM c WHERE EXISTS (SELECT 1 FROM vectors v WHERE v.path = c.path AND v.ordinal = c.ordinal AND question_no IS NOT NULL)) SELECT path, CAST(ordinal AS BIGINT) AS ordinal FROM c WHERE text NOT IN (SELECT text FROM k)",
    "i07_pruned_questions": "WITH c AS (SELECT DISTINCT path, ordinal, text FROM chunks), k AS (SELECT DISTINCT text FROM c WHERE EXISTS (SELECT 1 FROM vectors v WHERE v.path = c.path AND v.ordinal = c.ordinal AND question_no IS NOT NULL)) SELECT md5(text) AS chunk_hash FROM k WHERE text IN (SELECT text FROM c WHERE path IN (SELECT path FROM notes WHERE deleted_at IS NULL))",
    "i09_missing_queries": "SELECT DISTINCT query FROM feedback WHERE query IS NOT NULL AND query NOT IN (SELECT query FROM search_log WHERE query IS NOT NULL)",
    "j10_tolerated": f"WITH {_TOLERATED} SELECT qid, expected AS path FROM cases UNION SELECT qid, m.path FROM cases c JOIN said s ON s.path = c.expected JOIN named m ON m.key = {_PLAIN_KEY.format('s.link')}",
    "e10_clean_questions": f"WITH {_QUESTIONS} SELECT DISTINCT search_id, question FROM bare WHERE length(question) BETWEEN 8 AND 220",
    "j05_family_hits": "SELECT split_part(path, '/', 1) AS family, count(*) AS hits, count(*) FILTER (WHERE score IS NULL OR isnan(score)) AS unscored, round(CAST(max(score) FILTER (WHERE NOT isnan(score)) AS DOUBLE), 6) AS best FROM (SELECT DISTINCT * FROM note_hits) WHERE path IS NOT NULL GROUP BY 1",
}
