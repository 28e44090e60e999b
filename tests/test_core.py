"""The core's behaviour on small tables."""

import json
import os
import re
import struct
import subprocess

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.functions import encoder
from marginalia.functions.text import link_key, links, stem, strip
from marginalia.functions import vectors as vectors_
from marginalia.functions.vectors import cosine
from marginalia.operators import checks, chunking, curation, duplicates, feedback, hot, index, lexical, lifecycle, links as links_, measure, orphans, questions, ranking, secrets
from marginalia.session import materialize, shared_dir
from marginalia.sources import logs, notes as notes_
from marginalia.streaming import refresh as streams


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "x string").select(f(F.col("x"))).first()[0]


NOTES = "path string, fields map<string,string>, body string, added_at timestamp_ntz, modified_at timestamp_ntz, deleted_at timestamp_ntz"


def make(spark, *rows_):
    """Notes of (path, fields, body), added and modified in 2026."""
    sql = spark.createDataFrame([r[:3] for r in rows_] or [(None, None, None)], "path string, fields map<string,string>, body string")
    out = sql.select("*", F.expr("timestamp_ntz'2026-01-01'").alias("added_at"), F.expr("timestamp_ntz'2026-03-01'").alias("modified_at"), F.expr("cast(null as timestamp_ntz)").alias("deleted_at"))
    return out if rows_ else out.limit(0)


# the header


@pytest.mark.parametrize(
    ("raw", "fields", "body"),
    [
        ("---\nname: a\ndescription: \"b: c\"\n---\n\nBody", {"name": "a", "description": "b: c"}, "Body"),
        ("no header", {}, "no header"),
        ("---\nname: a\nbody without end", {}, "---\nname: a\nbody without end"),
        ("---\r\nname: a\r\n---\r\nx", {}, "---\r\nname: a\r\n---\r\nx"),
        ("---\nmetadata:\n  name: nested\n  type: user\nname: root\n---\nx", {"name": "root", "type": "user"}, "x"),
        ("---\nname: one\nname: two\n  k: 1\n  k: 2\n---\nx", {"name": "two", "k": "1"}, "x"),
        ("---\n# comment: x\nempty:\nbad key!: y\nok-1: 'z'\n---\n---\n\n\nx", {"ok-1": "z"}, "x"),
        ("---\nurl: http://x\n---\n", {"url": "http://x"}, ""),
        (None, {}, ""),
    ],
)
def test_header(raw, fields, body):
    assert notes_.parse_text(raw) == (fields, body)


def test_scan_and_write(spark, tmp_path):
    for name, text in {"fam/proj/a.md": "---\nname: a\n---\nA", "fam/proj/MEMORY.md": "x", "fam/.hidden/b.md": "x", "fam/common/_c.md": "C", "fam/proj/d.txt": "x"}.items():
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "fam/proj/bad.md").write_bytes(b"\xff\xfe")
    got = {r["path"]: (r["fields"], r["body"]) for r in notes_.parse_notes(notes_.scan_notes(spark, str(tmp_path))).collect()}
    assert got["fam/proj/a.md"] == ({"name": "a"}, "A") and set(got) <= {"fam/proj/a.md", "fam/common/_c.md"}
    assert notes_.projects(str(tmp_path)) == ["fam/.hidden", "fam/common", "fam/proj"]
    at = str(tmp_path / "fam/proj/MEMORY.md")
    assert notes_.write_if_changed(at, "y\n") == 2
    before = os.stat(at).st_mtime_ns
    assert notes_.write_if_changed(at, "y\n") == 2 and os.stat(at).st_mtime_ns == before
    hot_notes = make(spark, ("fam/proj/a.md", {"name": "a"}, "A"))
    assert set(notes_.write_indexes(hot.render(hot_notes), str(tmp_path))) == {"fam/proj"}


def test_logs(spark, tmp_path):
    (tmp_path / "s.tsv").write_text("100\tq one\ta.md,,b.md\nbroken\n200\tq two\t\nx\ty\tz\n")
    assert rows(logs.search_log(spark, str(tmp_path / "s.tsv"))) == [(100, "q one", ["a.md", "b.md"]), (200, "q two", [])]
    logs.append(spark.createDataFrame([(5, "a\tb\nc")], "secs bigint, path string"), str(tmp_path / "r"))
    assert rows(logs.read_log(spark, str(tmp_path / "r"))) == [(5, "a b c")]
    (tmp_path / "u.tsv").write_text("1\tsearch\t12ms\tok\n2\tx\tbad\tok\n")
    assert rows(logs.usage_log(spark, str(tmp_path / "u.tsv"))) == [(1, "search", 12, "ok")]
    logs.save_json(str(tmp_path / "q.json"), {"2": ["b"], "1": ["a", "c"]})
    assert (tmp_path / "q.json").read_text().index('"1"') < (tmp_path / "q.json").read_text().index('"2"')
    assert rows(logs.questions(spark, str(tmp_path / "q.json"))) == [("1", ["a", "c"]), ("2", ["b"])] and logs.questions(spark, str(tmp_path / "none.json")).count() == 0
    logs.save_json(str(tmp_path / "f.json"), [{"query": "q", "path": "p", "source": "missed", "count": 2, "last_day": 9}])
    assert rows(logs.feedback_table(spark, str(tmp_path / "f.json"))) == [("q", "p", "missed", 2, 9)] and logs.feedback_table(spark, str(tmp_path / "no")).count() == 0
    (tmp_path / "env").write_text("A_KEY=one\n# no\nHOME=/elsewhere\n")
    assert logs.settings(str(tmp_path / "env")) == {"A_KEY": "one", "HOME": os.environ["HOME"]}


def test_git_history(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-c", "user.name=n", "-c", "user.email=e@x", "-C", str(tmp_path), *a], check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.md").write_text("x")
    git("add", "-A")
    git("commit", "-qm", "first")
    (tmp_path / "f" / "a.md").write_text("y")
    (tmp_path / "f" / "MEMORY.md").write_text("y")
    git("add", "-A")
    git("commit", "-qm", "second")
    history = logs.git_history(spark, str(tmp_path))
    assert history.count() == 3 and rows(curation.changes_since(history, 0)) in ([("f", "f/a.md", "added")], [("f", "f/a.md", "changed")])
    assert curation.changes_since(history, 10**11).count() == 0


# scalar functions


def test_text_functions(spark):
    assert one(spark, "  x \n", strip) == "x"
    assert one(spark, "a/b/X-y.z.md", stem) == "X-y.z" and one(spark, "École_2-½", link_key) == "école2½"
    assert one(spark, "a [[x|y]] [[ z#s ]] [[open", links) == ["x|y", " z#s "]
    assert one(spark, "path/a.md#3?1", chunking.split_key) == ("path/a.md", 3, True) and one(spark, "plain", chunking.split_key) == ("plain", 0, False) and one(spark, "a#x", chunking.split_key) == ("a", 0, False)
    assert one(spark, "x" * 31, ranking.shape_prompt) == "x" * 31 and one(spark, "/" + "x" * 40, ranking.shape_prompt) is None and one(spark, "short", ranking.shape_prompt) is None
    assert one(spark, "see AB-12, my_name and conf.yaml. e.g. camelCase v2 AB-12", lexical.identifiers) == ["AB-12", "my_name", "conf.yaml", "camelCase"]
    assert one(spark, "The cat, the CAT-x a", lexical.query_words) == ["the", "cat", "the", "cat-x"]
    assert chunking.budget_for(512) == 450 and chunking.budget_for(8192) == 8130 and chunking.budget_for(10) == 1


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0, 0.0, 5.0], [1.0, 0.0])], "a array<float>, b array<float>")
    got = [r[0] for r in df.select(cosine(F.col("a"), F.col("b"))).collect()]
    assert abs(got[0] - 0.5**0.5) < 1e-9 and got[1] == 0.0


# passages


@pytest.mark.parametrize(
    ("body", "budget", "want"),
    [
        ("one paragraph", 450, [(0, "one paragraph")]), ("", 450, []), ("\n\n \n\n", 450, []), ("text\n\n## Head\n\nmore", 450, [(0, "text"), (6, "## Head\n\nmore")]),
        ("  é a\n\n\n\nb", 450, [(2, "é a\n\nb")]), ("aaaa\n \nbbbb", 450, [(0, "aaaa\n \nbbbb")]), ("a" * 90 + "\n\n" + "b" * 90, 40, [(0, "a" * 90), (92, "b" * 90)]), ("w " * 500, 50, [(0, ("w " * 500).strip())]),
    ],
)
def test_chunks(spark, body, budget, want):
    got = chunking.split_bodies(make(spark, ("p", {}, body)), budget).orderBy("ordinal").collect()
    assert [(r["start"], r["text"]) for r in got] == want and [r["ordinal"] for r in got] == list(range(len(want)))


def test_context(spark):
    f = lambda n, d: spark.range(1).select(chunking.with_context(F.lit(n), F.lit(d), F.lit("t"))).first()[0]
    assert f("n", "d") == "n\nd\n\nt" and f("n", "") == f("n", None) == "n\n\nt" and f("", "") == "\n\nt"


# ranking


def test_rank_is_max_per_note_and_ties_go_by_path(spark):
    v = spark.createDataFrame([("b", 7, None, [1.0, 0.0]), ("b", 1, None, [0.0, 1.0]), ("a", 0, None, [0.6, 0.8]), ("c", 2, None, [0.6, 0.8]), ("z", 0, None, [float("nan"), 0.0]), ("y", 0, None, None), (None, 0, None, [1.0, 0.0])], "path string, ordinal int, question_no int, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "qid bigint, embedding array<float>")
    got = ranking.rank_notes(v, q, 5, dim=2).orderBy("place").collect()
    assert [(r["path"], r["ordinal"]) for r in got] == [("b", 7), ("a", 0), ("c", 2)]
    bonus = spark.createDataFrame([(1, "c", 0.5)], "qid bigint, path string, bonus double")
    assert ranking.rank_notes(v, q, 1, bonus, dim=2).first()["path"] == "c"
    for n in (1, 4, 16):
        assert rows(ranking.rank_notes(v.repartition(n), q, 2, dim=2)) == rows(ranking.rank_notes(v, q, 2, dim=2))
    assert ranking.rank_notes(v.limit(0), q, 5, dim=2).count() == 0 and ranking.rank_notes(v, q.limit(0), 5, dim=2).count() == 0


def _unit64(*lead):
    return [float(x) for x in lead] + [0.0] * (64 - len(lead))


def _ranked(spark):
    v = [(f"n{i:02d}", 0, None, _unit64(1, i * 0.05)) for i in range(12)]
    notes = make(spark, *[(f"n{i:02d}", {"status": "archived"} if i in (1, 3, 9) else {"name": f"n{i}"}, "b") for i in range(12) if i != 2])
    chunks = spark.createDataFrame([(f"n{i:02d}", 0, 0, f"{i}" * 300) for i in range(12)], "path string, ordinal int, start int, text string")
    return spark.createDataFrame(v, "path string, ordinal int, question_no int, embedding array<float>"), spark.createDataFrame([(1, _unit64(1))], "qid bigint, embedding array<float>"), notes, chunks


def test_search_counts_hidden_before_the_last_shown(spark):
    v, q, notes, chunks = _ranked(spark)
    got = ranking.search(v, q, notes).orderBy("place").collect()
    assert [r["path"] for r in got] == ["n00", "n02", "n04", "n05", "n06"] and {r["hidden"] for r in got} == {2} and got[1]["description"] is None
    assert [r["path"] for r in ranking.search(v, q, notes, archives=True).orderBy("place").collect()] == ["n00", "n01", "n02", "n03", "n04"]
    got = ranking.answer(v, q, notes, chunks, n=5, max_chars=850).orderBy("place").collect()
    assert [(r["path"], len(r["text"])) for r in got] == [("n00", 300), ("n04", 300), ("n05", 250)]
    got = ranking.hook(v, q, notes, chunks).collect()
    assert len(got) == 2 and sum(len(r["text"]) for r in got) == 600
    assert json.loads(ranking.answer(v, q, notes, chunks).select(ranking.render_passage(True)).first()[0])["path"] == "n00"
    assert ranking.answer(v, q, notes, chunks).select(ranking.render_passage()).first()[0].startswith("## n0 (n00, 1.000)")
    assert rows(ranking.nearest_active_note(v, q, notes))[0][:2] == (1, "n00") and ranking.nearest_active_note(v, q, notes, threshold=1.1).count() == 0


def test_queries_in_blocks_give_the_same(spark, data):
    v = spark.read.parquet(f"{data}/vectors.parquet")
    q = v.where("vec_id % 10 = 0").groupBy(F.col("vec_id").alias("qid")).agg(F.max("embedding").alias("embedding"))
    near = lambda df, c: rows(df.withColumn(c, F.round(c, 9)).distinct())
    assert near(vectors_.score_against(v, q, most_queries=4), "score") == near(vectors_.score_against(v, q), "score")
    r = v.select(F.col("vec_id").alias("key"), "embedding")
    assert near(vectors_.alike(r, q, 0.5, most_queries=3), "sim") == near(vectors_.alike(r, q, 0.5), "sim")


def test_occurring(spark):
    t = spark.createDataFrame([("a", "aaa bb\r\nÀb aaa"), ("b", ""), ("c", None), ("d", "AAAA")], "path string, text string")
    assert rows(lexical.occurring(t, ["aa", "àb", "none", "aa"])) == [("a", "aa", 2, 1, "aaa bb"), ("a", "àb", 1, 2, "Àb aaa"), ("d", "aa", 2, 1, "AAAA")]
    assert rows(lexical.occurring(t, ["aa"], lower=False)) == [("a", "aa", 2, 1, "aaa bb")] and lexical.occurring(t, []).count() == 0


WORDS = ["älpha", "beta", "alphabet", "gam_ma", "be", "delta-x", "ta", "ETA", "omega"]


def _some_notes_and_queries(spark):
    """Notes and queries with repeats of words, of queries and of notes, ties, empty bodies."""
    rng = np.random.default_rng(5)
    text = lambda n, ends: "".join(rng.choice(WORDS) + rng.choice(ends) for _ in range(n))
    bodies = {f"n{i:03}": text(int(rng.integers(0, 9)), [" ", "\n", "\r\n", ", "]) for i in range(150)} | {"none": None}
    queries = {i: (text(int(rng.integers(0, 5)), [" ", ", "]) if i % 3 else "beta beta ta", f"n{i:03}") for i in range(24)}
    notes = make(spark, *[(p, {}, b) for p, b in bodies.items()], *[(p, {}, b) for p, b in list(bodies.items())[:9]]).repartition(5)
    return bodies, queries, notes, spark.createDataFrame([(i, *q) for i, q in queries.items()], "qid bigint, query string, expected string")


def _ranked(bodies, words, by_times):
    found = []
    for path, body in bodies.items():
        in_it = [w for w in words if w in (body or "").lower()]
        if in_it:
            found.append((-len(in_it), -sum(body.lower().count(w) for w in in_it) if by_times else 0, path))
    return sorted(found)


def _bench_words(query):
    return [w for w in re.split(r"[^\w-]+", query.lower()) if len(w) >= 3]


def _no_join_of_hits(df):
    return "Join Inner" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_words_only_ranks_where_notes_are_read(spark, monkeypatch):
    bodies, queries, notes, asked = _some_notes_and_queries(spark)
    want = sorted(((i, p, -h, -t, k + 1) for i, (q, _) in queries.items() for k, (h, t, p) in enumerate(_ranked(bodies, _bench_words(q), True)[:5])), key=repr)
    got = lexical.words_only(notes, asked)
    assert rows(got) == want and len(want) > 60 and _no_join_of_hits(got)
    monkeypatch.setattr(lexical, "MOST_QUERIES", 5)
    assert rows(lexical.words_only(notes, asked)) == want and lexical.words_only(notes, asked.where("false")).count() == 0


def test_first_lines_come_from_where_notes_are_read(spark, monkeypatch):
    bodies, queries, notes, asked = _some_notes_and_queries(spark)
    want = []
    for i, (q, _) in queries.items():
        words = [w for w in q.lower().split() if len(w.encode()) >= 3]
        for path, body in bodies.items():
            hit = next(((n, x) for n, x in enumerate(re.split(r"\r?\n", body or ""), 1) if any(w in x.lower() for w in words)), None)
            if hit:
                want.append((i, path, hit[0], hit[1].strip()[:110]))
    got = lexical.first_lines(notes, asked)
    assert rows(got) == sorted(want, key=repr) and len(want) > 500 and _no_join_of_hits(got)
    monkeypatch.setattr(lexical, "MOST_QUERIES", 5)
    assert rows(lexical.first_lines(notes, asked)) == sorted(want, key=repr) and lexical.first_lines(notes, asked.where("false")).count() == 0


def test_grep_cost_keeps_few_notes_of_each_query(spark):
    bodies, queries, notes, asked = _some_notes_and_queries(spark)
    want = []
    for i, (q, expected) in queries.items():
        read = [p for _, _, p in _ranked(bodies, sorted(set(_bench_words(q))), False)[:5]]
        read = read[: read.index(expected) + 1] if expected in read else read
        if read:
            want.append((i, len(read), sum(-(-len(bodies[p].encode()) // 4) for p in read), expected in read))
    asked = asked.repartition(3)
    got = lexical.grep_cost(notes, asked)
    assert [(a, b, int(c), d) for a, b, c, d in rows(got)] == sorted(want, key=repr) and len(want) > 12
    assert "octet_length" not in got._jdf.queryExecution().optimizedPlan().toString()  # hits aren't joined with the sizes of all notes


def test_mmr_prefers_the_unlike(spark):
    v = spark.createDataFrame([("a", 0, None, _unit64(1, 0.3)), ("b", 0, None, _unit64(1, 0.31)), ("c", 0, None, _unit64(1, -0.5))], "path string, ordinal int, question_no int, embedding array<float>")
    q = spark.createDataFrame([(1, _unit64(1))], "qid bigint, embedding array<float>")
    assert [r["path"] for r in ranking.mmr(v, q, take=2, weight=0.5).orderBy("place").collect()] == ["a", "c"]


# learning


def test_missed_pairs(spark):
    s = spark.createDataFrame([(1, 1000, "one", ["a", "b"]), (2, 5000, "two", ["c"]), (3, 5000, "three", None), (4, None, "x", [])], "search_id bigint, secs bigint, query string, shown array<string>")
    r = spark.createDataFrame([(1, 1100, "z"), (2, 1200, "a"), (3, 4000, "z"), (4, 5600, "y"), (5, 5601, "y"), (6, 1000, "q"), (7, 999, "q"), (8, None, "q"), (9, 1001, None), (1, 1100, "z")], "read_id bigint, secs bigint, path string")
    assert rows(feedback.missed_pairs(s, r).select("read_id", "query", "path")) == [(1, "one", "z"), (4, "three", "y"), (6, "one", "q")]
    assert feedback.missed_pairs(s.limit(0), r).count() == 0


def test_fold_decay_and_bonus(spark):
    p = spark.createDataFrame([("q", "p", 5, "missed"), ("q", "p", 5, "explicit"), ("q", "p", 7, "missed"), ("q", "o", 1, "missed")], "query string, path string, day bigint, source string")
    assert rows(feedback.fold(p)) == [("q", "o", "missed", 1, 1), ("q", "p", "explicit", 2, 7)]
    table = spark.createDataFrame([("asked", "p", "missed", 1, 100), ("asked", None, "missed", 1, 100), ("other", "p", "missed", 9, 100), ("asked", "old", "missed", 1, 40), ("asked", "many", "missed", 9, 100)], "query string, path string, source string, count int, last_day bigint")
    vec = spark.createDataFrame([("asked", _unit64(0.95, (1 - 0.95**2) ** 0.5)), ("other", _unit64(0.5, 0.75**0.5))], "query string, embedding array<float>")
    q = spark.createDataFrame([(1, "asked", _unit64(1))], "qid bigint, query string, embedding array<float>")
    got = {r["path"]: r["bonus"] for r in feedback.learned_bonus(table, vec, q, 100).collect()}
    assert abs(got["p"] - 0.03 * 0.95 / 3) < 1e-6 and abs(got["old"] - got["p"] / 2) < 1e-6 and abs(got["many"] - 0.03 * 0.95) < 1e-6 and len(got) == 3
    assert feedback.learned_bonus(table, vec, q, 100, skip_own=True).count() == 0
    base = spark.createDataFrame([(1, "top", 0.80), (1, "near", 0.72), (1, "far", 0.55)], "qid bigint, path string, score double")
    b = base.select("qid", "path", F.lit(0.03).alias("bonus"))
    assert {r["path"] for r in feedback.within_window(b, base).collect()} == {"top", "near"}
    assert feedback.forget(table, " asked ").count() == 1 and rows(feedback.missing_queries(table, vec.where("query = 'asked'"))) == [("other",)]


# checks, links, curation


def test_findings(spark):
    n = make(
        spark, ("f/p/good-note.md", {"name": "good-note", "description": "d", "type": "user", "status": "active"}, "[[other]] [[GOOD_note|x]] [[missing one]]"), ("f/p/Other.md", {"name": "other", "type": "memo", "status": "archived"}, "a\r\nb"),
        ("f/p/project-x.md", {"description": ">", "status": "Active"}, ""), ("g/p/other.md", {"name": "other", "description": "d"}, None), (None, {}, "x"),
    )
    got = {}
    for p, m in rows(checks.note_findings(n)):
        got.setdefault(p, set()).add(m)
    assert "f/p/good-note.md" not in got and got["f/p/Other.md"] == {"name differs from the file: other", "file name is not in kebab case", "no description", "unknown type: memo", "archived without a successor", "Windows line ends"}
    assert got["f/p/project-x.md"] == {"file name begins with a type", "no name", "folded text in the header", "unknown status: Active"}
    assert rows(links_.dangling(n)) == [("f/p/good-note.md", "link to a note that doesn't exist: [[missing one]]")]
    assert rows(links_.homonyms(n)) == [("f/p/Other.md", "name also borne by g/p/other.md")]
    assert checks.all_findings(n).count() == sum(map(len, got.values())) + 2 and not checks.is_clean(checks.all_findings(n)) and checks.is_clean(checks.all_findings(make(spark)))
    assert rows(links_.citing(n)) == [("f/p/Other.md", "f/p/good-note.md"), ("g/p/other.md", "f/p/good-note.md")]
    raw = spark.createDataFrame([("a", "---\nmetadata:\n  x: 1\n---\nb"), ("b", "---\nx: 1\n---\nmetadata:\n")], "path string, content string")
    assert rows(checks.nested_metadata(raw)) == [("a", "nested metadata in the header")]
    pins = make(spark, ("a", {"depends_on": "tool 1.2.x, other 3"}, ""), ("b", {"depends_on": "tool 1.3"}, ""))
    assert [r[0] for r in rows(checks.outdated_pins(pins, {"tool": "1.2.9"}))] == ["b"]


def test_homonyms_are_all_named(spark):
    paths = [f"f/p{i}/{j}.md" for i in range(20) for j in range(13)]
    n = make(spark, *((p, {"name": "hot"}, "") for p in paths), ("f/p/lone.md", {"name": "lone"}, ""))
    first, *others = sorted(paths, key=lambda p: p.split("/"))
    assert rows(links_.homonyms(n)) == [(first, "name also borne by " + ", ".join(others))]


def test_siblings_and_resolve(spark):
    n = make(spark, ("f/common/c.md", {}, ""), ("f/a/x.md", {"name": "Deep Thought"}, ""), ("f/b/y.md", {}, ""), ("g/a/z.md", {}, ""))
    assert rows(links_.common_siblings(n)) == [("f/a", "f/common/c.md"), ("f/b", "f/common/c.md")]
    wanted = spark.createDataFrame([("deep-thought",), ("X",), ("none",)], "name string")
    assert rows(links_.resolve(n, wanted)) == [("X", "f/a/x.md", 1), ("deep-thought", "f/a/x.md", 1), ("none", None, 0)]


def test_curation(spark):
    n = make(spark, ("a", {"verified": "2026-01-01"}, "x" * 40), ("b", {"verified": "2026-01-01", "type": "user"}, ""), ("c", {"verified": "2026-02-30"}, ""), ("d", {"status": "archived"}, ""), ("f/p/e", {}, "y" * 80))
    assert rows(curation.stale(n, "2026-03-03")) == [("a", 61)] and curation.stale(n, "2026-03-02").count() == 0
    assert rows(curation.long_notes(n, 10)) == [("f/p/e", 20)] and rows(curation.undated(n)) == [("f/p/e",)]
    have = spark.createDataFrame([("f/p",), ("f/empty",)], "project string")
    assert rows(curation.per_project(n, have)) == [("f", "f/empty", 0), ("f", "f/p", 1)]


def test_hot_index(spark):
    many = [(f"f/p/n{i:03d}.md", {"name": f"n{i:03d}", "type": "project", "description": "d" * 150, "verified": f"2026-01-{1 + i % 28:02d}"}, "") for i in range(200)]
    n = make(spark, *many, ("f/p/keep.md", {"name": "keep", "type": "feedback"}, ""), ("f/p/old.md", {"name": "old", "status": "archived"}, ""), ("f/common/c.md", {"name": "c", "type": "reference"}, ""))
    r = {x["project"]: x for x in hot.compaction(hot.lines(n)).collect()}
    assert r["f/p"]["bytes"] <= hot.LIMIT < r["f/p"]["full_bytes"] and r["f/common"]["left_out"] == 0
    texts = {x["project"]: x["text"] for x in hot.render(n).collect()}
    assert {p: len(t.encode()) for p, t in texts.items()} == {p: x["bytes"] for p, x in r.items()}
    k, text = r["f/p"]["left_out"], texts["f/p"]
    line = len(f"- [n000](n000.md): {'d' * 150}") + 1
    assert r["f/p"]["full_bytes"] == r["f/p"]["bytes"] + k * line - len(f"- {k} older project notes left out of the hot index, search finds them") - 1 and r["f/p"]["bytes"] + line > hot.LIMIT
    assert "[keep](keep.md)" in text and "## Shared by f\n\n- [c](../common/c.md)" in text and f"- {k} older project notes left out" in text and "(n000.md)" not in text
    assert text.startswith("# Memory index, f/p\n\n## Ways of working\n\n- [keep]") and "1 archived note(s)" in text.splitlines()[-1] and texts["f/common"] == "# Memory index, f/common\n\n## Durable knowledge\n\n- [c](c.md)\n"
    few = make(spark, ("f/p/old.md", {"status": "archived"}, ""), ("f/p/sub/x.md", {"type": "odd", "description": " d "}, ""))
    assert hot.render(few).first()["text"] == "# Memory index, f/p\n\n## odd\n\n- [x](sub/x.md): d\n\n<!-- 1 archived note(s), outside the index, reachable by a search of the archives -->\n"
    assert hot.render(make(spark)).count() == 0


def test_duplicates(spark):
    v = spark.createDataFrame([("a", 0, None, _unit64(1, 0.01)), ("a", 1, None, _unit64(1, 0.012)), ("b", 0, None, _unit64(1, 0.02)), ("c", 0, None, _unit64(0, 1)), ("d", 0, None, _unit64(1, 0.01)), ("e", 0, 1, _unit64(1, 0.01))], "path string, ordinal int, question_no int, embedding array<float>")
    n = make(spark, ("a", {}, ""), ("b", {}, ""), ("c", {}, ""), ("d", {"status": "archived"}, ""), ("e", {}, ""))
    assert [r[:2] for r in rows(duplicates.near_notes(v, n))] == [("a", "b")]
    rng = np.random.default_rng(1)
    x = rng.standard_normal((30, 64)).repeat(10, axis=0) + 0.35 * rng.standard_normal((300, 64))
    v = spark.createDataFrame([(f"n{i}", 0, None, r.tolist()) for i, r in enumerate(x)], "path string, ordinal int, question_no int, embedding array<float>")
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    i, j = np.nonzero(np.triu(u @ u.T >= 0.9, 1))
    want = {tuple(sorted((f"n{a}", f"n{b}"))) for a, b in zip(i, j)}
    assert {r[:2] for r in rows(duplicates.near_notes(v, rows_per_pivot=10))} == want and want


def test_near_notes_hold_a_bounded_number_of_rows(spark):
    """Many directions that are far from each other: no vector visits cells far away; a cell above the bound is cut into parts, and rounds end."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((40, 64)).repeat([100] + [5] * 39, axis=0) + 0.3 * rng.standard_normal((295, 64))
    v = spark.createDataFrame([(f"n{i % 200:03}", 0, None, r.tolist()) for i, r in enumerate(x)], "path string, ordinal int, question_no int, embedding array<float>")
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    best = {}
    for a, b in zip(*np.nonzero(u @ u.T >= 0.9)):
        if a % 200 < b % 200:
            key = (f"n{a % 200:03}", f"n{b % 200:03}")
            best[key] = max(best.get(key, 0), round(float(u[a] @ u[b]), 6))
    raw = spark.createDataFrame([(f"n{i}", r.tobytes()) for i, r in enumerate(u)], "path string, raw binary")
    pivots = duplicates._cover(u.astype(np.float32), 1000)
    assert len(pivots) < 60 and duplicates._visits(raw, pivots, 0.9, 64, "f8").count() < 1.5 * len(u)
    for bound in ({}, {"rows_per_pivot": 1}, {"most_pivots": 7}):
        assert {(a, b): round(s, 6) for a, b, s in rows(duplicates.near_notes(v, **bound))} == best


def test_near_notes_at_a_low_threshold_plan_no_whole_groups(spark):
    x = np.random.default_rng(3).standard_normal((60, 64)) + 2
    v = spark.createDataFrame([(f"n{i:02}", 0, None, r.tolist()) for i, r in enumerate(x)], "path string, ordinal int, question_no int, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    pairs = duplicates.near_notes(v, threshold=0.8, rows_per_pivot=1)
    assert "FlatMapGroups" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert [r[:2] for r in rows(pairs)] == [(f"n{i:02}", f"n{j:02}") for i in range(60) for j in range(i + 1, 60) if u[i] @ u[j] >= 0.8]


def test_secrets(spark):
    t = spark.createDataFrame([("a", "x\nglpat-" + "A1b2C3d4E5f6G7h8I9j0"), ("b", "password: hunter2hunter2"), ("c", "the password is changed weekly"), ("d", None), ("e", "AKIA" + "ABCDEFGH12345678")], "path string, text string")
    assert rows(secrets.scan(t)) == [("a", 2, "gitlab token"), ("b", 1, "assigned secret"), ("e", 1, "aws access key")]


# changes


def test_lifecycle(spark):
    c = "---\nname: a\nstatus: active\n---\n\nBody [[Beta_Two|that one]] [[beta two#s]] [[open"
    assert lifecycle.set_field(c, "status", "archived").splitlines()[2] == "status: archived" and 'source: "x: y"' in lifecycle.set_field(c, "source", "x: y") and "superseded_by: [[b]]" in lifecycle.set_field(c, "superseded_by", "[[b]]")
    assert lifecycle.set_field("plain", "a", "b") == "plain" and "status" not in lifecycle.remove_field(c, "status") and lifecycle.remove_field(c, "none") == c
    assert lifecycle.relink_text(c, "betatwo", "beta-three") == (c.replace("Beta_Two|", "beta-three|").replace("beta two#", "beta-three#"), 2)
    df = spark.createDataFrame([("f/p/a.md", c), ("f/p/beta-two.md", "---\nname: beta-two\n---\nold"), ("f/p/z.md", "no links"), ("f/p/n.md", None)], "path string, content string")
    got = {r["path"]: r for r in lifecycle.relink(df, "betatwo", "beta-three").collect()}
    assert got["f/p/a.md"]["relinked"] == 2 and got["f/p/z.md"]["relinked"] == 0 and len(got) == 4
    after = {r["path"]: r["content"] for r in lifecycle.supersede(df, "f/p/beta-two.md", "f/p/beta-three.md", lifecycle.new_note("beta-three", "d", "user", "text", "2026-05-05"), "2026-05-05").collect()}
    assert "superseded_by: [[beta-three]]" in after["f/p/beta-two.md"] and "[[beta-three|that one]]" in after["f/p/a.md"] and notes_.parse_text(after["f/p/beta-three.md"])[0]["verified"] == "2026-05-05"
    both = lifecycle.link_both(df, "f/p/a.md", "f/p/z.md")
    assert rows(lifecycle.link_both(both, "f/p/a.md", "f/p/z.md")) == rows(both) and "See also [[a]]" in {r["path"]: r["content"] for r in both.collect()}["f/p/z.md"]
    assert lifecycle.find_note(df, "Beta Two") == "f/p/beta-two.md"
    with pytest.raises(LookupError):
        lifecycle.find_note(df, "none")
    assert one(spark, "a\n\n", lambda x: lifecycle.append_paragraph(x, F.lit("  p \n"))) == "a\n\np\n"


# the index


def test_refresh_is_incremental(spark, tmp_path):
    n = make(spark, ("f/p/a.md", {"name": "a"}, "one\n\n# two"), ("f/p/b.md", {"name": "b"}, "three"))
    none = spark.createDataFrame([], "path string, ordinal int, question_no int, fingerprint string, embedding array<float>, truncated boolean")
    cached = chunking.split_bodies(n).where("path = 'f/p/b.md'").select(F.md5("text").alias("chunk_hash"), F.array(F.lit("why three?"), F.lit("what is it?")).alias("questions"))
    first, stats = index.refresh(n, chunking.split_bodies(n), none, cached)
    first = materialize(first)
    s = stats.first().asDict()
    assert (s["notes"], s["chunks"], s["questions"], s["encoded"], s["removed"], s["unchanged"]) == (2, 3, 2, 5, 0, 0)
    again = index.refresh(n, chunking.split_bodies(n), first, cached)[1].first().asDict()
    assert (again["encoded"], again["unchanged"], again["removed"]) == (0, 2, 0)
    changed = make(spark, ("f/p/a.md", {"name": "a"}, "one"))
    out, stats = index.refresh(changed, chunking.split_bodies(changed), first)
    s = stats.first().asDict()
    assert (s["encoded"], s["removed"]) == (1, 4) and out.count() == 1
    assert index.pending_questions(chunking.split_bodies(n), cached).count() == 2 and [r["path"] for r in index.pending_questions(chunking.split_bodies(n), cached, 1).collect()] == ["f/p/a.md"]
    assert index.prune_questions(cached, chunking.split_bodies(changed)).count() == 0
    head = {"model": "m", "weights_hash": "w", "dim": 64, "pooling": "mean", "prompts": ""}
    index.save(first, str(tmp_path / "ix"), head)
    assert index.load(spark, str(tmp_path / "ix"), head).count() == 5 and index.load(spark, str(tmp_path / "ix"), head | {"pooling": "cls"}) is None and index.load(spark, str(tmp_path / "none"), head) is None
    index.dump_chunks(n, str(tmp_path / "dump"))
    assert spark.read.json(str(tmp_path / "dump")).where("active").count() == 3
    bad = first.limit(1).withColumn("embedding", F.array(F.lit(1.0).cast("float")))
    with pytest.raises(Exception, match="wrong size"):
        index.upsert(first, bad, 64).collect()
    assert index.upsert(first, first, 64).count() == 5


def test_import_binary(spark, tmp_path):
    head = json.dumps({"dim": 2, "entries": [{"key": "a.md#1", "hash": 5}, {"key": "a.md#1?0", "hash": 6}]}).encode()
    data = index.MAGIC + struct.pack("<I", len(head)) + head + np.arange(4, dtype="<f4").tobytes()
    (tmp_path / "i.bin").write_bytes(data)
    assert rows(index.import_binary(spark, str(tmp_path / "i.bin"))) == [("a.md", 1, 0, "6", [2.0, 3.0]), ("a.md", 1, None, "5", [0.0, 1.0])]
    (tmp_path / "bad.bin").write_bytes(data[:-4])
    with pytest.raises(Exception, match="wrong size"):
        index.import_binary(spark, str(tmp_path / "bad.bin")).collect()


def test_encoder(spark):
    e = encoder.HashingEncoder()
    v, cut = e.encode(["a b c", "", "w " * 600])
    assert np.allclose(np.linalg.norm(v, axis=1), [1, 0, 1]) and cut.tolist() == [False, False, True]
    df = spark.createDataFrame([(i, f"text {i % 7} é") for i in range(50)], "i int, t string")
    for n in (1, 8):
        got = df.repartition(n).select("i", encoder.encode_column(F.col("t")).alias("e")).orderBy("i").select("e.embedding").collect()
        assert np.allclose([r[0] for r in got], e.encode([f"text {i % 7} é" for i in range(50)])[0], atol=1e-6)
    h, m = np.array([[[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]]]), np.array([[1, 1, 0]])
    assert encoder.pool(h, m, "cls").tolist() == [[1.0, 2.0]] and encoder.pool(h, m, "mean").tolist() == [[2.0, 3.0]] and np.isfinite(encoder.pool(h, m * 0, "mean")).all()
    with pytest.raises(ValueError):
        encoder.normalise(np.array([[np.nan, 1.0]]))
    conf = lambda a, n: json.dumps({"architectures": [a], "hidden_size": 8, "num_hidden_layers": 1, "num_attention_heads": 1, "max_position_embeddings": n})
    assert encoder.model_config(conf("XLMRobertaModel", 514))["window"] == 512 and encoder.model_config(conf("ModernBertModel", 8192))["window"] == 8192
    with pytest.raises(ValueError):
        encoder.model_config(conf("Other", 1))


def test_questions(spark):
    raw = "\x1b[1m> banner\n1. What is the first thing?\n- \"How does it work?\"\n\nshort\n* What is the first thing?\n3) Où est la pompe ?\nA fourth question here?"
    assert one(spark, raw, questions.clean) == ["What is the first thing?", "How does it work?", "Où est la pompe ?"]
    df = spark.createDataFrame([(1, "hello")], "chunk_hash bigint, text string")
    assert "hello" in questions.generate(df, "cat").first()["raw"] and questions.generate(df, "exit 3").first()["error"].startswith("exit 3")


# measures


def test_measures(spark):
    ranked = spark.createDataFrame([(1, "a", 0, 1), (1, "b", 0, 2), (2, "c", 1, 1), (2, "b", 4, 3)], "qid bigint, path string, ordinal int, place int")
    cases = spark.createDataFrame([(1, "x", "a", 0), (2, "x", "b", 5), (3, "y", "z", 0)], "qid bigint, family string, expected string, ordinal int")
    near = spark.createDataFrame([(3, "q"), (1, "a")], "qid bigint, path string")
    assert rows(measure.hit_rates(ranked, cases, near)) == [("x", 2, 0.5, 1.0, 0.5, 0.5), ("y", 1, 0.0, 0.0, 0.0, 0.0)]
    drawn = measure.draw(20, 50)
    assert len(set(drawn)) == 20 and drawn == measure.draw(20, 50) and sorted(measure.draw(99, 7)) == list(range(7))


# orphans


def test_orphans(spark):
    ts = lambda s: f"cast('{s}' as timestamp_ntz)" if s else "cast(null as timestamp_ntz)"

    def notes(*rs):
        out = None
        for path, fields, body, added, modified, deleted in rs:
            row = spark.createDataFrame([(path, fields, body)], "path string, fields map<string,string>, body string").select("*", *[F.expr(ts(x)).alias(c) for c, x in (("added_at", added), ("modified_at", modified), ("deleted_at", deleted))])
            out = row if out is None else out.unionByName(row)
        return out.withColumn("target", F.lit("clash"))

    d = ("2026-01-01", "2026-02-01", None)
    n = notes(
        ("f/p/a.md", {"name": "Alpha One"}, "[[b]] [[gone|x]] [[#only]]", *d), ("f/p/b.md", {}, "[[alpha_one#s]]", *d), ("f/p/c.md", {"superseded_by": "[[late]]"}, "[[b]]", *d), ("f/p/late.md", {}, None, "2026-05-01", "2026-05-02", None),
        ("f/p/dead.md", {}, "[[nothing]]", "2026-01-01", "2026-03-01", "2026-04-01"), ("f/p/e.md", {}, "[[dead]] [[guide]]", *d), ("f/p/ok.md", {}, "[[guide]]", *d), (None, {}, "[[x]]", *d), ("f/p/ok.md", {}, "[[guide]]", *d),
    )
    common = notes(("f/common/guide.md", {}, "[[unknown]]", "2018-01-01", "2018-01-02", None)).drop("deleted_at")
    fb = spark.createDataFrame([(1, "f/p/a.md", 20600), (2, "f/p/none.md", 20600), (3, "f/p/a.md", 10), (4, None, 20600), (5, "f/p/ok.md", 20600), (5, "f/p/ok.md", 20600), (6, "f/p/ok.md", None)], "pair_id bigint, path string, last_day bigint")
    got = rows(orphans.orphans(n, common, fb))
    assert [r[:5] for r in got if r[5] == 0] == [
        ("feedback", "path", "2", "f/p/none.md", "2026-05"), ("feedback", "path", "3", "f/p/a.md", "1970-01"), ("feedback", "path", "6", "f/p/ok.md", None), ("notes", "body", "f/p/a.md", "gone", "2026-02"),
        ("notes", "body", "f/p/dead.md", "nothing", "2026-03"), ("notes", "body", "f/p/e.md", "dead", "2026-02"), ("notes", "fields", "f/p/c.md", "late", "2026-02"),
    ]
    assert [(r[2], r[5]) for r in got if r[5] > 0] == [("1", 1), ("f/p/b.md", 1)]
    report = rows(orphans.orphan_report(orphans.orphans(n, common, fb)))
    assert ("feedback", "2026-05", 1, 1) in report and ("notes", "2026-02", 3, 1) in report
    assert orphans.orphans(n.limit(0), common.limit(0), fb.limit(0)).count() == 0


# streams


def test_streams(spark, tmp_path):
    s = spark.sql("select timestamp'2026-01-01 10:00:00' at, 'one' query, array('a') shown union all select timestamp'2026-01-01 10:05:00', 'two', array('b')")
    r = spark.sql("select 1L read_id, 'z' path, timestamp'2026-01-01 10:06:00' read_at_ union all select 2L, 'b', timestamp'2026-01-01 10:07:00' union all select 3L, 'z', timestamp'2026-01-01 12:00:00'").withColumnRenamed("read_at_", "at")
    s.write.parquet(str(tmp_path / "s"))
    r.write.parquet(str(tmp_path / "r"))
    out = []
    matched = streams.missed_stream(streams.stream(spark, str(tmp_path / "s"), s), streams.stream(spark, str(tmp_path / "r"), r))
    q = streams.watch(matched, lambda batch, k: out.extend(batch.collect()), str(tmp_path / "ck"), "0 seconds")
    q.processAllAvailable()
    q.stop()
    got = spark.createDataFrame([x.asDict() for x in out], matched.schema)
    assert rows(streams.latest_missed(got)) == [("two", "z", 20454)]
    pairs = spark.sql("select 'q' query, 'p' path, timestamp'2026-01-01 10:00:00' at union all select 'q', 'p', timestamp'2026-01-01 11:00:00'")
    pairs.write.parquet(str(tmp_path / "p"))
    q = streams.once_a_day(streams.stream(spark, str(tmp_path / "p"), pairs)).writeStream.format("memory").queryName("once").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("once").count() == 1


# sessions and entry points


def test_materialize(spark):
    df = spark.range(5).withColumn("x", F.rand())
    m = materialize(df)
    assert rows(m) == rows(m) and "table-" in m.inputFiles()[0] and shared_dir(spark)


def test_registered_queries_have_matching_sql():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_plan_prunes_columns(spark, data):
    df = curation.undated(spark.read.parquet(f"{data}/notes.parquet"))
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "ingested_at" not in text.split("ReadSchema")[1][:200]
