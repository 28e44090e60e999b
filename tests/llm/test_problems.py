"""The training-data operators against brute force, round trips and odd input."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marginalia.llm import knn, leak, markup, mix, neardup, queries, residue, split
from marginalia.llm.nearest_time import LineIndex, nearest_in_time
from marginalia.llm.residue_rules import kind
from marginalia.llm.words import WORD, bare_words, each, gram_sets, grams, hashed_words, words_of


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# 1: splitting


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["# Head\n", "word ", "Éa. ", "\n\n", "- item\n", "  - sub\n", "```\ncode\n```\n", "| a | b |\n", "日本語", "x" * 50, "~~~\n", "\r\n", "# "]), max_size=120), st.integers(20, 300), st.integers(0, 15))
def test_pieces_cover_the_text_within_the_limit(parts, limit, overlap):
    data = "".join(parts).encode()
    cut = split.split_text(data, limit, overlap)
    assert cut[0][0] == 0 and cut[-1][1] == len(data)
    for a, b in cut:
        assert b - a <= limit
        data[a:b].decode()
    for (_, e), (s, f) in zip(cut, cut[1:]):
        assert e - overlap <= s <= e < f


def test_pieces_end_at_sections_and_paragraphs():
    data = ("# A\n\n" + "one two. " * 10 + "\n\n# B\n\n" + "three four. " * 8).encode()
    cut = split.split_text(data, 140, 20)
    assert data[: cut[0][1]].endswith(b"\n\n") and data[cut[0][1] :].startswith(b"# B")


def test_very_long_text_without_boundaries():
    data = ("é" * 400_000).encode()
    cut = split.split_text(data, 1349, 120)
    assert all(b - a <= 1349 for a, b in cut) and cut[-1][1] == len(data)


def test_offsets_into_the_body(spark):
    body = "intro\n\n\n" + "é word. " * 300 + "\n\nend"
    chunks = split.body_chunks(body, 450)
    data = [(k, c[0][0], b"\n\n".join(b for _, b in c).decode()) for k, c in enumerate(chunks)]
    rows_ = [("p", k, None if k % 2 else s + 7, t) for k, s, t in data] + [("p", 0, 7, data[0][2]), ("q", 0, 3, "z " * 900), ("n", 0, None, None), (None, None, None, "y " * 900), ("e", 0, 0, "")]
    c = spark.createDataFrame(rows_, "path string, ordinal int, start int, text string").withColumn("body", F.lit("clash"))
    n = spark.createDataFrame([("p", body), ("p", body), ("q", None)], "path string, body string").withColumn("text", F.lit("clash"))
    got = split.split_oversized(c, n).collect()
    assert {r["path"] for r in got} == {"p", "q", None}
    raw = body.encode()
    for r in got:
        if r["path"] == "p":
            assert raw[r["body_start"] :].decode().startswith(r["text"].split("\n\n")[0])
        else:
            assert r["body_start"] is None
    assert len([r for r in got if r["path"] == "p" and r["piece"] == 0]) == 1
    assert split.split_oversized(c.limit(0), n).count() == 0


# 2: nearest vectors


def exact(x, ids, k):
    u = knn.unit(x)
    s = u @ u.T
    out = set()
    for i in range(len(x)):
        order = [j for j in np.lexsort((ids, -s[i])) if j != i][:k]
        out |= {(int(ids[i]), int(ids[j])) for j in order}
    return out


def test_collision_counting_against_brute_force():
    rng = np.random.default_rng(1)
    centre = rng.standard_normal((20, 64))
    x = (np.repeat(centre, 30, axis=0) + 0.2 * rng.standard_normal((600, 64))).astype(np.float32)
    ids = rng.permutation(600)
    a, b, s = knn.collide(np.arange(600), x, ids, 5)
    got, want = set(zip(ids[a].tolist(), ids[b].tolist())), exact(x, ids, 5)
    assert len(got & want) / len(want) > 0.97
    spread = rng.standard_normal((200, 64)).astype(np.float32)  # no near neighbours at all: the windows must grow
    a, b, _ = knn.collide(np.arange(200), spread, np.arange(200), 5)
    assert len(set(zip(a.tolist(), b.tolist())) & exact(spread, np.arange(200), 5)) / 1000 > 0.9


def exact_neighbours(x, queries, k=5):
    u = knn.unit(x)
    score = u[queries] @ u.T
    score[np.arange(len(queries)), queries] = -3
    return {(int(q), int(b)) for q, r in zip(queries, np.argsort(-score, axis=1, kind="stable")[:, :k]) for b in r}


def test_a_cell_of_near_copies_is_answered_exactly():
    rng = np.random.default_rng(3)
    x = (rng.standard_normal(64) + 1e-3 * rng.standard_normal((2500, 64))).astype(np.float32)
    a, b, _ = knn.collide(np.arange(2500), x, np.arange(2500), 5)
    queries = np.arange(0, 2500, 25)
    assert len(a) == 5 * 2500 and exact_neighbours(x, queries) <= set(zip(a.tolist(), b.tolist()))


def test_a_large_cell_is_cut_into_cells():
    rng = np.random.default_rng(4)
    x = (np.repeat(rng.standard_normal((150, 64)), 20, axis=0) + 0.2 * rng.standard_normal((3000, 64))).astype(np.float32)
    a, b, _ = (np.concatenate(c) for c in zip(*knn.answer_cell(np.arange(0, 3000, 2), x, np.arange(3000), 5, 300, 1.35, 4, 1000)))
    want = exact_neighbours(x, np.arange(0, 3000, 30))
    assert len(a) == 5 * 1500 and set(a.tolist()) == set(range(0, 3000, 2))
    assert len(want & set(zip(a.tolist(), b.tolist()))) >= 0.95 * len(want)


def test_vectors_with_odd_rows_and_copies(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((40, 64)).astype(np.float32).tolist()
    copies = [(100 + i, base[0]) for i in range(20)]
    odd = [(200, None), (201, [1.0] * 63), (202, [0.0] * 64), (203, [float("nan")] + [1.0] * 63), (204, [float("inf")] + [1.0] * 63), (205, [None] + [1.0] * 63), (None, base[1])]
    data = [(i, v) for i, v in enumerate(base)] + copies + odd + [(5, base[5])]
    v = spark.createDataFrame(data, "vec_id bigint, embedding array<float>").withColumn("score", F.lit(1)).withColumn("cell", F.lit(2))
    found = rows(knn.nearest_vectors(v).select("vec_a", "vec_b"))
    assert len(found) == len(set(found)) == 60 * 5
    assert {b for a, b in found if a == 110} == {0, 100, 101, 102, 103} and {b for a, b in found if a == 0} == {100, 101, 102, 103, 104}
    ids = np.array([i for i, _ in data[:60]])
    want = exact(np.array([x for _, x in data[:60]], np.float32), ids, 5)
    assert len(want & set(found)) / len(want) > 0.95
    assert knn.nearest_vectors(v.limit(0)).count() == 0 and knn.nearest_vectors(v.where("vec_id = 3")).count() == 0


def test_unusable_copies_have_no_partners(spark):
    base = np.random.default_rng(4).standard_normal((12, 64)).astype(np.float32).tolist()
    bad = [[0.0] * 64, [-0.0] * 64, [float("nan")] + [1.0] * 63, [float("inf")] + [1.0] * 63, [float("-inf")] + [1.0] * 63, [None] + [1.0] * 63]
    data = [(i, v) for i, v in enumerate(base)] + [(1000 * (j + 1) + i, v) for j, v in enumerate(bad) for i in range(9)]
    found = rows(knn.nearest_vectors(spark.createDataFrame(data, "vec_id bigint, embedding array<float>")).select("vec_a", "vec_b"))
    assert len(found) == 12 * 5 and all(a < 12 and b < 12 for a, b in found)


def test_recall_on_the_test_vectors(spark, data):
    v = spark.read.parquet(f"{data}/vectors.parquet")
    t = v.select("vec_id", "embedding").distinct().toArrow()
    at, x = knn.as_matrix(t["embedding"], 64)
    ids = t["vec_id"].to_numpy()[at]
    ids, first = np.unique(ids, return_index=True)
    want = {tuple(sorted(p)) for p in exact(x[first], ids, 5)}
    got = set(rows(knn.neighbour_pairs(knn.nearest_vectors(v))))
    assert len(want & got) / len(want) > 0.98


# 3: markup


@pytest.mark.parametrize(
    ("text", "families", "clean"),
    [
        ("<p>One <b>two</b></p>", ["html"], "One two"),
        ("a &lt; b &amp; c", ["html"], "a < b & c"),
        ("x <!-- note --> y", ["html"], "x  y"),
        ("<ul><li>a</li><li>b</li></ul>", ["html"], "- a\n- b"),
        ("<h2>T</h2><pre><code>x < 1</code></pre>", ["html"], None),
        ("'''bold''' and ''it''", ["wiki"], "bold and it"),
        ("== Title ==\ntext", ["wiki"], "## Title\ntext"),
        ("{{Warning|mind the gap}}", ["wiki"], "mind the gap"),
        ("[https://x.invalid/a label] __NOTOC__ --~~~~", ["wiki"], "label"),
        ("\\section{A}\n\\begin{itemize}\n\\item b\n\\end{itemize}", ["latex"], "## A\n\n- b"),
        ("so $x_1 = \\frac{1}{2}$ holds", ["latex"], "so $x_1 = \\frac{1}{2}$ holds"),
        ("end.\\footnote{why}", ["latex"], "end. (why)"),
        ("# Head\n\n- item `<b>` [[note|alias]]\n\n```\n<p>{{x|y}}\\alpha</p>\n```", [], None),
        ("p95 < 38 ms and p50 > 10 ms, R&D, $9 to $12, D:\\exports\\weekly, a <b and c> d, List<String>", [], None),
        ("it''s 5'' and 6''", [], None),
        ("~~~\n<div>\n", [], None),
        ("", [], ""),
        ("<div", [], "<div"),
    ],
)
def test_markup(text, families, clean):
    got, found = markup.read(text)
    assert found == families
    if clean is not None:
        assert got == clean
    elif not families:
        assert got == text


def test_navigation_and_footer_lines_go():
    prose = "<p>The depot importer keeps late rows for three days, after which the ledger team removes them by hand.</p>\n"
    bar = '<div><a href="/">Home</a> | <a href="/s">Search</a> | <a href="/h">Help pages</a></div>\n'
    foot = "<footer>Example wiki, all rights reserved</footer>\n"
    kept = '<ul><li><a href="/x">First</a> <a href="/y">item</a></li></ul>\n<h2><a href="/t">Top</a> <a href="/u">ics</a></h2>\n<table><tr><td><a href="/c">cell</a> <a href="/d">two</a></td></tr></table>\n'
    clean = markup.read(bar + prose * 3 + kept + prose + foot)[0]
    assert "Home" not in clean and "Help" not in clean and "rights" not in clean and clean.count("The depot importer") == 4
    assert "First item" in clean and "## Top ics" in clean and "cell two" in clean
    one = '<p><a href="/g">Read the guide of the ledger team</a></p>\n'  # a single link may be all a paragraph has
    assert "Read the guide" in markup.read(prose * 3 + one + prose)[0]
    assert markup.read("<nav>" + prose * 3)[0].count("The depot importer") == 3  # never closed


@pytest.mark.parametrize(("start", "end"), [("\\[", "\\]"), ("\\(", "\\)"), ("$", "$")])
def test_long_formulas_stay(start, end):
    formula = start + " + ".join(["\\frac{a}{b}"] * 400).strip() + end
    text = f"so {formula} holds\n\n\\emph{{x}}"
    assert markup.read(text) == (f"so {formula} holds\n\nx", ["latex"])
    assert markup.read(f"so {start}a_1 + " + "b + " * 400 + f"c{end} holds") == (f"so {start}a_1 + " + "b + " * 400 + f"c{end} holds", ["latex"])
    apart = f"cost {start}a_1\n\n\\emph{{y}} b{end} end"  # no formula beyond a blank line
    assert "\\emph" not in markup.read(apart)[0]


def test_formulas_with_line_breaks_stay():
    text = r"so \[ a \\[2pt] \frac{b}{c} \] holds"
    assert markup.read(text) == (text, ["latex"])


def test_deep_arguments_leave_nothing():
    assert markup.read("\\emph{" * 9 + "x" + "}" * 9)[0] == "x"


def test_nested_templates_leave_nothing():
    for depth in (1, 2, 3, 7):
        clean, families = markup.read("{{A|" * depth + "x" + "}}" * depth + " and prose")
        assert families == ["wiki"] and clean == "x and prose", clean


@settings(max_examples=200, deadline=None)
@given(st.text("<>/&;'={}|[]$\\~`#\n abipx\r-!_.", max_size=80))
def test_markup_never_fails_and_keeps_plain_text(text):
    clean, found = markup.read(text)
    assert isinstance(clean, str)
    if not found and "\r" not in text:
        assert clean == text


def test_markup_rows(spark):
    df = spark.createDataFrame([("a", "<p>x</p>"), ("a", "<p>x</p>"), ("b", None), (None, "<p>x</p>"), ("c", "x " * 200_000)], "path string, body string").withColumn("family", F.lit("clash"))
    assert rows(markup.markup_found(df)) == [("a", "html")]
    got = {r["path"]: r["clean_text"] for r in markup.clean_markup(df).collect()}
    assert got["b"] is None and len(got["c"]) == 400_000 and markup.clean_markup(df.limit(0)).count() == 0


# 4: nearest in time


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(-(10**6), 10**6), max_size=400), st.lists(st.integers(-(10**6), 10**6), max_size=50))
def test_learned_index_is_exact(keys, probes):
    keys = np.array(sorted(keys), np.int64)
    assert (LineIndex(keys).lower_bound(np.array(probes, np.int64)) == np.searchsorted(keys, np.array(probes, np.int64))).all()


def test_nearest_in_time_against_brute_force(spark):
    rng = np.random.default_rng(3)
    reads = [(i, int(rng.integers(0, 40_000)), f"p{rng.integers(0, 5)}") for i in range(3000)] + [(9001, None, "p1"), (9002, 5, None), (9003, 5, ""), (9004, 3600 * 5, "edge")]
    searches = [(i, int(rng.integers(0, 40_000)), [f"p{rng.integers(0, 5)}"] * 2) for i in range(700)] + [(800, 9, None), (801, 9, []), (802, 9, [""]), (803, None, ["p1"]), (804, 3600 * 5 - 600, ["edge"]), (805, 3600 * 5 + 600, ["edge"]), (799, 3600 * 5 - 600, ["edge"])]
    r = spark.createDataFrame(reads + reads[:50], "read_id bigint, secs bigint, path string").withColumn("search_id", F.lit(1)).withColumn("entity", F.lit("x"))
    s = spark.createDataFrame(searches + searches[:50], "search_id bigint, secs bigint, shown array<string>").withColumn("path", F.lit("x"))
    want = set()
    for i, t, p in reads:
        near = [(abs(t - u), u, j) for j, u, shown in searches if t is not None and u is not None and p is not None and p in (shown or []) and abs(t - u) <= 600]
        if near:
            want.add((i, min(near)[2]))
    got = rows(nearest_in_time(r, s).select("read_id", "search_id"))
    assert len(got) == len(set(got)) and set(got) == want and (9004, 799) in want
    assert nearest_in_time(r.limit(0), s).count() == 0 and nearest_in_time(r, s.limit(0)).count() == 0


# 6: near duplicates


def jaccard_pairs(texts, t, n):
    sets = {k: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} for k, x in texts.items() for w in [words_of(x)]}
    keys = sorted(sets)
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if sets[a] and sets[b] and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-12}


@pytest.mark.parametrize(("threshold", "n", "exact", "most"), [(0.5, 3, False, 4096), (0.8, 5, False, 4096), (0.5, 3, True, 4096), (0.5, 3, False, 3)])
def test_near_duplicates_against_brute_force(spark, threshold, n, exact, most):
    """Also the exact way, and with blocks of more than three classes cut into parts."""
    rng = np.random.default_rng(4)
    texts = {}
    for g in range(40):
        base = [f"w{rng.integers(0, 400)}" for _ in range(int(rng.integers(8, 120)))]
        for k in range(5):
            w = list(base)
            for _ in range(int(rng.integers(0, 1 + len(w) // 8))):
                w[int(rng.integers(0, len(w)))] = f"z{rng.integers(0, 400)}"
            texts[f"{g}-{k}"] = " ".join(w)
    texts |= {"copy1": "same words here again and again", "copy2": "Same words, here: again and again!", "short": "two words", "empty": ""}
    data = [*texts.items(), ("null", None), (None, "x y z"), ("copy1", texts["copy1"])]
    df = spark.createDataFrame(data, "key string, text string").withColumn("class_id", F.lit("clash")).withColumn("bits", F.lit(0))
    got = rows(neardup.near_pairs(neardup.near_duplicates(df, threshold, n, exact, most)))
    want = jaccard_pairs(texts, threshold, n)
    assert len(got) == len(set(got)) and set(got) == want and ("copy1", "copy2") in want
    assert neardup.near_pairs(neardup.near_duplicates(df.limit(0), threshold, n, exact, most)).count() == 0


def test_short_texts_have_classes_of_their_own(spark, monkeypatch):
    long = "one two three four five six seven"
    texts = [(1, "Zugriff verweigert."), (2, "zugriff, VERWEIGERT"), (3, "verweigert Zugriff"), (4, None), (5, ""), (6, "--"), (7, long), (8, long + "!"), (9, "one two three four"), (10, "a b c d e")]
    d = spark.createDataFrame(texts, "doc_id bigint, text string")
    monkeypatch.setattr(queries, "table", lambda *_: d)
    got = {r["doc_id"]: (r["class_id"], r["links"]) for r in queries.p6_groups(spark, "").collect()}
    assert sorted(got) == list(range(1, 11)) and all(links == 0 for _, links in got.values())
    kinds = [(1, 2), (3,), (4, 5, 6), (7, 8), (9,), (10,)]
    assert [len({got[i][0] for i in k}) for k in kinds] == [1] * 6 and len({c for c, _ in got.values()}) == 6
    found = neardup.near_duplicates(d.withColumnRenamed("doc_id", "key"))
    assert rows(neardup.near_pairs(found)) == [(7, 8)]  # short texts are in no pair


@pytest.mark.parametrize("most", [4096, 2])
def test_near_duplicates_leave_no_shuffle_files(spark, monkeypatch, most):
    """The rows of all blocks, many times the texts, are neither dealt out at once nor left on disk; large blocks too."""
    rng = np.random.default_rng(6)
    data = [(i, " ".join([f"g{i % 30}w{j}" for j in range(60)] + [f"z{x}" for x in rng.integers(0, 50, i // 30)])) for i in range(600)]
    df = spark.createDataFrame(data, "key bigint, text string").repartition(2)
    monkeypatch.setattr(neardup, "DEALT", 6000, raising=False)
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        found = disk.getAllFiles()
        return {found.apply(i).getPath(): found.apply(i).length() for i in range(found.size()) if "shuffle_" in found.apply(i).getName()}

    before = files()
    found = neardup.near_duplicates(df, 0.5, 3, most_in_block=most)
    left = sum(size for path, size in files().items() if path not in before)
    assert left < 60 * len(data)  # bytes; all blocks took 2000 and more a text
    assert set(rows(neardup.near_pairs(found))) == jaccard_pairs(dict(data), 0.5, 3)



# 7: leaks


def test_leaks(spark):
    item = "The quick brown fox jumps over the lazy dog while seven wizards écrivent une très longue lettre à la reine"
    words = item.split()
    docs = [
        (1, "Before. " + item.upper() + " After."), (2, "x " * 50 + " -- ".join(words[2:15])), (3, " ".join(words[:12])), (4, " ".join(words[:6]) + " oops " + " ".join(words[6:])),
        (5, item.replace("é", "e\u0301")), (6, None), (7, ""), (None, item), (1, "Before. " + item.upper() + " After."), (8, "filler " * 200_000),
    ]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit(0)).withColumn("score", F.lit(0))
    i = spark.createDataFrame([(1, item), (2, None), (3, "too short an item"), (None, "x"), (1, item), (4, item)], "item_id bigint, text string")
    found = leak.leaks(d, i)
    assert rows(leak.verbatim(found)) == [(1, 1), (1, 4), (2, 1), (2, 4), (4, 1), (4, 4), (5, 1), (5, 4)]
    share = {(r["doc_id"], r["item_id"]): r["share"] for r in found.collect()}
    assert share[1, 1] == 1.0 and 0.9 < share[4, 1] < 1 and leak.leaks(d.limit(0), i).count() == 0 and leak.leaks(d, i.limit(0)).count() == 0
    assert rows(leak.leaks(d, i, most_chars=120)) == rows(found)  # items in blocks
    with pytest.raises(ValueError):
        leak.leaks(d, i, n=14, run=13)


def test_seeds_are_the_rarest_of_every_window():
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 30, n)) for n in (0, 3, 5, 11, 13, 14, 60, 60)]
    items = leak.Items(np.arange(len(texts)), texts, 5, 13)
    count = rng.integers(0, 4, len(items.known))
    want = set()
    for item, g in enumerate(items.grams):
        seen = count[np.searchsorted(items.known, g)]
        width = min(9, len(g))
        for at in range(len(g) - width + 1 if len(g) else 0):
            place = min(range(at, at + width), key=lambda i: (seen[i], g[i]))
            want.add((int(g[place]), item, place))
    got = list(zip(*(x.tolist() for x in items.seeds(count))))
    assert got == sorted(want)


def test_alignment_against_plain_dynamic_programming():
    rng = np.random.default_rng(5)
    for _ in range(30):
        a, b = rng.integers(0, 4, 12).astype(np.uint64), rng.integers(0, 4, 15).astype(np.uint64)
        h = np.zeros((13, 16), int)
        for i in range(12):
            for j in range(15):
                h[i + 1, j + 1] = max(0, h[i, j] + (leak.MATCH if a[i] == b[j] else leak.MISMATCH), h[i, j + 1] + leak.GAP, h[i + 1, j] + leak.GAP)
        runs = [k for k in range(13) for i in range(12 - k + 1) for j in range(15 - k + 1) if (a[i : i + k] == b[j : j + k]).all()]
        assert leak.align(a, b) == (h.max(), max(runs))


# 8: mixing


def test_mix_reaches_shares_and_caps(spark):
    rng = np.random.default_rng(6)
    docs = [(i, "tok " * int(rng.integers(5, 60)), s) for i, s in enumerate(["big"] * 600 + ["mid", "MID"] * 100 + ["small"] * 30)] + [(9000, "x y", None), (9001, None, "big"), (9002, "", "big"), (9003, "x", "unknown"), (None, "x", "big")]
    d = spark.createDataFrame(docs + docs[:20], "doc_id bigint, text string, source string").withColumn("tokens", F.lit(-1)).withColumn("pass", F.lit(-1))
    t = spark.createDataFrame([("big", 0.5, 2), ("Mid", 0.3, 3), ("small", 0.2, 2), ("none", None, 1), ("zero", 0.1, 0)], "source string, target_share double, max_repeats int")
    m = mix.mix(d, t)
    got = {r["source"]: r for r in mix.shares(m, t).collect()}
    sizes = {r["source"]: r["n"] for r in mix.count_tokens(d).groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    total = sum(sizes.values())
    used = sum(r["tokens"] for r in got.values())
    assert total - 200 <= used <= total
    assert got["small"]["tokens"] == 2 * sizes["small"] and got["small"]["most_uses"] == 2  # its cap binds
    assert abs(got["big"]["tokens"] / got["Mid"]["tokens"] - 5 / 3) < 0.1 and got["none"]["tokens"] == got["zero"]["tokens"] == 0
    assert max(r["n"] for r in m.groupBy("doc_id", "pass").agg(F.count("*").alias("n")).collect()) == 1
    assert rows(mix.mix(d, t)) == rows(m)  # the same again
    assert mix.mix(d.limit(0), t).count() == 0 and mix.mix(d, t.limit(0)).count() == 0
    assert abs(sum(r["tokens"] for r in mix.mix(d, t, total=1000).collect()) - 1000) < 100


def test_mix_is_weighted_fair_queueing(spark):
    """Against a queue in plain Python, with slots and ranges of few rows."""
    rng = np.random.default_rng(8)
    docs = [(i, "tok " * int(rng.integers(0, 40)), "abc"[int(rng.integers(0, 9)) // 4]) for i in range(500)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    share, most = {"a": 0.2, "b": 0.3, "c": 0.5}, {"a": 1, "b": 3, "c": 6}
    t = spark.createDataFrame([(s, share[s], most[s]) for s in "abc"], "source string, target_share double, max_repeats int")
    sized = {r["doc_id"]: (r["source"], r["tokens"]) for r in mix.count_tokens(d).collect()}
    total = sum(n for _, n in sized.values())
    order = d.select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("pass")).select("doc_id", "pass", F.xxhash64("doc_id", "pass", F.lit(17)).alias("h")).collect()
    spent, queue = dict.fromkeys("abc", 0), []
    for r in sorted(order, key=lambda r: (r["pass"], (r["h"] >> 59) % 16, r["h"], r["doc_id"])):  # sixteen slots
        source, tokens = sized[r["doc_id"]]
        if r["pass"] <= most[source]:
            spent[source] += tokens
            queue.append((spent[source] / share[source], source, r["pass"], r["doc_id"], tokens))
    want, left = set(), total
    for finish, source, pass_, doc, tokens in sorted(queue):
        left -= tokens
        if left < 0:
            break
        want.add((doc, pass_))
    got = {(r["doc_id"], r["pass"]) for r in mix.mix(d, t, rows_in_one=20).collect()}
    assert {x for x in got ^ want if sized[x[0]][1]} == set() and len(got) > 400


# 9: residue


@pytest.mark.parametrize("text", [
    "Title: {{x}}\nOwner: XXXX", "Hello {{ name }},\n\nyour request %ID% was closed by <owner here> on [DATE].\n\nRegards,\n@@x@@", "404 Not Found", "# some title\n\nText to come.\n\nText to come.", "asdf asdf\ntest test test",
    "Dolentor velora bellume quamis non non tavora minet.", "<noscript>Please accept cookies to continue to the document.</noscript>", "Menu\n\nActivez JavaScript pour afficher cette page.\n\nPage 1 / 1\ntool 1.2.3",
    "| Title | Owner |\n|---|---|\n| XXXX | {{ y }} |", "# Limits\n\n## Context\n\n-\n\n## Symptoms\n\nTODO", '{"error": {"code": 502, "message": "Bad Gateway"}}', "---\nname: x\ntype: y\n---\n\nAccess denied.",
])
def test_residue_rules(text):
    assert kind(text)[0] == "residue"


@pytest.mark.parametrize("text", [
    "Set idle_limit to 317 and read the trace, not the log.", 'We removed 9 notes whose only text was "Text to come.".\n\nThe rest stays.', "A 404 Not Found from birchfs means that the disk is full. Lower the batch size.", "The mail still showed {{ date }} to 9 people, see KTL-9.",
    "See [[REGIONAL_KEEL_TOPIC]] for more about the queue.", "```\nimage: {{ .Values.x }}\n```", "Access denied is logged when a header is missing; compare both counts.", "",
])
def test_content_is_no_residue(text):
    assert kind(text)[0] != "residue"


def test_residue_spreads_over_links(spark):
    words = [f"word{i}" for i in range(60)]
    form = "Placeholder paragraph, replace before publishing.\n" * 3
    docs = [(1, form), (2, form), (3, " ".join(words) + "."), (4, None), (5, ""), (None, form), (1, form), (6, "404 Not Found"), (7, "x " * 100_000 + ". Another sentence. And one more here.")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("kind", F.lit("clash"))
    assert [r[0] for r in rows(residue.residue(d).select("doc_id"))] == [1, 2, 6]
    assert residue.residue(d.limit(0)).count() == 0
    # a message that no rule knows, in a page that is otherwise one of residue
    long_form = "\n".join(f"your{i} request {{{{b}}}} was{i} closed by {{{{c}}}} on {{{{d}}}}." for i in range(150))
    near = spark.createDataFrame([(1, long_form), (2, long_form + "\nwith kind greetings from all of us"), (3, "\n".join(words))], "doc_id bigint, text string")
    assert rows(residue.residue(near)) == [(1, "rule"), (2, "link")]


def test_simhash_blocks_find_all_within_three_bits():
    rng = np.random.default_rng(7)
    from itertools import combinations

    for _ in range(200):
        flip = rng.choice(64, 3, replace=False)
        touched = {b for b, (at, w) in enumerate(residue.BLOCKS) for f in flip if at <= f < at + w}
        assert any(not (set(c) & touched) for c in combinations(range(5), 2))


def test_links_at_the_similarity_are_found(spark):
    rng = np.random.default_rng(11)
    word = lambda n: "".join(f" w{x}" for x in rng.integers(0, 10**9, n))
    pairs = [(text, text + word((5, 10, 24)[i % 3])) for i, text in enumerate(word(104) for _ in range(60))]  # 100 shingles; 24 more are 0.806
    data = [(side * 1000 + i, not side, pair[side]) for i, pair in enumerate(pairs) for side in (0, 1)]
    named = spark.createDataFrame(data, "class_id bigint, labelled boolean, normal string")
    hashed = named.mapInArrow(residue._hash(residue.layout(0.8)[0] * residue.WIDTH), "class_id bigint, labelled boolean, size int, mark binary, shingles binary").cache()
    found = residue._linked(hashed.where("not labelled"), hashed.where("labelled"), 0.8)
    assert rows(found) == [(1000 + i,) for i in range(60)]
    # the same from the texts: a labelled form, and one that differs in a sixth of its words (old radius: 3 of 64 bits)
    lines = [f"{{{{a}}}} q{i} r{i}" for i in range(100)]
    d = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(lines) + "\n" + " ".join(f"new{i}" for i in range(30)))], "doc_id bigint, text string")
    assert rows(residue.residue(d)) == [(1, "rule"), (2, "link")]


def test_unknown_wording_is_reached_from_labelled_texts(spark):
    form = "\n".join(f"{{{{a}}}} q{i} r{i}" for i in range(60))
    page = form + "\nThe clerk is out to lunch. Nobody can answer you now. Come round some other day."  # three unknown sentences
    coded = form + "\n```\nlunch\n```"
    own = form + "".join(f"\nWe met the clerk at noon for KTL-{i}00 and waited." for i in range(3))  # strong evidence
    assert [kind(x)[0] for x in (form, page, coded, own)] == ["residue", "unknown", "unknown", "content"]
    d = spark.createDataFrame([(1, form), (2, page), (3, coded), (4, own)], "doc_id bigint, text string")
    assert rows(residue.residue(d)) == [(1, "rule"), (2, "link"), (3, "link")]


def test_trusted_content_is_read_whole_and_linked(spark):
    form = "\n".join(f"{{{{a}}}} q{i} r{i}" for i in range(60))
    own = form + "".join(f"\nWe met the clerk at noon for KTL-{i}00 and waited." for i in range(3))
    long = own + "\nThe clerk had left again."
    fill = own.replace("00 ", " ")  # no references, but the normal form of one that has them
    near = own.replace("KTL-200 and waited", "a while, then went home")  # two references, nearer to that text than to the form
    page = form + "\nThe clerk is out to lunch. Nobody can answer you now."
    assert [kind(x)[0] for x in (form, own, long, fill, near, page)] == ["residue", "content", "content", "unknown", "unknown", "unknown"]
    assert kind(long)[1].endswith("\nthe clerk had left again.") and kind(own)[1] == kind(fill)[1] != ""
    d = spark.createDataFrame([*enumerate((form, own, long, fill, near, page))], "doc_id bigint, text string")
    assert rows(residue.residue(d)) == [(0, "rule"), (5, "link")]


@pytest.mark.parametrize("text, expected", [
    ("Volanta merisum candolor quetis pravium estola.", "residue"), ("Gralor tumenti vasquis oleum parinda corvita, feltrum.", "residue"),  # in no list of words
    ("Depot importers retry late orders twice daily.", "unknown"), ("La tabla nueva guarda pocas filas repetidas.", "unknown"), ("Camperum dolentor.", "unknown"),
])
def test_filler_in_no_language(text, expected):
    assert kind(text)[0] == expected


def test_words():
    assert words_of("Été_2 l'eau-x") == ["été", "2", "l", "eau", "x"] and bare_words("ÉTÉ Straße e\u0301") == ["ete", "strasse", "e"]
    h, s = hashed_words(["a B a", None, "--", "b, a"])
    assert s.tolist() == [0, 3, 3, 3, 5] and h[0] == h[2] == h[4] and h[1] == h[3] and len(grams(h, 6)) == 0 and grams(h[:2], 2)[0] != grams(h[1:3], 2)[0]
    sets, edge = gram_sets(h, s, 2)
    assert edge.tolist() == [0, 2, 2, 2, 3] and set(sets[:2].tolist()) == {int(grams(h[:2], 2)[0]), int(grams(h[1:3], 2)[0])} and sets[2] == grams(h[3:], 2)[0]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.one_of(st.sampled_from("abÀé\u0301ßİΣσς \n-_x1²Ⅷ日a̧"), st.characters(codec="utf-8")), max_size=40)), max_size=8), st.booleans())
def test_hashes_are_those_of_the_words(texts, bare):
    h, s = hashed_words(texts, bare)
    seen = {}
    for x, (a, b) in zip(texts, each(s), strict=True):
        words = bare_words(x) if bare else ["".join(c.lower() if len(c.lower()) == 1 else c for c in w) for w in WORD.findall(x or "")]
        assert len(words) == b - a
        for w, v in zip(words, h[a:b].tolist()):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in w)
            assert seen.setdefault(low, v) == v
    assert len(set(seen.values())) == len(seen)
