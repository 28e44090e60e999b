"""Search without vectors: identifiers, words, first matching lines."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_chars, strip
from ..functions.vectors import in_blocks
from ..session import materialize

# File extensions that make a word an identifier.
EXTENSIONS = ("md", "sh", "rs", "php", "dart", "json", "yml", "yaml", "toml", "sql", "py", "ts", "js")
MOST_WORDS = 1_000_000
MOST_QUERIES = 65_536


def identifiers(query: Column) -> Column:
    """Words of a query that look like names of things: tickets, snake_case, file names, camelCase, letters with digits."""
    words = F.split(query, r"""(?U)[\s,;()«»"'?!:]+""")
    trimmed = F.transform(words, lambda w: F.when(w.rlike(r"\.(md|sh)$"), w).otherwise(F.regexp_replace(w, r"^\.+|\.+$", "")))
    ticket, file, both = r"^[A-Z]{2,}-[0-9]+$", rf"\.({'|'.join(EXTENSIONS)})$", lambda w: w.rlike("[0-9]") & w.rlike(r"\p{L}")
    camel = lambda w: w.rlike(r"^[\p{L}\p{N}]+$") & w.rlike("[a-z]") & w.rlike("^.[^A-Z]*[A-Z]")
    ok = lambda w: (F.char_length(w) >= 3) & w.rlike(r"[\p{L}\p{N}]") & (w.rlike(ticket) | w.contains("_") | w.rlike(file) | camel(w) | both(w))
    return F.array_distinct(F.filter(trimmed, ok))


def query_words(query: Column) -> Column:
    """Lower-case words of three letters or more, repeats kept."""
    return F.filter(F.split(F.lower(query), r"[^\p{L}\p{N}_-]+"), lambda w: F.char_length(w) >= 3)


def cli_words(query: Column) -> Column:
    return F.filter(F.split(F.lower(query), r"(?U)\s+"), lambda w: F.octet_length(w) >= 3)


def _asked(queries: DataFrame, words: Column) -> DataFrame:
    """One row for each word of a query, and ``said``, how often the query says it."""
    rows = queries.select("qid", F.explode(words).alias("word")).where("word <> ''")
    return rows.groupBy("qid", "word").agg(F.count("*").cast("int").alias("said"))


def _search(texts: DataFrame, asked: DataFrame, lower: bool = True) -> DataFrame:
    """``asked`` joined with where its words occur; the distinct words go to the executors in blocks of at most MOST_WORDS. The texts aren't
    shuffled: of a note that comes twice the hits are folded."""
    asked = materialize(asked)
    words = asked.select("word").distinct()
    hits = in_blocks(words, MOST_WORDS, lambda block: occurring(texts.where("path is not null"), [r["word"] for r in block.collect()], lower), "word")
    once = hits.groupBy("path", "word").agg(F.max(F.struct("times", "line_no", "line")).alias("h")).select("path", "word", "h.*")
    return asked.join(once, "word")


def _automaton(words: list[str]):
    import ahocorasick

    machine = ahocorasick.Automaton()
    for i, w in enumerate(words):
        machine.add_word(w, (i, len(w)))
    machine.make_automaton()
    return machine


def _found(machine, text: str, lower: bool = True) -> list[tuple[int, int, int, str]]:
    """Of each word in the text its number, how often without overlap, and the number and text of the first line with it."""
    read = text.lower() if lower else text
    found: dict[int, list[int]] = {}
    for end, (i, size) in machine.iter(read):
        at = found.setdefault(i, [0, -1, end - size + 1])  # times, end of the last counted, first start
        if end - size + 1 > at[1]:
            at[0], at[1] = at[0] + 1, end
    if not found:
        return []
    lines = text.split("\n")
    starts = np.cumsum([0] + [len(x) + 1 for x in read.split("\n")])
    no = np.searchsorted(starts, [x[2] for x in found.values()], side="right").tolist()
    return [(i, x[0], n, lines[n - 1].rstrip("\r")) for (i, x), n in zip(found.items(), no)]


def occurring(texts: DataFrame, words: list[str], lower: bool = True) -> DataFrame:
    """``path, word, times, line_no, line``: every given word that a text of ``texts(path, text)`` holds, how often without
    overlap, and the first line with it. Each text is read once for all words together, by an automaton."""
    shared = texts.sparkSession.sparkContext.broadcast(sorted(set(words)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not shared.value:
            return
        machine = _automaton(shared.value)
        for batch in batches:
            out = []
            for row, text in enumerate(batch.column("text").to_pylist()):
                if not text:
                    continue
                for i, times, no, line in _found(machine, text, lower):
                    out.append((row, shared.value[i], times, no, line))
            if out:
                row, word, times, no, line = zip(*out)
                yield pa.RecordBatch.from_arrays([batch.column("path").take(pa.array(row)), pa.array(word), pa.array(times, pa.int64()), pa.array(no, pa.int32()), pa.array(line, pa.string())], names=["path", "word", "times", "line_no", "line"])

    return texts.select("path", "text").mapInArrow(run, "path string, word string, times bigint, line_no int, line string")


def _whole(notes: DataFrame) -> DataFrame:
    """``path, texts``: the different bodies of each path in one row. Only notes that come more than once are shuffled."""
    texts = notes.where("path is not null").select("path", F.col("body").alias("text"))
    twice = materialize(texts.groupBy("path").count().where("count > 1").select("path"))
    few = F.broadcast(twice) if twice.count() <= 200_000 else twice
    many = texts.join(few, "path", "left_semi").groupBy("path").agg(F.collect_set("text").alias("texts"))
    return texts.join(few, "path", "left_anti").select("path", F.array("text").alias("texts")).unionByName(many)


def _by_note(notes: DataFrame, queries: DataFrame, words: Column, ask: Callable[[DataFrame, "_Asked"], DataFrame]) -> DataFrame:
    """``ask`` of the notes, once for each block of at most MOST_QUERIES queries. What a query finds in a note is known where the note is read, so neither
    hits nor pairs of queries and notes are shuffled."""
    texts = _whole(notes)
    each = materialize(_asked(queries, words).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("word", "said"))).alias("words")))
    return in_blocks(each, MOST_QUERIES, lambda block: ask(texts, _Asked(block)))


class _Asked:
    """A block of queries as it goes to the executors: queries of the same words are one class."""

    def __init__(self, block: DataFrame):
        classes: dict[tuple, list] = {}
        for r in block.collect():
            classes.setdefault(tuple((w["word"], w["said"]) for w in r["words"]), []).append(r["qid"])
        self.words = sorted({w for c in classes for w, _ in c})
        number = {w: i for i, w in enumerate(self.words)}
        who = sorted((number[w], c, said) for c, words in enumerate(classes) for w, said in words)
        self.classes = np.array([c for _, c, _ in who], np.int64)  # of each word, one after the other
        self.said = np.array([n for _, _, n in who], np.int64)
        self.first = np.searchsorted(np.array([i for i, _, _ in who], np.int64), np.arange(len(self.words) + 1))
        self.qids = np.array([q for x in classes.values() for q in x], np.int64)
        self.ends = np.cumsum([0, *map(len, classes.values())])

    def parts(self, batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list[str], list[list[str]], list[list[tuple]], np.ndarray, np.ndarray, np.ndarray]]:
        """At most ``most`` notes at a time: the paths, the texts and the words found of those that hold any; the note of each word found, and for
        each class that asks for it which word that is and where the class stands in ``classes``."""
        machine = _automaton(self.words)
        for batch in batches:
            for start in range(0, len(batch), most):
                part = batch.slice(start, most)
                paths, texts, found = [], [], []
                for path, some in zip(part.column("path").to_pylist(), part.column("texts").to_pylist()):
                    hits = [h for t in some if t for h in _found(machine, t)]
                    if len(some) > 1:
                        hits = list({h[0]: h for h in sorted(hits)}.values())  # of more than one body, each word as in the one with most of it
                    if hits:
                        paths.append(path)
                        texts.append(some)
                        found.append(hits)
                if found:
                    note = np.repeat(np.arange(len(found)), [len(h) for h in found])
                    word = np.array([h[0] for hits in found for h in hits])
                    n = self.first[word + 1] - self.first[word]
                    hit = np.repeat(np.arange(len(word)), n)
                    at = np.arange(len(hit)) - np.repeat(np.cumsum(n) - n, n) + self.first[word][hit]
                    yield paths, texts, found, note, hit, at


def _top_notes(notes: DataFrame, queries: DataFrame, words: Column, limit: int, by_times: bool) -> DataFrame:
    """``qid, path, held, times, octets, place``: of each query the first ``limit`` notes by how many of its words they hold (repeats count), with ``by_times``
    then by how often, then by path; the octets of the largest body. Each task keeps that many notes of each query."""

    def ask(texts: DataFrame, asked: _Asked) -> DataFrame:
        if not asked.words or limit < 1:
            return texts.sparkSession.createDataFrame([], "qid bigint, path string, held bigint, times bigint, octets bigint, place int")
        shared = texts.sparkSession.sparkContext.broadcast(asked)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q = shared.value
            n = len(q.ends) - 1
            kept = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, object), np.zeros(0, np.int64)]  # class, key, path, octets
            least = np.zeros(n)  # what a class's last kept note has, once it keeps ``limit``
            for paths, some, found, note, hit, at in q.parts(batches, max(1, (1 << 21) // n)):
                times = np.array([h[1] for hits in found for h in hits])[hit] if by_times else 0
                # what is held in the upper digits, how often in the lower ones: below 2**53 all is exact
                key = np.bincount(note[hit] * n + q.classes[at], q.said[at] * (2.0**32 + times), len(paths) * n).reshape(-1, n)
                if not len(kept[0]) and len(key) > limit:
                    least = np.maximum(least, np.partition(key, -limit, axis=0)[-limit])
                row, of = np.nonzero((key > 0) & (key >= least))
                if not len(row):
                    continue
                octets = np.array([max(len(t.encode()) for t in x if t) for x in some])
                new = [of, key[row, of], np.array(paths, object)[row], octets[row]]
                kept = [np.concatenate(x) for x in zip(kept, new)]
                rank = np.unique(kept[2].astype(str), return_inverse=True)[1]
                order = np.lexsort((rank, -kept[1], kept[0]))
                of = kept[0][order]
                order = order[np.arange(len(of)) - np.searchsorted(of, of) < limit]
                kept = [x[order] for x in kept]
                full = np.bincount(kept[0], minlength=n) >= limit
                low = np.full(n, np.inf)
                np.minimum.at(low, kept[0], kept[1])
                least = np.where(full, low, 0.0)
            held = np.floor(kept[1] / 2.0**32)
            for s in range(0, len(held), 10_000):
                e = slice(s, s + 10_000)
                yield pa.RecordBatch.from_arrays([pa.array(kept[0][e]), pa.array(kept[2][e], pa.string()), pa.array(held[e].astype(np.int64)), pa.array((kept[1] - held * 2.0**32)[e].astype(np.int64)), pa.array(kept[3][e])], names=["class", "path", "held", "times", "octets"])

        def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q = shared.value
            for batch in batches:
                for s in range(len(batch)):
                    one = batch.slice(s, 1)
                    c = one.column("class")[0].as_py()
                    qids = q.qids[q.ends[c] : q.ends[c + 1]]
                    yield pa.RecordBatch.from_arrays([pa.array(qids), *(one.column(x).take(pa.array(np.zeros(len(qids), np.int64))) for x in ("path", "held", "times", "octets", "place"))], names=["qid", "path", "held", "times", "octets", "place"])

        found = texts.mapInArrow(run, "class bigint, path string, held bigint, times bigint, octets bigint")
        place = F.row_number().over(Window.partitionBy("class").orderBy(F.desc("held"), F.desc("times"), "path"))
        return found.withColumn("place", place).where(F.col("place") <= limit).mapInArrow(named, "qid bigint, path string, held bigint, times bigint, octets bigint, place int")

    return _by_note(notes, queries, words, ask)


def raw_text(fields: Column, body: Column) -> Column:
    """A note as it stands in its file, but for the order of its fields."""
    return F.concat_ws("\n", F.array_join(F.transform(F.map_entries(fields), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n"), body)


def lexical_bonus(notes: DataFrame, queries: DataFrame, step: float = 0.04) -> DataFrame:
    """``qid, path, bonus``: the step for each of up to two identifiers of the query that the note holds verbatim, header and body."""
    raw = notes.select("path", raw_text(F.col("fields"), F.col("body")).alias("text"))
    hits = _search(raw, _asked(queries, identifiers(F.col("query"))), lower=False).groupBy("qid", "path").agg(F.count("*").alias("n"))
    return hits.where(F.lit(step) > 0).select("qid", "path", (F.least("n", F.lit(2)) * step).alias("bonus"))


def first_lines(notes: DataFrame, queries: DataFrame) -> DataFrame:
    """``qid, path, line_no, line``: the first body line of each note that holds any word of the query."""

    def ask(texts: DataFrame, asked: _Asked) -> DataFrame:
        shared = texts.sparkSession.sparkContext.broadcast(asked)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q = shared.value
            n = len(q.ends) - 1
            for paths, _, found, note, hit, at in q.parts(batches if q.words else iter(()), max(1, (1 << 20) // max(len(q.qids), 1))):
                lines, line_of = [], []  # all first lines, note by note from the top; the line of each word found
                for row, hits in enumerate(found):
                    own = sorted({h[2:] for h in hits})
                    rank = {x: len(lines) + i for i, x in enumerate(own)}
                    line_of += [rank[h[2:]] for h in hits]
                    lines += [(row, *x) for x in own]
                line_of = np.array(line_of)[hit]
                down = np.argsort(-line_of, kind="stable")
                first = np.full(len(paths) * n, -1)
                first[(note[hit] * n + q.classes[at])[down]] = line_of[down]  # of several the last stays, the first line
                asks = np.flatnonzero(first >= 0)
                asks = asks[np.argsort(first[asks], kind="stable")]
                line, c = first[asks], asks % n
                size = q.ends[c + 1] - q.ends[c]
                qids = q.qids[np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size - q.ends[c], size)]
                starts = np.flatnonzero(np.diff(line, prepend=-1))
                offsets = np.append((np.cumsum(size) - size)[starts], len(qids)).astype(np.int32)
                row, no, text = zip(*[lines[i] for i in line[starts].tolist()])
                yield pa.RecordBatch.from_arrays([pa.array([paths[r] for r in row], pa.string()), pa.array(no, pa.int32()), pa.array(text, pa.string()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(qids))], names=["path", "line_no", "line", "qids"])

        found = texts.mapInArrow(run, "path string, line_no int, line string, qids array<bigint>")
        cut = found.select("path", "line_no", first_chars(strip(F.col("line")), 110).alias("line"), "qids")
        return cut.select(F.explode("qids").alias("qid"), "path", "line_no", "line")

    return _by_note(notes, queries, cli_words(F.col("query")), ask)


def words_only(notes: DataFrame, queries: DataFrame, limit: int = 5) -> DataFrame:
    """Notes by how many of the query's words they hold (repeats count), then by how often, then by path."""
    return _top_notes(notes, queries, query_words(F.col("query")), limit, True).select("qid", "path", "held", "times", "place")


def grep_cost(notes: DataFrame, queries: DataFrame, longest: int | None = None, most_notes: int = 5) -> DataFrame:
    """What a reader of whole notes pays: notes ranked by matching words are read until the expected one
    (``queries.expected``), at most ``most_notes``: ``qid, notes_read, tokens, reached``. Tokens are a quarter of the octets, rounded up."""
    words = F.array_distinct(query_words(F.col("query")))
    if longest:
        words = F.slice(F.array_sort(words, lambda a, b: (F.char_length(b) - F.char_length(a))), 1, longest)
    ranked = _top_notes(notes, queries, words, most_notes, False).join(queries.select("qid", "expected"), "qid")
    order = Window.partitionBy("qid").orderBy("place")
    before = F.max((F.col("path") == F.col("expected")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    read = ranked.withColumn("done", F.coalesce(before, F.lit(0))).where("done = 0")
    return read.groupBy("qid").agg(F.count("*").alias("notes_read"), F.sum(F.ceil(F.col("octets") / 4)).alias("tokens"), F.max(F.coalesce(F.col("path") == F.col("expected"), F.lit(False))).alias("reached"))
