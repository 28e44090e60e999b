"""One object for a folder of notes: index, search, answer, write, check, curate, learn.

State lives below ``<root>/.marginalia``: the vectors' snapshots, the logs, the learned pairs, the questions' cache.
"""

from __future__ import annotations

import inspect
import json
import os
import socket
import sys
import time
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.encoder import Encoder, HashingEncoder, encode_column
from .functions.vectors import usable
from .operators import checks, chunking, curation, feedback, hot, index, lexical, lifecycle, links, questions, ranking, secrets
from .session import materialize, session, ship
from .sources import logs, notes


class Refused(ValueError):
    """A change that would break the corpus."""


class Engine:
    def __init__(self, root: str, spark: SparkSession | None = None, factory: Callable[[], Encoder] = HashingEncoder, today: str | None = None):
        self.root, self.spark, self.factory = os.path.abspath(root), spark or session(master="local[*]"), factory
        self.today = today or datetime.now(UTC).strftime("%Y-%m-%d")
        self.state = os.path.join(self.root, ".marginalia")
        os.makedirs(self.state, exist_ok=True)
        ship(self.spark)
        e = factory()
        self.header = {"model": e.name, "weights_hash": "", "dim": e.dim, "pooling": "mean", "prompts": ""}

    def _at(self, name: str) -> str:
        return os.path.join(self.state, name)

    # the corpus

    def raw(self) -> DataFrame:
        return notes.scan_notes(self.spark, self.root)

    def notes(self) -> DataFrame:
        return notes.parse_notes(self.raw()).select("path", "fields", "body", F.col("modified_at").cast("timestamp_ntz").alias("modified_at"))

    def chunks(self) -> DataFrame:
        return chunking.split_bodies(self.notes(), chunking.budget_for(self.factory().window))

    def questions(self) -> DataFrame:
        return logs.questions(self.spark, self._at("questions.json"))

    def vectors(self) -> DataFrame:
        have = index.load(self.spark, self._at("index"), self.header)
        if have is None:
            have = self.spark.createDataFrame([], "path string, ordinal int, question_no int, fingerprint string, embedding array<float>, truncated boolean")
        return have

    def index(self, questions_command: str | None = None, most: int | None = None) -> dict[str, int]:
        """Brings vectors, questions and the projects' indexes up to date; returns the statistics of the pass."""
        all_notes = materialize(self.notes())
        chunks = materialize(chunking.split_bodies(all_notes, chunking.budget_for(self.factory().window)))
        cache = index.prune_questions(self.questions(), chunks)
        if questions_command:
            todo = index.pending_questions(chunks, cache, most)
            made = questions.generate(todo.select("chunk_hash", "text"), questions_command).where("error is null")
            cache = cache.unionByName(made.select("chunk_hash", questions.clean(F.col("raw")).alias("questions")).where(F.size("questions") > 0))
        cache = materialize(cache)
        logs.save_json(self._at("questions.json"), {r["chunk_hash"]: r["questions"] for r in cache.toLocalIterator()})
        out, stats = index.refresh(all_notes, chunks, self.vectors(), cache, self.factory)
        done = stats.first().asDict()
        index.save(out, self._at("index"), self.header)
        notes.write_indexes(hot.render(all_notes), self.root)
        return done

    # asking

    def _query(self, text: str) -> DataFrame:
        one = self.spark.createDataFrame([(1, text)], "qid bigint, query string")
        return materialize(one.withColumn("embedding", encode_column(F.col("query"), self.factory)["embedding"]))

    def _bonus(self, q: DataFrame, vectors: DataFrame, all_notes: DataFrame) -> DataFrame:
        by_name = lexical.lexical_bonus(all_notes, q)
        table = logs.feedback_table(self.spark, self._at("feedback.json"))
        if table.isEmpty():
            return by_name
        known = materialize(table.select("query").distinct().withColumn("embedding", encode_column(F.col("query"), self.factory)["embedding"]))
        learned = feedback.learned_bonus(table, known, q, self._day())
        base = ranking.rank_notes(vectors, q, 50, dim=self.header["dim"])
        return feedback.sum_bonuses(by_name, feedback.within_window(learned, base))

    def _day(self) -> int:
        return (datetime.strptime(self.today, "%Y-%m-%d") - datetime(1970, 1, 1)).days

    def _log(self, name: str, *fields: object) -> None:
        with open(self._at(name), "a") as f:
            f.write("\t".join(str(x).replace("\t", " ").replace("\n", " ") for x in fields) + "\n")

    def search(self, query: str, archives: bool = False, now: int | None = None) -> list[dict]:
        """The five best notes, with an excerpt; without vectors, the first matching lines."""
        vectors, all_notes = self.vectors(), materialize(self.notes())
        if vectors.isEmpty():
            q = self.spark.createDataFrame([(1, query)], "qid bigint, query string")
            return [r.asDict() for r in lexical.first_lines(all_notes, q).orderBy("path").collect()]
        q = self._query(query)
        found = ranking.search(vectors, q, all_notes, archives=archives, bonus=self._bonus(q, vectors, all_notes))
        text = self.chunks().select("path", "ordinal", ranking.excerpt(F.col("text")).alias("excerpt"))
        out = [r.asDict() for r in found.join(text, ["path", "ordinal"], "left").orderBy("place").collect()]
        self._log("searches.tsv", now or int(time.time()), query, ",".join(r["path"] for r in out))
        return out

    def answer(self, query: str, n: int = 5, max_chars: int = 4000, now: int | None = None) -> list[dict]:
        """Passages within a budget. The search is logged with the five best notes before archived ones are passed over."""
        vectors, q, all_notes = self.vectors(), self._query(query), materialize(self.notes())
        bonus = materialize(self._bonus(q, vectors, all_notes))
        best = ranking.rank_notes(vectors, q, 5, bonus, dim=self.header["dim"]).orderBy("place").collect()
        self._log("searches.tsv", now or int(time.time()), query, ",".join(r["path"] for r in best))
        return [r.asDict() for r in ranking.answer(vectors, q, all_notes, self.chunks(), n, max_chars, bonus=bonus).orderBy("place").collect()]

    def context(self, topic: str) -> str:
        return "\n".join(f"## {p['name'] or p['path']} ({p['path']}, {p['score']:.3f})\n\n{p['text']}\n" for p in self.answer(topic))

    def hook(self, prompt: str) -> list[dict]:
        """What a prompt calls to mind: at most two passages, none for short prompts and commands."""
        asked = self.spark.range(1).select(ranking.shape_prompt(F.lit(prompt)).alias("q")).first()["q"]
        if not asked:
            return []
        return [p for p in self.answer(asked, n=2, max_chars=700) if p["score"] >= 0.60]

    def read(self, name: str, project: str | None = None, now: int | None = None) -> str:
        path = lifecycle.find_note(self.raw(), name, project)
        self._log("reads.tsv", now or int(time.time()), path)
        with open(os.path.join(self.root, path)) as f:
            return f.read()

    # changing

    def _put(self, path: str, text: str) -> None:
        notes.write_if_changed(os.path.join(self.root, path), text)

    def _content(self, path: str) -> str:
        with open(os.path.join(self.root, path)) as f:
            return f.read()

    def write(self, project: str, name: str, description: str, type_: str, body: str, force: bool = False, check_duplicates: bool = True) -> str:
        """A new note; refused if its name, type or project is wrong, it exists, holds a secret, or nearly repeats another."""
        path = f"{project}/{name}.md"
        if type_ not in checks.TYPES or not lifecycle.key_of(name) or name != name.lower() or project.count("/") != 1:
            raise Refused(f"bad type, name or project: {type_}, {name}, {project}")
        if os.path.exists(os.path.join(self.root, path)):
            raise Refused(f"{path} exists")
        text = lifecycle.new_note(name, description, type_, body, self.today)
        found = secrets.scan(self.spark.createDataFrame([(path, text)], "path string, text string")).collect()
        if found:
            raise Refused(f"{found[0]['kind']} in line {found[0]['line']}")
        vectors = self.vectors()
        if check_duplicates and not force and not vectors.isEmpty():
            context = self.spark.range(1).select(chunking.with_context(F.lit(name), F.lit(description), F.lit(body)).alias("t")).first()["t"]
            near = ranking.nearest_active_note(vectors, self._query(context), self.notes()).collect()
            if near:
                raise Refused(f"much like {near[0]['path']} ({near[0]['score']:.3f})")
        self._put(path, text)
        return path

    def append(self, name: str, paragraph: str) -> str:
        path = lifecycle.find_note(self.raw(), name)
        text = self._content(path).rstrip("\n") + "\n\n" + paragraph.strip() + "\n"
        self._put(path, lifecycle.set_field(text, "verified", self.today))
        return path

    def verify(self, name: str) -> str:
        path = lifecycle.find_note(self.raw(), name)
        self._put(path, lifecycle.set_field(self._content(path), "verified", self.today))
        return path

    def supersede(self, old: str, name: str, description: str, body: str) -> str:
        """A new note in the old one's place; the old one is archived and all links lead to the new."""
        raw = materialize(self.raw().select("path", "content"))
        path = lifecycle.find_note(raw, old)
        fields, _ = notes.parse_text(self._content(path))
        new = f"{os.path.dirname(path)}/{name}.md"
        if os.path.exists(os.path.join(self.root, new)):
            raise Refused(f"{new} exists")
        text = lifecycle.new_note(name, description, fields.get("type", "project"), body, self.today)
        changed = lifecycle.supersede(raw, path, new, text, self.today)
        before = raw.select("path", F.col("content").alias("before"))
        for r in changed.join(before, "path", "left").where(~F.col("content").eqNullSafe(F.col("before"))).toLocalIterator():
            self._put(r["path"], r["content"])
        return new

    def link(self, a: str, b: str) -> None:
        raw = self.raw()
        pa, pb = lifecycle.find_note(raw, a), lifecycle.find_note(raw, b)
        for at, other in ((pa, pb), (pb, pa)):
            self._put(at, lifecycle.see_also(self._content(at), other.rsplit("/", 1)[-1].removesuffix(".md")))

    # looking after it

    def check(self) -> list[tuple[str, str]]:
        raw = materialize(self.raw())
        found = checks.all_findings(materialize(self.notes())).unionByName(checks.nested_metadata(raw))
        kept = secrets.scan(raw.select("path", F.col("content").alias("text"))).select("path", F.concat("kind", F.lit(" in line "), F.col("line").cast("string")).alias("message"))
        return [tuple(r) for r in found.unionByName(kept).orderBy(F.split("path", "/"), "message").collect()]

    def curation(self) -> dict[str, list[tuple]]:
        n = materialize(self.notes())
        rows = lambda df: [tuple(r) for r in df.collect()]
        return {
            "stale": rows(curation.stale(n, self.today).orderBy(F.desc("age"), "path")), "long": rows(curation.long_notes(n).orderBy(F.desc("tokens"), "path")), "undated": rows(curation.undated(n).orderBy("path")),
            "left_out": rows(hot.compaction(hot.lines(n)).where("left_out > 0").select("project", "left_out").orderBy("project")),
        }

    def learn(self) -> int:
        """Folds the searches and reads so far into the learned pairs; returns how many pairs there are."""
        s, r, said = (self._at(f"{x}.tsv") for x in ("searches", "reads", "explicit"))
        missed = self.spark.createDataFrame([], "query string, path string, day bigint, source string")
        if os.path.exists(s) and os.path.exists(r):
            searches = logs.search_log(self.spark, s).withColumn("search_id", F.monotonically_increasing_id())
            reads = logs.read_log(self.spark, r).withColumn("read_id", F.monotonically_increasing_id())
            missed = missed.unionByName(feedback.missed_pairs(searches, reads).select("query", "path", "day", F.lit("missed").alias("source")))
        if os.path.exists(said):
            told = self.spark.read.text(said).select(F.split("value", "\t").alias("c")).where(F.size("c") == 3)
            missed = missed.unionByName(told.select(F.col("c")[1].alias("query"), F.col("c")[2].alias("path"), F.floor(F.col("c")[0].cast("bigint") / 86400).cast("bigint").alias("day"), F.lit("explicit").alias("source")))
        rows = [x.asDict() for x in feedback.fold(missed).orderBy("query", "path").collect()]  # a personal log
        logs.save_json(self._at("feedback.json"), rows)
        return len(rows)

    def teach(self, query: str, name: str, now: int | None = None) -> int:
        self._log("explicit.tsv", now or int(time.time()), query.strip(), lifecycle.find_note(self.raw(), name))
        return self.learn()

    def forget(self, query: str) -> int:
        """Drops the pairs of a query, and what was said about it; returns how many pairs are left."""
        said = self._at("explicit.tsv")
        if os.path.exists(said):
            with open(said) as f:
                kept = [x for x in f if x.split("\t")[1:2] != [query.strip()]]
            notes.write_if_changed(said, "".join(kept))
        left = feedback.forget(logs.feedback_table(self.spark, self._at("feedback.json")), query)
        rows = [r.asDict() for r in left.orderBy("query", "path").collect()]
        logs.save_json(self._at("feedback.json"), rows)
        return len(rows)

    def learned(self) -> list[dict]:
        """The learned pairs, newest first, with what age leaves of them."""
        report = feedback.pairs_report(logs.feedback_table(self.spark, self._at("feedback.json")), self._day())
        return [r.asDict() for r in report.orderBy(F.desc("last_day"), "query", "path").collect()]

    def regen(self, project: str | None = None) -> dict[str, int]:
        """Writes the projects' indexes, or one project's, and returns their octets."""
        rendered = hot.render(materialize(self.notes()))
        return notes.write_indexes(rendered.where(F.col("project") == project) if project else rendered, self.root)

    def secrets(self) -> list[tuple]:
        return [tuple(r) for r in secrets.scan(self.raw().select("path", F.col("content").alias("text"))).orderBy("path", "line", "kind").collect()]

    def list(self) -> list[tuple]:
        """Every project with its number of notes, also empty ones."""
        have = self.spark.createDataFrame([(p,) for p in notes.projects(self.root)] or [], "project string")
        return [tuple(r) for r in curation.per_project(self.notes(), have).orderBy("family", "project").collect()]

    def usage(self, now: int | None = None) -> dict[str, int]:
        """Calls so far and in the last day, and the upper median of their milliseconds."""
        at = self._at("usage.tsv")
        if not os.path.exists(at):
            return {"calls": 0, "last_day": 0, "median_ms": 0}
        log = logs.usage_log(self.spark, at)
        n = log.count()
        middle = log.orderBy("ms").offset(n // 2).limit(1).first()
        return {"calls": n, "last_day": log.where(F.col("secs") > (now or int(time.time())) - 86400).count(), "median_ms": middle["ms"] if middle else 0}

    def since(self, days: int) -> list[tuple]:
        return [tuple(r) for r in curation.changes_since(logs.git_history(self.spark, self.root, days), 0).orderBy("directory", "path").collect()]

    def why(self, name: str) -> dict[str, object]:
        path = lifecycle.find_note(self.raw(), name)
        fields, _ = notes.parse_text(self._content(path))
        commits = logs.git_history(self.spark, self.root).where(F.col("path") == path).select("secs", "commit", "subject").orderBy(F.desc("secs")).limit(12)
        citing = links.citing(self.notes()).where(F.col("path") == path).select("cited_by").orderBy("cited_by")
        return {"path": path, "fields": fields, "commits": [tuple(r) for r in commits.collect()], "cited_by": [r[0] for r in citing.collect()]}

    def status(self) -> dict[str, int]:
        v = self.vectors()
        return {"notes": self.raw().count(), "vectors": v.count(), "usable": v.where(usable(dim=self.header["dim"])).count()}


TOOLS = ("search", "answer", "context", "read", "append", "verify", "check", "curation", "learn", "since", "why", "status", "index", "hook", "link", "write", "supersede", "teach", "forget", "learned", "regen", "secrets", "list", "usage")


def _tool(name: str) -> dict[str, object]:
    """A tool as the Model Context Protocol lists it, from the method itself."""
    method = getattr(Engine, name)
    kinds = {"str": "string", "int": "integer", "bool": "boolean", "float": "number"}
    params = [p for p in inspect.signature(method).parameters.values() if p.name != "self"]
    props = {p.name: {"type": kinds.get(str(p.annotation).split(" | ")[0], "string")} for p in params}
    return {"name": name, "description": inspect.getdoc(method) or name, "inputSchema": {"type": "object", "properties": props, "required": [p.name for p in params if p.default is p.empty]}}


def _call(engine: Engine, name: str, params: dict[str, object] | list[object]) -> object:
    method = getattr(engine, name)
    return method(**params) if isinstance(params, dict) else method(*params)


def _protocol(engine: Engine, method: str, params: dict) -> object:
    """The methods of the Model Context Protocol; a refused call is a result that says so."""
    if method == "initialize":
        return {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "marginalia", "version": "0.2"}}
    if method == "ping":
        return {}
    if method == "tools/list":
        return {"tools": [_tool(x) for x in TOOLS]}
    if params.get("name") not in TOOLS:
        raise LookupError(f"no tool {params.get('name')}")
    try:
        got, failed = _call(engine, params["name"], params.get("arguments") or {}), False
    except (Refused, LookupError, TypeError) as e:
        got, failed = str(e), True
    return {"content": [{"type": "text", "text": got if isinstance(got, str) else json.dumps(got, default=str, ensure_ascii=False)}], "isError": failed}


def serve(engine: Engine, lines=sys.stdin, out=sys.stdout) -> None:
    """A line of JSON in, a line of JSON out: ``{"id", "method", "params"}``. Methods are those in TOOLS, ``tools``, and
    ``initialize``, ``ping``, ``tools/list`` and ``tools/call``; notifications get no answer."""
    for line in lines:
        if not line.strip():
            continue
        reply: dict[str, object] = {"jsonrpc": "2.0", "id": None}
        try:
            ask = json.loads(line)
            reply["id"], method, params = ask.get("id"), ask["method"], ask.get("params") or {}
            if method.startswith("notifications/"):
                continue
            if method == "tools":
                reply["result"] = [*TOOLS]
            elif method in ("initialize", "ping", "tools/list", "tools/call"):
                reply["result"] = _protocol(engine, method, params)
            elif method in TOOLS:
                reply["result"] = _call(engine, method, params)
            else:
                reply["error"] = {"code": -32601, "message": f"no method {method}"}
        except Exception as e:
            reply["error"] = {"code": -32000, "message": str(e)[:500]}
        print(json.dumps(reply, default=str, ensure_ascii=False), file=out, flush=True)


def listen(engine: Engine, at: str, most: int | None = None) -> None:
    """The same over a socket of this machine, one connection after another, so that calls find the session warm; ``most`` ends it after so many."""
    if os.path.exists(at):
        os.remove(at)
    with socket.socket(socket.AF_UNIX) as server:
        server.bind(at)
        os.chmod(at, 0o600)
        server.listen()
        while most is None or most > 0:
            link = server.accept()[0]
            with link, link.makefile("r", encoding="utf-8") as lines, link.makefile("w", encoding="utf-8") as out:
                serve(engine, lines, out)
            most = most - 1 if most is not None else None
    os.remove(at)


def main(args: list[str]) -> int:
    """``python -m marginalia ROOT COMMAND [ARGUMENT...]``"""
    if len(args) < 2 or (args[1] not in TOOLS and args[1] not in ("serve", "listen")):
        print(main.__doc__, "\ncommands: serve, listen SOCKET,", *TOOLS, file=sys.stderr)
        return 2
    engine = Engine(args[0])
    if args[1] == "serve":
        serve(engine)
        return 0
    if args[1] == "listen":
        listen(engine, args[2])
        return 0
    began = time.time()
    try:
        got = getattr(engine, args[1])(*[int(a) if a.isdigit() else a for a in args[2:]])
    except (Refused, LookupError) as e:
        engine._log("usage.tsv", int(began), args[1], f"{int(1000 * (time.time() - began))}ms", "error")
        print(e, file=sys.stderr)
        return 1
    engine._log("usage.tsv", int(began), args[1], f"{int(1000 * (time.time() - began))}ms", "ok")
    print(got if isinstance(got, str) else json.dumps(got, default=str, ensure_ascii=False, indent=1))
    return int(args[1] == "check" and bool(got))
