"""A whole corpus in a folder, from writing to learning."""

import io
import json
import os
import socket
import subprocess
import threading
import time

import pytest
from pyspark.sql import functions as F

from marginalia.api import Engine, Refused, listen, serve
from marginalia.functions import tokens


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(str(tmp_path), spark, today="2026-05-05")
    e.write("fam/proj", "queue-timeouts", "Why the queue times out", "reference", "The import queue times out when max_wait is too low.\n\n## Fix\n\nRaise max_wait to 30.")
    e.write("fam/proj", "disk-alerts", "When disks fill up", "project", "Disk alerts come from the nightly export. See [[queue-timeouts]].")
    return e


def test_from_writing_to_learning(engine):
    assert [r["path"] for r in engine.search("disk alerts")] == ["fam/proj/disk-alerts.md"]  # lexical, before the first index
    stats = engine.index()
    assert stats["notes"] == 2 and stats["encoded"] == stats["chunks"] == 3 and engine.index()["encoded"] == 0
    assert engine.status()["vectors"] == 3 and os.path.exists(os.path.join(engine.root, "fam/proj/MEMORY.md"))
    found = engine.search("the import queue times out when max_wait is low", now=1000)
    assert found[0]["path"] == "fam/proj/queue-timeouts.md" and found[0]["excerpt"]
    assert engine.answer("disk alerts nightly export")[0]["path"] == "fam/proj/disk-alerts.md" and "disk-alerts" in engine.context("disk alerts")
    assert engine.hook("short") == [] and isinstance(engine.hook("what do the disk alerts of the nightly export say and why"), list)
    with pytest.raises(Refused, match="exists"):
        engine.write("fam/proj", "disk-alerts", "x", "project", "y")
    with pytest.raises(Refused, match="gitlab"):
        engine.write("fam/proj", "leak", "x", "project", "glpat-" + "a" * 20)
    with pytest.raises(Refused, match="much like"):
        engine.write("fam/proj", "disk-alerts-two", "When disks fill up", "project", "Disk alerts come from the nightly export. See [[queue-timeouts]].")
    with pytest.raises(Refused):
        engine.write("fam", "a", "x", "memo", "y")
    engine.append("disk-alerts", "Another line.")
    assert "Another line." in engine.read("disk alerts", now=1100)
    engine.link("disk-alerts", "queue-timeouts")
    assert "See also [[disk-alerts]]" in engine.read("queue-timeouts")
    new = engine.supersede("queue-timeouts", "queue-limits", "Limits of the queue", "Set them in one place.")
    assert new == "fam/proj/queue-limits.md" and "[[queue-limits]]" in engine.read("disk-alerts") and "status: archived" in engine.read("queue-timeouts")
    assert engine.check() == []
    assert set(engine.curation()) == {"stale", "long", "undated", "left_out"}
    with open(os.path.join(engine.state, "searches.tsv"), "w") as f:
        f.write("1000\thow\tx.md\n")
    with open(os.path.join(engine.state, "reads.tsv"), "w") as f:
        f.write("1100\tfam/proj/disk-alerts.md\n1101\tx.md\n9000\tfam/proj/disk-alerts.md\n")
    assert engine.learn() == 1 == engine.learn() and engine.teach("limits", "queue-limits", now=2000) == 2
    assert {r["query"] for r in engine.learned()} == {"how", "limits"} and engine.secrets() == [] and engine.list() == [("fam", "fam/proj", 3)]
    engine.index()
    assert engine.search("limits")[0]["path"] == "fam/proj/queue-limits.md"


def test_forgetting_usage_and_ambiguity(engine):
    os.makedirs(os.path.join(engine.root, "fam/empty"))
    assert engine.list() == [("fam", "fam/empty", 0), ("fam", "fam/proj", 2)]
    engine.write("fam/other", "disk-alerts", "The same name elsewhere", "project", "Other text.")
    with pytest.raises(LookupError, match="ambiguous"):
        engine.read("disk-alerts")
    assert "Other text." in engine.read("disk-alerts", project="fam/other")
    assert engine.teach("full disks", "queue-timeouts", now=86400) == 1 and engine.forget(" full disks ") == 0 == len(engine.learned()) and engine.learn() == 0
    assert engine.usage()["calls"] == 0
    for i, ms in enumerate((5, 30, 10, 20)):
        engine._log("usage.tsv", 1000 + i, "search", f"{ms}ms", "ok")
    assert engine.usage(now=1002 + 86400) == {"calls": 4, "last_day": 1, "median_ms": 20}
    assert set(engine.regen("fam/proj")) == {"fam/proj"} and set(engine.regen()) == {"fam/proj", "fam/other"}


def test_history_and_serving(engine, tmp_path):
    git = lambda *a: subprocess.run(["git", "-c", "user.name=n", "-c", "user.email=e@x", "-C", engine.root, *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", "-A")
    git("commit", "-qm", "first")
    assert {r[1] for r in engine.since(3)} == {"fam/proj/disk-alerts.md", "fam/proj/queue-timeouts.md"}
    why = engine.why("queue-timeouts")
    assert why["cited_by"] == ["fam/proj/disk-alerts.md"] and why["commits"][0][2] == "first"
    out = io.StringIO()
    serve(engine, ['{"id": 1, "method": "tools"}', '{"id": 2, "method": "status"}', '{"id": 3, "method": "none"}', "not json", '{"id": 4, "method": "read", "params": {"name": "none"}}', ""], out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert "search" in got[0]["result"] and got[1]["result"]["notes"] == 2 and got[2]["error"]["code"] == -32601 and "error" in got[3] and "not found" in got[4]["error"]["message"]
    asks = [("initialize", {"protocolVersion": "2025-01-01"}), ("notifications/initialized", {}), ("tools/list", {}), ("tools/call", {"name": "status"}), ("tools/call", {"name": "read", "arguments": {"name": "none"}}), ("tools/call", {"name": "no"})]
    at = str(tmp_path / "socket")
    there = threading.Thread(target=listen, args=(engine, at, 1))
    there.start()
    while not os.path.exists(at):
        time.sleep(0.05)
    with socket.socket(socket.AF_UNIX) as s:
        s.connect(at)
        s.sendall("".join(json.dumps({"jsonrpc": "2.0", "id": i, "method": m, "params": p}) + "\n" for i, (m, p) in enumerate(asks)).encode())
        s.shutdown(socket.SHUT_WR)
        got = {x["id"]: x for x in map(json.loads, s.makefile())}
    there.join()
    assert sorted(got) == [0, 2, 3, 4, 5] and got[0]["result"]["protocolVersion"] == "2025-01-01" and "no tool" in got[5]["error"]["message"]
    listed = {t["name"]: t for t in got[2]["result"]["tools"]}
    assert listed["search"]["inputSchema"]["required"] == ["query"] and listed["answer"]["inputSchema"]["properties"]["n"] == {"type": "integer"}
    assert json.loads(got[3]["result"]["content"][0]["text"])["notes"] == 2 and not got[3]["result"]["isError"] and got[4]["result"]["isError"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_tokens(spark, name):
    path = f"/opt/tokenizers/{name}"
    if not os.path.exists(path):
        pytest.skip("no vocabulary")
    texts = ["", " ", "éàü 😀 日本 <|endoftext|> ﬁ", "x" * 3000, None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(tokens.token_count(F.col("t"), path)).collect()]
    assert got == [None if t is None else tokens.count(t, path) for t in texts]
    cut = df.where("i = 3").select(tokens.truncate(F.col("t"), 12, path).alias("c"), tokens.would_truncate(F.col("t"), 12, path).alias("w")).first()
    assert len(cut["c"]["ids"]) == 10 and cut["c"]["truncated"] and cut["w"]


def test_byte_level_tokenizers_agree():
    a, b = "/opt/tokenizers/byte_bpe_50k.tiktoken", "/opt/tokenizers/byte_bpe_50k.json"
    if not os.path.exists(a):
        pytest.skip("no vocabulary")
    for text in ("The queue's 12 limits — déjà vu", "  two  spaces\n\n\tand tabs ", "日本語とemoji 😀"):
        assert list(tokens.encoder(a)(text)) == list(tokens.encoder(b)(text))
