"""Logs and small state files: tab-separated logs, JSON caches, settings, git history."""

from __future__ import annotations

import json
import os
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _tsv(spark: SparkSession, path: str, columns: int) -> DataFrame:
    cut = spark.read.text(path).select(F.split("value", "\t", -1).alias("c"))
    return cut.where((F.size("c") == columns) & F.col("c")[0].rlike(r"^\d{1,18}$"))  # malformed lines are dropped


def search_log(spark: SparkSession, path: str) -> DataFrame:
    """``secs, query, shown``."""
    shown = F.filter(F.split(F.col("c")[2], ","), lambda x: x != "")
    return _tsv(spark, path, 3).select(F.col("c")[0].cast("bigint").alias("secs"), F.col("c")[1].alias("query"), shown.alias("shown"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """``secs, path``."""
    return _tsv(spark, path, 2).select(F.col("c")[0].cast("bigint").alias("secs"), F.col("c")[1].alias("path"))


def usage_log(spark: SparkSession, path: str) -> DataFrame:
    """``secs, command, ms, outcome``."""
    ms = F.regexp_extract(F.col("c")[2], r"^(\d+)ms$", 1)
    return _tsv(spark, path, 4).where(ms != "").select(F.col("c")[0].cast("bigint").alias("secs"), F.col("c")[1].alias("command"), ms.cast("int").alias("ms"), F.col("c")[3].alias("outcome"))


def append(rows: DataFrame, path: str) -> None:
    """Appends rows to a tab-separated log; tabs and line ends in a value become spaces, lists are joined by commas."""
    flat = lambda c, t: F.array_join(c, ",") if t.startswith("array") else F.regexp_replace(F.col(c).cast("string"), r"[\t\r\n]", " ")
    rows.select(F.concat_ws("\t", *[F.coalesce(flat(c, t), F.lit("")) for c, t in rows.dtypes]).alias("value")).write.mode("append").text(path)


def questions(spark: SparkSession, path: str) -> DataFrame:
    """``chunk_hash, questions`` from a JSON object of lists; an unreadable file is an empty cache."""
    try:
        text = spark.read.text(path, wholetext=True)
        return text.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("chunk_hash", "questions"))
    except Exception:
        return spark.createDataFrame([], "chunk_hash string, questions array<string>")


def save_json(path: str, value: object) -> None:
    """Sorted, indented JSON, swapped in by a rename."""
    with open(path + ".tmp", "w") as f:
        json.dump(value, f, sort_keys=True, indent=2, ensure_ascii=False)
    os.replace(path + ".tmp", path)


FEEDBACK = "query string, path string, source string, count int, last_day bigint"


def feedback_table(spark: SparkSession, path: str) -> DataFrame:
    """The learned pairs from a JSON list; none if the file is unreadable."""
    if not os.path.exists(path):
        return spark.createDataFrame([], FEEDBACK)
    return spark.read.schema(FEEDBACK).option("multiLine", True).json(path).where("query is not null and path is not null")


def settings(path: str) -> dict[str, str]:
    """``KEY=VALUE`` lines; the environment wins."""
    out = {}
    if os.path.exists(path):
        for line in open(path):
            key, eq, value = line.strip().partition("=")
            if eq and key and not key.startswith("#"):
                out[key.strip()] = value.strip().strip("\"'")
    return {k: os.environ.get(k, v) for k, v in out.items()}


def git_history(spark: SparkSession, root: str, days: int | None = None) -> DataFrame:
    """``secs, commit, subject, status, path`` of every change of a file in the repository's history."""
    since = [f"--since={days}.days"] if days else []
    log = subprocess.run(["git", "-C", root, "log", "--name-status", "--format=%x01%ct%x09%h%x09%s", *since], capture_output=True, text=True, timeout=600, errors="replace").stdout
    rows = []
    for commit in log.split("\x01")[1:]:
        head, *files = commit.strip().split("\n")
        secs, short, subject = head.split("\t", 2)
        rows += [(int(secs), short, subject, f.split("\t")[0], f.split("\t")[-1]) for f in files if "\t" in f]
    return spark.createDataFrame(rows, "secs bigint, commit string, subject string, status string, path string")
