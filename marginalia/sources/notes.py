"""Notes in files: scanning, the header grammar, writing back."""

from __future__ import annotations

import os
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KEY = re.compile(r"[\w-]+")


def parse_text(raw: str | None) -> tuple[dict[str, str], str]:
    """The fields and the body. Without a line ``---`` first, or without its end, all is body. Indented fields count as
    fields of the root unless the root has them; of two in the root the last counts, of two indented the first."""
    if raw is None:
        return {}, ""
    end = raw.find("\n---", 4) if raw.startswith("---\n") else -1
    if end < 0:
        return {}, raw
    root: dict[str, str] = {}
    nested: dict[str, str] = {}
    for line in raw[4:end].split("\n"):
        key, colon, value = line.partition(":")
        key, value = key.strip(), value.strip().strip("\"'")
        if not colon or not value or line.strip().startswith("#") or not _KEY.fullmatch(key):
            continue
        if line[:1].isspace():
            nested.setdefault(key, value)
        else:
            root[key] = value
    body = raw[end:]
    while body.startswith("\n---"):
        body = body[4:]
    return nested | root, body.lstrip("\n")


@F.pandas_udf(T.StructType([T.StructField("fields", T.MapType(T.StringType(), T.StringType())), T.StructField("body", T.StringType())]))
def parse_note(contents: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_text(x) for x in contents], columns=["fields", "body"])


def scan_notes(spark: SparkSession, root: str) -> DataFrame:
    """``path, content, modified_at`` of every note below a folder: ``*.md`` but generated indexes, outside of hidden folders.
    Files are listed by Spark; paths are relative to the root and order is left to the reader (``split(path, '/')`` gives the order of folders)."""
    base = os.path.abspath(root) if "://" not in root else root.rstrip("/")
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root)
    rel = F.regexp_replace(F.col("path"), "^(file:)?/*" + re.escape(base.lstrip("/")) + "/", "")
    rows = read.select(rel.alias("path"), F.try_validate_utf8("content").alias("content"), F.col("modificationTime").alias("modified_at"))
    return rows.where(~F.substring_index("path", "/", -1).startswith("MEMORY") & ~F.col("path").rlike(r"(^|/)\.[^/]*/") & F.col("content").isNotNull())


def parse_notes(raw: DataFrame) -> DataFrame:
    """``raw(path, content, …)`` with ``fields`` and ``body``."""
    return raw.withColumn("n", parse_note("content")).select(*raw.columns, "n.fields", "n.body")


def projects(root: str) -> list[str]:
    """``family/project`` of every folder two deep, also empty ones; hidden families aside."""
    out = []
    for fam in sorted(os.listdir(root)):
        at = os.path.join(root, fam)
        if not fam.startswith(".") and os.path.isdir(at):
            out += [f"{fam}/{p}" for p in sorted(os.listdir(at)) if os.path.isdir(os.path.join(at, p))]
    return out


def write_if_changed(path: str, text: str) -> int:
    """Writes the file only if its text differs, by way of another name; returns its octets."""
    data = text.encode()
    try:
        with open(path, "rb") as f:
            if f.read() == data:
                return len(data)
    except FileNotFoundError:
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path + ".tmp", "wb") as f:
        f.write(data)
    os.replace(path + ".tmp", path)
    return len(data)


def write_indexes(rendered: DataFrame, root: str) -> dict[str, int]:
    """Writes each project's index (``project, text``) as MEMORY.md; one row at a time passes the driver."""
    return {r["project"]: write_if_changed(os.path.join(root, r["project"], "MEMORY.md"), r["text"]) for r in rendered.toLocalIterator()}
