"""Questions that a passage answers, made by an outside command and cleaned."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

MOST = 3


def clean(raw: Column) -> Column:
    """Up to three questions from a command's output: no colour codes, no bullets or numbers, no quotes, no banners,
    of 8 to 220 characters, each once."""
    plain = F.regexp_replace(raw, r"\x1b(\[[^A-Za-z]*[A-Za-z])?", "")
    bare = lambda x: strip(F.regexp_replace(strip(F.regexp_replace(x, r"(?U)^[\d.)\-*•\s]+", "")), r"""^["'«“]+\s*|\s*["'»”]+$""", ""))
    kept = F.filter(F.transform(F.split(plain, "\r?\n"), strip), lambda x: (x != "") & ~x.rlike(r"^(>|#|---)"))
    good = F.filter(F.transform(kept, bare), lambda x: F.char_length(x).between(8, 220))
    return F.slice(F.array_distinct(good), 1, MOST)


def prompt(text: Column) -> Column:
    return F.concat(F.lit("Write three short questions that this passage answers, one on each line, in its language:\n\n"), text)


def generate(pending: DataFrame, command: str, timeout: int = 120) -> DataFrame:
    """``pending(chunk_hash, text)`` with ``raw`` (the command's output for the prompt) and ``error`` of each row. One bad row
    doesn't stop the others."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["prompt"]:
                try:
                    done = subprocess.run(command, shell=True, input=text or "", capture_output=True, text=True, timeout=timeout, errors="replace")
                    out.append((done.stdout, None if done.returncode == 0 else f"exit {done.returncode}: {done.stderr[:200]}"))
                except Exception as e:
                    out.append((None, str(e)[:200]))
            yield batch[["chunk_hash"]].assign(raw=[r for r, _ in out], error=[e for _, e in out])

    asked = pending.select(F.col("chunk_hash").cast("string").alias("chunk_hash"), prompt(F.col("text")).alias("prompt"))
    return asked.mapInPandas(run, "chunk_hash string, raw string, error string")
