"""Secrets left in texts, by the public formats of common tokens: path, line, kind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Public formats of keys and tokens.
PATTERNS = {
    "gitlab token": r"glpat-[0-9A-Za-z_-]{20}",
    "github token": r"gh[pousr]_[0-9A-Za-z]{36}",
    "aws access key": r"AKIA[0-9A-Z]{16}",
    "slack token": r"xox[abpr]-[0-9A-Za-z-]{10,}",
    "private key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "json web token": r"eyJ[0-9A-Za-z_-]{10,}\.eyJ[0-9A-Za-z_-]{10,}\.[0-9A-Za-z_-]{10,}",
    "assigned secret": r"(?i)(?:token|api[_-]?key|secret|password|passwd)\s*[:=]\s*[\"']?[0-9A-Za-z_+/.-]{12,}",
}


def scan(texts: DataFrame) -> DataFrame:
    """``texts(path, text)``: a row for each line and kind of secret in it, lines from 1. The matched text is not shown."""
    lines = texts.where("path is not null").select("path", F.posexplode(F.split("text", "\r?\n")).alias("no", "text"))
    kinds = F.array_compact(F.array(*[F.when(F.col("text").rlike(p), F.lit(k)) for k, p in PATTERNS.items()]))
    return lines.select("path", (F.col("no") + 1).alias("line"), F.explode(kinds).alias("kind")).distinct()
