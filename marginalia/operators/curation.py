"""What needs a curator's eye: stale, long and undated notes, counts per project."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import family, field, project


def _heads(notes: DataFrame) -> DataFrame:
    return notes.where("path is not null").groupBy("path").agg(F.max(F.struct(field("status").alias("status"), field("type").alias("type"), field("verified").alias("verified"), F.char_length("body").alias("chars"))).alias("h")).select("path", "h.*")


def stale(notes: DataFrame, today: str, days: int = 60) -> DataFrame:
    """Active project notes last verified more than ``days`` ago. A date that isn't one is no date."""
    age = F.datediff(F.lit(today).cast("date"), F.try_to_date("verified", "yyyy-MM-dd"))
    ok = F.col("verified").rlike(r"^\d{4}-\d{2}-\d{2}$") & ~F.col("status").eqNullSafe(F.lit("archived")) & (F.coalesce("type", F.lit("project")) == "project")
    return _heads(notes).where(ok).select("path", age.cast("int").alias("age")).where(F.col("age") > days)


def long_notes(notes: DataFrame, tokens: int = 2000) -> DataFrame:
    size = F.floor(F.col("chars") / 4).cast("bigint")
    return _heads(notes).select("path", size.alias("tokens")).where(F.col("tokens") > tokens)


def undated(notes: DataFrame) -> DataFrame:
    return _heads(notes).where(~F.col("status").eqNullSafe(F.lit("archived")) & F.col("verified").isNull()).select("path")


def per_project(notes: DataFrame, projects: DataFrame | None = None) -> DataFrame:
    """``family, project, notes``; with ``projects(project)`` also the empty ones."""
    counted = notes.where("path is not null").select("path").distinct().groupBy(project(F.col("path")).alias("project")).agg(F.count("*").alias("notes"))
    if projects is not None:
        counted = projects.select("project").distinct().join(counted, "project", "left").withColumn("notes", F.coalesce("notes", F.lit(0)))
    return counted.select(family(F.col("project")).alias("family"), "project", "notes")


def changes_since(commits: DataFrame, since: int) -> DataFrame:
    """``directory, path, verb``: what happened to each note file since a time, from ``commits(secs, status, path)``; the
    latest commit counts. Generated indexes and derived state are left out."""
    from pyspark.sql import Window

    kept = commits.where((F.col("secs") >= since) & F.col("path").endswith(".md") & ~F.substring_index("path", "/", -1).startswith("MEMORY") & ~F.col("path").rlike(r"(^|/)\.[^/]+/"))
    last = Window.partitionBy("path").orderBy(F.desc("secs"), "status")
    verb = F.when(F.col("status").startswith("A"), "added").when(F.col("status").startswith("D"), "deleted").when(F.col("status").startswith("R"), "renamed").otherwise("changed")
    first = kept.withColumn("k", F.row_number().over(last)).where("k = 1")
    return first.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("directory"), "path", verb.alias("verb"))
