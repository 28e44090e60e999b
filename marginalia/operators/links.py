"""Names and links between notes: resolving, homonyms, dangling links, citations, siblings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import family, field, link_key, link_target, links, project, stem, strip


def names(notes: DataFrame) -> DataFrame:
    """``path, key``: the link keys of each note's name and of its file stem."""
    keys = F.array_distinct(F.array_compact(F.array(link_key(field("name")), link_key(stem(F.col("path"))))))
    return notes.where("path is not null").select("path", F.explode(keys).alias("key")).where("key <> ''").distinct()


def edges(notes: DataFrame) -> DataFrame:
    """``path, target, key``: every link of a body, one row for each occurrence (of a repeated row only one set)."""
    once = notes.where("path is not null").groupBy("path").agg(F.max("body").alias("body"))
    cut = once.select("path", F.explode(links(F.col("body"))).alias("link")).select("path", strip(link_target(F.col("link"))).alias("target"))
    return cut.withColumn("key", link_key(F.col("target")))


def dangling(notes: DataFrame) -> DataFrame:
    """A finding for each link that leads to no note."""
    return edges(notes).join(names(notes).select("key").distinct(), "key", "left_anti").select("path", F.concat(F.lit("link to a note that doesn't exist: [["), F.col("target"), F.lit("]]")).alias("message"))


def homonyms(notes: DataFrame) -> DataFrame:
    """A finding for each name that several notes bear, on the first of them, with all the others. The message lists every path,
    so the paths of one name come together in one row."""
    named = notes.select("path", field("name").alias("name")).where("path is not null and name is not null").distinct()
    listed = named.groupBy("name").agg(F.sort_array(F.collect_list(F.split("path", "/"))).alias("parts")).where(F.size("parts") > 1)
    paths = listed.select(F.transform("parts", lambda p: F.array_join(p, "/")).alias("paths"))
    return paths.select(F.col("paths")[0].alias("path"), F.concat(F.lit("name also borne by "), F.array_join(F.expr("slice(paths, 2, size(paths))"), ", ")).alias("message"))


def citing(notes: DataFrame) -> DataFrame:
    """``path, cited_by``: which notes link to each note, itself aside."""
    return names(notes).join(edges(notes).select(F.col("path").alias("cited_by"), "key"), "key").where("path <> cited_by").select("path", "cited_by").distinct()


def resolve(notes: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted(name)`` with the paths that bear the name: ``name, path, matches``; none gives a null path and 0."""
    keyed = wanted.select("name", link_key(F.col("name")).alias("key")).distinct()
    found = keyed.join(names(notes), "key", "left")
    from pyspark.sql import Window

    return found.select("name", "path", F.count("path").over(Window.partitionBy("name")).alias("matches"))


def common_siblings(notes: DataFrame) -> DataFrame:
    """``project, path``: the notes of a family's ``common`` project, for every other project of the family. Both sides
    are folded to distinct keys first."""
    placed = notes.where("path is not null").select("path", family(F.col("path")).alias("family"), project(F.col("path")).alias("project")).distinct()
    others = placed.where(~F.col("project").endswith("/common")).select("family", "project").distinct()
    return placed.where(F.col("project").endswith("/common")).select("family", "path").join(others, "family").select("project", "path")


def tolerated(notes: DataFrame, expected: DataFrame) -> DataFrame:
    """``qid, path``: the expected note, the notes it names under "See also" or "Voir aussi", and its successor."""
    near = notes.where("path is not null").groupBy("path").agg(F.max("body").alias("body"), F.max(field("superseded_by")).alias("next"))
    also = F.flatten(F.transform(F.regexp_extract_all("body", F.lit(r"(?m)^.*(?:See also|Voir aussi).*$"), F.lit(0)), links))
    one = lambda x: link_key(link_target(x))
    keys = F.array_distinct(F.array_compact(F.concat(F.transform(also, one), F.array(one(F.col("next"))))))
    wide = expected.join(near, expected["expected"] == near["path"]).select("qid", F.explode(keys).alias("key"))
    reached = wide.join(names(notes).groupBy("key").agg(F.max("path").alias("path")), "key").select("qid", "path")
    return expected.select("qid", F.col("expected").alias("path")).unionByName(reached).distinct()
