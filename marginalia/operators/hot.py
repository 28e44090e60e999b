"""The bounded index of each project: its notes by kind, the oldest project notes left out until the whole text fits.

What leaves is found by one running sum over the project's notes, not by removing and measuring again; the sizes are those of the
whole text, with title, headings, the family's common notes, the line about what is left out and the count of archived notes. Nothing gathers
a project's notes but the final text, which is bounded by ``limit`` octets and the notes of the kinds that never leave.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import family, field, project, stem, strip

# The most octets of an index, the strata in their order with their labels, the project that a family shares.
LIMIT = 17_408
STRATA = (("reference", "Durable knowledge"), ("feedback", "Ways of working"), ("user", "About the user"), ("project", "Projects"))
COMMON = "common"


def lines(notes: DataFrame) -> DataFrame:
    """One line for each note: project, path, name, rel (the path below the project), description, stratum, archived, date, line."""
    heads = [field(c).alias(c) for c in ("name", "type", "status", "description", "verified", "modified")]
    once = notes.where("path is not null").groupBy("path").agg(F.max(F.struct(*heads, F.col("modified_at").alias("at"))).alias("h")).select("path", "h.*")
    rows = once.select(
        project(F.col("path")).alias("project"), "path", F.coalesce("name", stem(F.col("path"))).alias("name"),
        F.expr("substr(path, length(substring_index(path, '/', 2)) + 2)").alias("rel"), F.coalesce(strip(F.col("description")), F.lit("")).alias("description"),
        F.coalesce("type", F.lit("project")).alias("stratum"), F.col("status").eqNullSafe(F.lit("archived")).alias("archived"), F.coalesce("verified", "modified", F.date_format("at", "yyyy-MM-dd"), F.lit("")).alias("date"),
    )
    return rows.withColumn("line", _line(F.col("rel")))


def _line(rel: Column) -> Column:
    return F.concat(F.lit("- ["), F.col("name"), F.lit("]("), rel, F.lit(")"), F.when(F.col("description") != "", F.concat(F.lit(": "), F.col("description"))).otherwise(F.lit("")))


def left_out_message(k: Column) -> Column:
    return F.concat(F.lit("- "), k.cast("string"), F.lit(" older project notes left out of the hot index, search finds them"))


def _archived_message(n: Column) -> Column:
    return F.concat(F.lit("<!-- "), n.cast("string"), F.lit(" archived note(s), outside the index, reachable by a search of the archives -->"))


def _title() -> Column:
    return F.concat(F.lit("# Memory index, "), F.col("project"))


def _heading(stratum: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for pair in STRATA for x in pair])
    return F.concat(F.lit("## "), F.coalesce(F.try_element_at(labels, stratum), stratum))


def _rank(stratum: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for i, (k, _) in enumerate(STRATA) for x in (k, i)]), stratum), F.lit(len(STRATA)))


def _shared(rows: DataFrame) -> DataFrame:
    """``family, line``: the common notes as the other projects of their family list them."""
    common = rows.where(~F.col("archived") & (F.substring_index("project", "/", -1) == COMMON))
    return common.select(family(F.col("project")).alias("family"), _line(F.concat(F.lit(f"../{COMMON}/"), F.col("rel"))).alias("line"))


def _takes_shared() -> Column:
    return F.col("project").contains("/") & (F.substring_index("project", "/", -1) != COMMON)


def _shared_heading() -> Column:
    return F.concat(F.lit("## Shared by "), F.col("family"))


def _fixed(rows: DataFrame) -> DataFrame:
    """``project, fixed``: the octets of each project's text besides the lines of its own notes. Blocks are parted by an empty line."""
    heads = rows.where("not archived").groupBy("project", "stratum").agg(F.count("*")).groupBy("project").agg(F.sum(F.octet_length(_heading(F.col("stratum"))) + 3).alias("heads"))
    of_family = _shared(rows).groupBy("family").agg(F.sum(F.octet_length("line") + 1).alias("shared")).withColumn("shared", F.col("shared") + F.octet_length(_shared_heading()) + 3)
    base = rows.groupBy("project").agg(F.sum(F.col("archived").cast("int")).alias("archived")).withColumn("family", family(F.col("project")))
    whole = base.join(heads, "project", "left").join(of_family, "family", "left")
    tail = F.when(F.col("archived") > 0, F.octet_length(_archived_message(F.col("archived"))) + 2).otherwise(0)
    shared = F.when(_takes_shared(), F.coalesce("shared", F.lit(0))).otherwise(0)
    return whole.select("project", (F.octet_length(_title()) + 1 + F.coalesce("heads", F.lit(0)) + shared + tail).alias("fixed"))


def compaction(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``project, full_bytes, left_out, bytes``: how many of the project notes, oldest first, must leave for the text to
    fit. ``rows`` as from ``lines``; archived notes have no line. If even all leaving doesn't do, all leave."""
    live = rows.where("not archived").withColumn("size", F.octet_length("line") + 1)
    full = _fixed(rows).join(live.groupBy("project").agg(F.sum("size").alias("own")), "project", "left").select("project", (F.col("fixed") + F.coalesce("own", F.lit(0))).alias("full_bytes"))
    oldest = Window.partitionBy("project").orderBy("date", "name", "path")
    leaving = live.where("stratum = 'project'").withColumn("k", F.row_number().over(oldest)).withColumn("gone", F.sum("size").over(oldest.rowsBetween(Window.unboundedPreceding, 0))).join(full, "project")
    after = F.col("full_bytes") - F.col("gone") + F.octet_length(left_out_message(F.col("k"))) + 1
    some = leaving.withColumn("bytes", after).groupBy("project").agg(F.min(F.when(F.col("bytes") <= limit, F.struct("k", "bytes"))).alias("fits"), F.max(F.struct("k", "bytes")).alias("all"))
    need = full.join(some, "project", "left")
    pick = F.when(F.col("full_bytes") <= limit, F.struct(F.lit(0).alias("k"), F.col("full_bytes").alias("bytes"))).otherwise(F.coalesce("fits", "all", F.struct(F.lit(0).alias("k"), F.col("full_bytes").alias("bytes"))))
    return need.withColumn("p", pick).select("project", "full_bytes", F.col("p.k").alias("left_out"), F.col("p.bytes").alias("bytes"))


def strata(rows: DataFrame) -> DataFrame:
    """``project, stratum, position, notes, bytes``, unknown kinds after the known ones by name."""
    live = rows.where("not archived").groupBy("project", "stratum").agg(F.count("*").alias("notes"), F.sum(F.octet_length("line") + 1).alias("bytes"))
    order = Window.partitionBy("project").orderBy(_rank(F.col("stratum")), "stratum")
    return live.select("project", "stratum", F.row_number().over(order).alias("position"), "notes", "bytes")


def render(notes: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``project, text``: each project's index, with the family's common notes and the count of archived ones."""
    rows = lines(notes)
    cut = compaction(rows, limit).select("project", "left_out")
    oldest = Window.partitionBy("project", "stratum").orderBy("date", "name", "path")
    kept = rows.where("not archived").withColumn("k", F.row_number().over(oldest)).join(cut, "project")
    here = F.when((F.col("stratum") != "project") | (F.col("k") > F.col("left_out")), F.struct("name", "rel", "description", "date", "line"))
    sections = kept.groupBy("project", "stratum", "left_out").agg(F.sort_array(F.collect_list(here)).alias("rows"))
    more = F.when((F.col("stratum") == "project") & (F.col("left_out") > 0), F.array(left_out_message(F.col("left_out")))).otherwise(F.array().cast("array<string>"))
    body = F.array_join(F.concat(F.transform("rows", lambda s: s["line"]), more), "\n")
    block = lambda at, name, text: F.struct(at.alias("at"), name.alias("name"), text.alias("text"))
    blocks = sections.select("project", block(_rank(F.col("stratum")), F.col("stratum"), F.concat(_heading(F.col("stratum")), F.lit("\n\n"), body)).alias("b"))
    projects = rows.groupBy("project").agg(F.sum(F.col("archived").cast("int")).alias("archived")).withColumn("family", family(F.col("project")))
    shared = _shared(rows).groupBy("family").agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("lines"))
    theirs = projects.where(_takes_shared()).join(shared, "family").select("project", block(F.lit(1000), F.lit(""), F.concat(_shared_heading(), F.lit("\n\n"), F.col("lines"))).alias("b"))
    title = projects.select("project", block(F.lit(-1), F.lit(""), _title()).alias("b"))
    old = projects.where("archived > 0").select("project", block(F.lit(2000), F.lit(""), _archived_message(F.col("archived"))).alias("b"))
    text = F.concat(F.array_join(F.transform(F.sort_array(F.collect_list("b")), lambda b: b["text"]), "\n\n"), F.lit("\n"))
    return title.unionByName(blocks).unionByName(theirs).unionByName(old).groupBy("project").agg(text.alias("text"))


def sizes(notes: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``project, bounded, unbounded, all_notes`` in octets."""
    rows = lines(notes)
    whole = notes.where("path is not null").groupBy("path").agg(F.max(F.octet_length("body")).alias("o")).groupBy(project(F.col("path")).alias("project")).agg(F.sum("o").alias("all_notes"))
    return compaction(rows, limit).join(whole, "project", "left").select("project", F.col("bytes").alias("bounded"), F.col("full_bytes").alias("unbounded"), "all_notes")
