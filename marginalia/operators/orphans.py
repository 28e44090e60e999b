"""References to records that do not exist, direct and inherited (problem 5).

A reference is met when its target exists early enough: of each link key and each path only the first day of
existence matters, so the targets are folded to one row before any join, and a hot key costs no more than its
references. What isn't met is a direct orphan. Then the fixpoint: whatever refers to a record with an orphan
reference has inherited one. The references between records are written once; each round semi-joins them with the records found in the round
before, and drops those found earlier. It ends when nothing is new, after as many rounds as the longest chain has links.

Defined results: null links, keys and paths are no references, an empty link key is no link; a null time of the
referring record can't be met and gives a null period; a null time of a target never meets; repeated rows count
once; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import field, link_key, link_target, links, stem
from ..session import materialize

COLUMNS = ("ref_table", "ref_field", "ref_key", "target", "period")


def _month(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM")


def _note_refs(notes: DataFrame) -> DataFrame:
    of = lambda name, found: notes.where("path is not null").select(F.lit(name).alias("ref_field"), F.col("path").alias("ref_key"), "modified_at", F.explode(found).alias("link"))
    both = of("body", links(F.col("body"))).unionByName(of("fields", F.array_compact(F.array(field("superseded_by")))))
    keyed = both.select(F.lit("notes").alias("ref_table"), "ref_field", "ref_key", link_key(link_target(F.col("link"))).alias("target"), "modified_at", _month(F.col("modified_at")).alias("period"))
    return keyed.where("target <> ''").distinct()


def _targets(notes: DataFrame, common: DataFrame) -> DataFrame:
    """path, name, added_at of every note that may be referred to."""
    some = lambda df: df.select("path", field("name").alias("name"), "added_at")
    return some(notes.where("deleted_at is null")).unionByName(some(common)).where("path is not null")


def references(notes: DataFrame, common: DataFrame, feedback: DataFrame) -> DataFrame:
    """Every reference with ``met``, and ``by_path``: whether its target is a path or a link key."""
    targets = _targets(notes, common)
    keys = targets.select(F.explode(F.array_distinct(F.array_compact(F.array(link_key(F.col("name")), link_key(stem(F.col("path"))))))).alias("target"), "added_at").groupBy("target").agg(F.min("added_at").alias("since"))
    paths = targets.select(F.col("path").alias("target"), "added_at").groupBy("target").agg(F.min("added_at").alias("since"))
    links_ = _note_refs(notes).join(keys, "target", "left").withColumn("met", F.coalesce(F.col("since") <= F.col("modified_at"), F.lit(False)))
    rated = (
        feedback.where("path is not null")
        .select(F.lit("feedback").alias("ref_table"), F.lit("path").alias("ref_field"), F.col("pair_id").cast("string").alias("ref_key"), F.col("path").alias("target"), "last_day")
        .distinct()
        .join(paths, "target", "left")
        .withColumn("met", F.coalesce(F.unix_date(F.to_date("since")) <= F.col("last_day"), F.lit(False)))
        .withColumn("period", _month(F.date_from_unix_date(F.col("last_day").cast("int"))))
    )
    return links_.select(*COLUMNS, "met", F.lit(False).alias("by_path")).unionByName(rated.select(*COLUMNS, "met", F.lit(True).alias("by_path")))


def orphans(notes: DataFrame, common: DataFrame, feedback: DataFrame) -> DataFrame:
    """Every orphan reference: ref_table, ref_field, ref_key, target, period and ``depth``, 0 for direct ones; a
    record that refers to a record of depth d (and to none of less) has inherited depth d + 1."""
    refs = materialize(references(notes, common, feedback))
    record = ["ref_table", "ref_key"]
    broken = refs.where("not met").select(*record).distinct()
    # The records behind a met target: the notes that carry the key, or the path.
    nodes = _targets(notes, common).select("path", "name").distinct()
    keyed = nodes.select("path", F.explode(F.array_distinct(F.array_compact(F.array(link_key(F.col("name")), link_key(stem(F.col("path"))))))).alias("target"), F.lit(False).alias("by_path"))
    carried = keyed.unionByName(nodes.select("path", F.col("path").alias("target"), F.lit(True).alias("by_path"))).distinct()
    edges = materialize(refs.where("met").join(carried, ["target", "by_path"]).join(broken, record, "left_anti").select(*COLUMNS, "path"))
    # Down the graph: only notes are referred to, so only they carry the cascade on. A round reads the edges and what was reached, and writes what is new.
    frontier = materialize(broken.where("ref_table = 'notes'").select(F.col("ref_key").alias("path")))
    down = edges.where("ref_table = 'notes'").select("ref_key", "path")
    reached = frontier.withColumn("depth", F.lit(0))
    depth = 0
    while not frontier.isEmpty():  # every round reaches notes that none before did, or is the last
        depth += 1
        step = down.join(frontier, "path", "left_semi").select(F.col("ref_key").alias("path")).distinct()
        frontier = materialize(step.join(reached, "path", "left_anti"))
        reached = reached.unionByName(frontier.withColumn("depth", F.lit(depth)))
    per_ref = edges.join(reached, "path").groupBy(*COLUMNS).agg((F.min("depth") + 1).alias("depth"))
    inherited = per_ref.withColumn("first", F.min("depth").over(Window.partitionBy(*record))).where("depth = first").drop("first")
    return refs.where("not met").select(*COLUMNS, F.lit(0).alias("depth")).unionByName(inherited)


def orphan_report(found: DataFrame) -> DataFrame:
    """For each table and month: direct and inherited orphan references."""
    count = lambda on, name: F.sum(F.when(on, 1).otherwise(0)).alias(name)
    return found.groupBy("ref_table", "period").agg(count(F.col("depth") == 0, "direct"), count(F.col("depth") > 0, "inherited"))
