"""The vector table: what is stale, what is gone, and the next snapshot.

A snapshot is a folder of its own with a pointer to the newest, so a reader never sees half of one.
"""

from __future__ import annotations

import json
import os
import struct
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.encoder import Encoder, HashingEncoder, encode_column
from ..functions.text import field
from ..session import materialize
from .chunking import split_bodies, with_context

KEY = ["path", "ordinal", "question_no"]


def fingerprints(notes: DataFrame) -> DataFrame:
    """``path, note_hash``: any change of a note's fields or body changes it."""
    fields = F.array_sort(F.transform(F.map_entries("fields"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return notes.where("path is not null").groupBy("path").agg(F.max(F.md5(F.concat_ws("\n", F.array_join(fields, "\n"), F.coalesce("body", F.lit(""))))).alias("note_hash"))


def expected(notes: DataFrame, chunks: DataFrame, questions: DataFrame | None = None, by_chunk: bool = False) -> DataFrame:
    """``path, ordinal, question_no, text, fingerprint`` of every vector that should exist: one for each chunk with its
    context, and one for each of its cached questions (``questions(chunk_hash, questions)``). By default a note's
    fingerprint covers the whole note; ``by_chunk`` re-encodes only changed chunks."""
    heads = notes.where("path is not null").groupBy("path").agg(F.max(F.struct(field("name").alias("name"), field("description").alias("description"))).alias("h"))
    once = chunks.groupBy("path", "ordinal").agg(F.max("text").alias("text")).withColumn("chunk_hash", F.md5("text"))
    rows = once.join(heads, "path").join(fingerprints(notes), "path")
    text = with_context(F.col("h.name"), F.col("h.description"), F.col("text"))
    main = rows.select("path", "ordinal", F.lit(None).cast("int").alias("question_no"), text.alias("full"), (F.md5(text) if by_chunk else F.col("note_hash")).alias("fingerprint"))
    if questions is None:
        return main.withColumnRenamed("full", "text")
    asked = rows.join(questions, "chunk_hash").select("path", "ordinal", F.posexplode("questions").alias("question_no", "full"), "note_hash")
    more = asked.select("path", "ordinal", "question_no", "full", (F.md5("full") if by_chunk else F.col("note_hash")).alias("fingerprint"))
    return main.unionByName(more).withColumnRenamed("full", "text")


def _matched(a: DataFrame, b: DataFrame, how: str, also: tuple[str, ...] = ()) -> DataFrame:
    """The rows of a with (``left_semi``) or without (``left_anti``) a row of the same key in b."""
    keyed = lambda df: df.select("path", "ordinal", F.coalesce("question_no", F.lit(-1)).alias("_question"), *also)
    on = ["path", "ordinal", "_question", *also]
    return a.withColumn("_question", F.coalesce("question_no", F.lit(-1))).join(keyed(b), on, how).select(*a.columns)


def stale(wanted: DataFrame, have: DataFrame) -> DataFrame:
    """The wanted vectors that are missing or have another fingerprint."""
    return _matched(wanted, have, "left_anti", ("fingerprint",))


def ghosts(wanted: DataFrame, have: DataFrame) -> DataFrame:
    """The vectors that nothing wants any more."""
    return _matched(have, wanted, "left_anti")


def pending_questions(chunks: DataFrame, questions: DataFrame, most: int | None = None) -> DataFrame:
    """Chunks without questions, in the order of folders, files and ordinals."""
    todo = chunks.select("path", "ordinal", "text").distinct().withColumn("chunk_hash", F.md5("text")).join(questions.select("chunk_hash"), "chunk_hash", "left_anti")
    return todo.orderBy(F.split("path", "/"), "ordinal").limit(most) if most is not None else todo


def prune_questions(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    return questions.join(chunks.select(F.md5("text").alias("chunk_hash")).distinct(), "chunk_hash", "left_semi")


def upsert(have: DataFrame, new: DataFrame, dim: int) -> DataFrame:
    """The table with the new rows in place of those of the same key. A vector of another size, or with numbers that
    aren't finite, is refused with an error."""
    good = F.coalesce((F.size("embedding") == dim) & F.forall("embedding", lambda v: ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    guarded = new.withColumn("embedding", F.when(good, F.col("embedding")).otherwise(F.raise_error(F.lit("a vector has the wrong size or isn't finite"))))
    return _matched(have, new, "left_anti").unionByName(guarded)


def refresh(notes: DataFrame, chunks: DataFrame, have: DataFrame, questions: DataFrame | None = None, factory: Callable[[], Encoder] = HashingEncoder) -> tuple[DataFrame, DataFrame]:
    """The next vectors (``path, ordinal, question_no, fingerprint, embedding, truncated``) and the statistics of the pass, one row."""
    wanted = materialize(expected(notes, chunks, questions))
    todo = stale(wanted, have)
    new = materialize(todo.withColumn("e", encode_column(F.col("text"), factory)).select(*KEY, "fingerprint", "e.embedding", "e.truncated"))
    kept = _matched(_matched(have, wanted, "left_semi"), new, "left_anti")
    out = kept.select(*new.columns).unionByName(new)
    count = lambda df, name, what="*": df.agg(F.count(what).alias(name))
    stats = count(wanted.select("path").distinct(), "notes").crossJoin(wanted.agg(F.count_if(F.col("question_no").isNull()).alias("chunks"), F.count_if(F.col("question_no").isNotNull()).alias("questions")))
    stats = stats.crossJoin(new.agg(F.count("*").alias("encoded"), F.count_distinct("path").alias("notes_encoded"), F.count_if("truncated").alias("truncated"))).crossJoin(count(ghosts(wanted, have), "removed"))  # one row each
    return out, stats.withColumn("unchanged", F.col("notes") - F.col("notes_encoded"))


HEADER = ("model", "weights_hash", "dim", "pooling", "prompts")


def _files(spark: SparkSession, path: str):
    """The JVM's view of the file system that holds ``path``, a shared one too."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    return hadoop, hadoop.FileContext.getFileContext(at.toUri() if at.toUri().getScheme() else hadoop.Path(f"file://{os.path.abspath(path)}").toUri(), spark._jsc.hadoopConfiguration())


def save(vectors: DataFrame, root: str, header: dict[str, object]) -> str:
    """Writes the next snapshot and then moves the pointer to it, by a rename that overwrites; readers of the old one are not disturbed."""
    spark, version = vectors.sparkSession, f"v{time.time_ns()}"
    vectors.write.parquet(f"{root}/{version}")
    hadoop, files = _files(spark, root)
    flags = spark._jvm.java.util.EnumSet.of(hadoop.CreateFlag.CREATE, hadoop.CreateFlag.OVERWRITE)
    none = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.CreateOpts, 0)
    next_ = hadoop.Path(f"{root}/CURRENT.{version}")
    out = files.create(next_, flags, none)
    out.write(bytearray(json.dumps({"version": version, "header": header}).encode()))
    out.close()
    over = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files.rename(next_, hadoop.Path(f"{root}/CURRENT"), over)
    return version


def load(spark: SparkSession, root: str, header: dict[str, object]) -> DataFrame | None:
    """The newest snapshot, or None if there is none or it was made by another model, pooling or prompt."""
    hadoop, files = _files(spark, root)
    at = hadoop.Path(f"{root}/CURRENT")
    if not files.util().exists(at):
        return None
    pointer = files.open(at)
    try:
        now = json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(pointer)))
    except ValueError:
        return None
    finally:
        pointer.close()
    if any(now["header"].get(k) != header.get(k) for k in HEADER):
        return None
    return spark.read.parquet(f"{root}/{now['version']}")


#: Fixed value: how a flat binary index begins.
MAGIC = b"MEMIDX1\n"


def import_binary(spark: SparkSession, path: str) -> DataFrame:
    """``path, ordinal, question_no, fingerprint, embedding`` from flat binary indexes: a magic line, the length of a JSON header, the
    header with keys, hashes and dimension, then little-endian floats, row by row. A file of the wrong size is refused."""
    schema = "path string, ordinal int, question_no int, fingerprint string, embedding array<float>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content").to_pylist():
                if data[: len(MAGIC)] != MAGIC:
                    raise ValueError("not an index file")
                (size,) = struct.unpack_from("<I", data, len(MAGIC))
                start = len(MAGIC) + 4
                head = json.loads(data[start : start + size])
                keys, dim = [e["key"] for e in head["entries"]], head["dim"]
                x = np.frombuffer(data, "<f4", offset=start + size)
                if len(x) != len(keys) * dim:
                    raise ValueError("the index file has the wrong size")
                parts = [k.rpartition("#") if "#" in k else (k, "", "0") for k in keys]
                number = lambda s: int(s) if s.isdigit() else 0
                ordinal = [number(t.split("?")[0]) for _, _, t in parts]
                question = [number(t.split("?")[1]) if "?" in t else None for _, _, t in parts]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) + 1, dim, dtype=np.int32)), pa.array(x))
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _, _ in parts]), pa.array(ordinal, pa.int32()), pa.array(question, pa.int32()), pa.array([str(e["hash"]) for e in head["entries"]]), lists], names=["path", "ordinal", "question_no", "fingerprint", "embedding"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def dump_chunks(notes: DataFrame, path: str) -> None:
    """Every passage with its key and whether its note is active, as JSON lines."""
    active = notes.where("path is not null").groupBy("path").agg(F.max(field("status")).alias("status")).select("path", (~F.col("status").eqNullSafe(F.lit("archived"))).alias("active"))
    rows = split_bodies(notes).join(active, "path")
    rows.select(F.concat("path", F.lit("#"), F.col("ordinal").cast("string")).alias("key"), "path", "ordinal", "active", "text").write.json(path)
