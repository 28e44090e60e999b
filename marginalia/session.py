"""The Spark session and what cuts lineage.

Nothing here keeps state on one machine: intermediate tables go to the folder that the cluster names in
``spark.checkpoint.dir``, which every executor shares, so that losing an executor loses no data.
"""

from __future__ import annotations

import atexit
import math
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_written: list[tuple[SparkSession, str]] = []


def session(name: str = "marginalia", master: str | None = None, cores: int = 8, **conf: str) -> SparkSession:
    """A session with the settings that the operators expect: UTC, Arrow, adaptive plans."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": str(cores),
    } | conf
    builder = SparkSession.builder.appName(name).config(map=settings)
    if master:
        builder = builder.master(master)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for an application, wherever they were started. The archive is the
    driver's; Spark serves it to every executor, also to those that come later."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    package = Path(__file__).resolve().parent
    at = Path(tempfile.mkdtemp(prefix="marginalia-code-")) / "marginalia_code.zip"
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    atexit.register(shutil.rmtree, at.parent, ignore_errors=True)
    sc.addPyFile(str(at))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only a local session may fall back to a folder of this machine."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named and sc.getCheckpointDir():
        named = sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="marginalia-")
        sc.setCheckpointDir(named)
    return named


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the JVM may be gone already
        pass


def materialize(df: DataFrame) -> DataFrame:
    """The same rows, read from a table just written to the shared folder: lineage ends there and nothing
    is computed twice."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"table-{uuid.uuid4().hex}")
    df.write.parquet(path)
    if not _written:
        atexit.register(lambda: [_remove(*x) for x in _written])
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Drops the table behind a materialized frame that nothing will read again."""
    names = {f.rsplit("/", 2)[-2] for f in df.inputFiles() if "/table-" in f}
    for spark, path in [x for x in _written if x[1].rsplit("/", 1)[-1] in names]:
        _remove(spark, path)
        _written.remove((spark, path))


def partitions_for(spark: SparkSession, rows: int, per_partition: int) -> int:
    """How many partitions hold ``rows`` at no more than ``per_partition`` each, at least the session's number."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / per_partition))
