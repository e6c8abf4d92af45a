"""The session the engine is meant for."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "girder", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, ANSI and adaptive plans; on a cluster the master and sizes come from spark-submit."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    }
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or the context's checkpoint folder.

    Where neither is set a local folder serves a local session, as in tests; a cluster has none, and is told so.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local") or context.master.startswith("local-"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file:{tempfile.gettempdir()}/girder-checkpoints"
    if not context.getCheckpointDir():
        context.setCheckpointDir(root)
    return root.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Folders of tables that :func:`written` wrote and nobody deleted.
WRITTEN: set[str] = set()


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder, compressed, and read it back; takes less disk than a checkpoint.

    The driver's JVM is asked to collect what stands for the shuffles that made it, so that their files go.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    WRITTEN.add(path)
    df.write.option("compression", "zstd").parquet(path)
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a context, so that Python functions find it wherever the driver runs.

    The archive is made in a folder of the driver's own and served from there; executors need no shared path. Arrow
    batches are kept to a thousand rows, since rows may hold long texts.
    """
    context = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    if not getattr(context, "_girder_is_there", False):
        archive = shutil.make_archive(f"{tempfile.mkdtemp()}/girder", "zip", Path(__file__).parents[1], "girder")
        context.addPyFile(archive)
        context._girder_is_there = True
