"""Session settings and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

# Defaults for a job of this library; a cluster's own settings for sizes and counts stay untouched.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Recording the call site of every column expression doubles the time it takes to build a wide plan.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # Rows of this library are wide. HotSpot leaves methods of more than 8000 bytes interpreted; such plans run in smaller ones.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build_session(name: str, master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> None:
    """The setting for wide rows, in a session that others have built; one that is set already stays."""
    key = "spark.sql.codegen.hugeMethodLimit"
    if key not in spark.conf.getAll:
        spark.conf.set(key, SETTINGS[key])


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application; where it is installed on all of them, that is not needed."""
    context = spark.sparkContext
    if getattr(context, "_firmlake_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="firmlake-package-"), "firmlake.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(root):
            for name in sorted(n for n in names if n.endswith(".py")):
                file = os.path.join(folder, name)
                archive.write(file, os.path.relpath(file, os.path.dirname(root)))
    context.addPyFile(path)
    context._firmlake_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors reach: ``spark.checkpoint.dir``; only where that is unset, one of our own for this session."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="firmlake-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def work_path(spark: SparkSession, purpose: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_folder(spark)}/firmlake/{purpose}-{uuid.uuid4().hex[:12]}"


def settle(df, purpose: str = "settled"):
    """Write a frame once to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = work_path(spark, purpose)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._firmlake_path = path
    return out


def discard(*frames) -> None:
    """Delete what ``settle`` wrote for the frames, once nothing reads them any more."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._firmlake_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
