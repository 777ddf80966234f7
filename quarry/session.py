"""Sessions, and letting Python workers import this package."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship_package(spark: SparkSession) -> None:
    """Let the workers of a local session import this package; on a cluster it is installed or added with addPyFile."""
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if root not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, have) if x)


SHARED_DIR_SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver share: spark.checkpoint.dir of the session.

    Where it is unset and all runs in one process (tests), a fresh temporary folder is chosen once for the session; on a cluster that is an
    error, since executors would write to disks of their own.
    """
    found = spark.conf.get(SHARED_DIR_SETTING, None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError(f"set {SHARED_DIR_SETTING} to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quarry-shared-")
        spark.conf.set(SHARED_DIR_SETTING, found)
    return found.rstrip("/")


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Folders of this process that results may still read; they go when the process ends.
_FOLDERS: list[str] = []


def _delete_folders() -> None:
    spark = SparkSession.getActiveSession()
    while spark is not None and _FOLDERS:
        with contextlib.suppress(Exception):  # the gateway may be gone already
            delete_folder(spark, _FOLDERS.pop())


atexit.register(_delete_folders)


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A name in the shared folder that nothing else has. What is written there is deleted when the process ends; results that have to outlive it are written elsewhere."""
    folder = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _FOLDERS.append(folder)
    return folder


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows, written once to the shared folder and read from there: for what a plan reads more than once, and to cut lineage."""
    path = fresh_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_session(cpus: int = 8, partitions: int | None = None, **conf: str) -> SparkSession:
    """A session on this machine, for tests and benchmarks; on a cluster use the session that spark-submit gives."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark
