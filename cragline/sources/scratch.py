"""Intermediate tables: written to the folder that all machines share, and deleted when nothing needs them any more.

Writing a table cuts the lineage of a plan, and a lost executor costs no more than the stages after it. Once it is
written, the shuffle files of that plan are removed; Spark else keeps them until the driver collects garbage.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_folders: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, with its scheme: spark.checkpoint.dir of the session.

    Where that is unset, the context's checkpoint folder, else a folder in the warehouse, which a cluster shares as
    well; a session in local mode has one machine only, and takes a temporary folder of it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        master = spark.sparkContext.master
        local = master == "local" or master.startswith("local[")
        found = tempfile.mkdtemp(prefix="cragline-") if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/cragline-shared"
        spark.conf.set("spark.checkpoint.dir", found)
    return qualified(spark, found.rstrip("/"))


def _at(spark: SparkSession, path: str):
    """File system and path, of Hadoop."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def qualified(spark: SparkSession, path: str) -> str:
    """path with its scheme, as file:///x or hdfs://host/x."""
    store, at = _at(spark, path)
    name = store.makeQualified(at).toString()
    return name.replace("file:/", "file:///", 1) if name.startswith("file:/") and not name.startswith("file://") else name


def scratch_dir(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables, deleted when the program ends."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        _folders[app] = f"{shared_dir(spark)}/cragline-{app}"
        store, at = _at(spark, _folders[app])

        def remove() -> None:
            with contextlib.suppress(Exception):  # the JVM may be gone first
                store.delete(at, True)

        atexit.register(remove)
    return _folders[app]


@contextlib.contextmanager
def _shuffles_removed(spark: SparkSession):
    """What is written in here leaves no shuffle files; the setting is then as it was."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def cut(df: DataFrame, label: str = "table") -> DataFrame:
    """df read back from a Parquet table of its own."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    with _shuffles_removed(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*frames: DataFrame | None) -> None:
    """Delete the tables of frames that cut returned. No plan that reads them may be left to run."""
    for df in frames:
        path = None if df is None else df.__dict__.get("_scratch")
        if path:
            store, at = _at(df.sparkSession, path)
            store.delete(at, True)
