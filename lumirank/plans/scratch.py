"""Tables written part-way through a job, in the folder the cluster shares.

A job that reads one ordering of its rows twice must see the same rows in the same places both
times, also after an executor is lost. Writing the rows once gives that; nothing is kept on the
executors' own disks.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

_CONF = "spark.checkpoint.dir"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_root(spark: SparkSession) -> str:
    """The shared scratch folder: `spark.checkpoint.dir`, or the context's checkpoint folder.

    Only a local session without either gets a folder of its own.
    """
    root = spark.conf.get(_CONF, None) or spark.sparkContext.getConf().get(_CONF, None)
    if root:
        return root.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError(f"set {_CONF} to a folder that every executor can reach")
    root = tempfile.mkdtemp(prefix="run-", dir=None)
    spark.sparkContext.setCheckpointDir(root)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path nobody has used yet under the scratch folder."""
    return f"{scratch_root(spark)}/lumirank/{name}-{uuid.uuid4().hex}"


def scratch_table(df: DataFrame, name: str = "table", drop_shuffles: bool = False) -> DataFrame:
    """Write `df` once and return a reader of the written rows.

    With `drop_shuffles`, Spark deletes the shuffle files of the write as soon as it is over. Otherwise they
    stay until the driver's garbage is collected, and then for as long as anything still refers to the write.
    """
    path = scratch_path(df.sparkSession, name)
    _write(df, path, "errorifexists", drop_shuffles)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_parts(parts: Iterable[DataFrame], name: str = "parts") -> DataFrame:
    """Write frames of one layout, one at least, one after the other and return a reader of all their rows.

    Made one at a time, as by a generator, the driver holds the plan and the broadcasts of one of them, however many
    there are, and the shuffle files of each go when it is written.
    """
    path = None
    for df in parts:
        spark, schema = df.sparkSession, df.schema
        path = path or scratch_path(spark, name)
        _write(df, path, "append", True)
    return spark.read.schema(schema).parquet(path)


def _write(df: DataFrame, path: str, mode: str, drop_shuffles: bool) -> None:
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, "false")
    if drop_shuffles:
        conf.set(_CLEANUP, "true")
    try:
        df.write.mode(mode).parquet(path)
    finally:
        if drop_shuffles:
            conf.set(_CLEANUP, before)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as Spark's file system names it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of a job, wherever Spark can reach it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders right under a folder; none if it is not there."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path, "*")
    listed = found.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(found) or []
    return sorted(s.getPath().getName() for s in listed if s.isDirectory())


def waiting_files(spark: SparkSession, pattern: str) -> list[tuple[str, int]]:
    """Name and number of files of each folder or file that a pattern names; the driver gets counts, not files."""
    found = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    system = found.getFileSystem(spark._jsc.hadoopConfiguration())
    listed = [(s.getPath(), s.isDirectory()) for s in system.globStatus(found) or []]
    return sorted((p.getName(), system.getContentSummary(p).getFileCount() if folder else 1) for p, folder in listed)


def release(table: DataFrame) -> None:
    """Delete a scratch table that nothing reads any more."""
    files = table.inputFiles()
    if files:
        remove(table.sparkSession, files[0].rsplit("/", 1)[0])
