"""An id-keyed collection of vectors on parquet.

    <path>/meta/v=N                 one row: name, dimension, metric, base version
    <path>/base/v=N                 rows unique by (namespace, id), partitioned by namespace
    <path>/batches/v=N/b=W-NAME     rows of write W after base N, partitioned by namespace

An upsert writes only its own rows, under the number of its write and the name of its batch, so a
replayed batch replaces itself. A later write wins over an earlier one, whatever times its rows carry. A
read lists the writes after the newest base and lets them pass before it; `compact` folds them into a new
base and then publishes a new meta version; `vacuum` deletes what no reader of the newest base needs. The
`_SUCCESS` file Spark writes last marks what is complete. One writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumirank.functions.records import record_id, record_metadata
from lumirank.operators.validate import require_dimension
from lumirank.plans.scratch import remove

RECORD_SCHEMA = (
    "id string, values array<float>, metadata struct<image_path:string,preprocess_time:string>, "
    "updated_at timestamp, source_seq long, namespace string"
)
DEFAULT_NAMESPACE = "image_embeddings"
_META_SCHEMA = "name string, dimension int, metric string, base string"
_NO_BASE = "0"


def _complete(spark: SparkSession, folder: str, done: bool = True) -> list[str]:
    """Names of the sub-folders of `folder`, completely written ones only if `done`; one request either way."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder, "*=*/_SUCCESS" if done else "*=*")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return sorted((s.getPath().getParent() if done else s.getPath()).getName() for s in found)


def _meta(spark: SparkSession, path: str):
    """(version, row) of the newest description, or None."""
    versions = [int(name.split("=")[1]) for name in _complete(spark, f"{path}/meta")]
    if not versions:
        return None
    newest = max(versions)
    return newest, spark.read.schema(_META_SCHEMA).json(f"{path}/meta/v={newest}").first()


def _require(spark: SparkSession, path: str):
    found = _meta(spark, path)
    if found is None:
        raise FileNotFoundError(f"no collection at {path}; call ensure_collection first")
    return found


def ensure_collection(
    spark: SparkSession, path: str, dim: int, name: str = "collection", metric: str = "cosine"
) -> dict:
    """Create the collection if it is missing; returns its description either way."""
    if metric != "cosine":
        raise ValueError("the only metric is cosine")
    found = _meta(spark, path)
    if found is None:
        row = spark.createDataFrame([(name, dim, metric, None)], _META_SCHEMA)
        row.coalesce(1).write.json(f"{path}/meta/v=0")
        found = _meta(spark, path)
    if found[1]["dimension"] != dim:
        raise ValueError(f"the collection has dimension {found[1]['dimension']}, not {dim}")
    return {"name": found[1]["name"], "dimension": found[1]["dimension"], "metric": found[1]["metric"]}


def dimension(spark: SparkSession, path: str) -> int:
    """The number of values of every vector of the collection."""
    return _require(spark, path)[1]["dimension"]


def records(
    df: DataFrame,
    path: Column,
    values: Column,
    time: Column,
    source_seq: Column | None = None,
    id_col: Column | None = None,
    iso: bool = False,
) -> DataFrame:
    """Rows in the record layout; the id is the last path component unless `id_col` is given."""
    return df.select(
        (record_id(path) if id_col is None else id_col).alias("id"),
        values.cast("array<float>").alias("values"),
        record_metadata(path, time, iso).alias("metadata"),
        time.cast("timestamp").alias("updated_at"),
        (F.lit(0) if source_seq is None else source_seq).cast("long").alias("source_seq"),
    )


def upsert(
    spark: SparkSession,
    path: str,
    df: DataFrame,
    namespace: str | Column = DEFAULT_NAMESPACE,
    batch: str | None = None,
) -> str:
    """Insert or replace records by (namespace, id).

    The later upsert wins; within one, the greatest (updated_at, source_seq) does, and of rows equal in
    both the same one at every read. Writes the records of this batch and nothing else. Give a stream's
    batch its own name, so that a batch that is run again replaces what it wrote before.
    """
    _, meta = _require(spark, path)
    batch = batch or f"u-{uuid.uuid4().hex}"
    space = F.lit(namespace) if isinstance(namespace, str) else namespace
    rows = require_dimension(df.withColumn("namespace", space), meta["dimension"])
    rows = rows.select("id", "values", "metadata", "updated_at", "source_seq", "namespace")
    folder = f"{path}/batches/v={meta['base'] or _NO_BASE}"
    there = [n.split("=", 1)[1] for n in _complete(spark, folder, done=False)]
    same = [n for n in there if n.split("-", 1)[1] == batch]
    write = int(same[0].split("-")[0]) if same else 1 + max([0, *(int(n.split("-")[0]) for n in there)])
    rows.write.mode("overwrite").partitionBy("namespace").parquet(f"{folder}/b={write:08d}-{batch}")
    return batch


def _latest(news: DataFrame) -> DataFrame:
    """One row per (namespace, id). Spark cuts each partition to its best row before the shuffle."""
    write = F.split("b", "-")[0].cast("long")
    w = W.partitionBy("namespace", "id").orderBy(
        write.desc(), F.col("updated_at").desc(), F.col("source_seq").desc(), F.xxhash64("values", "metadata"), F.to_json("values")
    )
    return news.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn", "b")


def _read(spark: SparkSession, parent: str, part: str, names: list[str]) -> DataFrame:
    """Rows of the folders `<parent>/<part>=NAME` in one scan, `namespace` and `part` taken from the folder names."""
    schema = f"{RECORD_SCHEMA}, {part} string"
    if not names:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", parent).parquet(*[f"{parent}/{part}={name}" for name in names])


def _state(spark: SparkSession, path: str):
    """(version, description, names of the writes after its base)."""
    version, meta = _require(spark, path)
    found = _complete(spark, f"{path}/batches/v={meta['base'] or _NO_BASE}")
    return version, meta, [n.split("=", 1)[1] for n in found]


def state_token(spark: SparkSession, path: str) -> tuple:
    """What tells one state of the collection from another: names and times of its finished writes, bases and descriptions.

    Two listings; no rows are read.
    """
    version, meta = _require(spark, path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batches/v={meta['base'] or _NO_BASE}", "*=*/_SUCCESS")
    found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(folder) or []
    return version, tuple(sorted((s.getPath().getParent().getName(), s.getModificationTime()) for s in found))


class HeldCollection:
    """A collection's current rows, kept by the executors from one use to the next.

    `rows` reads the collection again only when its state has changed. What is kept is in memory or on the executors'
    disks; blocks that are lost with an executor are read again from the collection, of the same state.
    """

    def __init__(self, path: str, namespace: str | None = None):
        self.path, self.namespace = path, namespace
        self.token, self.kept, self.reads = None, None, 0

    def rows(self, spark: SparkSession) -> DataFrame:
        now = state_token(spark, self.path)
        if self.kept is None or now != self.token:
            self.release()
            self.kept = read_collection(spark, self.path, self.namespace).persist(StorageLevel.MEMORY_AND_DISK)
            self.token, self.reads = now, self.reads + 1
        return self.kept

    def release(self) -> None:
        """Drop what is kept."""
        if self.kept is not None:
            self.kept.unpersist()
            self.kept = None


def read_collection(spark: SparkSession, path: str, namespace: str | None = None) -> DataFrame:
    """The current record of each id, of all namespaces or one (read from its own folders only).

    The base is scanned once. Rows of it that were written again are left out by a join on their ids alone,
    which Spark broadcasts where the writes are small, so their vectors are not shuffled.
    """
    _, meta, fresh = _state(spark, path)
    base = _read(spark, f"{path}/base", "v", [meta["base"]] if meta["base"] else []).drop("v")
    news = _read(spark, f"{path}/batches/v={meta['base'] or _NO_BASE}", "b", fresh)
    if namespace is not None:
        base = base.where(F.col("namespace") == namespace)
        news = news.where(F.col("namespace") == namespace)
    if not fresh:
        return base
    if not meta["base"]:
        return _latest(news)
    again = news.select("namespace", "id").distinct()
    return base.join(again, ["namespace", "id"], "left_anti").unionByName(_latest(news))


def compact(spark: SparkSession, path: str) -> None:
    """Fold the writes into a new base, then publish it. Readers of the old base are not disturbed."""
    version, meta, fresh = _state(spark, path)
    if not fresh:
        return
    base = str(version + 1)
    read_collection(spark, path).write.mode("overwrite").partitionBy("namespace").parquet(f"{path}/base/v={base}")
    row = spark.createDataFrame([(meta["name"], meta["dimension"], meta["metric"], base)], _META_SCHEMA)
    row.coalesce(1).write.mode("overwrite").json(f"{path}/meta/v={version + 1}")


def vacuum(spark: SparkSession, path: str) -> None:
    """Delete bases, folded writes and descriptions older than the newest. No reader may use them any more."""
    version, meta = _require(spark, path)
    current = meta["base"] or _NO_BASE
    for folder, newest in (("base", current), ("batches", current), ("meta", str(version))):
        for name in _complete(spark, f"{path}/{folder}", done=False):
            if int(name.split("=")[1]) < int(newest):
                remove(spark, f"{path}/{folder}/{name}")


def describe_collection(spark: SparkSession, path: str) -> DataFrame:
    """Records per namespace with the collection's name, dimension and metric."""
    _, meta = _require(spark, path)
    return describe_records(read_collection(spark, path)).select(
        F.lit(meta["name"]).alias("name"),
        F.lit(meta["dimension"]).alias("dimension"),
        F.lit(meta["metric"]).alias("metric"),
        "namespace",
        "records",
        "smallest",
        "largest",
    )


def describe_records(rows: DataFrame) -> DataFrame:
    """Records and the span of their dimensions per namespace."""
    return rows.groupBy("namespace").agg(
        F.count(F.lit(1)).alias("records"),
        F.min(F.size("values")).alias("smallest"),
        F.max(F.size("values")).alias("largest"),
    )
