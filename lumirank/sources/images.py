"""Image directories and the small projections on their rows."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumirank.plans.scratch import qualified, waiting_files

IMAGE_SCHEMA = "image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"


FOLDER_FILES = 1000  # files of one folder that a task writes
BACKLOG_FILES = 40_000  # waiting files that are left to one stream, whose driver lists and remembers all of them

# For many small files: a task reads as many as there is work for, listing takes a few tasks instead of one a file, and
# the driver does not keep what it has listed.
_SMALL_FILES_CONF = {
    "spark.sql.files.openCostInBytes": str(64 << 10),
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "64",
    "spark.sql.hive.filesourcePartitionFileCacheSize": "0",
}


def write_image_files(rows: DataFrame, path: str, name: str = "name", data: str = "data") -> None:
    """Write one file per row under `path`, by the executors: named by a string column, filled by a binary one.

    On a folder that the executors mount, files lie a thousand to a folder, so that listing them takes a task per thousand;
    rows of one name get a file each. Elsewhere Spark writes them, in a folder per name.
    """
    some = rows.select(F.col(name).alias("name"), F.col(data).alias("data"))
    spark = rows.sparkSession
    where = qualified(spark, path)
    if not where.startswith("file:"):
        some.select(F.col("data").cast("string").alias("value"), "name").write.partitionBy("name").text(path)
        return
    root = "/" + where.removeprefix("file:").lstrip("/")

    def write(found) -> None:
        task, last, same = TaskContext.get().partitionId(), None, 0
        for n, row in enumerate(found):
            if n % FOLDER_FILES == 0:
                folder = f"{root}/{task}-{n // FOLDER_FILES}"
                os.makedirs(folder, exist_ok=True)
            # A task that is run again writes the same files.
            last, same = row.name, same + 1 if row.name == last else 0
            stem, end = os.path.splitext(row.name)
            with open(f"{folder}/name={stem}{f'-{same}' if same else ''}{end}", "wb") as file:
                file.write((row.data or b"") + b"\n")

    tasks = 4 * spark.sparkContext.defaultParallelism
    some.repartition(tasks, "name").sortWithinPartitions("name", "data").foreachPartition(write)


def read_images(
    spark: SparkSession, path: str, drop_invalid: bool = False, glob: str | None = None, recursive: bool = False
) -> DataFrame:
    """A directory of images; a file that is no image has height -1 unless `drop_invalid`."""
    reader = spark.read.format("image").option("dropInvalid", drop_invalid)
    if recursive:
        reader = reader.option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def read_image_stream(
    spark: SparkSession, path: str, drop_invalid: bool = False, files_per_trigger: int = 1000, most_triggers: int | None = None
) -> DataFrame:
    """A directory that keeps receiving images, as a stream.

    With `most_triggers` the files that are there already are counted, and a trigger takes more than `files_per_trigger` of
    them where they would need more micro-batches than that: each one costs a look at all files that were seen. The
    driver remembers every file of a stream; see `image_backlogs`.
    """
    if most_triggers:
        waiting = sum(n for _, n in waiting_files(spark, path))
        files_per_trigger = max(files_per_trigger, -(-waiting // most_triggers))
    return (
        spark.readStream.format("image")
        .schema(IMAGE_SCHEMA)
        .option("dropInvalid", drop_invalid)
        .option("maxFilesPerTrigger", files_per_trigger)
        .load(path)
    )


def image_backlogs(
    spark: SparkSession, path: str, most_triggers: int | None = None, most_files: int = BACKLOG_FILES
) -> list[tuple[str, int | None]]:
    """The folders right under a folder in groups for a stream each: a pattern, and its share of `most_triggers`, one at least.

    A group holds at most `most_files` files, or one folder. Streams that take one group after the other list and
    remember as many files on the driver as one of them has, however many wait.
    """
    found = [(name, n) for name, n in waiting_files(spark, f"{path}/*") if n]
    groups, room = [], 0
    for name, n in found:
        if n > room:
            groups.append([])
            room = most_files
        groups[-1].append((name, n))
        room -= n
    total = sum(n for _, n in found)
    out = []
    for group in groups:
        names = ",".join(re.sub(r"([][{}*?,^\\])", r"\\\1", name) for name, _ in group)
        share = most_triggers and max(1, most_triggers * sum(n for _, n in group) // total)
        out.append((f"{path}/{{{names}}}", share))
    return out


@contextmanager
def small_files(spark: SparkSession) -> Iterator[None]:
    """Settings for reading many small files; a stream keeps those it is started with."""
    before = {key: spark.conf.get(key, None) for key in _SMALL_FILES_CONF}
    for key, value in _SMALL_FILES_CONF.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def strip_pixels(df: DataFrame) -> DataFrame:
    """Drop the pixel bytes from the image struct."""
    return df.withColumn("image", F.col("image").dropFields("data"))


def with_image_path(df: DataFrame) -> DataFrame:
    return df.withColumn("image_path", F.col("image.origin"))


def with_preprocess_time(df: DataFrame, time: Column | None = None) -> DataFrame:
    """Stamp the rows: one time per query or micro-batch, or the given column."""
    return df.withColumn("preprocess_time", F.current_timestamp() if time is None else time)
