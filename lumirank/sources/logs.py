"""Text logs as numbered lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the text files at `path` with their 1-based number in their own file.

    A large file is read in splits. A first pass counts the lines of each split; the second adds the number of lines
    before it, and nothing is written or sorted in between. Both passes go over one listing of the files, which fixes the splits and how
    they are dealt to tasks, so a line has the same place in both, and what is appended meanwhile is in neither. A
    filter on the lines, such as that of `extract_throughput`, runs in the scan, before the join with the counts.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_seq"),
        "value",
    )
    splits = lines.groupBy("file", "_start").agg(F.min("_seq").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("file").orderBy("_start").rowsBetween(W.unboundedPreceding, -1)
    splits = splits.select(
        "file", "_start", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift")
    )
    return lines.join(splits, ["file", "_start"]).select(
        "file", (F.col("_seq") + F.col("_shift") + 1).alias("line_number"), F.col("value").alias("line")
    )
