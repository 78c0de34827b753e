"""Throughput series and request outcomes of a run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumirank.plans.ordered import GROUP_ROWS, index_within, with_halo

# The pattern of a throughput line, and the text of the statistics.
THROUGHPUT = r"Throughput:\s+(\d+\.\d+)\s+requests/sec"
STATS_FORMAT = "Max: %.2f req/sec\nMin: %.2f req/sec\nAvg: %.2f req/sec"


def extract_throughput(lines: DataFrame, line: str = "line") -> DataFrame:
    """Lines that report a throughput, with the number as `throughput`."""
    return (
        lines.withColumn("_found", F.regexp_extract(line, THROUGHPUT, 1))
        .where(F.col("_found") != "")
        .withColumn("throughput", F.col("_found").cast("double"))
        .drop("_found", line)
    )


def moving_average(
    series: DataFrame,
    width: int = 5,
    order_by: str = "line_number",
    value: str = "throughput",
    group_by: Sequence[str] = (),
    block_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Mean of each point and the `width` - 1 before it; only full windows.

    A series of fewer points has one window of all its points, a single point has none.
    """
    keys = list(group_by)
    points = index_within(series.select(*keys, order_by, value), [order_by], keys, "_i", block_rows)
    blocks = with_halo(points, "_i", width - 1, block_rows)
    at = W.partitionBy(*keys, "_block").orderBy("_i")
    short_and_last = F.lead("_i").over(at).isNull() & (F.col("_i") < width - 1) & (F.col("_i") > 0)
    return (
        blocks.withColumn("moving_average", F.avg(value).over(at.rowsBetween(1 - width, 0)))
        .withColumn("_full", (F.col("_i") >= width - 1) | short_and_last)
        .where(F.col("_full") & ~F.col("_halo") & F.lit(width > 1))
        .select(*keys, order_by, "moving_average")
    )


def throughput_stats(series: DataFrame, value: str = "throughput", group_by: Sequence[str] = ()) -> DataFrame:
    """Average, largest and smallest value with a text of them; no row for an empty series."""
    stats = (
        series.groupBy(*group_by)
        .agg(
            F.count(value).alias("points"),
            F.avg(value).alias("average"),
            F.max(value).alias("largest"),
            F.min(value).alias("smallest"),
        )
        .where(F.col("points") > 0)
    )
    text = F.format_string(STATS_FORMAT, "largest", "smallest", "average")
    return stats.withColumn("stats_text", text)


def run_summary(
    outcomes: DataFrame,
    success: Column | None = None,
    time: str = "ts",
    group_by: Sequence[str] = (),
) -> DataFrame:
    """Requests, successes, failures, seconds from first to last and requests per second."""
    ok = F.col("success") if success is None else success
    seconds = (F.unix_micros(F.max(F.col(time).cast("timestamp"))) - F.unix_micros(F.min(F.col(time).cast("timestamp")))) / 1e6
    return (
        outcomes.groupBy(*group_by)
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(ok).alias("successes"),
            F.count_if(~ok).alias("failures"),
            seconds.alias("duration_s"),
        )
        .withColumn("requests_per_s", F.when(F.col("duration_s") > 0, F.col("total") / F.col("duration_s")))
    )


def failure_breakdown(outcomes: DataFrame, success: Column | None = None, group_by: Sequence[str] = ()) -> DataFrame:
    """Failed requests by status code or error text."""
    ok = F.col("success") if success is None else success
    return outcomes.where(~ok).groupBy(*group_by, "error_info").agg(F.count(F.lit(1)).alias("failures"))


def batch_assign(queries: DataFrame, order_by: Sequence[str], size: int = 50) -> DataFrame:
    """Number the queries in order and put each `size` of them into one batch."""
    return index_within(queries, order_by, name="position").withColumn(
        "batch", F.floor(F.col("position") / F.lit(size)).cast("long")
    )


def batch_count(queries: DataFrame, size: int = 50) -> DataFrame:
    """Queries and the number of batches they fill."""
    return queries.agg(F.count(F.lit(1)).alias("queries")).withColumn(
        "batches", F.ceil(F.col("queries") / F.lit(size)).cast("long")
    )
