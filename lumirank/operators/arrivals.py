"""Grouping arrivals by count and idle gap, and counting them per period.

Rows of one key that lie in the same stretch of `idle_gap` length can never be separated by such a gap.
So the rows are first counted per key and stretch, before any shuffle, and only those counts are walked
in order. A hot key costs one count per stretch of time, not one task for all its rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumirank.plans.ordered import GROUP_ROWS, index_within, key_struct
from lumirank.plans.scratch import scratch_table


def _micros(gap: timedelta) -> int:
    return round(gap / timedelta(microseconds=1))


def _stretches(df: DataFrame, keys: Sequence[str], ts: str, gap: timedelta) -> DataFrame:
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    return (
        df.withColumn("_k", key_struct(keys))
        .withColumn("_at", at)
        .withColumn("_stretch", F.col("_at") - F.pmod(F.col("_at"), F.lit(_micros(gap))))
    )


def _counts(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("_at").isNotNull()).groupBy("_k", "_stretch").agg(
        F.min("_at").alias("_from"), F.max("_at").alias("_to"), F.count(F.lit(1)).alias("_n")
    )


def _sessions(counts: DataFrame, starts_session) -> DataFrame:
    """Stretches of each key with the running number of their session (from 1)."""
    order = W.partitionBy("_k").orderBy("_stretch")
    gap = F.col("_from") - F.lag("_to").over(order)
    return counts.withColumn("_new", F.coalesce(starts_session(gap), F.lit(True)).cast("long")).withColumn(
        "session", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0))
    )


def micro_batches(
    df: DataFrame,
    max_count: int = 50,
    idle_gap: timedelta = timedelta(seconds=5),
    keys: Sequence[str] = (),
    ts: str = "ts",
    id_col: str = "id",
    group_rows: int = GROUP_ROWS,
    tails: DataFrame | None = None,
) -> DataFrame:
    """Assign each row to a group that ends at `max_count` rows or before a gap of at least `idle_gap`.

    Adds `session` (from 1, per key), `part` (from 0, in the session) and `position` (from 0, in the
    part). Rows are taken in order of time, then id; a row without a time is in no group. `tails` (the
    keys, `last` in microseconds, `session`, `filled`) says where earlier rows of a key have left off.
    """
    rows = _stretches(df, keys, ts, idle_gap)
    counts = scratch_table(_counts(rows), "stretches")
    largest = counts.agg(F.max("_n").alias("n")).first()["n"] or 0
    counts = counts.withColumn("_base", F.lit(0).cast("long"))
    if tails is not None:
        # A tail is a stretch before all others: its rows count towards the session it ends in.
        before_all = tails.select(
            key_struct(keys).alias("_k"),
            F.lit(None).cast("long").alias("_stretch"),
            F.lit(None).cast("long").alias("_from"),
            F.col("last").alias("_to"),
            F.col("filled").alias("_n"),
            (F.col("session") - 1).alias("_base"),
        )
        counts = counts.unionByName(before_all)
    sessions = _sessions(counts, lambda gap: gap >= _micros(idle_gap))
    sessions = sessions.withColumn("session", F.col("session") + F.max("_base").over(W.partitionBy("_k")))
    before = W.partitionBy("_k", "session").orderBy("_stretch").rowsBetween(W.unboundedPreceding, -1)
    offsets = sessions.select("_k", "_stretch", "session", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    placed = index_within(rows, ["_at", id_col], ["_k", "_stretch"], "_i", group_rows, largest)
    place = F.col("_before") + F.col("_i")
    return (
        placed.join(offsets, ["_k", "_stretch"], "left")
        .withColumn("part", F.floor(place / F.lit(max_count)).cast("long"))
        .withColumn("position", place % F.lit(max_count))
        .select(*df.columns, "session", "part", "position")
    )


def session_windows(
    df: DataFrame, gap: timedelta, keys: Sequence[str] = (), ts: str = "ts"
) -> DataFrame:
    """Sessions of each key as Spark's `session_window` has them: rows exactly `gap` apart share one.

    Returns the keys, `session_start`, `session_end` (last row + gap) and `arrivals`.
    """
    rows = _stretches(df, keys, ts, gap)
    sessions = _sessions(_counts(rows), lambda between: between > _micros(gap))
    return (
        sessions.groupBy("_k", "session")
        .agg(F.min("_from").alias("_from"), F.max("_to").alias("_to"), F.sum("_n").alias("arrivals"))
        .select(
            *[F.col(f"_k.{k}").alias(k) for k in keys],
            F.timestamp_micros("_from").alias("session_start"),
            F.timestamp_micros(F.col("_to") + F.lit(_micros(gap))).alias("session_end"),
            "arrivals",
        )
    )


def throughput(df: DataFrame, every: timedelta = timedelta(seconds=5), ts: str = "ts") -> DataFrame:
    """Arrivals per second in each period from the first to the last arrival, empty periods included."""
    return fill_periods(period_counts(df, every, ts), every)


def period_counts(df: DataFrame, every: timedelta, ts: str = "ts") -> DataFrame:
    """Arrivals per period that has any (batch or stream)."""
    time = F.col(ts)
    if not isinstance(df.schema[ts].dataType, T.TimestampType):
        time = time.cast("timestamp")  # a cast would hide a stream's watermark
    window = F.window(time, f"{_micros(every)} microseconds")
    return df.groupBy(window.alias("w")).agg(F.count(F.lit(1)).alias("arrivals")).select(
        F.col("w.start").alias("period_start"), "arrivals"
    )


def fill_periods(counts: DataFrame, every: timedelta) -> DataFrame:
    """Add the periods without arrivals between the first and the last, and the rate."""
    step = _micros(every)
    at = F.unix_micros("period_start")
    span = counts.agg(F.min(at).alias("low"), F.max(at).alias("high")).first()
    spark = counts.sparkSession
    if span["low"] is None:
        spine = spark.range(0)
    else:
        spine = spark.range(span["low"], span["high"] + 1, step)
    found = counts.select(at.alias("_p"), "arrivals")
    n = F.coalesce("arrivals", F.lit(0))
    return spine.join(found, F.col("id") == F.col("_p"), "left").select(
        F.timestamp_micros("id").alias("period_start"), n.alias("arrivals"), (n / F.lit(step / 1e6)).alias("rate")
    )
