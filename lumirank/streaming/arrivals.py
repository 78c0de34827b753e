"""Grouping and counting of arrivals as they come, by event time.

Rows later than the watermark are dropped by Spark; what the watermark has not passed yet is withheld. Where a
stream has ended, `final_sessions`, `final_period_counts` and `final_micro_batches` give what is withheld, as if
the stream stayed idle: they read the state under its checkpoint and change neither. A stream that goes on
afterwards emits those rows itself, so take them only once it is over.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence
from datetime import timedelta
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from lumirank.operators.arrivals import fill_periods, micro_batches, period_counts
from lumirank.plans.scratch import folders, remove
from lumirank.streaming.run import batch_name, consume

# The process in which Spark checks a stateful operator does not get added files: send the class itself.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _micros(gap: timedelta) -> int:
    return round(gap / timedelta(microseconds=1))


def with_event_time(stream: DataFrame, ts: str, delay: str) -> DataFrame:
    """Cast `ts` to a time a watermark accepts and set the watermark."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def drop_repeats(stream: DataFrame, id_cols: Sequence[str], ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Keep the first row of each id among rows no further apart than the watermark delay."""
    return with_event_time(stream, ts, delay).dropDuplicatesWithinWatermark(list(id_cols))


def session_windows_stream(
    stream: DataFrame, gap: timedelta, keys: Sequence[str] = (), ts: str = "ts", delay: str = "0 seconds"
) -> DataFrame:
    """Sessions the watermark has closed; in append mode each comes out once."""
    window = F.session_window(ts, f"{_micros(gap)} microseconds")
    return (
        with_event_time(stream, ts, delay)
        .groupBy(*keys, window.alias("w"))
        .agg(F.count(F.lit(1)).alias("arrivals"))
        .select(*keys, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "arrivals")
    )


def period_counts_stream(
    stream: DataFrame, every: timedelta = timedelta(seconds=5), ts: str = "ts", delay: str = "0 seconds"
) -> DataFrame:
    """Arrivals per period that has any. Empty periods are filled in at read time by `fill_periods`."""
    return period_counts(with_event_time(stream, ts, delay), every, ts)


#: Of the two stateful steps of `throughput_live`, the one that counts.
_COUNTS = 1


def _state(spark: SparkSession, checkpoint: str, variable: str | None = None, operator: int = 0) -> DataFrame:
    reader = spark.read.format("statestore").option("operatorId", operator)
    return (reader.option("stateVarName", variable) if variable else reader).load(checkpoint)


def final_sessions(spark: SparkSession, checkpoint: str, keys: Sequence[str] = ()) -> DataFrame:
    """The sessions `session_windows_stream` still holds open, in its columns."""
    value = F.col("value")
    window = value["session_window"]
    return _state(spark, checkpoint).select(
        *[value[k].alias(k) for k in keys],
        window["start"].alias("session_start"),
        window["end"].alias("session_end"),
        value["count"].alias("arrivals"),
    )


def final_period_counts(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The periods `period_counts_stream` has not emitted, in its columns."""
    return _state(spark, checkpoint).select(
        F.col("key.window.start").alias("period_start"), F.col("value.count").alias("arrivals")
    )


def final_live_periods(spark: SparkSession, checkpoint: str, emitted: DataFrame, every: timedelta) -> DataFrame:
    """The periods `throughput_live` has not emitted, given those it has: what was counted, and the empty ones before it."""
    waiting = _state(spark, checkpoint, operator=_COUNTS).select(
        F.col("key.window.start").alias("period_start"), F.col("value.count").alias("arrivals")
    )
    last = emitted.agg(F.max("period_start").alias("period_start"))
    known = last.where("period_start IS NOT NULL").select("period_start", F.lit(0).cast("long").alias("arrivals"))
    rest = fill_periods(known.unionByName(waiting), every).select("period_start", "arrivals")
    return rest.join(F.broadcast(known.select("period_start")), "period_start", "left_anti")  # one row


def final_micro_batches(
    spark: SparkSession,
    checkpoint: str,
    max_count: int = 50,
    idle_gap: timedelta = timedelta(seconds=5),
    keys: Sequence[str] = (),
    by_first: bool = False,
) -> DataFrame:
    """The rows `micro_batches_stream` still holds back, placed where each key's last group stands."""
    names = [F.col("key")[k].alias(k) for k in keys]
    waiting = _state(spark, checkpoint, "waiting").select(
        *names, F.explode(F.arrays_zip("list_element.ids", "list_element.ats")).alias("row")
    )
    rows = waiting.select(*keys, F.col("row.ids").alias("id"), F.timestamp_micros("row.ats").alias("ts"))
    tails = _state(spark, checkpoint, "tail").select(*names, "value.last", "value.session", "value.filled")
    columns = [*keys, "id", "ts", "session", "part", "position"]
    if not by_first:
        return micro_batches(rows, max_count, idle_gap, keys, tails=tails).select(*columns)
    # The numbers tell sessions apart: 1 is the one a tail stands in, which has its name; the others are named by their first row.
    placed = micro_batches(rows, max_count, idle_gap, keys, tails=tails.withColumn("session", F.lit(1).cast("long")))
    named = tails.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("session").alias("_named"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    of_session = W.partitionBy(*keys, "session")
    first = F.min(F.unix_micros(F.col("ts").cast("timestamp"))).over(of_session)
    out = placed.join(named, reduce(and_, same), "left")
    session = F.when((F.col("session") == 1) & F.col("_named").isNotNull(), F.col("_named")).otherwise(first)
    return out.withColumn("session", session).select(*columns)


class _Grouper(StatefulProcessor):
    """Keeps, per key, the rows the watermark has not passed and where the last group stands.

    Where sessions are named by their first arrival, the latter goes too, once the watermark is so far past the last row that
    the next one starts a session of its own.
    """

    def __init__(self, max_count: int, gap: int, by_first: bool = False):
        self.max_count, self.gap, self.by_first = max_count, gap, by_first

    def init(self, handle) -> None:
        self.handle = handle
        # One value per trigger, not per row: each value costs a call to the JVM.
        self.waiting = handle.getListState("waiting", "ids array<long>, ats array<long>")
        self.tail = handle.getValueState("tail", "last long, filled long, session long")

    def handleInputRows(self, key, rows, timerValues):
        earliest = None
        for pdf in rows:
            micros = pdf["micros"].to_numpy()
            self.waiting.appendValue((pdf["row_id"].tolist(), micros.tolist()))
            first = int(micros.min())
            earliest = first if earliest is None else min(earliest, first)
        if earliest is not None:
            self.handle.registerTimer(earliest // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        parts = list(self.waiting.get())
        ids = np.concatenate([np.array(p[0], np.int64) for p in parts] or [np.empty(0, np.int64)])
        ats = np.concatenate([np.array(p[1], np.int64) for p in parts] or [np.empty(0, np.int64)])
        order = np.lexsort((ids, ats))
        ids, ats = ids[order], ats[order]
        n = int(np.searchsorted(ats, passed))
        if n == 0:
            if self.by_first and self.tail.exists():
                over = self.tail.get()[0] + self.gap
                if over <= passed and (not len(ats) or ats[0] >= over):
                    self.tail.clear()
            return
        if n == len(ats):
            self.waiting.clear()
        else:
            self.waiting.put([(ids[n:].tolist(), ats[n:].tolist())])
            self.handle.registerTimer(int(ats[n]) // 1000 + 1)
        ids, ats = ids[:n], ats[:n]
        last, filled, session = self.tail.get() if self.tail.exists() else (None, 0, 0)

        starts = np.empty(n, dtype=bool)
        starts[0] = last is None or ats[0] - last >= self.gap
        starts[1:] = np.diff(ats) >= self.gap
        number = np.cumsum(starts)
        begin = np.maximum.accumulate(np.where(starts, np.arange(n), 0))  # where each row's session starts
        place = np.arange(n) - begin + np.where(number == 0, filled, 0)
        number = np.where(number == 0, session, ats[begin]) if self.by_first else session + number
        self.tail.update((int(ats[-1]), int(place[-1]) + 1, int(number[-1])))
        if self.by_first:
            self.handle.registerTimer((int(ats[-1]) + self.gap) // 1000 + 1)
        columns = {name: [value] * n for name, value in zip(self.keys, key)}
        columns["id"] = ids
        columns["ts"] = pd.to_datetime(ats, unit="us", utc=True)
        columns["session"], columns["part"], columns["position"] = number, place // self.max_count, place % self.max_count
        yield pd.DataFrame(columns)

    def close(self) -> None:
        pass


class _Zeros(StatefulProcessor):
    """Passes counted periods on and adds those without arrivals, once the watermark has passed them."""

    def __init__(self, every: int):
        self.every = every  # milliseconds

    def init(self, handle) -> None:
        self.handle = handle
        self.next = handle.getValueState("next", "start long")

    def handleInputRows(self, key, rows, timerValues):
        counted = pd.concat(list(rows), ignore_index=True).sort_values("start")
        starts = counted["start"].to_numpy()
        at = self.next.get()[0] if self.next.exists() else int(starts[0])
        every = np.arange(at, int(starts[-1]) + self.every, self.every)
        counts = np.zeros(len(every), np.int64)
        # Periods come closed and in order: one that is late could only be one that was given as empty.
        fresh = starts >= at
        counts[(starts[fresh] - at) // self.every] = counted["arrivals"].to_numpy()[fresh]
        yield self._rows(every, counts)
        self._wait(int(starts[-1]) + self.every)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        at, passed = self.next.get()[0], timerValues.getCurrentWatermarkInMs()
        empty = np.arange(at, passed - self.every + 1, self.every)
        if len(empty):
            yield self._rows(empty, np.zeros(len(empty), np.int64))
            at = int(empty[-1]) + self.every
        self._wait(at)

    def _wait(self, at: int) -> None:
        self.next.update((at,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        # Past the end of the next period, and of its rows, which come when the watermark is at that end.
        self.handle.registerTimer(at + self.every + 1)

    def _rows(self, starts: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"period_start": pd.to_datetime(starts, unit="ms", utc=True), "arrivals": counts})

    def close(self) -> None:
        pass


def throughput_live(
    stream: DataFrame, every: timedelta = timedelta(seconds=5), ts: str = "ts", delay: str = "0 seconds"
) -> DataFrame:
    """Arrivals per period, empty periods included, each as soon as the watermark has passed it: period_start, arrivals.

    Rows are counted where they are; one task then sees a row per period. Periods begin with the first
    one that has arrivals; those after the last one come as far as the watermark gets.
    """
    if every % timedelta(milliseconds=1):
        raise ValueError("periods are whole milliseconds")
    counted = period_counts_stream(stream, every, ts, delay).select(
        F.lit(0).alias("all"), "period_start", F.unix_millis("period_start").alias("start"), "arrivals"
    )
    return counted.groupBy("all").transformWithStateInPandas(
        statefulProcessor=_Zeros(every // timedelta(milliseconds=1)), outputStructType="period_start timestamp, arrivals long",
        outputMode="Append", timeMode="EventTime",
    )


def micro_batches_stream(
    stream: DataFrame,
    max_count: int = 50,
    idle_gap: timedelta = timedelta(seconds=5),
    keys: Sequence[str] = (),
    ts: str = "ts",
    id_col: str = "id",
    delay: str = "0 seconds",
    by_first: bool = False,
) -> DataFrame:
    """The streaming form of `micro_batches`: keys, id, ts, session, part and position of each row.

    Sessions of a key are numbered, for which every key that ever came stays in the state. With `by_first`, `session`
    is the time of the session's first row in microseconds instead, and a key's state goes once the watermark is an
    idle gap past its last row: the state holds the keys of late, however many there have been.

    Keys are needed: without any, one task and one state would hold the whole stream. A row comes out when
    the watermark has passed it. State holds ids and times of waiting rows only, so
    a key's state is bounded by its rows within `delay` and one trigger; bound the latter at the source.
    Where one key may fill a trigger, use `micro_batches_to_files`: it spreads a key over all tasks.
    """
    if not keys:
        raise ValueError("give keys, or use micro_batches_to_files, which spreads a stream without keys over all tasks")
    rows = with_event_time(stream, ts, delay)
    names = list(keys)
    grouper = _Grouper(max_count, _micros(idle_gap), by_first)
    grouper.keys = names
    key_fields = [rows.schema[n] for n in names]
    out = T.StructType(
        [
            *key_fields,
            T.StructField("id", T.LongType()),
            T.StructField("ts", T.TimestampType()),
            T.StructField("session", T.LongType()),
            T.StructField("part", T.LongType()),
            T.StructField("position", T.LongType()),
        ]
    )
    slim = rows.select(
        *names, ts, F.col(id_col).cast("long").alias("row_id"), F.unix_micros(F.col(ts)).alias("micros")
    )
    return slim.groupBy(*names).transformWithStateInPandas(
        statefulProcessor=grouper, outputStructType=out, outputMode="Append", timeMode="EventTime"
    )


def micro_batches_to_files(
    stream: DataFrame,
    out: str,
    state: str,
    checkpoint: str,
    max_count: int = 50,
    idle_gap: timedelta = timedelta(seconds=5),
    keys: Sequence[str] = (),
    ts: str = "ts",
    id_col: str = "id",
    delay: timedelta = timedelta(0),
    available_now: bool = False,
    final: bool = False,
) -> StreamingQuery:
    """`micro_batches` on a stream, for keys of any size: rows go to `<out>/b=NAME` per micro-batch.

    Each micro-batch runs the batch plan on the rows the watermark has passed. What it hands on (rows still
    waiting, and where each key has left off) is written under the micro-batch's name, so a micro-batch that
    is run again starts from the same state; older states are deleted. `final`, for a stream that reads
    what there is and ends, waits for its end and then closes the rows that still wait, as if the stream
    would stay idle: they go to `<out>/b=RUN-final`.
    """
    if final and not available_now:
        raise ValueError("only a stream that ends has final rows: set available_now")
    names = list(keys)

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        run = batch_name(batch, batch_id).rsplit("-", 1)[0]
        here, before = f"{state}/{run}/n={batch_id}", f"{state}/{run}/n={batch_id - 1}"
        time = F.unix_micros(F.col(ts).cast("timestamp"))
        fields = [batch.schema[name] for name in [*names, id_col, ts]]
        rows = batch.select(*names, id_col, ts).where(time.isNotNull())
        tail_type = T.StructType(
            [*fields[: len(names)], *[T.StructField(c, T.LongType()) for c in ("last", "session", "filled")]]
        )
        tails, mark = None, None
        if batch_id > 0:
            mark = spark.read.schema("mark long").parquet(f"{before}/mark").first()["mark"]
            tails = spark.read.schema(tail_type).parquet(f"{before}/tails")
            waiting = spark.read.schema(T.StructType(fields)).parquet(f"{before}/waiting")
            rows = (rows if mark is None else rows.where(time >= mark)).unionByName(waiting)
        high = rows.agg(F.max(time).alias("high")).first()["high"]
        if high is not None:
            passed = (high - _micros(delay)) // 1000 * 1000
            mark = passed if mark is None else max(mark, passed)
        ready = rows.where(F.lit(False) if mark is None else time < mark)
        placed = f"{out}/b={run}-{batch_id}"
        micro_batches(ready, max_count, idle_gap, names, ts, id_col, tails=tails).write.mode("overwrite").parquet(placed)

        done = spark.read.parquet(placed).select(
            *names, time.alias("last"), "session", (F.col("part") * max_count + F.col("position") + 1).alias("filled")
        )
        ends = (done if tails is None else done.unionByName(tails)).groupBy(*names).agg(
            F.max("last").alias("last"), F.max(F.struct("session", "filled")).alias("at")
        )
        ends = ends.where(F.col("last").isNotNull()).select(*names, "last", "at.session", "at.filled")
        ends.write.mode("overwrite").parquet(f"{here}/tails")
        rows.where(F.lit(True) if mark is None else time >= mark).write.mode("overwrite").parquet(f"{here}/waiting")
        spark.createDataFrame([(mark,)], "mark long").coalesce(1).write.mode("overwrite").parquet(f"{here}/mark")
        if batch_id > 1:
            remove(spark, f"{state}/{run}/n={batch_id - 2}")

    query = consume(stream, handle, checkpoint, available_now)
    if not final:
        return query
    query.awaitTermination()
    spark, run = stream.sparkSession, str(query.id)
    last = max((int(n.split("=")[1]) for n in folders(spark, f"{state}/{run}")), default=None)
    if last is not None:
        here = f"{state}/{run}/n={last}"
        waiting = spark.read.schema(T.StructType([stream.schema[c] for c in [*names, id_col, ts]])).parquet(f"{here}/waiting")
        longs = [T.StructField(c, T.LongType()) for c in ("last", "session", "filled")]
        tails = spark.read.schema(T.StructType([*[stream.schema[c] for c in names], *longs])).parquet(f"{here}/tails")
        closed = micro_batches(waiting, max_count, idle_gap, names, ts, id_col, tails=tails)
        closed.write.mode("overwrite").parquet(f"{out}/b={run}-final")
    return query
