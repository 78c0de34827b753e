"""Starting streams: a handler per micro-batch, or rows appended to files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


def _trigger(writer, available_now: bool, every: str | None):
    if available_now:
        return writer.trigger(availableNow=True)
    return writer.trigger(processingTime=every) if every else writer


def consume(
    stream: DataFrame,
    handler: Callable[[DataFrame, int], None],
    checkpoint: str,
    available_now: bool = False,
    every: str | None = None,
) -> StreamingQuery:
    """Call `handler(rows, batch_id)` for each micro-batch; progress is kept once it has returned.

    With its checkpoint a stream resumes; with a new checkpoint it starts from the earliest row again.
    """
    writer = stream.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint)
    return _trigger(writer, available_now, every).start()


def batch_name(batch: DataFrame, batch_id: int) -> str:
    """A name for a micro-batch: the same when it is run again, another for another checkpoint."""
    run = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
    if not run:
        raise RuntimeError("not inside a micro-batch")
    return f"{run}-{batch_id}"


def to_files(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    mode: str = "append",
    available_now: bool = True,
    every: str | None = None,
) -> StreamingQuery:
    """Append the rows of a stream to parquet files."""
    writer = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint)
    return _trigger(writer.option("path", path), available_now, every).start()


class _WhenOver(StreamingQueryListener):
    def __init__(self, spark: SparkSession, run_id: str, act: Callable[[], None]):
        self.spark, self.run_id, self.act = spark, run_id, act

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if str(event.runId) == self.run_id:
            self.act()


def when_over(spark: SparkSession, query: StreamingQuery, act: Callable[[], None]) -> None:
    """Call `act` once the stream has ended, whether or not it failed."""
    spark.streams.addListener(_WhenOver(spark, str(query.runId), act))
    if not query.isActive:
        act()
