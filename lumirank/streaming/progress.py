"""Reports of a running stream, one row per micro-batch, as it goes."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

COLUMNS = "query string, batch long, at string, messages long, errors long, bytes long"


class DeliveryReports(StreamingQueryListener):
    """Writes what `observe_delivery` counts in a stream under `path`, one small table per micro-batch.

    Add it with `spark.streams.addListener`. The stream carries the counters itself (`observe_delivery` under the same
    `name`), so nothing is counted twice. A micro-batch that runs again replaces its report; a stream that is
    started again with its checkpoint goes on under the same id. Reports of micro-batches without rows are left out.
    """

    def __init__(self, spark: SparkSession, path: str, name: str = "delivery"):
        self.spark, self.path, self.name = spark, path, name
        self.written: set[tuple[str, int]] = set()
        self._changed = threading.Condition()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        run, seen = str(progress.id), progress.observedMetrics.get(self.name)
        if seen is not None and seen["messages"]:
            row = Row(run, progress.batchId, progress.timestamp, seen["messages"], seen["errors"], seen["bytes"])
            report = self.spark.createDataFrame([row], COLUMNS).coalesce(1)
            report.write.mode("overwrite").parquet(f"{self.path}/b={run}-{progress.batchId}")
        with self._changed:
            self.written.add((run, progress.batchId))
            self._changed.notify_all()

    def wait(self, query: StreamingQuery, seconds: float = 60) -> None:
        """Wait until the last micro-batch of a stream that has ended is reported."""
        last = query.lastProgress
        if last is None:
            return
        with self._changed:
            if not self._changed.wait_for(lambda: (str(query.id), last["batchId"]) in self.written, seconds):
                raise TimeoutError("the last micro-batch was not reported")


def reports(spark: SparkSession, path: str) -> DataFrame:
    """The reports so far: query, batch, at, messages, errors, bytes."""
    return spark.read.schema(COLUMNS).option("recursiveFileLookup", True).parquet(path)


def totals(reported: DataFrame) -> DataFrame:
    """Messages, errors and bytes of all reports."""
    return reported.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("messages", "errors", "bytes")])
