"""Message streams: a Kafka topic, or a directory of files with the same columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumirank.operators.envelopes import ENVELOPE_SCHEMA


def kafka_options(servers: str, topics: str | Sequence[str], starting: str = "earliest", **more) -> dict:
    """Options of Spark's Kafka source for one topic or several."""
    names = topics if isinstance(topics, str) else ",".join(topics)
    return {
        "kafka.bootstrap.servers": servers,
        "subscribe": names,
        "startingOffsets": starting,
        "includeHeaders": "true",
        **more,
    }


def read_envelopes(
    spark: SparkSession,
    fmt: str,
    options: dict | None = None,
    path: str | None = None,
    topics: str | Sequence[str] | None = None,
    streaming: bool = True,
) -> DataFrame:
    """Messages from the earliest on: `fmt` "kafka" with `kafka_options`, or a file format and a path.

    `topics` picks the topics out of files; a Kafka source is subscribed to them by its options.
    """
    reader = (spark.readStream if streaming else spark.read).format(fmt).options(**(options or {}))
    if fmt == "kafka":
        return reader.load()
    # Named batches lie in folders of their own.
    messages = reader.schema(ENVELOPE_SCHEMA).option("recursiveFileLookup", "true").load(path)
    if topics is None:
        return messages
    return messages.where(F.col("topic").isin([topics] if isinstance(topics, str) else list(topics)))
