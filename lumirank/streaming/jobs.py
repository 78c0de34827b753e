"""End-to-end streams: messages into a collection, queries to answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lumirank.operators.embedding import ColumnEmbedder, Embedder, embed_images
from lumirank.operators.envelopes import FORMAT_BASE64, decode_rows, observe_delivery, readable_rows
from lumirank.operators.validate import split_rejects
from lumirank.plans.ingest import answer_queries
from lumirank.sources import collection
from lumirank.streaming.run import batch_name, consume, when_over

COUNTERS = "messages long, errors long, bytes long"


def ingest_batch(
    messages: DataFrame,
    schema: T.StructType,
    path: str,
    embedder: Embedder | None,
    name: str,
    namespace: str | Column = collection.DEFAULT_NAMESPACE,
    rejects_path: str | None = None,
    fmt: str = FORMAT_BASE64,
    size: int = 224,
    id_col: Column | None = None,
) -> None:
    """Decode one batch of messages, embed the good rows, upsert them under `name`, keep the rejects.

    A payload has `image` (with `origin`), `tensors` and `preprocess_time`. Without an embedder the
    tensors are taken for embeddings already. A message that cannot be read, or whose tensor has another
    length or a null in it, is a reject and nothing else.
    """
    spark = messages.sparkSession
    decoded = decode_rows(messages, schema, fmt)
    readable, unreadable = readable_rows(decoded)
    order = F.coalesce("offset", F.lit(0)) if "offset" in messages.columns else F.lit(0)
    flat = readable.select("row.*", order.alias("_offset"))
    expected = collection.dimension(spark, path) if embedder is None else 3 * size * size
    good, bad = split_rejects(flat, size=expected)
    if embedder is not None:
        good = embed_images(good, embedder, size=size)
    vector = F.col("tensors" if embedder is None else "embedding")
    rows = collection.records(
        good, F.col("image.origin"), vector, F.col("preprocess_time"), F.col("_offset"), id_col=id_col
    )
    collection.upsert(spark, path, rows, namespace, batch=name)
    if rejects_path:
        rejects = bad.select(F.col("image.origin").alias("origin"), "reason").unionByName(
            unreadable.select(F.lit(None).cast("string").alias("origin"), "reason")
        )
        rejects.write.mode("overwrite").parquet(f"{rejects_path}/b={name}")


def ingest_stream(
    messages: DataFrame,
    schema: T.StructType,
    path: str,
    embedder: Embedder | None,
    checkpoint: str,
    available_now: bool = False,
    compact_every: int | None = None,
    **options,
) -> StreamingQuery:
    """Messages → vectors → collection. A batch that is run again replaces what it wrote.

    With `compact_every`, every so many batches are folded into the base before the next one, so a read
    never has more of them to settle.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        if compact_every and batch_id and batch_id % compact_every == 0:
            collection.compact(batch.sparkSession, path)
        ingest_batch(batch, schema, path, embedder, batch_name(batch, batch_id), **options)

    return consume(messages, handle, checkpoint, available_now)


def count_delivery(
    messages: DataFrame,
    schema: T.StructType,
    out: str,
    counters: str,
    checkpoint: str,
    fmt: str = FORMAT_BASE64,
    available_now: bool = False,
) -> StreamingQuery:
    """Decode a stream of messages into files under `out` and count each micro-batch under `counters`.

    A micro-batch has one row of counters, under its own name: run again, it replaces that row, and no
    number of micro-batches is too large. `delivered` adds them up.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        name, seen = batch_name(batch, batch_id), Observation()
        decoded = observe_delivery(decode_rows(batch, schema, fmt), seen)
        decoded.write.mode("overwrite").parquet(f"{out}/b={name}")
        row = batch.sparkSession.createDataFrame([Row(**seen.get)], COUNTERS)
        row.coalesce(1).write.mode("overwrite").parquet(f"{counters}/b={name}")

    return consume(messages, handle, checkpoint, available_now)


def delivered(spark: SparkSession, counters: str) -> DataFrame:
    """Messages, errors and bytes of all micro-batches counted under `counters`."""
    rows = spark.read.schema(COUNTERS).option("recursiveFileLookup", True).parquet(counters)
    return rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("messages", "errors", "bytes")])


def search_stream(
    queries: DataFrame,
    path: str,
    embedder: Embedder | ColumnEmbedder,
    out: str,
    checkpoint: str,
    k: int = 1,
    namespace: str | None = None,
    available_now: bool = False,
    held: collection.HeldCollection | None = None,
) -> StreamingQuery:
    """Answer queries as they come; each micro-batch writes its matches and its rejected queries.

    The collection is read by the first micro-batch and by the first one after a change; in between the executors
    keep it (`held`, which the caller may share between streams, and then releases). Otherwise it is released when the stream ends.
    """
    mine = held or collection.HeldCollection(path, namespace)

    def handle(batch: DataFrame, batch_id: int) -> None:
        name = batch_name(batch, batch_id)
        matches, rejected = answer_queries(batch, mine.rows(batch.sparkSession), embedder, k)
        matches.write.mode("overwrite").parquet(f"{out}/matches/b={name}")
        rejected.write.mode("overwrite").parquet(f"{out}/rejected/b={name}")

    query = consume(queries, handle, checkpoint, available_now)
    if held is None:
        when_over(queries.sparkSession, query, mine.release)
    return query
