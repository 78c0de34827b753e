"""Images to a searchable collection, and texts to answers, as batch jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumirank.operators.embedding import ColumnEmbedder, Embedder, embed_texts, preprocess_and_embed
from lumirank.operators.search import top_k
from lumirank.operators.validate import split_rejects
from lumirank.sources import collection
from lumirank.sources.images import with_preprocess_time
from lumirank.sources.queries import valid_queries


def embedded_images(
    images: DataFrame, embedder: Embedder, size: int = 224, time: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """(rows with a vector, rejected rows with the reason) of an image table."""
    rows = with_preprocess_time(preprocess_and_embed(images, embedder, size=size), time)
    return split_rejects(rows, payload="embedding")


def ingest_images(
    spark: SparkSession,
    images: DataFrame,
    path: str,
    embedder: Embedder,
    namespace: str = collection.DEFAULT_NAMESPACE,
    id_col: Column | None = None,
    rejects_path: str | None = None,
    batch: str | None = None,
    size: int = 224,
    time: Column | None = None,
) -> None:
    """Preprocess, embed and upsert an image table; rejected rows go to their own table."""
    good, bad = embedded_images(images, embedder, size, time)
    rows = collection.records(good, F.col("image.origin"), F.col("embedding"), F.col("preprocess_time"), id_col=id_col)
    collection.upsert(spark, path, rows, namespace, batch)
    if rejects_path:
        bad.select("image", "error", "reason", "preprocess_time").write.mode("append").parquet(rejects_path)


def answer_queries(
    queries: DataFrame, rows: DataFrame, embedder: Embedder | ColumnEmbedder, k: int = 1, **options
) -> tuple[DataFrame, DataFrame]:
    """(ranked matches, rejected queries) of a table of texts against collection rows."""
    good, bad = valid_queries(queries)
    return top_k(embed_texts(good, embedder), rows, k, **options), bad
