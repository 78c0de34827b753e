"""Batched model inference over columns, with a model the user supplies."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumirank.functions.text import bucket_counts, bucket_lists
from lumirank.operators.preprocess import SIZE, float_lists, stripped_schema, tensors_of, without_pixels

# Fixed batch sizes of the two models.
IMAGE_BATCH = 50
TEXT_BATCH = 32


class Embedder:
    """A model: `load` runs once per Python worker and returns a function from a batch to an (n, dim) array.

    A worker keeps the last model it loaded and uses it for all tasks with an equal embedder. Image models get float arrays (n, 3, size, size), text models lists of strings. The object is sent
    to the executors, so weights belong in `load`, not in its fields.
    """

    dim: int

    def load(self) -> Callable[..., np.ndarray]:
        raise NotImplementedError


class ColumnEmbedder:
    """A model that is a column expression and needs no Python."""

    dim: int

    def column(self, value: Column) -> Column:
        raise NotImplementedError


class HashingTextEmbedder(ColumnEmbedder):
    """Counts of hashed tokens: a stand-in text model that needs no weights."""

    def __init__(self, dim: int = 512):
        self.dim = dim

    def column(self, value: Column) -> Column:
        dim = self.dim

        @F.arrow_udf("array<float>")
        def counts(lowered: pa.Array) -> pa.Array:
            return bucket_counts(lowered, dim)

        return counts(F.lower(value))


class SparseTextEmbedder(ColumnEmbedder):
    """The same counts without the zeros, for `top_k_sparse`: a struct of `buckets` and `weights`. `dim` may be large."""

    def __init__(self, dim: int = 512):
        self.dim = dim

    def column(self, value: Column) -> Column:
        dim = self.dim

        @F.arrow_udf("struct<buckets:array<int>,weights:array<double>>")
        def lists(lowered: pa.Array) -> pa.Array:
            return bucket_lists(lowered, dim)

        return lists(F.lower(value))


class HashingTextModel(Embedder):
    """The same counts as a model that is called with batches of texts."""

    def __init__(self, dim: int = 512):
        self.dim = dim

    def load(self):
        dim = self.dim

        def embed(texts: list[str]) -> np.ndarray:
            counts = bucket_counts(pa.array([text.lower() for text in texts]), dim)
            return counts.flatten().to_numpy().reshape(len(texts), dim)

        return embed


class BlockMeanEmbedder(Embedder):
    """Mean of each plane in `grid` × `grid` blocks: a stand-in image model that needs no weights."""

    def __init__(self, grid: int = 7):
        self.grid, self.dim = grid, 3 * grid * grid

    def load(self):
        grid = self.grid

        def embed(batch: np.ndarray) -> np.ndarray:
            n, c, h, w = batch.shape
            edge_h, edge_w = h // grid * grid, w // grid * grid
            blocks = batch[:, :, :edge_h, :edge_w].reshape(n, c, grid, edge_h // grid, grid, edge_w // grid)
            return blocks.mean(axis=(3, 5), dtype=np.float64).reshape(n, -1)

        return embed


class PooledImageEmbedder(Embedder):
    """A fixed projection of the block means to any dimension: sums with signs taken from a hash."""

    def __init__(self, dim: int = 512, grid: int = 7, seed: int = 0):
        self.dim, self.grid, self.seed = dim, grid, seed

    def load(self):
        means = BlockMeanEmbedder(self.grid)
        # Even and odd first digits of md5("seed-mean-dimension") are plus and minus.
        signs = np.array(
            [
                [1 - 2 * (int(hashlib.md5(f"{self.seed}-{i}-{j}".encode()).hexdigest()[0], 16) % 2) for j in range(self.dim)]
                for i in range(means.dim)
            ],
            float,
        )
        embed = means.load()
        return lambda batch: embed(batch) @ signs


def _vectors(model, inputs: list, dim: int, batch_size: int, as_batch) -> list[np.ndarray | None]:
    """One vector per input, in order; None for None. Calls the model with `batch_size` inputs at most."""
    out: list[np.ndarray | None] = [None] * len(inputs)
    present = [i for i, value in enumerate(inputs) if value is not None]
    for start in range(0, len(present), batch_size):
        at = present[start : start + batch_size]
        vectors = np.asarray(model(as_batch([inputs[i] for i in at])))
        if vectors.shape != (len(at), dim):
            raise ValueError(f"the model gave {vectors.shape} for {len(at)} inputs of dimension {dim}")
        for i, vector in zip(at, vectors):
            out[i] = vector
    return out


_LOADED: dict[str, Callable] = {}


def _key(embedder: Embedder) -> str:
    """A name for the embedder's class and fields."""
    return hashlib.sha256(cloudpickle.dumps(embedder)).hexdigest()


def _model(embedder: Embedder, key: str) -> Callable:
    """The loaded model; another one that this worker held before is let go."""
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = embedder.load()
    return _LOADED[key]


def _in_batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The same rows, `size` at a time across the ends of Arrow batches; only the last may be shorter."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, size - rows)
            batch = batch.slice(part.num_rows)
            held.append(part)
            rows += part.num_rows
            if rows == size:
                yield pa.concat_batches(held)
                held, rows = [], 0
    if held:
        yield pa.concat_batches(held)


def _embed(df: DataFrame, col: str, out: str, embedder: Embedder, batch_size: int, inputs, as_batch) -> DataFrame:
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))])

    key = _key(embedder)

    def run(batches):
        model = _model(embedder, key)
        for part in _in_batches(batches, batch_size):
            vectors = _vectors(model, inputs(part.column(col)), embedder.dim, batch_size, as_batch)
            columns = {name: part.column(name) for name in part.schema.names}
            columns[out] = float_lists(vectors)
            yield pa.RecordBatch.from_pydict(columns)

    return df.mapInArrow(run, schema)


def embed_images(
    df: DataFrame,
    embedder: Embedder,
    batch_size: int = IMAGE_BATCH,
    tensors: str = "tensors",
    size: int = SIZE,
    out: str = "embedding",
) -> DataFrame:
    """Add the vector of each tensor; rows without a tensor get null."""

    def inputs(column: pa.Array) -> list:
        return [v.values.to_numpy().reshape(3, size, size) if v.is_valid else None for v in column]

    return _embed(df, tensors, out, embedder, batch_size, inputs, np.stack)


def embed_texts(
    df: DataFrame,
    embedder: Embedder | ColumnEmbedder,
    batch_size: int = TEXT_BATCH,
    text: str = "text",
    out: str = "embedding",
) -> DataFrame:
    """Add the vector of each text; rows without a text get null."""
    if isinstance(embedder, ColumnEmbedder):
        return df.withColumn(out, embedder.column(F.col(text)))
    return _embed(df, text, out, embedder, batch_size, lambda column: column.to_pylist(), list)


def preprocess_and_embed(
    df: DataFrame,
    embedder: Embedder,
    batch_size: int = IMAGE_BATCH,
    size: int = SIZE,
    gray: str = "replicate",
    out: str = "embedding",
) -> DataFrame:
    """Image rows to vectors in one pass: the tensors never leave the Python worker.

    Adds the vector and `error`; pixel bytes are dropped. Same result as `preprocess_images` followed by
    `embed_images`, without moving 602 KB per image through the JVM twice.
    """
    schema = stripped_schema(
        df, T.StructField(out, T.ArrayType(T.FloatType())), T.StructField("error", T.StringType())
    )

    key = _key(embedder)

    def run(batches):
        model = _model(embedder, key)
        for part in _in_batches(batches, batch_size):
            tensors, errors = tensors_of(part.column("image").to_pylist(), size, gray)
            columns = without_pixels(part)
            columns[out] = float_lists(_vectors(model, tensors, embedder.dim, batch_size, np.stack))
            columns["error"] = pa.array(errors, pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    return df.mapInArrow(run, schema)


def sparse_counts(df: DataFrame, id_col: str, embedding: str = "embedding") -> DataFrame:
    """The counts of a hashing embedder as rows (id, bucket, n), zeros left out.

    The outer form keeps the optimizer from adding a filter that would run the embedder a second time.
    """
    return df.select(id_col, F.posexplode_outer(embedding).alias("bucket", "n")).where(F.col("n") > 0)
