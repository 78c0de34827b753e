"""Approximate cosine search over short codes, with exact scores for what they bring up.

A vector is named by its cell, the nearest of some centres, and by a code of one byte per part of what it differs from
that centre (residual product quantisation). A row looks as good as the inner product of a query and the vector that code
and cell stand for, which a scan puts together again, so it reads a few bytes of a row instead of its vector. The
`rerank` rows that look best per query are then looked up and scored exactly.

Centres and code books are fitted on a bounded sample: the SAMPLE_ROWS rows (fewer if they exceed SAMPLE_BYTES) whose ids
hash lowest. All rows are coded. An index may be stored, one folder per cell; a search that probes some cells then reads
only their folders.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lumirank.operators.search import _BUFFER_ROWS, _DIGITS, BROADCAST_BYTES, _final, _matrix, _ranked, _sides, _spread
from lumirank.plans.scratch import scratch_parts, scratch_table

SAMPLE_ROWS = 20_000
SAMPLE_BYTES = 64 << 20
PART_VALUES = 4  # values of a vector named by one byte
ENTRIES = 256
MOST_CELLS = 256
RERANK = 20  # rows scored exactly per row asked for
_FIT_ROUNDS = 8
_TILE_ROWS, _TILE_QUERIES = 2048, 1024
_CANDIDATE_BYTES = 96  # of a candidate in a broadcast, with an id of some length


# ---------------------------------------------------------------- the model


def _fitted(x: np.ndarray, entries: int) -> np.ndarray:
    """Centres of Lloyd's rounds that start from the first rows; one nobody is nearest to stays."""
    centres = x[:entries].copy()
    for _ in range(_FIT_ROUNDS):
        near = _nearest(x, centres)
        order = np.argsort(near, kind="stable")
        own, first, count = np.unique(near[order], return_index=True, return_counts=True)
        if len(own):
            centres[own] = np.add.reduceat(x[order], first) / count[:, None]
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    half = (centres * centres).sum(axis=1) / 2
    for at in range(0, len(x), _TILE_ROWS):
        out[at : at + _TILE_ROWS] = (x[at : at + _TILE_ROWS] @ centres.T - half).argmax(axis=1)
    return out


@dataclass
class CodeModel:
    """Centres (cells, dim) and code books (parts, entries, width) for unit vectors of `dim` values."""

    dim: int
    centres: np.ndarray
    books: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, cells: int, part_values: int = PART_VALUES) -> "CodeModel":
        sample, dim = sample.astype(np.float32), sample.shape[1]
        parts = -(-dim // part_values)
        centres = _fitted(sample, cells)
        rest = cls._parts(sample - centres[_nearest(sample, centres)], parts, part_values)
        return cls(dim, centres, np.stack([_fitted(rest[:, p], ENTRIES) for p in range(parts)]))

    @staticmethod
    def _parts(x: np.ndarray, parts: int, width: int) -> np.ndarray:
        out = np.zeros((len(x), parts * width), x.dtype)
        out[:, : x.shape[1]] = x
        return out.reshape(len(x), parts, width)

    def encode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells and codes (rows, parts) of unit vectors."""
        cells = _nearest(unit, self.centres)
        rest = self._parts(unit - self.centres[cells], *self.books.shape[::2])
        return cells, np.stack([_nearest(rest[:, p], book) for p, book in enumerate(self.books)], axis=1).astype(np.uint8)


def fit_codes(
    collection: DataFrame, id_col: str = "id", vec_col: str = "values", cells: int | None = None, part_values: int = PART_VALUES,
    sample_rows: int = SAMPLE_ROWS,
) -> CodeModel | None:
    """A model for a collection, from a bounded sample of it; None for an empty one.

    There are as many cells as the root of the sampled rows, MOST_CELLS at most, unless told otherwise.
    """
    rows = collection.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<float>").alias("v")).where(F.size("v") > 0)
    first = rows.select(F.size("v")).first()
    if first is None:
        return None
    sample_rows = min(sample_rows, max(1, SAMPLE_BYTES // (4 * first[0])))
    sample = _matrix(rows.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("v").toArrow()["v"], first[0])
    return CodeModel.fit(sample, cells or min(MOST_CELLS, math.isqrt(len(sample))), part_values)


def encode_rows(collection: DataFrame, model: CodeModel, vec_col: str = "values") -> DataFrame:
    """Add `cell` and `code` to the rows of a collection."""
    spark = collection.sparkSession
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<cell:int,code:binary>")
    def encode(values: pa.Array) -> pa.Array:
        cells, codes = shared.value.encode(_matrix(values, shared.value.dim))
        width = codes.shape[1]
        codes = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(cells), [None, pa.py_buffer(codes.tobytes())])
        return pa.StructArray.from_arrays([pa.array(cells.astype(np.int32)), codes.cast(pa.binary())], names=["cell", "code"])

    coded = collection.withColumn("_coded", encode(F.col(vec_col).cast("array<float>")))
    return coded.select("*", "_coded.cell", "_coded.code").drop("_coded")


# ---------------------------------------------------------------- a stored index


def write_index(collection: DataFrame, path: str, model: CodeModel, vec_col: str = "values") -> None:
    """Store the coded rows with one folder per cell, and the model beside them.

    A cell with many rows is written by several tasks, as Spark rebalances the partitions it finds too large.
    """
    spark = collection.sparkSession
    coded = encode_rows(collection, model, vec_col)
    coded.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    cells = [(i, c.tolist()) for i, c in enumerate(model.centres)]
    spark.createDataFrame(cells, "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
    saved = [(model.dim, *model.books.shape, model.books.ravel().tolist())]
    schema = "dim int, parts int, entries int, width int, books array<double>"
    spark.createDataFrame(saved, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/books")


@dataclass
class StoredIndex:
    """An index that was read: its rows (with `cell` and `code`), its table of cells, its model."""

    rows: DataFrame
    cells: DataFrame
    model: CodeModel


def open_index(spark: SparkSession, path: str) -> StoredIndex:
    """The index under a folder. The driver reads the model only: centres and code books."""
    cells = spark.read.parquet(f"{path}/cells")
    centres = np.array([r["centre"] for r in cells.orderBy("cell").collect()], float)
    saved = spark.read.parquet(f"{path}/books").first()
    books = np.array(saved["books"], float).reshape(saved["parts"], saved["entries"], saved["width"])
    return StoredIndex(spark.read.parquet(f"{path}/rows"), cells, CodeModel(saved["dim"], centres, books))


def _visited(index: StoredIndex, wanted: np.ndarray) -> DataFrame:
    """The coded rows of some cells. A join with the table of cells: Spark prunes the folders while the query runs."""
    cells = index.cells.where(F.col("cell").isin([int(c) for c in wanted])).select("cell")
    return index.rows.join(F.broadcast(cells), "cell")  # a row per cell at most


# ---------------------------------------------------------------- search


def _look_up(batches: Iterator[pa.RecordBatch], model: CodeModel, unit: np.ndarray, probed: np.ndarray | None, rerank: int):
    """(query, row, looks) of the rows that look best per query, and the ids of all rows seen.

    A tile's codes and cells are put back into the vectors they stand for, and one product gives all looks. Rows that look better
    than a query's last one so far gather in a buffer, which is merged into the best when it has outgrown them.
    """
    n_queries, parts = len(unit), len(model.books)
    own = model._parts(unit.astype(np.float32), *model.books.shape[::2]).reshape(n_queries, -1)
    centres = model._parts(model.centres.astype(np.float32), *model.books.shape[::2]).reshape(len(model.centres), -1)
    books = model.books.astype(np.float32)
    if probed is not None:
        seen_by = np.zeros((len(centres), n_queries), bool)
        seen_by[probed.T, np.arange(n_queries)] = True
    floor = np.full(n_queries, -np.inf, np.float32)
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    best, buffer, held = none, [], 0

    def merge():
        query, place, look = (np.concatenate(x) for x in zip(best, *buffer))
        # One whole number sorts by query and falling looks.
        bits = look.view(np.uint32)
        rising = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31))
        order = np.argsort(query.astype(np.uint64) << np.uint64(32) | ~rising, kind="stable")
        firsts = np.searchsorted(query[order], np.arange(n_queries))
        turn = np.arange(len(order)) - firsts[query[order]]
        last = order[turn == rerank - 1]
        floor[query[last]] = look[last]
        order = order[turn < rerank]
        return query[order], place[order], look[order]

    ids, start = [], 0
    for batch in batches:
        cells = batch["cell"].to_numpy()
        codes = np.frombuffer(b"".join(batch["code"].to_pylist()), np.uint8).reshape(-1, parts)
        ids.append(batch["id"])
        for at in range(0, len(cells), _TILE_ROWS):
            cell, code = cells[at : at + _TILE_ROWS], codes[at : at + _TILE_ROWS]
            stands_for = (books[np.arange(parts), code].reshape(len(cell), -1) + centres[cell]).T
            visitors = np.arange(n_queries)
            if probed is not None:
                here = np.unique(cell)
                visitors = np.flatnonzero(seen_by[here].any(axis=0))
            for first in range(0, len(visitors), _TILE_QUERIES):
                some = visitors[first : first + _TILE_QUERIES]
                look = own[some] @ stands_for
                if probed is not None and len(here) > 1:
                    look[~seen_by[np.ix_(cell, some)].T] = -np.inf
                least = np.nextafter(floor[some], np.float32(np.inf))
                if len(cell) > rerank and np.isneginf(floor[some]).any():
                    least = np.maximum(least, np.partition(look, -rerank, axis=1)[:, -rerank])
                spot = np.flatnonzero(look >= least[:, None])
                query, place = np.divmod(spot, len(cell))
                buffer.append((some[query], place + (start + at), look.ravel()[spot]))
                held += len(query)
            if held > max(_BUFFER_ROWS, 2 * n_queries * rerank):
                best, buffer, held = merge(), [], 0
        start += len(cells)
    query, place, look = merge() if buffer else best
    return query, place, look, ids


def knn_join_codes(
    queries: DataFrame,
    collection: DataFrame | StoredIndex,
    k: int = 1,
    rerank: int | None = None,
    n_probe: int | None = None,
    model: CodeModel | None = None,
    query_id: str = "query_id",
    query_vec: str = "embedding",
    id_col: str = "id",
    vec_col: str = "values",
    carry: tuple[str, ...] = (),
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """The k most similar rows among the `rerank` (RERANK * k unless given) whose codes look best, with exact scores.

    `collection` is a stored index, or rows, which are coded and written first (by `model`, or one fitted to them).
    `n_probe` restricts each query to the cells nearest to it. Queries go in parts, so that the vectors and
    the candidates of a part fit a broadcast; each part scans the codes once and looks up its candidates' vectors once. Where
    there are several, they are run and written here one after the other, so the driver holds the broadcasts of one. More
    rows to re-rank give a better answer; as many as there are rows give the exact one.
    """
    if not isinstance(collection, StoredIndex):
        model = model or fit_codes(collection, id_col, vec_col)
        if model is None:
            _, _, schema = _sides(queries, collection, query_id, query_vec, id_col, vec_col, carry)
            return _final(collection.sparkSession.createDataFrame([], schema), k, query_id, id_col)
        coded = scratch_table(encode_rows(collection, model, vec_col), "coded")
        collection = StoredIndex(coded, coded.select("cell").distinct(), model)
    index = collection
    spark, model = index.rows.sparkSession, index.model
    sides = lambda rows: _sides(queries, rows, query_id, query_vec, id_col, vec_col, carry)
    wanted, _, schema = sides(index.rows)
    rerank = max(k, rerank or RERANK * k)
    n_queries = wanted.count()
    per_query = max(8 * model.dim, _CANDIDATE_BYTES * rerank)
    parts = max(1, -(-n_queries * per_query // broadcast_bytes))
    if not n_queries:
        return _final(spark.createDataFrame([], schema), k, query_id, id_col)
    if parts == 1:
        return _final(_part(index, sides, wanted.toArrow(), rerank, n_probe, query_id, id_col, schema)[0], k, query_id, id_col)
    wanted = scratch_table(wanted, "queries")

    def found() -> Iterator[DataFrame]:
        for part in range(parts):
            table = wanted.where(_spread(query_id, F.lit(parts), 3) == part).toArrow()
            if table.num_rows:
                scored, shared = _part(index, sides, table, rerank, n_probe, query_id, id_col, schema)
                yield _final(scored, k, query_id, id_col)
                shared.destroy()

    return scratch_parts(found(), "found")


def _part(
    index: StoredIndex, sides, table: pa.Table, rerank: int, n_probe: int | None, query_id: str, id_col: str, schema
) -> tuple[DataFrame, Broadcast]:
    """Exact scores of the candidates of one part of the queries, and what is broadcast for them."""
    spark, model = index.rows.sparkSession, index.model
    unit = _matrix(table["_v"], model.dim)
    probed = None
    rows = index.rows
    if n_probe is not None and n_probe < len(model.centres):
        half = (model.centres**2).sum(axis=1) / 2
        probed = np.argsort(-(unit @ model.centres.T - half), axis=1, kind="stable")[:, :n_probe]
        rows = _visited(index, np.unique(probed))
    shared = spark.sparkContext.broadcast((model, unit, probed, table[query_id].combine_chunks()))
    looked = T.StructType([T.StructField("_q", T.LongType()), T.StructField(id_col, schema[id_col].dataType), T.StructField("score", T.FloatType())])

    def look(batches):
        query, place, score, ids = _look_up(batches, *shared.value[:3], rerank)
        if len(query):
            every = pa.concat_arrays(ids)
            columns = [pa.array(query), every.take(pa.array(place)), pa.array(score)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, to_arrow_schema(looked))], schema=to_arrow_schema(looked))

    # No more tasks than cores: each brings up to `rerank` rows per query.
    codes = rows.select(F.col(id_col).alias("id"), "cell", "code").coalesce(spark.sparkContext.defaultParallelism).mapInArrow(look, looked)
    # `rerank` rows per query of a part that was counted.
    candidates = F.broadcast(_final(codes, rerank, "_q", id_col).select("_q", id_col))
    names = schema.fieldNames()

    def score(batches):
        _, unit, _, query_ids = shared.value
        for batch in batches:
            q = batch["_q"].to_numpy()
            vectors = _matrix(batch["_v"], unit.shape[1])
            exact = np.round((unit[q] * vectors).sum(axis=1), _DIGITS)
            exact[~unit[q].any(axis=1) | ~vectors.any(axis=1)] = -np.inf
            made = {query_id: query_ids.take(batch["_q"]), "score": pa.array(exact)}
            yield pa.RecordBatch.from_arrays([made[n] if n in made else batch[n] for n in names], schema=to_arrow_schema(schema))

    return sides(rows)[1].join(candidates, id_col).mapInArrow(score, schema), shared


def top_k_codes(
    queries: DataFrame,
    collection: DataFrame | StoredIndex,
    k: int = 1,
    namespace: str | None = None,
    include_values: bool = False,
    include_metadata: bool = True,
    **options,
) -> DataFrame:
    """`top_k` by codes; see `knn_join_codes`."""
    if not isinstance(collection, StoredIndex):
        return _ranked(knn_join_codes, queries, collection, k, namespace, include_values, include_metadata, options)

    def search(queries, rows, k, carry, **options):
        return knn_join_codes(queries, StoredIndex(rows, collection.cells, collection.model), k, carry=carry, **options)

    return _ranked(search, queries, collection.rows, k, namespace, include_values, include_metadata, options)
