"""Cosine nearest neighbours, exact and by cells.

Exact search has three plans that give the same answer:

* one *scan*, when the query side is proven to fit a broadcast: every partition of the collection keeps
  its own best k rows per query, and only those are shuffled;
* several scans, one per part of a query side of a few times that size: vectors are never shuffled;
* a *grid* of query blocks and row blocks for any other size: each cell is a task of bounded size.

`top_k_approx` visits a given number of cells around pivots instead of all rows. Large cells and crowded
cells are cut into blocks, so no task holds a whole cell.

Scores are computed in double and compared to twelve decimals; equal scores are ranked by id. A vector
without length has no score and ranks last.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumirank.functions.records import resolve_path
from lumirank.plans.scratch import scratch_parts, scratch_table

BROADCAST_BYTES = 64 << 20  # most query-vector bytes sent to every executor
BLOCK_BYTES = 64 << 20  # vector bytes of one block of the grid or of a cell
MAX_SCANS = 8  # scans of the collection that are still cheaper than moving its vectors
MOST_BLOCKS = 16  # blocks a side is cut into while they stay within BLOCK_BYTES: each is repeated for all of the other side
PROBED_SHARE = 0.75  # cells visited unless told otherwise: nine in ten neighbours without clusters need six to seven in ten
_TILE_QUERIES, _TILE_ROWS = 1024, 2048
_BUFFER_ROWS = 200_000  # candidates gathered before they are merged into the best lists, at least
_HELD_BYTES = 32 << 20  # of carried columns gathered before those nobody needs are dropped
_EMIT_ROWS = 50_000  # rows of one batch of results
_CHUNK_CELLS = 2 << 20  # numbers of the second look held at once
_SINGLE = 2.0**-24  # rounding of one single-precision step
_DIGITS = 12


# ---------------------------------------------------------------- kernels on Arrow batches


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors (double) of a list column; rows without length stay zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count or (len(column) and (np.diff(column.offsets.to_numpy()) != dim).any()):
        raise ValueError(f"every vector must have {dim} values; split the others off first")
    m = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)
    for at in range(0, len(m), _TILE_ROWS):  # in place: a driver holds a part of the queries once
        tile = m[at : at + _TILE_ROWS]
        norms = np.sqrt((tile * tile).sum(axis=1, keepdims=True))
        np.divide(tile, norms, out=tile, where=norms > 0)
        tile[~(norms > 0)[:, 0]] = 0
    return m


def _best(found: pa.Table, k: int, id_col: str) -> pa.Table:
    """The best k rows per query of a table with `_q`, `score` and the id."""
    order = pd.DataFrame(
        {"q": found["_q"].to_numpy(), "s": -found["score"].to_numpy(), "i": found[id_col].to_pandas()}
    ).sort_values(["q", "s", "i"], kind="stable")
    keep = order.groupby("q", sort=False).cumcount().to_numpy() < k
    return found.take(pa.array(order.index.to_numpy()[keep]))


class _Carried:
    """The other columns of rows that are among the best, once per row, however many queries found it."""

    def __init__(self):
        self.tables, self.rows, self.fresh = [], 0, 0

    def add(self, table: pa.Table) -> int:
        """Keep the rows of a tile; the place of the first."""
        self.tables.append(table)
        self.rows += table.num_rows
        self.fresh += table.nbytes
        return self.rows - table.num_rows

    def narrow(self, places: np.ndarray) -> np.ndarray:
        """Drop all rows but those at `places`; where these are then."""
        used, now = np.unique(places, return_inverse=True)
        self.tables = [pa.concat_tables(self.tables).take(pa.array(used)).combine_chunks()]
        self.rows, self.fresh = len(used), 0
        return now

    def take(self, places: pa.Array) -> pa.Table:
        self.tables = [pa.concat_tables(self.tables)]
        return self.tables[0].take(places)


def _scan(queries: np.ndarray, batches, k: int, id_col: str, vec_col: str, carried: _Carried | None = None):
    """Best k rows per query over a stream of batches (rows of the collection); other columns go to `carried`.

    Works in tiles of queries and rows. A product in single precision picks the rows of a tile that can be
    among the best, whatever its rounding; those are scored again in double. Candidates gather in a buffer,
    which is merged into the best lists when it has outgrown them, so the lists are sorted a number of times
    that does not depend on the number of queries.
    """
    n_queries, dim = queries.shape
    rough = queries.astype(np.float32)
    slack = 1e-9 + 2 * (dim + 4) * _SINGLE
    no_length = ~queries.any(axis=1)
    floor = np.full(n_queries, -np.inf)
    best, buffer, held = None, [], 0
    carried = _Carried() if carried is None else carried

    def merge():
        tables = buffer if best is None else [best, *buffer]
        merged = _best(pa.concat_tables(tables), k, id_col)
        counts = np.bincount(merged["_q"].to_numpy(), minlength=n_queries)
        last = np.cumsum(counts) - 1
        full = counts >= k
        floor[full] = np.maximum(floor[full], merged["score"].to_numpy()[last[full]])
        if "_row" in merged.column_names:
            now = carried.narrow(merged["_row"].to_numpy())
            merged = merged.drop(["_row"]).append_column("_row", pa.array(now))
        return merged

    for batch in batches:
        table = batch if isinstance(batch, pa.Table) else pa.Table.from_batches([batch])
        for start in range(0, table.num_rows, _TILE_ROWS):
            part = table.slice(start, _TILE_ROWS)
            unit = _matrix(part[vec_col], dim)
            rough_rows, none = unit.astype(np.float32).T, ~unit.any(axis=1)
            others = part.drop([vec_col, id_col])
            first = None
            for at in range(0, n_queries, _TILE_QUERIES):
                tile = slice(at, at + _TILE_QUERIES)
                found = _candidates(queries[tile], unit, rough[tile] @ rough_rows, no_length[tile], none, floor[tile], slack, k)
                if found is None:
                    continue
                rows, cols, exact = found
                found = pa.table({"_q": rows + at, "score": exact, id_col: part[id_col].take(pa.array(cols)), "_at": cols})
                found = _best(found, k, id_col)  # at most k rows per query go on
                if others.num_columns:
                    first = carried.add(others) if first is None else first
                    found = found.append_column("_row", pa.array(found["_at"].to_numpy() + first))
                buffer.append(found.drop(["_at"]))
                held += found.num_rows
            if held > max(_BUFFER_ROWS, 2 * n_queries * k) or carried.fresh > _HELD_BYTES:
                best, buffer, held = merge(), [], 0
    return merge() if buffer else best


def _candidates(queries, unit, scores, no_length, none, floor, slack: float, k: int):
    """(query, row, score) of the pairs of a tile that can be among the best, scored in double."""
    scores[no_length] = -np.inf
    scores[:, none] = -np.inf
    limit = floor
    if scores.shape[1] > k and np.isneginf(floor).any():
        limit = np.maximum(floor, np.partition(scores, -k, axis=1)[:, -k])
    rows, cols = np.divmod(np.flatnonzero(scores >= (limit - slack).astype(np.float32)[:, None]), scores.shape[1])
    if not len(rows):
        return None
    exact = np.empty(len(rows))
    pairs = max(1, _CHUNK_CELLS // queries.shape[1])
    for at in range(0, len(rows), pairs):  # the same sum for every copy of a vector
        r, c = rows[at : at + pairs], cols[at : at + pairs]
        exact[at : at + pairs] = np.round((queries[r] * unit[c]).sum(axis=1), _DIGITS)
    exact[np.isneginf(scores[rows, cols])] = -np.inf
    return rows, cols, exact


def _emit(best: pa.Table | None, query_ids: pa.Array, query_id: str, columns: list[str], carried: _Carried | None = None):
    """The rows in parts, with their query ids and carried columns, in the declared column order."""
    for at in range(0, 0 if best is None else best.num_rows, _EMIT_ROWS):
        some = best.slice(at, _EMIT_ROWS).combine_chunks()
        out = some.append_column(query_id, query_ids.take(some["_q"].combine_chunks()))
        if "_row" in some.column_names:
            more = carried.take(some["_row"].combine_chunks())
            for name in more.column_names:
                out = out.append_column(name, more[name])
        yield out.select(columns).combine_chunks()


# ---------------------------------------------------------------- plans


def _final(local: DataFrame, k: int, query_id: str, id_col: str) -> DataFrame:
    w = W.partitionBy(query_id).orderBy(F.col("score").desc(), F.col(id_col))
    return (
        local.withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= k)
        .withColumn("score", F.when(F.col("score") >= -2.0, F.col("score")))
    )


def _small_side(queries: DataFrame, query_id: str, vec: str, limit_bytes: int) -> pa.Table | None:
    """The query vectors if they stay within `limit_bytes`, else None. Never fetches more than that."""
    first = queries.select(F.size(vec).alias("n")).first()
    if first is None:
        return queries.select(query_id, vec).limit(0).toArrow()
    most = limit_bytes // (8 * max(1, first["n"] or 1))
    if most < 1:
        return None
    table = queries.select(query_id, vec).limit(most + 1).toArrow()
    return table if table.num_rows <= most else None


def _scan_plan(
    spark, small: pa.Table, coll: DataFrame, k: int, query_id: str, id_col: str, vec: str, schema
) -> tuple[DataFrame, Broadcast | None]:
    """The best rows of each partition, and what is broadcast for them."""
    columns = schema.fieldNames()
    if not small.num_rows:
        return spark.createDataFrame([], schema), None
    ids = small[query_id].combine_chunks()
    dim = len(small[1][0])
    shared = spark.sparkContext.broadcast((_matrix(small[1], dim), ids))

    def scan(batches):
        matrix, query_ids = shared.value
        carried = _Carried()
        best = _scan(matrix, batches, k, id_col, vec, carried)
        for out in _emit(best, query_ids, query_id, columns, carried):
            yield from out.to_batches()

    return coll.mapInArrow(scan, schema), shared


def _nearest_pivot(df: DataFrame, vec: str, pivots, dim: int) -> DataFrame:
    """Add `_cell` (nearest pivot) and `_angle` (radians to it). Vectors without length go to cell -1."""

    @F.arrow_udf("struct<cell:int,angle:double>")
    def assign(values: pa.Array) -> pa.Array:
        unit = _matrix(values, dim)
        scores = np.round(unit @ pivots.value.T, _DIGITS)
        cell = scores.argmax(axis=1)
        angle = np.arccos(np.clip(scores[np.arange(len(cell)), cell], -1.0, 1.0))
        zero = ~unit.any(axis=1)
        cell[zero], angle[zero] = -1, 0.0
        return pa.StructArray.from_arrays(
            [pa.array(cell.astype(np.int32)), pa.array(angle)], names=["cell", "angle"]
        )

    return (
        df.withColumn("_home", assign(F.col(vec)))
        .withColumn("_cell", F.col("_home.cell"))
        .withColumn("_angle", F.col("_home.angle"))
        .drop("_home")
    )


def _spread(key: str, parts: Column, seed: int) -> Column:
    """A part number for a row, fixed by its id."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(key)), parts).cast("int")


def _block_count(n_bytes: int, block_bytes: int) -> int:
    """Blocks of `block_bytes`, or of up to BLOCK_BYTES where that leaves MOST_BLOCKS: a side is moved once per block of the other."""
    wanted, least = -(-n_bytes // block_bytes), -(-n_bytes // max(block_bytes, BLOCK_BYTES))
    return max(1, least, min(wanted, MOST_BLOCKS))


def _many_queries_plan(
    queries: DataFrame, coll: DataFrame, k: int, query_id: str, id_col: str, vec: str, schema, scan_bytes: int, block_bytes: int,
    max_scans: int,
):
    """A query side beyond one broadcast. Both sides are evaluated once, and written."""
    spark = coll.sparkSession
    queries, rows = scratch_table(queries, "queries"), scratch_table(coll, "rows")
    dim, n_queries = queries.agg(F.max(F.size(vec)), F.count(F.lit(1))).first()
    vector_bytes = 8 * max(1, dim or 1)
    parts = -(-n_queries * vector_bytes // scan_bytes)
    if parts <= max_scans:
        # More scans than moving the vectors would cost are made only where a broadcast holds no more.
        parts = min(parts, max(MAX_SCANS, -(-n_queries * vector_bytes // BROADCAST_BYTES)))

        def found():
            for part in range(parts):
                some = queries.where(_spread(query_id, F.lit(parts), 3) == part).select(query_id, vec).toArrow()
                scanned, shared = _scan_plan(spark, some, rows, k, query_id, id_col, vec, schema)
                yield scanned
                if shared:
                    shared.destroy()

        return scratch_parts(found(), "found")

    # Every query block meets every row block; a block of either side is repeated for the blocks of the other.
    q_blocks = _block_count(n_queries * vector_bytes, block_bytes)
    r_blocks = _block_count(rows.count() * vector_bytes, block_bytes)
    columns = schema.fieldNames()

    def blocks(df: DataFrame, key: str, own: str, n: int, other: str, repeats: int) -> DataFrame:
        return df.withColumn(own, _spread(key, F.lit(n), 3)).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))

    def match(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.drop(["_qb", "_rb"]), right.drop(["_qb", "_rb"])
        best, carried = None, _Carried()
        if left.num_rows and right.num_rows:
            best = _scan(_matrix(left[vec], dim), [right], k, id_col, vec, carried)
        return _found_or_none(best, carried, right, left, query_id, columns)

    left = blocks(queries.select(query_id, vec), query_id, "_qb", q_blocks, "_rb", r_blocks)
    keep = [c for c in columns if c not in (query_id, "score")]
    right = blocks(rows.select(*keep, vec), id_col, "_rb", r_blocks, "_qb", q_blocks)
    keys = ["_qb", "_rb"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(match, schema)


def _found_or_none(best, carried, rows: pa.Table, queries: pa.Table, query_id: str, columns: list[str]) -> pa.Table:
    if best is None:
        empty = rows.slice(0, 0).append_column(query_id, queries[query_id].slice(0, 0))
        return empty.append_column("score", pa.array([], pa.float64())).select(columns)
    return pa.concat_tables(_emit(best, queries[query_id].combine_chunks(), query_id, columns, carried))


def _cells_plan(
    queries: DataFrame, coll: DataFrame, pivots: np.ndarray, n_probe: int, k: int, query_id: str, id_col: str, vec: str, schema,
    block_bytes: int,
):
    """Every query visits the `n_probe` cells whose pivots are nearest to it."""
    spark = coll.sparkSession
    dim = pivots.shape[1]
    shared = spark.sparkContext.broadcast(pivots)
    columns = schema.fieldNames()
    homes = scratch_table(_nearest_pivot(coll, vec, shared, dim).drop("_angle"), "cells")
    # One row per cell, so at most one more than there are pivots.
    sizes = {r["_cell"]: r["count"] for r in homes.groupBy("_cell").count().collect()}
    n_rows = sum(sizes.values())
    block_rows = max(k, block_bytes // (8 * dim), -(-n_rows // _block_count(8 * dim * n_rows, block_bytes)))
    subs = {cell: -(-count // block_rows) for cell, count in sizes.items()}
    if not subs:
        return spark.createDataFrame([], schema)
    # By cell, null for cells without rows; a constant, so it is parsed once.
    sub_list = F.from_json(F.lit(json.dumps([subs.get(cell) for cell in range(len(pivots))])), "array<int>")

    @F.arrow_udf("array<int>")
    def probed(values: pa.Array) -> pa.Array:
        scores = np.round(_matrix(values, dim) @ shared.value.T, _DIGITS)
        nearest = np.argsort(-scores, axis=1, kind="stable")[:, :n_probe]
        return pa.array(nearest.astype(np.int32).tolist(), pa.list_(pa.int32()))

    def match(left: pa.Table, right: pa.Table) -> pa.Table:
        best, carried = None, _Carried()
        if left.num_rows and right.num_rows:
            best = _scan(_matrix(left[vec], dim), [right], k, id_col, vec, carried)
        return _found_or_none(best, carried, right, left, query_id, columns)

    routed = scratch_table(
        queries.select(query_id, vec).withColumn("_cell", F.explode(probed(F.col(vec)))).where(F.get(sub_list, F.col("_cell")).isNotNull()),
        "routed",
    ).withColumn("_sub", F.explode(F.sequence(F.lit(0), F.get(sub_list, F.col("_cell")) - 1)))
    placed = homes.withColumn("_sub", _spread(id_col, F.get(sub_list, F.col("_cell")), 1))
    keep = [c for c in columns if c not in (query_id, "score")]
    return _blocks(routed, placed.select(*keep, vec, "_cell", "_sub"), block_rows, query_id, match, schema)


def _blocks(queries, coll, block_rows: int, query_id: str, fn, schema) -> DataFrame:
    """Run `fn(queries, rows)` for each (cell, sub) block, cutting crowds of queries into parts.

    A part meets every row of the block: the rows are repeated once per part, so neither side of a
    task exceeds `block_rows`. Blocks no query visits are not shuffled.
    """
    load = queries.groupBy("_cell", "_sub").agg(F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("int").alias("_parts"))
    load = scratch_table(load, "load")
    left = queries.join(load, ["_cell", "_sub"]).withColumn("_part", _spread(query_id, F.col("_parts"), 3)).drop("_parts")
    right = (
        coll.join(load, ["_cell", "_sub"])
        .withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
        .drop("_parts")
    )
    strip = ["_cell", "_sub", "_part", "_angle"]

    def run(l: pa.Table, r: pa.Table) -> pa.Table:
        return fn(l.drop([c for c in strip if c in l.column_names]), r.drop([c for c in strip if c in r.column_names]))

    keys = ["_cell", "_sub", "_part"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)


def _sides(queries, collection, query_id, query_vec, id_col, vec_col, carry):
    """Both sides with their vectors as `_v`, and the layout of what is found."""
    coll = collection.select(F.col(id_col), *carry, F.col(vec_col).cast("array<float>").alias("_v"))
    wanted = queries.select(F.col(query_id), F.col(query_vec).cast("array<float>").alias("_v"))
    schema = T.StructType(
        [
            T.StructField(query_id, queries.schema[query_id].dataType),
            *[T.StructField(f.name, f.dataType) for f in coll.schema if f.name != "_v"],
            T.StructField("score", T.DoubleType()),
        ]
    )
    return wanted, coll, schema


def knn_join(
    queries: DataFrame,
    collection: DataFrame,
    k: int = 1,
    query_id: str = "query_id",
    query_vec: str = "embedding",
    id_col: str = "id",
    vec_col: str = "values",
    carry: tuple[str, ...] = (),
    broadcast_bytes: int = BROADCAST_BYTES,
    block_bytes: int = BLOCK_BYTES,
    max_scans: int = MAX_SCANS,
) -> DataFrame:
    """The k most similar rows of the collection for every query.

    Returns query_id, id, the `carry` columns, score and rank; ids and query ids are taken to be unique. The
    query side is broadcast only if it was found to hold no more than `broadcast_bytes`; up to `max_scans`
    times that it is broadcast part by part, beyond that it meets the collection block by block. Parts and blocks
    are larger than `broadcast_bytes` and `block_bytes` say where there would be more than MAX_SCANS or MOST_BLOCKS of
    them, up to BROADCAST_BYTES and BLOCK_BYTES.
    """
    wanted, coll, schema = _sides(queries, collection, query_id, query_vec, id_col, vec_col, carry)
    small = _small_side(wanted, query_id, "_v", broadcast_bytes)
    if small is not None:
        local, _ = _scan_plan(coll.sparkSession, small, coll, k, query_id, id_col, "_v", schema)
    else:
        local = _many_queries_plan(wanted, coll, k, query_id, id_col, "_v", schema, broadcast_bytes, block_bytes, max_scans)
    return _final(local, k, query_id, id_col)


def knn_join_approx(
    queries: DataFrame,
    collection: DataFrame,
    k: int = 1,
    n_probe: int | None = None,
    n_pivots: int | None = None,
    pivots: DataFrame | None = None,
    query_id: str = "query_id",
    query_vec: str = "embedding",
    id_col: str = "id",
    vec_col: str = "values",
    carry: tuple[str, ...] = (),
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The k most similar rows among those of the `n_probe` cells nearest to a query, with exact scores.

    Cells gather around pivots: the vectors of `pivots` (columns `id_col` and `vec_col`, in the order of
    their ids), or `n_pivots` rows of the collection chosen by a hash of the id. Either must fit a broadcast.
    A row belongs to the pivot most similar to it, ties go to the first; rows without length are in no
    cell. More probes give a better answer and cost more; all of them give the exact one but for rows
    without length. Unless given, there are as many pivots as the root of the number of rows and three in
    four cells are visited, which finds nine in ten neighbours among vectors without clusters too; give
    fewer probes where vectors are known to cluster.
    """
    wanted, coll, schema = _sides(queries, collection, query_id, query_vec, id_col, vec_col, carry)
    by_rows = n_pivots is None
    if pivots is None:
        if by_rows:
            n_pivots = math.isqrt(max(collection.count() - 1, 0)) + 1
        chosen = collection.orderBy(F.xxhash64(id_col), id_col).limit(n_pivots)
    else:
        chosen = pivots.orderBy(id_col)
    vectors = chosen.select(F.col(vec_col).cast("array<float>").alias("_v")).toArrow()["_v"]
    if not len(vectors):
        return _final(coll.sparkSession.createDataFrame([], schema), k, query_id, id_col)
    matrix = _matrix(vectors, len(vectors[0]))
    matrix = matrix[matrix.any(axis=1)]
    if pivots is None and by_rows:
        matrix = matrix[: max(1, BROADCAST_BYTES // (8 * matrix.shape[1]))]
    if matrix.nbytes > BROADCAST_BYTES:
        raise ValueError("the pivots are more than a broadcast holds; choose fewer")
    if n_probe is None:
        n_probe = math.ceil(PROBED_SHARE * len(matrix))
    local = _cells_plan(wanted, coll, matrix, n_probe, k, query_id, id_col, "_v", schema, block_bytes)
    return _final(local, k, query_id, id_col)


def top_k(
    queries: DataFrame,
    collection: DataFrame,
    k: int = 1,
    namespace: str | None = None,
    include_values: bool = False,
    include_metadata: bool = True,
    **options,
) -> DataFrame:
    """Ranked matches of each query among the rows of a collection (optionally of one namespace).

    Returns query_id, rank, id, score, and image_path / metadata and values as asked for.
    """
    return _ranked(knn_join, queries, collection, k, namespace, include_values, include_metadata, options)


def top_k_approx(
    queries: DataFrame,
    collection: DataFrame,
    k: int = 1,
    n_probe: int | None = None,
    namespace: str | None = None,
    include_values: bool = False,
    include_metadata: bool = True,
    **options,
) -> DataFrame:
    """`top_k` among the `n_probe` nearest cells of each query only; see `knn_join_approx`."""
    options = {**options, "n_probe": n_probe}
    return _ranked(knn_join_approx, queries, collection, k, namespace, include_values, include_metadata, options)


def _ranked(search, queries, collection, k, namespace, include_values, include_metadata, options) -> DataFrame:
    coll = collection
    if namespace is not None:
        coll = coll.where(F.col("namespace") == namespace)
    carry = ()
    if include_values:
        coll = coll.withColumn("_values", F.col("values"))
        carry += ("_values",)
    if include_metadata:
        carry += ("metadata",)
    found = search(queries, coll, k, carry=carry, **options)
    out = [F.col("query_id"), F.col("rank"), F.col("id"), F.col("score")]
    if include_metadata:
        out += [resolve_path(F.col("metadata"), F.col("id").cast("string")).alias("image_path"), F.col("metadata")]
    if include_values:
        out += [F.col("_values").alias("values")]
    return found.select(*out)


def no_match_report(queries: DataFrame, matches: DataFrame, query_id: str = "query_id") -> DataFrame:
    """The queries that found nothing."""
    hit = matches.select(query_id).distinct()
    return queries.join(hit, query_id, "left_anti").withColumn("reason", F.lit("no matches found"))
