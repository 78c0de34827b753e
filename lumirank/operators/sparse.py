"""Cosine nearest neighbours of sparse vectors through an inverted index, exact and without scoring all pairs.

A sparse vector is a struct of `buckets` (distinct whole numbers) and `weights` (not negative). The index cuts the
collection into blocks of rows, one index row each, with a posting list per bucket: which rows of the block have the
bucket, with what weight, and `most`, the largest weight as a share of its vector's length. So a bucket that
every row has is spread over all blocks, and building the index moves nothing between tasks.

A query works through a block's lists in the order of what they can add, which `most` bounds. What a row can still
reach is bounded twice: by the sum of the bounds of the lists to come, and by the lengths of what is left of both
vectors (Cauchy and Schwarz). A row that cannot get among the best k is dropped; a query whose bounds of all lists stay below its
k-th best score so far skips the block. Only rows that stay open are scored, from their whole vectors, so the answer is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lumirank.operators.search import _DIGITS, BROADCAST_BYTES, _best, _emit, _final, _spread
from lumirank.plans.scratch import scratch_table

BLOCK_ROWS = 8192  # rows of a block, at most
BLOCK_POSTINGS = 1_000_000  # postings after which a block is closed; a task holds some 100 bytes for each
_CLOSE = 1 / 16  # share of a block's rows that is scored at once rather than narrowed further
_SLACK = 1e-9


# ---------------------------------------------------------------- the index


def index_schema(id_type: T.DataType, carried: list[T.StructField]) -> T.StructType:
    """One row per block: per row `ids`, `lengths` and the carried columns; per list `buckets`, `most` and its end in
    `docs` (places in the block) and `weights`."""
    array = lambda kind: T.ArrayType(kind)
    return T.StructType(
        [
            T.StructField("ids", array(id_type)),
            T.StructField("lengths", array(T.DoubleType())),
            T.StructField("buckets", array(T.IntegerType())),
            T.StructField("most", array(T.DoubleType())),
            T.StructField("ends", array(T.IntegerType())),
            T.StructField("docs", array(T.IntegerType())),
            T.StructField("weights", array(T.DoubleType())),
            *[T.StructField(f"with_{f.name}", array(f.dataType)) for f in carried],
        ]
    )


def _posted(part: pa.Table, fields: list[str]) -> dict[str, pa.Array]:
    """The index row of some rows (`id`, `buckets`, `weights` and carried columns)."""
    lists = part["buckets"].combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    buckets = lists.flatten().to_numpy()
    weights = part["weights"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    if not (weights >= 0).all() or not np.isfinite(weights).all():
        raise ValueError("weights must be finite and not negative")
    docs = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    lengths = np.sqrt(np.bincount(docs, weights * weights, minlength=len(sizes)))
    share = weights / np.maximum(lengths, np.finfo(float).tiny)[docs]
    # Lists by bucket, in each the heaviest first.
    order = np.lexsort((docs, -share, buckets))
    ordered = buckets[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(order) else np.zeros(0, np.int64)
    ends = np.append(first[1:], len(order)) if len(order) else first
    made = {
        "ids": part["id"].combine_chunks(), "lengths": pa.array(lengths), "buckets": pa.array(ordered[first]), "most": pa.array(share[order][first]),
        "ends": pa.array(ends.astype(np.int32)), "docs": pa.array(docs[order]), "weights": pa.array(weights[order]),
    } | {f: part[f].combine_chunks() for f in fields}
    return {name: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values) for name, values in made.items()}


def sparse_index(
    rows: DataFrame, id_col: str = "id", vec_col: str = "vector", carry: tuple[str, ...] = (), block_rows: int = BLOCK_ROWS,
    block_postings: int = BLOCK_POSTINGS,
) -> DataFrame:
    """The index of a collection, for `top_k_sparse`; write it where many batches of queries are to come.

    Every task indexes its own rows. Rows without a vector, or with an empty one, match nothing and are not in it.
    """
    some = rows.where(F.size(F.col(vec_col)["buckets"]) > 0).select(
        F.col(id_col).alias("id"),
        F.col(vec_col)["buckets"].cast("array<int>").alias("buckets"),
        F.col(vec_col)["weights"].cast("array<double>").alias("weights"),
        *[F.col(c).alias(f"with_{c}") for c in carry],
    )
    fields = [f.name for f in some.schema.fields[3:]]
    schema = index_schema(some.schema["id"].dataType, [rows.schema[c] for c in carry])
    arrow = to_arrow_schema(schema)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, postings = [], 0, 0

        def block():
            lists = _posted(pa.concat_tables(held), fields)
            return pa.RecordBatch.from_arrays([lists[f.name].cast(f.type) for f in arrow], schema=arrow)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            sizes = np.cumsum(np.diff(batch["buckets"].offsets.to_numpy()))
            at = 0
            while at < len(sizes):
                before = sizes[at - 1] if at else 0
                # As many rows as fit, but one at least.
                fits = int(np.searchsorted(sizes, before + block_postings - postings, "right")) - at
                take = min(max(fits, 0 if held else 1), block_rows - count, len(sizes) - at)
                if take:
                    held.append(table.slice(at, take))
                    count, postings, at = count + take, postings + int(sizes[at + take - 1] - before), at + take
                if not take or count >= block_rows or postings >= block_postings:
                    made = block()
                    held, count, postings = [], 0, 0
                    yield made
                    del made
        if held:
            yield block()

    return some.mapInArrow(post, schema)


# ---------------------------------------------------------------- search


class Block:
    """One index row in a task."""

    def __init__(self, row: dict[str, pa.Array]):
        get = lambda name: row[name].to_numpy(zero_copy_only=False)
        self.ids, self.lengths, self.buckets, self.most = row["ids"], get("lengths"), get("buckets"), get("most")
        self.starts = np.concatenate([[0], get("ends")])
        self.docs, self.weights = get("docs"), get("weights")
        self.share = self.weights / self.lengths[self.docs].clip(np.finfo(float).tiny)
        self.by_doc = None

    def score(self, docs: np.ndarray, at: np.ndarray, weights: np.ndarray, length: float) -> np.ndarray:
        """Cosines of some rows and a query with `weights` in the lists `at`, to twelve decimals."""
        if self.by_doc is None:
            order = np.argsort(self.docs, kind="stable").astype(np.int32)
            lists = np.repeat(np.arange(len(self.buckets), dtype=np.int32), np.diff(self.starts))
            firsts = np.concatenate([[0], np.cumsum(np.bincount(self.docs, minlength=len(self.lengths)))])
            self.by_doc = firsts, lists[order], self.weights[order]
        firsts, lists, own = self.by_doc
        wanted = np.zeros(len(self.buckets))
        wanted[at] = weights
        sizes = firsts[docs + 1] - firsts[docs]
        begins = np.cumsum(sizes) - sizes
        spot = np.arange(sizes.sum()) + np.repeat(firsts[docs] - begins, sizes)
        dots = np.add.reduceat(own[spot] * wanted[lists[spot]], begins)
        product = length * self.lengths[docs]
        return np.round(np.divide(dots, product, out=np.zeros(len(dots)), where=product > 0), _DIGITS)

    def search(self, buckets: np.ndarray, weights: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray, int]:
        """Rows that can be among the best k of a query, their scores, and how many rows had all their lists added.

        Rows without a common bucket are no match. Scores under `floor` do not matter.
        """
        none = np.zeros(0, np.int64), np.zeros(0), 0
        length = float(np.sqrt((weights * weights).sum()))
        at = np.searchsorted(self.buckets, buckets)
        known = at < len(self.buckets)
        known[known] = self.buckets[at[known]] == buckets[known]
        known &= weights > 0
        at, given = at[known], weights[known]
        if not len(at):
            return none
        unit = given / length
        bound = unit * self.most[at]
        order = np.argsort(-bound, kind="stable")
        to_come = np.append(np.cumsum(bound[order][::-1])[::-1], 0.0)
        if to_come[0] < floor - _SLACK:
            return none
        left = np.sqrt(np.append(np.cumsum((unit[order] ** 2)[::-1])[::-1], 0.0))
        n = len(self.lengths)
        reached, used, open_ = np.zeros(n), np.zeros(n), np.ones(n, bool)
        scored, looked, next_look = 0, False, max(1, len(order) // 4)
        for j, i in enumerate(order):
            lists = slice(self.starts[at[i]], self.starts[at[i] + 1])
            docs, share = self.docs[lists], self.share[lists]
            reached[docs] += unit[i] * share
            used[docs] += share * share
            if j + 1 < next_look or j + 1 == len(order):
                continue
            next_look = j + 1 + max(1, len(order) // 8)
            if not looked and n > k:
                # The rows that lead so far are scored: the k-th of them is a floor.
                looked = True
                ahead = np.argpartition(-reached, k - 1)[:k]
                floor = max(floor, float(self.score(ahead, at, given, length).min()))
                scored += k
            most = reached + np.minimum(to_come[j + 1], left[j + 1] * np.sqrt(np.maximum(0.0, 1.0 - used)))
            open_ = most >= floor - _SLACK
            if open_.sum() <= max(k, _CLOSE * n):
                break
        scored += int(open_.sum())
        docs = np.flatnonzero(open_)
        if j + 1 == len(order):
            docs = docs[(reached[docs] > 0) & (reached[docs] >= floor - _SLACK)]
        if not len(docs):
            return none[0], none[1], scored
        scores = self.score(docs, at, given, length)
        keep = (scores > 0) & (scores >= floor - _SLACK)
        return docs[keep], scores[keep], scored


def _search_blocks(batches: Iterator[pa.RecordBatch], queries: list[tuple], k: int, id_col: str, carry: list[str]) -> tuple[pa.Table | None, np.ndarray, int]:
    """Best k rows per query over some blocks, rows scored per query, and rows seen."""
    best, floor = None, np.full(len(queries), -np.inf)
    scored, seen = np.zeros(len(queries), np.int64), 0
    for batch in batches:
        for r in range(batch.num_rows):
            row = {name: batch[name][r].values for name in batch.schema.names}
            block = Block(row)
            seen += len(block.lengths)
            found = [] if best is None else [best]
            for q, (buckets, weights) in enumerate(queries):
                docs, scores, n = block.search(buckets, weights, k, floor[q])
                scored[q] += n
                if len(docs):
                    if len(docs) > k:  # ties stay for the ids to decide
                        top = scores >= np.partition(scores, -k)[-k]
                        docs, scores = docs[top], scores[top]
                    spots = pa.array(docs)
                    columns = {"_q": pa.array(np.full(len(docs), q)), "score": pa.array(scores), id_col: block.ids.take(spots)}
                    found.append(pa.table(columns | {c: row[f"with_{c}"].take(spots) for c in carry}))
            del block, row  # before the next one is read
            if found:
                best = _best(pa.concat_tables(found), k, id_col)
                of = best["_q"].to_numpy()
                counts = np.bincount(of, minlength=len(queries))
                full = counts >= k
                floor[full] = best["score"].to_numpy()[(np.cumsum(counts) - 1)[full]]
    return best, scored, seen


def _vectors(table: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    return [
        (np.array(b.as_py(), np.int64), np.array(w.as_py(), float)) for b, w in zip(table["buckets"], table["weights"])
    ]


def _query_parts(queries: DataFrame, query_id: str, vec_col: str, limit_bytes: int) -> Iterator[pa.Table]:
    """The query side in parts that were counted to hold about `limit_bytes`."""
    plain = queries.where(F.size(F.col(vec_col)["buckets"]) > 0).select(
        F.col(query_id),
        F.col(vec_col)["buckets"].cast("array<int>").alias("buckets"),
        F.col(vec_col)["weights"].cast("array<double>").alias("weights"),
    )
    size = plain.agg(F.sum(F.size("buckets") * F.lit(16) + 64)).first()[0] or 0
    parts = max(1, -(-size // limit_bytes))
    if parts > 1:
        plain = scratch_table(plain, "queries")
    for part in range(parts):
        yield (plain.where(_spread(query_id, F.lit(parts), 3) == part) if parts > 1 else plain).toArrow()


def top_k_sparse(
    queries: DataFrame,
    index: DataFrame,
    k: int = 1,
    query_id: str = "query_id",
    vec_col: str = "vector",
    id_col: str = "id",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """The k most similar rows of an index (`sparse_index`) for every query: query_id, id, carried columns, score, rank.

    Scores are cosines, compared to twelve decimals, equal ones by id. Rows that share no bucket with a query are no match,
    so a query may find fewer than k, and one that is null or empty finds none. Queries are broadcast in parts of a counted
    size, a scan of the index each; ids and query ids are taken to be unique.
    """
    spark = index.sparkSession
    carry = [name.removeprefix("with_") for name in index.schema.names if name.startswith("with_")]
    kinds = {f.name: f.dataType for f in index.schema.fields}
    schema = T.StructType(
        [
            T.StructField(query_id, queries.schema[query_id].dataType),
            T.StructField(id_col, kinds["ids"].elementType),
            *[T.StructField(c, kinds[f"with_{c}"].elementType) for c in carry],
            T.StructField("score", T.DoubleType()),
        ]
    )

    def scan(part: pa.Table) -> DataFrame:
        shared = spark.sparkContext.broadcast((_vectors(part), part[query_id].combine_chunks()))

        def search(batches):
            vectors, ids = shared.value
            best, _, _ = _search_blocks(batches, vectors, k, id_col, carry)
            for out in _emit(best, ids, query_id, schema.fieldNames()):
                yield from out.to_batches()

        return index.mapInArrow(search, schema)

    out = None
    for part in _query_parts(queries, query_id, vec_col, broadcast_bytes):
        if part.num_rows:
            out = scan(part) if out is None else out.unionByName(scan(part))
    return _final(spark.createDataFrame([], schema) if out is None else out, k, query_id, id_col)
