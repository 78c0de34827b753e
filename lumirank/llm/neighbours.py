"""Approximate nearest neighbours by inner product: stable projections, a kd-tree, a chi-square stop.

Vectors get one more coordinate that makes all of them equally long, so the largest inner product is the
smallest distance. A few Gaussian projections keep distances in this sense: the squared distance of two
projections, divided by the true one, follows a chi-square law with as many degrees of freedom as there
are projections. A kd-tree over the projections is cut into cells. A query visits cells in the order of their
projected distance and verifies true distances there, and it stops as soon as what is left in the
projection is so far away that a vector nearer than the k-th best found would have to be an outlier of
that law.

Rows lie in the tasks of their cell; a cell with many rows is cut into blocks, one with many queries
into groups. A first pass visits each query's own cell, which gives it a k-th best distance; the second visits
every other cell the stop test leaves open.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumirank.llm.common import ready, with_columns_from
from lumirank.plans.scratch import scratch_table

PROJECTIONS = 8
CONFIDENCE = 0.96  # of the chi-square law at the stop
SAMPLE_ROWS = 50_000  # vectors the tree is fitted on
CELL_ROWS = 4_096  # rows a cell should have
MOST_CELLS = 4_096  # cells of a tree; larger cells are cut into blocks
BLOCK_ROWS = 16_384
GROUP_QUERIES = 2_048
LEAF_ROWS = 256  # rows a visit verifies at a time inside a block
SEED = 5


def chi_square_quantile(p: float, degrees: int) -> float:
    """The value a chi-square variable stays below with probability p."""

    def below(x: float) -> float:
        # Series of the lower incomplete gamma function.
        a, h = degrees / 2, x / 2
        term = total = 1 / a
        n = a
        while term > total * 1e-16:
            n += 1
            term *= h / n
            total += term
        return total * math.exp(-h + a * math.log(h) - math.lgamma(a)) if h > 0 else 0.0

    low, high = 0.0, 1.0
    while below(high) < p:
        high *= 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < p else (low, middle)
    return high


@dataclass
class Tree:
    """Projections and the splits of a complete kd-tree over them; leaf i is cell i."""

    directions: np.ndarray  # (dimension + 1) x projections
    longest: float  # length that all vectors are filled up to
    axes: np.ndarray
    values: np.ndarray
    low: np.ndarray  # box of each cell
    high: np.ndarray

    def project(self, vectors: np.ndarray, rows: bool) -> np.ndarray:
        """Projections of rows (filled up to equal length) or of queries (unit length, nothing to fill)."""
        if rows:
            rest = np.sqrt(np.maximum(self.longest**2 - np.einsum("ij,ij->i", vectors, vectors), 0))
            full = np.column_stack([vectors / self.longest, rest / self.longest])
        else:
            norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]
            full = np.column_stack([vectors / norms, np.zeros(len(vectors))])
        return full @ self.directions

    def cell_of(self, projected: np.ndarray) -> np.ndarray:
        node = np.zeros(len(projected), np.int64)
        while len(self.axes) and node.min(initial=len(self.axes)) < len(self.axes):
            node = 2 * node + 1 + (projected[np.arange(len(node)), self.axes[node]] >= self.values[node])
        return node - len(self.axes)

    def gaps(self, projected: np.ndarray) -> np.ndarray:
        """Squared distance of every query to every cell's box."""
        out = np.zeros((len(projected), len(self.low)))
        for j in range(projected.shape[1]):
            x = projected[:, j, None]
            out += np.maximum(np.maximum(self.low[:, j] - x, x - self.high[:, j]), 0) ** 2
        return out


def build_tree(sample: np.ndarray, longest: float, cells: int) -> Tree:
    """Median splits of the sample's widest projection, level by level, into `cells` cells (a power of two)."""
    dimension = sample.shape[1]
    directions = np.random.default_rng(SEED).standard_normal((dimension + 1, PROJECTIONS))
    tree = Tree(directions, longest, np.zeros(0, np.int64), np.zeros(0), np.zeros((1, 0)), np.zeros((1, 0)))
    points = tree.project(sample, True)
    parts = [(points, np.full(PROJECTIONS, -np.inf), np.full(PROJECTIONS, np.inf))]
    axes, values = [], []
    while len(parts) < cells:
        deeper = []
        for part, low, high in parts:
            axis = int(np.argmax(part.var(0))) if len(part) else 0
            value = float(np.median(part[:, axis])) if len(part) else 0.0
            axes.append(axis)
            values.append(value)
            right = part[:, axis] >= value
            below, above = high.copy(), low.copy()
            below[axis], above[axis] = min(value, high[axis]), max(value, low[axis])
            deeper += [(part[~right], low, below), (part[right], above, high)]
        parts = deeper
    return Tree(directions, longest, np.array(axes, np.int64), np.array(values), np.array([p[1] for p in parts]), np.array([p[2] for p in parts]))


def _matrix(arrays: pa.Array | pd.Series) -> np.ndarray:
    if isinstance(arrays, pa.Array):
        flat = arrays.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        return flat.reshape(len(arrays), -1) if len(arrays) else flat.reshape(0, 0)
    return np.stack(arrays.to_numpy()).astype(np.float64)


def _leaves(points: np.ndarray) -> list[np.ndarray]:
    """Row numbers of the block's own kd-tree leaves."""
    parts = [np.arange(len(points))]
    while len(parts[0]) > LEAF_ROWS:
        deeper = []
        for rows in parts:
            axis = int(np.argmax(points[rows].var(0)))
            half = len(rows) // 2
            order = np.argpartition(points[rows, axis], half)
            deeper += [rows[order[:half]], rows[order[half:]]]
        parts = deeper
    return [p for p in parts if len(p)]


def search_block(
    tree: Tree, ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best k rows of a block for each query, as (query number, id, score).

    `floors` are k-th best scores known already. Leaves are visited in rounds, nearest first; after each
    round the stop test drops the queries, or the leaves, that it closes.
    """
    stop = chi_square_quantile(CONFIDENCE, PROJECTIONS)
    norms = np.sqrt(np.einsum("ij,ij->i", queries, queries))
    points, asked = tree.project(rows, True), tree.project(queries, False)
    leaves = _leaves(points)
    gap = np.zeros((len(queries), len(leaves)))
    for i, leaf in enumerate(leaves):
        low, high = points[leaf].min(0), points[leaf].max(0)
        gap[:, i] = (np.maximum(np.maximum(low - asked, asked - high), 0) ** 2).sum(1)
    nearest = np.argsort(gap, axis=1, kind="stable")
    best_score = np.full((len(queries), k), -np.inf)
    best_id = np.full((len(queries), k), np.iinfo(np.int64).max)
    done, step = 0, 1
    while done < len(leaves):
        # Squared distance of the filled-up unit vectors: 2 - 2 <q, x> / (|q| longest).
        kth = np.maximum(best_score[:, -1], floors)
        radius = np.where(np.isfinite(kth), stop * np.maximum(2 - 2 * kth / (norms * tree.longest), 1e-12), np.inf)
        turn = nearest[:, done : done + step]
        open_ = np.take_along_axis(gap, turn, 1) <= radius[:, None]
        if not open_.any():
            break
        for leaf in np.unique(turn[open_]):
            who = np.flatnonzero(((turn == leaf) & open_).any(1))
            members = leaves[leaf]
            score = queries[who] @ rows[members].T
            score[query_ids[who][:, None] == ids[members][None, :]] = -np.inf
            _merge(best_score, best_id, who, score, ids[members], queries, rows[members], k)
        done += step
        step *= 2
    who, at = np.nonzero(np.isfinite(best_score))
    return who, best_id[who, at], best_score[who, at]


def _merge(best_score, best_id, who, rough, ids, queries, rows, k) -> None:
    """Take a leaf's rows into the best lists. `rough` decides what is computed once more, pair by pair,

    so that equal vectors have equal scores wherever they lie."""
    margin = 1e-9 * (1 + np.abs(rough).max(initial=0, where=np.isfinite(rough)))
    part = min(k, rough.shape[1]) - 1
    enough = -np.partition(-rough, part, axis=1)[:, part] if rough.shape[1] >= k else np.full(len(who), -np.inf)
    bar = np.maximum(best_score[who, -1], np.where(np.isfinite(enough), enough, -np.inf)) - margin
    q, r = np.nonzero((rough >= bar[:, None]) & np.isfinite(rough))
    if not len(q):
        return
    exact = np.einsum("ij,ij->i", queries[who[q]], rows[r])
    known_q, known_at = np.nonzero(np.isfinite(best_score[who]))
    all_q = np.concatenate([q, known_q])
    all_s = np.concatenate([exact, best_score[who[known_q], known_at]])
    all_i = np.concatenate([ids[r], best_id[who[known_q], known_at]])
    order = np.lexsort((all_i, -all_s, all_q))
    all_q, all_s, all_i = all_q[order], all_s[order], all_i[order]
    first = np.flatnonzero(np.diff(all_q, prepend=-1))
    rank = np.arange(len(all_q)) - np.repeat(first, np.diff(np.append(first, len(all_q))))
    keep = rank < k
    best_score[who[all_q[keep]], rank[keep]] = all_s[keep]
    best_id[who[all_q[keep]], rank[keep]] = all_i[keep]


_FOUND = "query_id long, vec_id long, score double"


def _visit(rows: DataFrame, visits: DataFrame, shared, k: int) -> DataFrame:
    """Search each (cell, block) by the query groups that visit it."""

    def search(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        queries, ids = _matrix(right["vector"]), right["query_id"].to_numpy()
        who, found, score = search_block(
            shared.value, left["vec_id"].to_numpy(), _matrix(left["vector"]), ids, queries, right["kth"].fillna(-np.inf).to_numpy(), k
        )
        return pd.DataFrame({"query_id": ids[who], "vec_id": found, "score": score})

    keys = ["cell", "block", "group"]
    return rows.groupBy(*keys).cogroup(visits.groupBy(*keys)).applyInPandas(search, _FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query; ties go to the smaller id."""
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def usable(vector: Column) -> Column:
    """Vectors that take part: not null or empty, every component there and finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest_vectors(table: DataFrame, queries: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Each query's k nearest rows found, largest inner product first: query_id, rank, vec_id, score.

    `queries` selects the rows of `table` that ask; every other row is a candidate, never the row
    itself. Scores are those of the original vectors in double precision, ties go to the smaller id; a
    query with fewer candidates gets all of them. The tree is fitted on at most SAMPLE_ROWS vectors, every
    vector is indexed. Vectors that are null, empty, zero or hold a null or non-finite component take no part, nor
    do rows without an id; all others must have one dimension. Rows repeated with one id and vector count
    once. Other columns are ignored; an empty table gives no rows.
    """
    spark = ready(table.sparkSession)
    base = (
        table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"), queries.alias("asks"))
        .where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
        .dropDuplicates(["vec_id", "vector"])
    )
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda t, x: t + x * x))
    base = scratch_table(base.withColumn("length", length), "vectors")
    total, longest, narrow, wide = base.agg(F.count(F.lit(1)), F.max("length"), F.min(F.size("vector")), F.max(F.size("vector"))).first()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if narrow != wide:
        raise ValueError(f"vectors have between {narrow} and {wide} components")
    sample = base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("vector").toArrow()["vector"].combine_chunks()
    cells = min(MOST_CELLS, 1 << max(0, math.ceil(math.log2(max(1, total / CELL_ROWS)))))
    tree = build_tree(_matrix(sample), longest, cells)
    shared = spark.sparkContext.broadcast(tree)

    def make():
        def place(vectors):
            made = _matrix(vectors)
            return [pa.array(shared.value.cell_of(shared.value.project(made, True)))] if len(made) else [pa.array([], pa.int64())]

        return place

    placed = scratch_table(with_columns_from(base, ["vector"], [T.StructField("cell", T.LongType())], make), "cells")
    rows_in = {r["cell"]: (r["rows"], r["asking"]) for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), F.count_if("asks").alias("asking")).collect()}
    blocks = {c: max(1, -(-n // BLOCK_ROWS)) for c, (n, _) in rows_in.items()}
    counts = spark.sparkContext.broadcast(blocks)
    asking = placed.where("asks").select(F.col("vec_id").alias("query_id"), "vector", "cell")
    n_queries = sum(q for _, q in rows_in.values())
    groups = max(1, -(-n_queries // GROUP_QUERIES))

    def per_cell(numbers: dict) -> Column:
        """The number of a row's cell, looked up by its place in a constant list."""
        return F.get(F.array(*[F.lit(numbers.get(c, 1)).cast("long") for c in range(len(tree.low))]), F.col("cell").cast("int"))

    block_of = per_cell(blocks)
    rows = placed.withColumn("block", F.pmod(F.xxhash64("vec_id"), block_of))

    # First pass: the query's own cell.
    home_groups = per_cell({c: max(1, -(-asking // GROUP_QUERIES)) for c, (_, asking) in rows_in.items()})
    own = rows.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), home_groups - 1)))
    home = (
        asking.withColumn("group", F.pmod(F.xxhash64("query_id"), home_groups))
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), block_of - 1)))
        .withColumn("kth", F.lit(None).cast("double"))
    )
    first = scratch_table(_best(_visit(own.select("cell", "block", "group", "vec_id", "vector"), home, shared, k), k), "first")
    floor = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))

    # Second pass: every other cell the stop test leaves open.
    stop = chi_square_quantile(CONFIDENCE, PROJECTIONS)

    def make_visits():
        def visits(vectors, kth, home_cell):
            t, where = shared.value, counts.value
            made = _matrix(vectors)
            if not len(made):
                return [pa.array([], pa.list_(pa.int64()))]
            norm = np.sqrt(np.einsum("ij,ij->i", made, made))
            best = np.nan_to_num(kth.to_numpy(zero_copy_only=False).astype(float), nan=-np.inf)
            radius = np.where(np.isfinite(best), stop * np.maximum(2 - 2 * best / (norm * t.longest), 1e-12), np.inf)
            open_ = t.gaps(t.project(made, False)) <= radius[:, None]
            open_[np.arange(len(made)), home_cell.to_numpy()] = False
            return [pa.array([[c for c in np.flatnonzero(o).tolist() if c in where] for o in open_], pa.list_(pa.int64()))]

        return visits

    floored = asking.join(floor, "query_id", "left").withColumnRenamed("cell", "home")
    planned = with_columns_from(floored, ["vector", "kth", "home"], [T.StructField("cells", T.ArrayType(T.LongType()))], make_visits)
    away = (
        planned.withColumn("cell", F.explode("cells"))
        .withColumn("group", F.pmod(F.xxhash64("query_id"), F.lit(groups)))
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), block_of - 1)))
        .select("cell", "block", "group", "query_id", "vector", "kth")
    )
    spread = rows.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    second = _visit(spread.select("cell", "block", "group", "vec_id", "vector"), away, shared, k)
    merged = _best(first.select("query_id", "vec_id", "score").unionByName(second), k)
    return merged.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
