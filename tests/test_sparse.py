"""Search through the inverted index against brute force, and the work it saves."""

import os
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lumirank.functions.text import bucket_lists
from lumirank.operators import sparse
from lumirank.operators.embedding import SparseTextEmbedder

SCHEMA = "id long, vector struct<buckets:array<int>,weights:array<double>>, name string"
TABLES = "/root/testdata"


def made(seed, n, dim=60, hot=True):
    """Vectors with one bucket in all of them, a third of them equal, ties, and rows without a vector."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        some = {rng.randrange(1, dim): float(rng.choice([1, 1, 2, 5])) for _ in range(rng.randint(1, 12))}
        if hot:
            some[0] = float(rng.choice([1, 3]))
        if i % 3 == 0:
            some = {0: 1.0, 7: 2.0, 11: 1.0}
        rows.append((i, some))
    rows[5 % n] = (rows[5 % n][0], None)
    rows[6 % n] = (rows[6 % n][0], {})
    rows[8 % n] = (rows[8 % n][0], {3: 0.0})
    return rows


def frame(spark, rows):
    as_lists = lambda v: None if v is None else (sorted(v), [v[b] for b in sorted(v)])
    return spark.createDataFrame([(i, as_lists(v), f"n{i}") for i, v in rows], SCHEMA)


def expected(queries, rows, k):
    out = []
    for qid, q in queries:
        found = []
        for rid, v in rows:
            if not q or not v:
                continue
            dot = sum(w * v.get(b, 0.0) for b, w in q.items())
            if dot > 0:
                found.append((-round(dot / np.sqrt(sum(w * w for w in q.values())) / np.sqrt(sum(w * w for w in v.values())), 12), rid))
        out += [(qid, rank + 1, rid, -s) for rank, (s, rid) in enumerate(sorted(found)[:k])]
    return sorted(out)


def same(df, wanted):
    got = sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in df.collect())
    assert [g[:3] for g in got] == [w[:3] for w in wanted]
    assert np.allclose([g[3] for g in got], [w[3] for w in wanted], atol=1e-11)


@pytest.mark.parametrize("k,block_rows,postings,limit", [(1, 8192, 10**6, 1 << 20), (7, 16, 10**6, 1 << 20), (5, 8192, 90, 2000), (400, 50, 200, 1 << 20)])
def test_equals_brute_force(spark, k, block_rows, postings, limit):
    rows, queries = made(1, 300), made(2, 40)
    index = sparse.sparse_index(frame(spark, rows).repartition(3), carry=("name",), block_rows=block_rows, block_postings=postings)
    q = frame(spark, queries).withColumnRenamed("id", "query_id")
    found = sparse.top_k_sparse(q, index, k, broadcast_bytes=limit)
    same(found, expected(queries, rows, k))
    assert found.where(F.col("name") != F.concat(F.lit("n"), F.col("id"))).count() == 0


def test_a_hot_bucket_is_split(spark):
    index = sparse.sparse_index(frame(spark, made(3, 400)).coalesce(1), block_rows=50)
    lists = index.select(F.posexplode("buckets").alias("at", "bucket"), "ends").where("bucket = 0")
    longest = lists.select((F.col("ends")[F.col("at")] - F.when(F.col("at") > 0, F.col("ends")[F.col("at") - 1]).otherwise(0)).alias("n"))
    assert index.count() == 8 and longest.agg(F.max("n")).first()[0] <= 50
    plan = index._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_nothing_to_find(spark):
    rows, none = frame(spark, made(4, 20)), frame(spark, made(4, 20)).limit(0)
    q = rows.withColumnRenamed("id", "query_id")
    assert sparse.top_k_sparse(q, sparse.sparse_index(none), 3).collect() == []
    assert sparse.top_k_sparse(none.withColumnRenamed("id", "query_id"), sparse.sparse_index(rows), 3).collect() == []
    with pytest.raises(Exception, match="not negative"):
        sparse.sparse_index(frame(spark, [(1, {2: -1.0})])).collect()


def test_sparse_counts_are_the_dense_ones(spark):
    rows = spark.createDataFrame([(1, "One two TWO, two"), (2, ""), (3, None), (4, "a-b c")], "id long, text string")
    got = {r["id"]: r["v"] for r in rows.select("id", SparseTextEmbedder(1 << 20).column(F.col("text")).alias("v")).collect()}
    assert sorted(got[1]["weights"]) == [1.0, 3.0] and got[2]["buckets"] == [] and got[3] is None and len(got[4]["buckets"]) == 3


@pytest.mark.skipif(not os.path.isdir(f"{TABLES}/sf0.01"), reason="no test tables here")
@pytest.mark.parametrize("dim,share", [(512, 0.4), (1 << 20, 0.25)])
def test_less_than_half_of_the_pairs_are_scored(dim, share):
    """Of the pairs that share a bucket. Measured: 0.27 with 512 buckets, 0.06 to 0.1 with 2^20."""
    texts = {t: [x.lower() for x in pq.read_table(f"{TABLES}/sf0.01/{t}.parquet")["text"].to_pylist()] for t in ("documents", "benchmark")}
    docs, asked = (bucket_lists(pa.array(texts[t]), dim) for t in ("documents", "benchmark"))
    posted = sparse._posted(pa.table({"id": np.arange(len(docs)), "buckets": docs.field(0), "weights": docs.field(1)}), [])
    block = pa.RecordBatch.from_arrays(list(posted.values()), names=list(posted))
    queries = sparse._vectors(pa.table({"buckets": asked.field(0), "weights": asked.field(1)}))
    _, scored, _ = sparse._search_blocks([block], queries, 10, "id", [])
    held = [set(d) for d in docs.field(0).to_pylist()]
    sharing = sum(not wanted.isdisjoint(d) for wanted in map(set, asked.field(0).to_pylist()) for d in held)
    assert scored.sum() < share * sharing


def test_blocks_are_bounded_by_postings(spark):
    """What a task holds of a block does not grow with the rows it has: long vectors make blocks of fewer rows."""
    rows = [(i, (list(range(500)), [1.0 + (i + b) % 7 for b in range(500)]), "") for i in range(4500)]
    index = sparse.sparse_index(spark.createDataFrame(rows, SCHEMA).coalesce(1)).select(F.size("docs"), F.size("ids")).collect()
    assert sum(r[1] for r in index) == 4500 and max(r[0] for r in index) <= 1_000_000
