import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumirank.functions import vectors
from lumirank.operators import search, validate

DIM = 16
TABLES = "/root/testdata"


def expected(queries, rows, k):
    """Brute force: score desc, id asc; rows without length last and without score."""
    out = []
    for qid, q in queries:
        q = np.asarray(q, np.float32).astype(float)
        scored = []
        for rid, v in rows:
            v = np.asarray(v, np.float32).astype(float)
            norm = np.linalg.norm(q) * np.linalg.norm(v)
            scored.append((round(float(q @ v / norm), 9) if norm else None, rid))
        scored.sort(key=lambda t: (t[0] is None, -(t[0] or 0.0), t[1]))
        out += [(qid, rank + 1, rid, s) for rank, (s, rid) in enumerate(scored[:k])]
    return sorted(out)


def answers(df):
    return sorted(
        (r["query_id"], r["rank"], r["id"], None if r["score"] is None else round(r["score"], 9)) for r in df.collect()
    )


def fixture(seed, n_rows=400, n_queries=60):
    """Clusters, a third of all rows one and the same vector, exact ties, and vectors without length."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((5, DIM)) * 4
    rows = [centres[i % 5] + rng.standard_normal(DIM) * 0.3 for i in range(n_rows)]
    for i in range(0, n_rows, 3):
        rows[i] = centres[0]
    rows[min(7, n_rows - 1)] = np.zeros(DIM)
    rows = [(i, np.round(v, 3).tolist()) for i, v in enumerate(rows)]
    queries = [(100 + i, np.round(centres[i % 5] + rng.standard_normal(DIM), 3).tolist()) for i in range(n_queries)]
    queries.append((999, [0.0] * DIM))
    return queries, rows


def frames(spark, queries, rows):
    q = spark.createDataFrame(queries, "query_id long, embedding array<float>")
    c = spark.createDataFrame(rows, "id long, values array<float>").repartition(5)
    return q, c


@pytest.mark.parametrize("k", [1, 7])
def test_scan_equals_brute_force(spark, k):
    queries, rows = fixture(1)
    q, c = frames(spark, queries, rows)
    assert answers(search.knn_join(q, c, k)) == expected(queries, rows, k)


@pytest.mark.parametrize("k,scan,block,scans", [(1, 20, 40, 9), (7, 20, 25, 0), (3, 7, 1000, 9), (3, 7, 60, 2)])
def test_many_queries_equal_brute_force_for_any_size(spark, k, scan, block, scans):
    queries, rows = fixture(2)
    q, c = frames(spark, queries, rows)
    got = search.knn_join(q, c, k, broadcast_bytes=8 * DIM * scan, block_bytes=8 * DIM * block, max_scans=scans)
    assert answers(got) == expected(queries, rows, k)


@pytest.mark.parametrize("buffer", [1, 10_000])
def test_tiles_and_buffers_do_not_change_the_answer(monkeypatch, buffer):
    import pyarrow as pa

    for name, value in (("_TILE_QUERIES", 7), ("_TILE_ROWS", 11), ("_BUFFER_ROWS", buffer)):
        monkeypatch.setattr(search, name, value)
    queries, rows = fixture(6, 150, 20)
    table = pa.table({"id": [r[0] for r in rows], "_v": pa.array([r[1] for r in rows], pa.list_(pa.float32()))})
    unit = search._matrix(pa.array([q[1] for q in queries], pa.list_(pa.float32())), DIM)
    best = search._scan(unit, table.to_batches(max_chunksize=40), 5, "id", "_v")
    got = sorted((queries[q][0], i, s) for q, i, s in zip(best["_q"].to_pylist(), best["id"].to_pylist(), best["score"].to_pylist()))
    want = sorted((q, i, -np.inf if s is None else s) for q, _, i, s in expected(queries, rows, 5))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert np.allclose([g[2] for g in got if g[2] > -2], [w[2] for w in want if w[2] > -2], atol=1e-8)


@pytest.mark.parametrize("block", [20, 1000])
def test_approximate_search_within_its_cells(spark, block):
    queries, rows = fixture(2)
    q, c = frames(spark, queries, rows)
    with_length = [r for r in rows if any(r[1])]
    some = [x for x in queries if any(x[1])]
    q = q.where("query_id <> 999")
    options = {"n_pivots": 12, "block_bytes": 8 * DIM * block}
    want = expected(some, with_length, 7)
    assert answers(search.knn_join_approx(q, c, 7, n_probe=12, **options)) == want
    got = answers(search.knn_join_approx(q, c, 7, n_probe=4, **options))
    assert len({g[::2] for g in got} & {w[::2] for w in want}) >= 0.9 * len(want)
    assert {r["id"] for r in search.knn_join_approx(q, c, 1, n_probe=1, n_pivots=1).collect()} <= {r[0] for r in rows}
    assert search.knn_join_approx(q, c.limit(0), 1).count() == 0 and search.knn_join_approx(q.limit(0), c, 1).count() == 0


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables here")
@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_defaults_find_nine_in_ten_on_the_given_embeddings(spark, sf):
    e = spark.read.parquet(f"{TABLES}/{sf}/embeddings.parquet")
    q = e.select(F.col("vec_id").alias("query_id"), "embedding")
    c = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("values"))
    # Six, of which the query's own row is taken away: it is always found.
    true, found = (
        {(r["query_id"], r["id"]) for r in form(q, c, 6).collect() if r["query_id"] != r["id"]}
        for form in (search.knn_join, search.knn_join_approx)
    )
    recall = len(true & found) / len(true)
    print(f"recall {sf}: {recall:.4f} of {len(true)}")
    assert recall >= 0.9


def test_more_neighbours_than_rows(spark):
    queries, rows = fixture(3, 6, 3)
    q, c = frames(spark, queries, rows)
    want = expected(queries, rows, 10)
    assert answers(search.knn_join(q, c, 10)) == want
    assert answers(search.knn_join(q, c, 10, broadcast_bytes=8 * DIM * 2, max_scans=1)) == want


def test_empty_sides(spark):
    queries, rows = fixture(4, 6, 3)
    q, c = frames(spark, queries, rows)
    for limit in (8 * DIM, 1 << 20):
        assert search.knn_join(q.limit(0), c, 2, broadcast_bytes=limit).count() == 0
        assert search.knn_join(q, c.limit(0), 2, broadcast_bytes=limit).count() == 0


def test_query_side_is_fetched_up_to_the_bound_only(spark):
    queries, rows = fixture(5)
    q, _ = frames(spark, queries, rows)
    q = q.withColumnRenamed("embedding", "_v")
    assert search._small_side(q, "query_id", "_v", 8 * DIM * len(queries)).num_rows == len(queries)
    assert search._small_side(q, "query_id", "_v", 8 * DIM * (len(queries) - 1)) is None


def test_top_k_returns_metadata_and_path(spark):
    rows = [("a.png", [1.0, 0.0], ("dir/a.png", "t"), "x"), ("b.png", [0.0, 1.0], None, "x"), ("c.png", [1.0, 0.1], None, "y")]
    c = spark.createDataFrame(
        rows, "id string, values array<float>, metadata struct<image_path:string,preprocess_time:string>, namespace string"
    )
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0])], "query_id long, embedding array<float>")
    got = {r["query_id"]: r for r in search.top_k(q, c, 1, namespace="x", include_values=True).collect()}
    assert (got[1]["id"], got[1]["image_path"], got[1]["score"], got[1]["values"]) == ("a.png", "dir/a.png", 1.0, [1.0, 0.0])
    assert (got[2]["id"], got[2]["image_path"]) == ("b.png", "b.png")
    plain = search.top_k(q, c, 1, include_metadata=False)
    assert plain.columns == ["query_id", "rank", "id", "score"]


def test_wrong_dimension_fails_loudly_and_can_be_split_off(spark):
    c = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0]), (3, None)], "id long, values array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<float>")
    with pytest.raises(Exception, match="every vector must have 2 values"):
        search.knn_join(q, c, 1).collect()
    good, bad = validate.check_dimension(c, 2)
    assert [r["id"] for r in search.knn_join(q, good, 5).collect()] == [1]
    assert {r["id"]: r["reason"] for r in bad.collect()} == {2: "dimension 1, expected 2", 3: "dimension -1, expected 2"}
    with pytest.raises(Exception, match="in a collection of 2"):
        validate.require_dimension(c, 2).collect()


def test_no_match_report(spark):
    q = spark.createDataFrame([(1,), (2,)], "query_id long")
    hits = spark.createDataFrame([(2,), (2,)], "query_id long")
    assert [tuple(r) for r in search.no_match_report(q, hits).collect()] == [(1, "no matches found")]


def test_cosine_and_norm_columns(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    rows = df.select(
        vectors.cosine(F.col("a"), F.col("b")).alias("c"), vectors.normalize_l2(F.col("a")).alias("n")
    ).collect()
    assert rows[0]["c"] == pytest.approx(0.96) and rows[0]["n"] == pytest.approx([0.6, 0.8])
    assert rows[1]["c"] is None and rows[1]["n"] is None


def test_vector_dimension_and_conversion(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "id long, v array<float>")
    assert vectors.vector_dim(df, "v") == vectors.vector_dim(df, "v", strict=True) == 2
    ml = vectors.to_vector(df, "v")
    assert vectors.to_array(ml, "v").orderBy("id").first()["v"] == [1.0, 2.0]
    odd = df.unionByName(spark.createDataFrame([(3, [1.0])], "id long, v array<float>"))
    with pytest.raises(ValueError, match="between 1 and 2"):
        vectors.vector_dim(odd, "v", strict=True)


def test_scan_shuffles_only_the_best_rows(spark):
    queries, rows = fixture(6)
    q, c = frames(spark, queries, rows)
    plan = search.knn_join(q, c, 3)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "WindowGroupLimit" in plan


def test_blocks_and_scans_do_not_multiply_with_the_table():
    """A small block size does not mean blocks by the square of the rows; large tables still get blocks of bounded size."""
    assert search._block_count(2000 * 512, 1 << 17) == 8
    assert search._block_count(600_000 * 512, 1 << 15) == search.MOST_BLOCKS
    assert search._block_count(100 * search.BLOCK_BYTES, 1 << 15) == 100
    assert search._block_count(0, 1 << 15) == 1


def test_parts_of_the_query_side_stay_few(spark, monkeypatch):
    queries, rows = fixture(4, n_queries=120)
    q, c = frames(spark, queries, rows)
    scans = []
    plan = search._scan_plan
    monkeypatch.setattr(search, "_scan_plan", lambda *a: scans.append(1) or plan(*a))
    found = search.knn_join(q, c, 3, broadcast_bytes=4 * 8 * DIM, max_scans=1000)
    assert len(scans) == search.MAX_SCANS
    assert answers(found) == expected(queries, rows, 3)


def test_carried_columns_are_held_once_per_row(spark, monkeypatch):
    """However many queries find a row, a task holds its other columns once; few bytes at a time give the same rows."""
    queries, rows = fixture(5)
    unit = search._matrix(pa.array([v for _, v in queries], pa.list_(pa.float32())), DIM)
    table = pa.table({"id": [i for i, _ in rows], "text": [f"row {i}" for i, _ in rows], "_v": pa.array([v for _, v in rows], pa.list_(pa.float32()))})
    monkeypatch.setattr(search, "_HELD_BYTES", 100)
    monkeypatch.setattr(search, "_EMIT_ROWS", 50)
    carried = search._Carried()
    best = search._scan(unit, table.to_batches(max_chunksize=40), 5, "id", "_v", carried)
    assert best.column_names == ["_q", "score", "id", "_row"] and best.num_rows == 5 * len(queries)
    assert carried.rows == len(set(best["id"].to_pylist()))
    parts = list(search._emit(best, pa.array([q for q, _ in queries]), "query_id", ["query_id", "id", "text", "score"], carried))
    assert [p.num_rows for p in parts][:-1] == [50] * (len(parts) - 1)
    out = pa.concat_tables(parts)
    assert out["text"].to_pylist() == [f"row {i}" for i in out["id"].to_pylist()]


def test_parts_of_the_queries_leave_no_broadcasts(spark, monkeypatch):
    """What was broadcast for a scan is gone before the next one."""
    rng = np.random.default_rng(8)
    rows = spark.createDataFrame([(i, rng.standard_normal(8).tolist()) for i in range(300)], "id long, values array<float>")
    q = rows.select(F.col("id").alias("query_id"), F.col("values").alias("embedding"))
    plan, made = search._scan_plan, []

    def one(*args):
        assert not any(b._jbroadcast.isValid() for b in made)
        scanned, shared = plan(*args)
        made.append(shared)
        return scanned, shared

    whole = sorted(map(tuple, search.knn_join(q, rows, 3).collect()))
    monkeypatch.setattr(search, "_scan_plan", one)
    found = search.knn_join(q, rows, 3, broadcast_bytes=64 * 60)
    assert len(made) == 5 and not any(b._jbroadcast.isValid() for b in made)
    assert sorted(map(tuple, found.collect())) == whole
