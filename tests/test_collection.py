from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lumirank.functions import records
from lumirank.operators.paths import list_files, resolve_existing_path
from lumirank.sources import collection

T0 = datetime(2024, 1, 1)
ROW = (
    "id string, values array<float>, metadata struct<image_path:string,preprocess_time:string>, "
    "updated_at timestamp, source_seq long"
)


def batch(spark, *rows):
    """rows of (id, value, seconds, seq)"""
    return spark.createDataFrame(
        [(i, [float(v), 0.0], (f"p/{i}", str(s)), T0 + timedelta(seconds=s), q) for i, v, s, q in rows], ROW
    )


def state(spark, path, **kw):
    return {(r["namespace"], r["id"]): r["values"][0] for r in collection.read_collection(spark, path, **kw).collect()}


@pytest.fixture()
def coll(spark, tmp_path):
    path = str(tmp_path / "c")
    collection.ensure_collection(spark, path, 2, "test")
    return path


def test_ensure_reuses_and_checks(spark, coll):
    again = collection.ensure_collection(spark, coll, 2, "other")
    assert again == {"name": "test", "dimension": 2, "metric": "cosine"}
    with pytest.raises(ValueError, match="dimension 2, not 3"):
        collection.ensure_collection(spark, coll, 3)
    with pytest.raises(ValueError, match="cosine"):
        collection.ensure_collection(spark, coll, 2, metric="dotproduct")
    with pytest.raises(FileNotFoundError):
        collection.read_collection(spark, coll + "-missing")


def test_last_write_wins_within_and_across_batches(spark, coll):
    collection.upsert(spark, coll, batch(spark, ("a", 1, 0, 0), ("a", 2, 0, 1), ("b", 3, 5, 0)))
    space = collection.DEFAULT_NAMESPACE
    assert state(spark, coll) == {(space, "a"): 2.0, (space, "b"): 3.0}
    collection.upsert(spark, coll, batch(spark, ("a", 4, 9, 0), ("b", 5, 1, 0)))  # an older time, but a later write
    want = {(space, "a"): 4.0, (space, "b"): 5.0}
    assert state(spark, coll) == want
    collection.compact(spark, coll)
    assert state(spark, coll) == want
    collection.upsert(spark, coll, batch(spark, ("c", 6, 0, 0), ("a", 7, 10, 0)))
    want |= {(space, "a"): 7.0, (space, "c"): 6.0}
    assert state(spark, coll) == want
    collection.compact(spark, coll)
    collection.compact(spark, coll)
    assert state(spark, coll) == want


def test_replayed_batch_replaces_itself(spark, coll):
    rows = batch(spark, ("a", 1, 0, 0), ("b", 2, 0, 0))
    for _ in range(2):
        collection.upsert(spark, coll, rows, batch="s-0")
    raw = spark.read.parquet(f"{coll}/batches")
    assert raw.select("b").distinct().count() == 1 and raw.count() == 2 and len(state(spark, coll)) == 2
    collection.compact(spark, coll)
    collection.upsert(spark, coll, rows, batch="s-0")  # run again after it was folded: same rows, no effect
    assert len(state(spark, coll)) == 2


@pytest.mark.parametrize("fold", [False, True])
def test_a_later_write_with_the_same_time_wins(spark, coll, fold):
    for value in (1, 2, 3):
        collection.upsert(spark, coll, batch(spark, ("a", value, 0, 0), ("b", -value, 5 - value, 0)))
        if fold:
            collection.compact(spark, coll)
        assert {i: v for (_, i), v in state(spark, coll).items()} == {"a": float(value), "b": float(-value)}


def test_rows_equal_in_time_and_sequence_settle_alike(spark, coll):
    rows = batch(spark, *[("a", v, 0, 0) for v in range(20)])
    collection.upsert(spark, coll, rows.repartition(5))
    first = state(spark, coll)
    collection.upsert(spark, coll, rows.repartition(3))
    assert state(spark, coll) == first


def test_vacuum_leaves_the_newest_state(spark, coll, tmp_path):
    for value in (1, 2):
        collection.upsert(spark, coll, batch(spark, ("a", value, 0, 0)))
        collection.compact(spark, coll)
    collection.upsert(spark, coll, batch(spark, ("b", 3, 0, 0)))
    before = state(spark, coll)
    collection.vacuum(spark, coll)
    assert state(spark, coll) == before
    root = tmp_path / "c"
    assert sorted(str(p.relative_to(root)) for p in root.glob("*/v=*")) == ["base/v=2", "batches/v=2", "meta/v=2"]


def test_a_read_scans_the_base_once_and_sends_only_ids(spark, coll):
    collection.upsert(spark, coll, batch(spark, *[(f"i{i}", i, 0, 0) for i in range(50)]))
    collection.compact(spark, coll)
    collection.upsert(spark, coll, batch(spark, ("i1", 9, 0, 0)))
    plan = collection.read_collection(spark, coll)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 3  # the base, the ids written since, the rows written since
    assert "LeftAnti, BuildRight" in plan


def test_namespaces_are_separate_and_pruned(spark, coll):
    collection.upsert(spark, coll, batch(spark, ("a", 1, 0, 0)), "x")
    collection.upsert(spark, coll, batch(spark, ("a", 2, 0, 0)), "y")
    assert state(spark, coll) == {("x", "a"): 1.0, ("y", "a"): 2.0}
    assert state(spark, coll, namespace="y") == {("y", "a"): 2.0}
    collection.compact(spark, coll)
    plan = collection.read_collection(spark, coll, "y")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(namespace" in plan
    got = {r["namespace"]: r["records"] for r in collection.describe_collection(spark, coll).collect()}
    assert got == {"x": 1, "y": 1}


def test_wrong_dimension_is_not_written(spark, coll):
    bad = batch(spark, ("a", 1, 0, 0)).withColumn("values", F.array(F.lit(1.0)).cast("array<float>"))
    with pytest.raises(Exception, match="vector of dimension 1"):
        collection.upsert(spark, coll, bad)
    assert state(spark, coll) == {}


def test_records_take_the_name_of_the_file(spark):
    df = spark.createDataFrame([("a/b/c.png", [1.0], T0), ("x/", [2.0], T0)], "p string, v array<float>, t timestamp")
    got = collection.records(df, F.col("p"), F.col("v"), F.col("t")).collect()
    assert [r["id"] for r in got] == ["c.png", ""]
    assert got[0]["metadata"].asDict() == {"image_path": "a/b/c.png", "preprocess_time": "2024-01-01 00:00:00.000000"}
    whole = collection.records(df, F.col("p"), F.col("v"), F.col("t"), id_col=F.col("p"), iso=True).first()
    assert (whole["id"], whole["metadata"]["preprocess_time"]) == ("a/b/c.png", "2024-01-01T00:00:00.000000")


def test_match_text(spark):
    df = spark.createDataFrame([("q", 0.123456)], "q string, s double")
    text = df.select(records.format_match(F.col("q"), F.lit("p.png"), F.col("s"))).first()[0]
    assert text == "Original query: q\n Displayed `p.png` (score: 0.1235)"


def test_missing_file_falls_back_to_its_name(spark, tmp_path):
    (tmp_path / "images").mkdir()
    (tmp_path / "far").mkdir()
    for name in ("images/a.png", "images/b.png", "far/b.png"):
        (tmp_path / name).write_bytes(b"x")
    files = list_files(spark, str(tmp_path))
    root = files.where("path like '%far/b.png'").first()["path"].removesuffix("far/b.png")
    stored = [f"{root}far/a.png", f"{root}far/b.png", f"{root}far/c.png", f"{root}far/a.png", None]
    matches = spark.createDataFrame([(i, p) for i, p in enumerate(stored)], "n long, image_path string")
    got = {r["n"]: r["found_path"] for r in resolve_existing_path(matches, files, root + "images").collect()}
    assert got == {0: f"{root}images/a.png", 1: f"{root}far/b.png", 2: None, 3: f"{root}images/a.png", 4: None}


def test_paths_of_different_sources_meet(spark, tmp_path):
    (tmp_path / "images").mkdir()
    for name in ("a b.png", "images/c+d.png", "e.png"):
        (tmp_path / name).write_bytes(b"x")
    files = list_files(spark, str(tmp_path))
    root = str(tmp_path)
    stored = [f"file://{root}/a%20b.png", f"file:{root}/a b.png", f"{root}/e.png", f"file://{root}/c+d.png", f"file://{root}/no.png"]
    matches = spark.createDataFrame([(i, p) for i, p in enumerate(stored)], "n long, image_path string")
    got = {r["n"]: r["found_path"] for r in resolve_existing_path(matches, files).collect()}
    assert [got[i] for i in range(3)] == stored[:3] and got[4] is None
    assert got[3].endswith("images/c+d.png")
    images = spark.read.format("image").load(root).select("image.origin")
    found = resolve_existing_path(images.withColumnRenamed("origin", "image_path"), files)
    assert found.where("found_path IS NULL").count() == 0
