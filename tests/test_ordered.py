import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumirank.operators import arrivals, runlogs
from lumirank.plans.ordered import index_within
from lumirank.plans.scratch import folders, scratch_root
from lumirank.sources.logs import read_log_lines


def numbered(spark, n, seed=1):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "a", "a", None, "b"]), i, rng.randrange(10**6)) for i in range(n)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, id long, v long").repartition(3)


@pytest.mark.parametrize("bound", [10**6, 10])
@pytest.mark.parametrize("keys", [[], ["k"]])
def test_index_within_is_dense_for_any_group_bound(spark, bound, keys):
    df = numbered(spark, 400)
    got = index_within(df, ["v", "id"], keys, group_rows=bound).collect()
    groups = {}
    for r in got:
        groups.setdefault(r["k"] if keys else None, []).append(r)
    assert sum(map(len, groups.values())) == 400
    for rows in groups.values():
        rows.sort(key=lambda r: (r["v"], r["id"]))
        assert [r["row_index"] for r in rows] == list(range(len(rows)))


def arrivals_fixture(spark, seed=3):
    rng = random.Random(seed)
    t0 = datetime(2024, 1, 1)
    rows, clock = [], {}
    for i in range(600):
        key = rng.choice(["hot", "hot", "hot", "x", None])
        step = rng.choice([0, 1, 2, 4.999999, 5, 5.000001, 60])
        clock[key] = clock.get(key, t0) + timedelta(seconds=step)
        rows.append((key, i, clock[key]))
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "key string, id long, ts timestamp")


def expected_batches(rows, max_count, gap):
    out = {}
    by_key = {}
    for key, i, ts in rows:
        by_key.setdefault(key, []).append((ts, i))
    for key, items in by_key.items():
        session, filled, last = 0, 0, None
        for ts, i in sorted(items):
            if last is None or ts - last >= gap:
                session, filled = session + 1, 0
            out[i] = (session, filled // max_count, filled % max_count)
            filled, last = filled + 1, ts
    return out


@pytest.mark.parametrize("bound", [10**6, 3])
def test_micro_batches_follow_the_count_and_gap_rule(spark, bound):
    rows, df = arrivals_fixture(spark)
    gap = timedelta(seconds=5)
    got = arrivals.micro_batches(df, 3, gap, ["key"], group_rows=bound).collect()
    assert {r["id"]: (r["session"], r["part"], r["position"]) for r in got} == expected_batches(rows, 3, gap)


def test_rows_without_a_time_are_kept_but_in_no_group(spark):
    rows = [("a", 1, datetime(2024, 1, 1)), ("a", 2, None), ("b", 3, None)]
    df = spark.createDataFrame(rows, "key string, id long, ts timestamp")
    got = {r["id"]: (r["session"], r["part"]) for r in arrivals.micro_batches(df, keys=["key"]).collect()}
    assert got == {1: (1, 0), 2: (None, None), 3: (None, None)}
    assert arrivals.session_windows(df, timedelta(seconds=5), ["key"]).count() == 1


def test_micro_batches_without_a_key(spark):
    rows, df = arrivals_fixture(spark)
    got = arrivals.micro_batches(df, 50, timedelta(seconds=5)).collect()
    want = expected_batches([(None, i, ts) for _, i, ts in rows], 50, timedelta(seconds=5))
    assert {r["id"]: (r["session"], r["part"], r["position"]) for r in got} == want


def test_session_windows_equal_the_built_in_window(spark):
    _, df = arrivals_fixture(spark)
    gap = timedelta(seconds=5)
    got = arrivals.session_windows(df, gap, ["key"])
    built_in = df.groupBy("key", F.session_window("ts", "5 seconds").alias("w")).count()
    built_in = built_in.select("key", "w.start", "w.end", "count")
    assert sorted(got.collect(), key=str) == sorted((tuple(r) for r in built_in.collect()), key=str)


def test_throughput_fills_empty_periods(spark):
    rows = [(datetime(2024, 1, 1, 0, 0, s),) for s in (1, 2, 4, 21)]
    got = arrivals.throughput(spark.createDataFrame(rows, "ts timestamp")).orderBy("period_start").collect()
    assert [(r["arrivals"], r["rate"]) for r in got] == [(3, 0.6), (0, 0.0), (0, 0.0), (0, 0.0), (1, 0.2)]
    assert arrivals.throughput(spark.createDataFrame([], "ts timestamp")).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 20, 57])
@pytest.mark.parametrize("block", [10**6, 7])
def test_moving_average_has_full_windows_only(spark, n, block):
    values = [float((i * 37) % 11) for i in range(n)]
    df = spark.createDataFrame([(10 * i, v) for i, v in enumerate(values)], "line_number long, throughput double")
    got = runlogs.moving_average(df.repartition(3), block_rows=block).orderBy("line_number").collect()
    width = min(5, n)
    want = np.convolve(values, np.ones(width) / width, mode="valid") if width > 1 else []
    assert [r["line_number"] for r in got] == [10 * i for i in range(n)][width - 1 :][: len(want)]
    assert np.allclose([r["moving_average"] for r in got], want)


def test_moving_average_per_group(spark):
    rows = [(g, i, float(i * i % 7)) for g, n in (("a", 9), ("b", 3), ("c", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, line_number long, throughput double")
    got = runlogs.moving_average(df, group_by=["g"]).groupBy("g").count().collect()
    assert {r["g"]: r["count"] for r in got} == {"a": 5, "b": 1}


def test_log_lines_keep_their_numbers_when_the_file_is_split(spark, tmp_path):
    lines = [f"2024 INFO Throughput:  {i}.5 requests/sec" if i % 3 == 0 else f"other {i}" for i in range(2000)]
    (tmp_path / "a.log").write_text("\n".join(lines) + "\n")
    written = folders(spark, f"{scratch_root(spark)}/lumirank")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        read = read_log_lines(spark, str(tmp_path / "a.log"))
        got = {r["line_number"]: r["line"] for r in read.collect()}
        found = runlogs.extract_throughput(read).orderBy("line_number").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {i + 1: line for i, line in enumerate(lines)}
    assert folders(spark, f"{scratch_root(spark)}/lumirank") == written  # the log is not copied
    assert [(r["line_number"], r["throughput"]) for r in found] == [(i + 1, i + 0.5) for i in range(0, 2000, 3)]


def test_throughput_stats(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 4.0), (3, 9.0)], "line_number long, throughput double")
    row = runlogs.throughput_stats(df).first()
    assert (row["points"], row["average"], row["largest"], row["smallest"]) == (3, 5.0, 9.0, 2.0)
    assert row["stats_text"].startswith("Max: 9.00 req/sec")
    assert runlogs.throughput_stats(df.limit(0)).count() == 0


def test_run_summary_and_failures(spark):
    t = datetime(2024, 1, 1)
    rows = [(True, 1, None, t), (False, 2, "500", t + timedelta(seconds=2)), (False, 3, "timeout", t + timedelta(seconds=4))]
    df = spark.createDataFrame(rows, "success boolean, request_id long, error_info string, ts timestamp")
    row = runlogs.run_summary(df).first()
    assert (row["total"], row["successes"], row["failures"], row["duration_s"]) == (3, 1, 2, 4.0)
    assert row["requests_per_s"] == 0.75
    assert runlogs.run_summary(df.limit(1)).first()["requests_per_s"] is None
    assert {tuple(r) for r in runlogs.failure_breakdown(df).collect()} == {("500", 1), ("timeout", 1)}


def test_batches_of_fifty(spark):
    df = spark.range(120).withColumnRenamed("id", "query_id")
    got = runlogs.batch_assign(df, ["query_id"]).collect()
    assert all(r["batch"] == r["query_id"] // 50 for r in got)
    assert tuple(runlogs.batch_count(df).first()) == (120, 3)
