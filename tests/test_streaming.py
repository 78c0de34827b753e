import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lumirank.operators import arrivals, embedding, envelopes
from lumirank.plans.scratch import folders
from lumirank.registry.queries import VECTOR_PAYLOAD
from lumirank.sources import collection
from lumirank.sources.envelopes import read_envelopes
from lumirank.streaming import arrivals as stream_arrivals
from lumirank.streaming import jobs
from lumirank.streaming.run import batch_name, consume, to_files

T0 = datetime(2024, 1, 1)
DDL = "key string, id long, ts timestamp"
GAP = timedelta(seconds=5)


def files(spark, path, seed=5, n=300, parts=4):
    """Arrivals in several files, slightly out of order within a file."""
    rng = random.Random(seed)
    rows, at = [], T0
    for i in range(n):
        at += timedelta(seconds=rng.choice([0, 1, 2, 4, 5, 9]))
        rows.append((rng.choice(["hot", "hot", "x"]), i, at))
    size = n // parts
    for p in range(parts):
        chunk = rows[p * size : (p + 1) * size]
        rng.shuffle(chunk)
        spark.createDataFrame(chunk, DDL).coalesce(1).write.mode("append").parquet(path)
    return spark.createDataFrame(rows[: size * parts], DDL)


def source(spark, path):
    return spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(path)


def run(spark, stream, tmp_path, name):
    out, schema = str(tmp_path / f"{name}-out"), stream.schema
    to_files(stream, out, str(tmp_path / f"{name}-progress")).awaitTermination()
    return spark.read.schema(schema).parquet(out)


def test_groups_equal_the_batch_form_below_the_watermark(spark, tmp_path):
    path = str(tmp_path / "in")
    batch = files(spark, path)
    got = run(
        spark, stream_arrivals.micro_batches_stream(source(spark, path), 3, GAP, ["key"], delay="1 minute"), tmp_path, "m"
    )
    last = batch.agg(F.max("ts")).first()[0] - timedelta(minutes=1)
    assert got.count() > 200 and got.where(F.col("ts") >= F.lit(last)).count() == 0
    columns = ["key", "id", "ts", "session", "part", "position"]
    want = arrivals.micro_batches(batch, 3, GAP, ["key"]).select(*columns)
    assert sorted(got.select(*columns).collect()) == sorted(r for r in want.collect() if r["ts"] < last)


def test_groups_through_files_equal_the_batch_form_over_triggers(spark, tmp_path):
    for n, (keys, delay) in enumerate([(["key"], timedelta(minutes=1)), ([], timedelta(0))]):
        path, out = str(tmp_path / f"in{n}"), str(tmp_path / f"out{n}")
        batch = files(spark, path, seed=n)
        stream_arrivals.micro_batches_to_files(
            source(spark, path), out, str(tmp_path / f"s{n}"), str(tmp_path / f"p{n}"), 3, GAP, keys, delay=delay, available_now=True
        ).awaitTermination()
        last = batch.agg(F.max("ts")).first()[0] - delay
        columns = [*keys, "id", "ts", "session", "part", "position"]
        got = spark.read.option("recursiveFileLookup", True).parquet(out).select(*columns).collect()
        want = arrivals.micro_batches(batch, 3, GAP, keys).select(*columns).collect()
        assert sorted(got) == sorted(r for r in want if r["ts"] < last)
        assert len(got) > 200 and spark.read.parquet(out).select("b").distinct().count() > 1


def test_groups_over_several_triggers(spark, tmp_path):
    path = str(tmp_path / "in")
    batch = files(spark, path, n=200)
    delay = "2 minutes"
    got = run(spark, stream_arrivals.micro_batches_stream(source(spark, path), 50, GAP, ["key"], delay=delay), tmp_path, "u")
    last = batch.agg(F.max("ts")).first()[0] - timedelta(minutes=2)
    got = got.select("id", "ts", "session", "part", "position")
    want = arrivals.micro_batches(batch, 50, GAP, ["key"]).select("id", "ts", "session", "part", "position")
    seen = {r["id"]: r for r in want.collect()}
    rows = got.collect()
    assert len({r["id"] for r in rows}) == len(rows) == sum(r["ts"] < last for r in seen.values()) > 100
    assert all(tuple(seen[r["id"]]) == tuple(r) for r in rows)


def test_a_stream_without_keys_is_refused_by_the_stateful_form(spark, tmp_path):
    path = str(tmp_path / "in")
    files(spark, path, n=20)
    with pytest.raises(ValueError, match="give keys"):
        stream_arrivals.micro_batches_stream(source(spark, path), 3, GAP)


def test_final_rows_are_closed_and_old_states_deleted(spark, tmp_path):
    path, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    batch = files(spark, path, seed=7)
    query = stream_arrivals.micro_batches_to_files(
        source(spark, path), out, state, str(tmp_path / "p"), 3, GAP, ["key"], delay=timedelta(minutes=1), available_now=True, final=True
    )
    columns = ["key", "id", "ts", "session", "part", "position"]
    want = arrivals.micro_batches(batch, 3, GAP, ["key"]).select(*columns)
    assert sorted(spark.read.parquet(out).select(*columns).collect()) == sorted(want.collect())
    assert len(folders(spark, f"{state}/{query.id}")) == 2


def test_sessions_and_periods_equal_the_batch_forms(spark, tmp_path):
    path = str(tmp_path / "in")
    batch = files(spark, path)
    end = batch.agg(F.max("ts")).first()[0] - timedelta(minutes=1)
    got = run(spark, stream_arrivals.session_windows_stream(source(spark, path), GAP, ["key"], delay="1 minute"), tmp_path, "s")
    want = arrivals.session_windows(batch, GAP, ["key"]).where(F.col("session_end") <= F.lit(end))
    assert got.count() > 20 and sorted(got.collect()) == sorted(want.collect())
    got = run(spark, stream_arrivals.period_counts_stream(source(spark, path), GAP, delay="1 minute"), tmp_path, "t")
    want = arrivals.period_counts(batch, GAP).where(F.col("period_start") + F.expr("interval 5 seconds") <= F.lit(end))
    assert got.count() > 20 and sorted(got.collect()) == sorted(want.collect())
    filled = arrivals.fill_periods(got, GAP)
    assert filled.agg(F.sum("arrivals")).first()[0] == want.agg(F.sum("arrivals")).first()[0]


def test_ended_streams_hold_nothing_back(spark, tmp_path):
    path = str(tmp_path / "in")
    batch = files(spark, path, seed=9)
    forms = {
        "m": (
            stream_arrivals.micro_batches_stream(source(spark, path), 3, GAP, ["key"], delay="1 minute"),
            lambda at: stream_arrivals.final_micro_batches(spark, at, 3, GAP, ["key"]),
            arrivals.micro_batches(batch, 3, GAP, ["key"]).select("key", "id", "ts", "session", "part", "position"),
        ),
        "s": (
            stream_arrivals.session_windows_stream(source(spark, path), GAP, ["key"], delay="1 minute"),
            lambda at: stream_arrivals.final_sessions(spark, at, ["key"]),
            arrivals.session_windows(batch, GAP, ["key"]),
        ),
        "p": (
            stream_arrivals.period_counts_stream(source(spark, path), GAP, delay="1 minute"),
            lambda at: stream_arrivals.final_period_counts(spark, at),
            arrivals.period_counts(batch, GAP),
        ),
    }
    for name, (form, withheld, want) in forms.items():
        emitted, rest = run(spark, form, tmp_path, name), withheld(str(tmp_path / f"{name}-progress"))
        assert emitted.count() and rest.count()
        assert sorted(emitted.unionByName(rest).collect()) == sorted(want.collect())


def test_repeats_are_dropped(spark, tmp_path):
    path = str(tmp_path / "in")
    files(spark, path)
    twice = source(spark, path).union(source(spark, path))
    got = run(spark, stream_arrivals.drop_repeats(twice, ["id"], delay="1 hour"), tmp_path, "d")
    assert got.count() == got.select("id").distinct().count() == 300


def test_consumer_resumes_with_its_progress_and_replays_without(spark, tmp_path):
    path = str(tmp_path / "in")
    files(spark, path)
    seen = []

    def handler(batch, batch_id):
        seen.append((batch_name(batch, batch_id), batch.count()))

    for progress in ("a", "a", "b"):
        consume(source(spark, path), handler, str(tmp_path / progress), available_now=True).awaitTermination()
    assert sum(n for _, n in seen) == 600
    assert len({name for name, n in seen if n}) == len([1 for _, n in seen if n])


def vector_messages(spark, n=40):
    df = spark.range(n).select(
        F.struct(F.when(F.col("id") % 10 != 0, F.concat(F.lit("d/"), F.col("id").cast("string"))).alias("origin")).alias("image"),
        F.when(F.col("id") % 7 != 0, F.array(F.col("id").cast("float"), F.lit(1.0).cast("float"))).alias("tensors"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("preprocess_time"),
    )
    return envelopes.encode_rows(df, topic="t")


def test_ingest_survives_a_replay_from_the_start(spark, tmp_path):
    topic, path = str(tmp_path / "topic"), str(tmp_path / "c")
    envelopes.publish(vector_messages(spark), "parquet", topic)
    broken = vector_messages(spark).limit(1).withColumn("value", F.lit("???").cast("binary"))
    envelopes.publish(broken, "parquet", topic)
    collection.ensure_collection(spark, path, 2)
    states = []
    for progress in ("p1", "p2"):  # the second run has lost its progress
        stream = read_envelopes(spark, "parquet", {"maxFilesPerTrigger": 2}, topic, "t")
        rejects = str(tmp_path / f"rejects-{progress}")
        jobs.ingest_stream(
            stream, VECTOR_PAYLOAD, path, None, str(tmp_path / progress), available_now=True, rejects_path=rejects
        ).awaitTermination()
        rows = collection.read_collection(spark, path)
        states.append(sorted((r["id"], r["values"][0]) for r in rows.collect()))
        collection.compact(spark, path)
        reasons = spark.read.option("recursiveFileLookup", True).parquet(rejects).groupBy("reason").count().collect()
        assert {r["reason"]: r["count"] for r in reasons} == {
            "missing image.origin": 4, "missing tensors": 5, "not base64": 1,
        }
    want = sorted((str(i), float(i)) for i in range(40) if i % 10 and i % 7)
    assert states == [want, want]


def test_published_stream_is_read_back(spark, tmp_path):
    path, topic = str(tmp_path / "in"), str(tmp_path / "topic")
    batch = files(spark, path)
    sent = envelopes.encode_rows(source(spark, path), {"from": "test"}, "key", topic="t")
    writer = envelopes.publish_stream(sent, "parquet", str(tmp_path / "p"), topic)
    writer.trigger(availableNow=True).start().awaitTermination()
    read = read_envelopes(spark, "parquet", path=topic, topics=["t"], streaming=False)
    back = envelopes.decode_rows(read, batch.schema)
    assert sorted(back.select("row.*").collect()) == sorted(batch.collect())
    assert back.where(F.col("key").isNull() | F.col("timestamp").isNull() | (F.col("metadata")["from"] != "test")).count() == 0


def test_counters_of_more_batches_than_progress_is_kept(spark, tmp_path):
    topic, out, counters = (str(tmp_path / n) for n in ("topic", "o", "c"))
    for _ in range(5):
        envelopes.publish(vector_messages(spark, 10).coalesce(1), "parquet", topic)
    envelopes.publish(vector_messages(spark, 10).coalesce(1).withColumn("value", F.lit("?").cast("binary")), "parquet", topic)
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", 2)
    try:
        source = read_envelopes(spark, "parquet", {"maxFilesPerTrigger": 1}, topic)
        jobs.count_delivery(source, VECTOR_PAYLOAD, out, counters, str(tmp_path / "p"), available_now=True).awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    total = jobs.delivered(spark, counters).first()
    assert (total["messages"], total["errors"]) == (60, 10) and total["bytes"] > 0
    assert spark.read.parquet(out).count() == 60


def test_wrong_tensors_are_rejects(spark, tmp_path):
    rows = spark.range(10).select(
        F.struct(F.concat(F.lit("d/"), F.col("id").cast("string")).alias("origin")).alias("image"),
        F.when(F.col("id") == 3, F.array(F.lit(1.0)))
        .when(F.col("id") == 4, F.array(F.lit(1.0), F.lit(None).cast("double")))
        .otherwise(F.array(F.lit(1.0), F.lit(2.0))).cast("array<float>").alias("tensors"),
        F.lit(T0).alias("preprocess_time"),
    )
    topic, path, rejects = (str(tmp_path / n) for n in ("t", "c", "r"))
    envelopes.publish(envelopes.encode_rows(rows, topic="t"), "parquet", topic)
    collection.ensure_collection(spark, path, 2)
    source = read_envelopes(spark, "parquet", path=topic, topics="t")
    jobs.ingest_stream(
        source, VECTOR_PAYLOAD, path, None, str(tmp_path / "p"), available_now=True, rejects_path=rejects, compact_every=1
    ).awaitTermination()
    assert collection.read_collection(spark, path).count() == 8
    reasons = sorted(r["reason"] for r in spark.read.option("recursiveFileLookup", True).parquet(rejects).collect())
    assert reasons == ["null among tensors", "tensors of 1 values, expected 2"]


def test_queries_are_answered_as_they_come(spark, tmp_path):
    path, inbox, out = (str(tmp_path / n) for n in ("c", "q", "o"))
    model = embedding.HashingTextEmbedder(64)
    docs = spark.createDataFrame([("a", "red fox"), ("b", "blue whale"), ("c", "green tea")], "id string, text string")
    rows = embedding.embed_texts(docs, model, out="values").select(
        "id", "values", F.struct(F.col("id").alias("image_path"), F.lit("t").alias("preprocess_time")).alias("metadata"),
        F.lit("2024-01-01").cast("timestamp").alias("updated_at"), F.lit(0).cast("long").alias("source_seq"),
    )
    collection.ensure_collection(spark, path, 64)
    collection.upsert(spark, path, rows)
    for part in ([(1, "the blue whale"), (2, "  ")], [(3, "tea")]):
        spark.createDataFrame(part, "query_id long, text string").coalesce(1).write.mode("append").parquet(inbox)
    stream = spark.readStream.schema("query_id long, text string").option("maxFilesPerTrigger", 1).parquet(inbox)
    jobs.search_stream(stream, path, model, out, str(tmp_path / "p"), available_now=True).awaitTermination()
    read = spark.read.option("recursiveFileLookup", True)
    assert {(r["query_id"], r["id"]) for r in read.parquet(f"{out}/matches").collect()} == {(1, "b"), (3, "c")}
    assert [r["query_id"] for r in read.parquet(f"{out}/rejected").collect()] == [2]
