"""Streams that run on: bounded state, empty periods as they pass, a held collection, reports; messages without a schema."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lumirank.operators import arrivals, embedding, envelopes
from lumirank.sources import collection
from lumirank.sources.envelopes import read_envelopes
from lumirank.streaming import arrivals as stream_arrivals
from lumirank.streaming import jobs, progress
from lumirank.streaming.run import to_files

T0 = datetime(2024, 1, 1)
DDL = "key string, id long, ts timestamp"
GAP = timedelta(seconds=5)


def inbox(spark, path, chunks):
    for chunk in chunks:
        spark.createDataFrame(chunk, DDL).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(path)


def new_keys(triggers, keys=3):
    """Every trigger brings keys of its own, a minute after the last, with sessions of 4 rows that end in a gap."""
    out = []
    for t in range(triggers):
        at = T0 + timedelta(minutes=t)
        out.append([(f"k{t}-{k}", 100 * t + 10 * k + i, at + timedelta(seconds=2 * i + 20 * (i == 3))) for k in range(keys) for i in range(4)])
    return out


def test_state_holds_late_keys_only(spark, tmp_path):
    path, out, at = (str(tmp_path / n) for n in ("in", "out", "progress"))
    chunks = new_keys(20)
    grouped = stream_arrivals.micro_batches_stream(inbox(spark, path, chunks), 3, GAP, ["key"], by_first=True)
    query = to_files(grouped, out, at)
    query.awaitTermination()
    state = [p["stateOperators"][0]["customMetrics"] and p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress]
    # After the first triggers as many keys go as come: rows, tails and timers of two triggers' keys.
    assert len(state) >= 20 and max(state[10:]) <= max(state[:5])
    rows = spark.read.schema(grouped.schema).parquet(out).unionByName(
        stream_arrivals.final_micro_batches(spark, at, 3, GAP, ["key"], by_first=True)
    )
    batch = spark.createDataFrame([r for c in chunks for r in c], DDL)
    w = F.min(F.unix_micros("ts")).over(stream_arrivals.W.partitionBy("key", "session"))
    want = arrivals.micro_batches(batch, 3, GAP, ["key"]).withColumn("session", w)
    columns = ["key", "id", "ts", "session", "part", "position"]
    assert sorted(rows.select(*columns).collect()) == sorted(want.select(*columns).collect())


def test_a_session_goes_on_under_its_name(spark, tmp_path):
    """Rows less than a gap apart over many triggers, and a key that comes back after its state has gone."""
    path, out, at = (str(tmp_path / n) for n in ("in", "out", "progress"))
    chunks = [[("a", 10 * t + i, T0 + timedelta(seconds=8 * t + 4 * i)) for i in range(2)] for t in range(6)]
    chunks += [[("b", 900 + t, T0 + timedelta(minutes=5 + t))] for t in range(3)]
    chunks += [[("a", 990 + t, T0 + timedelta(minutes=9, seconds=3 * t))] for t in range(2)]
    grouped = stream_arrivals.micro_batches_stream(inbox(spark, path, chunks), 3, GAP, ["key"], by_first=True)
    to_files(grouped, out, at).awaitTermination()
    rows = spark.read.schema(grouped.schema).parquet(out).unionByName(
        stream_arrivals.final_micro_batches(spark, at, 3, GAP, ["key"], by_first=True)
    )
    first = [r for r in rows.where("key = 'a' AND id < 900").orderBy("ts").collect()]
    start = int(spark.range(1).select(F.unix_micros(F.lit(T0).cast("timestamp"))).first()[0])
    assert {r["session"] for r in first} == {start} and [3 * r["part"] + r["position"] for r in first] == list(range(12))
    again = rows.where("key = 'a' AND id >= 990").orderBy("ts").collect()
    assert len({r["session"] for r in again}) == 1 and [r["position"] for r in again] == [0, 1]


def test_empty_periods_come_by_themselves(spark, tmp_path):
    path, out, at = (str(tmp_path / n) for n in ("in", "out", "progress"))
    seconds = [0, 1, 7, 7, 31, 33, 34, 90, 91, 200]
    chunks = [[("k", i, T0 + timedelta(seconds=s))] for i, s in enumerate(seconds)]
    live = stream_arrivals.throughput_live(inbox(spark, path, chunks), GAP)
    to_files(live, out, at).awaitTermination()
    emitted = spark.read.schema(live.schema).parquet(out)
    batch = spark.createDataFrame([r for c in chunks for r in c], DDL)
    want = arrivals.fill_periods(arrivals.period_counts(batch, GAP), GAP).select("period_start", "arrivals")
    # All but what the watermark has not passed, zeros included, each once.
    passed = want.where(F.col("period_start") + F.expr("INTERVAL 5 SECONDS") <= F.lit(T0 + timedelta(seconds=200)))
    got = sorted(emitted.collect())
    assert got == sorted(passed.collect()) and sum(r["arrivals"] == 0 for r in got) > 25
    final = stream_arrivals.final_live_periods(spark, at, emitted, GAP)
    assert sorted(emitted.unionByName(final).collect()) == sorted(want.collect())


def text_collection(spark, path, texts, model):
    docs = spark.createDataFrame(texts, "id string, text string")
    rows = embedding.embed_texts(docs, model, out="values").select(
        "id", "values", F.struct(F.col("id").alias("image_path"), F.lit("t").alias("preprocess_time")).alias("metadata"),
        F.lit("2024-01-01").cast("timestamp").alias("updated_at"), F.lit(0).cast("long").alias("source_seq"),
    )
    collection.ensure_collection(spark, path, model.dim)
    collection.upsert(spark, path, rows)


def ask(spark, folder, name, texts):
    spark.createDataFrame(texts, "query_id long, text string").coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def test_the_collection_is_read_once_and_again_after_a_change(spark, tmp_path, monkeypatch):
    path, out, at = (str(tmp_path / n) for n in ("c", "o", "p"))
    model = embedding.HashingTextEmbedder(64)
    text_collection(spark, path, [("a", "red fox"), ("b", "blue whale")], model)
    reads, read = [], collection.read_collection
    monkeypatch.setattr(collection, "read_collection", lambda *a, **b: reads.append(a) or read(*a, **b))
    held = collection.HeldCollection(path)

    def answer(texts):
        for i, text in enumerate(texts):
            ask(spark, str(tmp_path / "q"), f"{text.replace(' ', '-')}-{i}", [(len(reads) * 100 + i, text)])
        stream = spark.readStream.schema("query_id long, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "q" / "*"))
        query = jobs.search_stream(stream, path, model, out, at, available_now=True, held=held)
        query.awaitTermination()
        assert query.exception() is None
        return sum(p["numInputRows"] > 0 for p in query.recentProgress)

    assert answer(["whale"] * 10) == 10 and len(reads) == held.reads == 1
    kept = held.rows(spark)
    assert kept.storageLevel.useDisk and "InMemoryTableScan" in kept._jdf.queryExecution().executedPlan().toString()
    text_collection(spark, path, [("c", "green tea")], model)
    assert answer(["green tea", "tea"]) == 2 and len(reads) == 2
    found = spark.read.option("recursiveFileLookup", True).parquet(f"{out}/matches")
    assert {(r["query_id"], r["id"]) for r in found.collect()} >= {(100, "c"), (101, "c")}
    assert found.where("id = 'b'").count() == 10
    held.release()
    assert not kept.storageLevel.useMemory


def test_reports_of_a_stream_go_on_after_a_restart(spark, tmp_path):
    topic, out, at, where = (str(tmp_path / n) for n in ("t", "o", "p", "r"))
    rows = spark.range(40).select(F.col("id"), F.col("id").cast("string").alias("name"))
    sent = envelopes.encode_rows(rows, key_col="id", topic="t")
    sent = sent.withColumn("value", F.when(F.col("key").cast("string").endswith("7"), F.lit("?").cast("binary")).otherwise(F.col("value")))
    listener = progress.DeliveryReports(spark, where)
    spark.streams.addListener(listener)
    try:
        for n in range(2):
            envelopes.publish(sent.repartition(3), "parquet", topic)
            source = read_envelopes(spark, "parquet", {"maxFilesPerTrigger": 1}, topic, "t")
            decoded = envelopes.observe_delivery(envelopes.decode_rows(source, rows.schema))
            query = to_files(decoded.select("key", "row", "error"), out, at)
            query.awaitTermination()
            listener.wait(query)
    finally:
        spark.streams.removeListener(listener)
    reported = progress.reports(spark, where)
    assert reported.select("query").distinct().count() == 1 and reported.count() == reported.select("batch").distinct().count() >= 6
    total = progress.totals(reported).first()
    assert (total["messages"], total["errors"]) == (80, 8)
    assert total["bytes"] == 2 * sent.agg(F.sum(F.octet_length("value"))).first()[0]


def test_messages_without_a_schema(spark):
    texts = [
        '{"id":123,"user":{"name":"n","email":null},"tags":["a","b"],"metrics":{"visits":42,"conversions":3.14},"when":"2023-01-01 12:00:00"}',
        '{"id":124,"user":{"name":"m"},"tags":[],"metrics":{"visits":1,"conversions":2},"new":true,"OBJECT<`":1}',
        '{"id":"text"}', "{}", "{", "", "[1]", "7", "null", None, "Ünï",
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), "k int, value string").repartition(3)
    back = envelopes.decode_json_any(frame)
    kinds = {f.name: f.dataType.simpleString() for f in back.schema["row"].dataType}
    assert kinds["user"] == "struct<email:string,name:string>" and kinds["tags"] == "array<string>"
    assert kinds["metrics"] == "struct<conversions:double,visits:bigint>" and kinds["id"] == "variant" and kinds["OBJECT<`"] == "bigint"
    got = {r["k"]: r for r in back.select("k", "row.user.name", "row.metrics.conversions", "row.metrics.visits", "row.new", "error").collect()}
    assert (got[0]["name"], got[0]["conversions"], got[0]["visits"], got[0]["new"]) == ("n", 3.14, 42, None)
    assert (got[1]["conversions"], got[1]["new"]) == (2.0, True)
    reasons = {k: r["error"] for k, r in got.items()}
    assert [reasons[k] for k in range(4)] == [None] * 4
    assert reasons[4] == reasons[10] == reasons[5] == "not JSON" and reasons[6] == reasons[7] == reasons[8] == "not a row"
    assert reasons[9] == "empty message"
    given = envelopes.infer_schema(frame.where("k < 2"))
    assert given["id"].dataType.simpleString() == "bigint"
    # A given schema: what does not fit is null.
    assert [r[0] for r in envelopes.decode_json_any(frame.where("k IN (0, 2)"), given).orderBy("k").select("row.id").collect()] == [123, None]
    nothing = envelopes.decode_json_any(frame.where("k > 3"))
    assert nothing.where("row IS NOT NULL").count() == 0 and nothing.count() == 7
