"""The registered queries: (session, folder of parquet tables) -> DataFrame."""

from __future__ import annotations

from datetime import timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumirank.functions import records, vectors
from lumirank.functions.pixels import MEAN, STD, normalize_pixels
from lumirank.operators import arrivals, codes, embedding, envelopes, paths, preprocess, runlogs, search, sparse, validate
from lumirank.plans import ingest
from lumirank.plans.ordered import index_within
from lumirank.plans.scratch import scratch_path
from lumirank.plans.spread import spread
from lumirank.session import prepare
from lumirank.sources import collection, logs, queries as text_queries
from lumirank.sources.envelopes import read_envelopes
from lumirank.sources.images import (
    IMAGE_SCHEMA,
    image_backlogs,
    read_image_stream,
    read_images,
    small_files,
    strip_pixels,
    with_image_path,
    with_preprocess_time,
    write_image_files,
)
from lumirank.streaming import arrivals as stream_arrivals
from lumirank.streaming import jobs, progress
from lumirank.streaming.run import batch_name, consume, to_files

SIX_HOURS = timedelta(hours=6)
TEN_MINUTES = timedelta(minutes=10)
DIM = 512


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def heavy(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table for work that is heavy per row."""
    return spread(table(spark, folder, name).select(*columns))


def stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The same table as a stream of files."""
    schema = table(spark, folder, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def naive(col: str | Column) -> Column:
    """A time without zone, as the tables have it."""
    return (F.col(col) if isinstance(col, str) else col).cast("timestamp_ntz")


def finished(query) -> None:
    """Wait for a stream that stops by itself."""
    query.awaitTermination()
    if query.exception():
        raise query.exception()


# ------------------------------------------------------------------ vectors and search


def _vector_queries(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")


def _vector_rows(spark, d):
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("values"), F.col("label").cast("string").alias("namespace")
    )


def _ranked(df: DataFrame) -> DataFrame:
    return df.select("query_id", F.col("rank").cast("long").alias("rank"), "id", F.round("score", 6).alias("score"))


def topk_cosine(spark, d):
    return _ranked(search.top_k(_vector_queries(spark, d), _vector_rows(spark, d), 5, include_metadata=False))


def topk_cell_join(spark, d):
    """All of sixteen cells probed, which gives the exact answer; cells and crowds are cut into blocks."""
    found = search.knn_join_approx(
        _vector_queries(spark, d), _vector_rows(spark, d), 5, n_probe=16, n_pivots=16, block_bytes=1 << 15
    )
    return _ranked(found)


def topk_many_queries(spark, d):
    """A query side of several broadcasts: one scan of the collection for each part of it."""
    found = search.knn_join(_vector_queries(spark, d), _vector_rows(spark, d), 5, broadcast_bytes=1 << 18, max_scans=1000)
    return _ranked(found)


def topk_grid(spark, d):
    """Blocks of queries against blocks of rows."""
    found = search.knn_join(
        _vector_queries(spark, d), _vector_rows(spark, d), 5, broadcast_bytes=1 << 14, block_bytes=1 << 17, max_scans=1
    )
    return _ranked(found)


def topk_approx(spark, d):
    """By codes of sixteen bytes; the hundred rows that look best per query are scored exactly."""
    found = codes.top_k_codes(_vector_queries(spark, d), _vector_rows(spark, d), 5, include_metadata=False)
    return _ranked(found)


def topk_approx_recall(spark, d):
    """Whether the defaults of the approximate search find at least nine in ten of the five true neighbours."""
    q, rows = _vector_queries(spark, d), _vector_rows(spark, d)
    true = search.top_k(q, rows, 5, include_metadata=False).select("query_id", "id")
    found = codes.top_k_codes(q, rows, 5, include_metadata=False).select("query_id", "id", F.lit(1).alias("hit"))
    return true.join(found, ["query_id", "id"], "left").agg(
        F.count(F.lit(1)).alias("neighbours"), (F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("enough")
    )


def _stored_index(spark, d) -> codes.StoredIndex:
    rows, path = _vector_rows(spark, d), scratch_path(prepare(spark), "index")
    codes.write_index(rows, path, codes.fit_codes(rows))
    return codes.open_index(spark, path)


def topk_stored(spark, d):
    """The same from an index stored by cells."""
    return _ranked(codes.top_k_codes(_vector_queries(spark, d), _stored_index(spark, d), 5, include_metadata=False))


def topk_probed(spark, d):
    """Every vector finds itself in the one cell that is nearest to it."""
    found = codes.top_k_codes(_vector_queries(spark, d), _stored_index(spark, d), 1, n_probe=1, include_metadata=False)
    return _ranked(found)


def topk_in_namespace(spark, d):
    found = search.top_k(_vector_queries(spark, d), _vector_rows(spark, d), 3, namespace="3", include_metadata=False)
    return _ranked(found)


def topk_with_values(spark, d):
    found = search.top_k(
        _vector_queries(spark, d), _vector_rows(spark, d), 2, include_values=True, include_metadata=False
    )
    total = F.aggregate("values", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "id", F.round(total, 5).alias("total"))


def cosine_to_label_mean(spark, d):
    """Cosine of every vector and the mean vector of its label."""
    rows = table(spark, d, "embeddings")
    means = (
        rows.select("label", F.posexplode("embedding").alias("pos", "v"))
        .groupBy("label", "pos")
        .agg(F.avg(F.col("v").cast("double")).alias("v"))
        .groupBy("label")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("m"))
        .select("label", F.col("m.v").alias("mean"))
    )
    score = vectors.cosine(F.col("embedding"), F.col("mean"))
    return rows.join(means, "label").select("vec_id", F.round(score, 6).alias("score"))


def vector_profile(spark, d):
    rows = table(spark, d, "embeddings")
    sq = vectors.dot(F.col("embedding"), F.col("embedding"))
    return rows.groupBy("label").agg(
        F.count(F.lit(1)).alias("records"),
        F.min(F.size("embedding")).alias("smallest"),
        F.max(F.size("embedding")).alias("largest"),
        F.round(F.sum(sq), 4).alias("squares"),
    )


def vector_dimension(spark, d):
    rows = table(spark, d, "embeddings")
    dim = vectors.vector_dim(rows, "embedding", strict=True)
    return rows.agg(F.count(F.lit(1)).alias("records")).select(F.lit(dim).alias("dimension"), "records")


def vector_normalize(spark, d):
    rows = table(spark, d, "embeddings")
    unit = vectors.normalize_l2(F.transform("embedding", lambda x: x.cast("double") * 3 + 1))
    return rows.select("vec_id", F.posexplode(unit).alias("pos", "v")).select("vec_id", "pos", F.round("v", 6).alias("v"))


def vector_conversion(spark, d):
    """Array to ML vector and back."""
    rows = vectors.to_array(vectors.to_vector(table(spark, d, "embeddings"), "embedding"), "embedding")
    total = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return rows.select("vec_id", F.size("embedding").alias("n"), F.round(total, 5).alias("total"))


def check_dimension(spark, d):
    """Vectors of a wrong dimension: label 7 loses its last value here, label 8 its whole vector."""
    v = F.when(F.col("label") == 7, F.slice("embedding", 1, 63)).when(F.col("label") != 8, F.col("embedding"))
    good, bad = validate.check_dimension(table(spark, d, "embeddings").select("vec_id", v.alias("values")), 64)
    return good.select("vec_id", F.lit("ok").alias("reason")).unionByName(bad.select("vec_id", "reason"))


def valid_embeddings(spark, d):
    v = F.when(F.col("label") == 7, F.slice("embedding", 1, 0)).when(F.col("label") != 8, F.col("embedding"))
    good, bad = validate.valid_embeddings(table(spark, d, "embeddings").select("vec_id", v.alias("embedding")))
    return good.select("vec_id", F.lit("ok").alias("reason")).unionByName(bad.select("vec_id", "reason"))


def no_match_report(spark, d):
    """Vectors searched in the namespace of their own label, where namespace 4 holds nothing."""
    rows = _vector_rows(spark, d).where("namespace <> '4'")
    q = table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("label").cast("string").alias("ns"))
    hits = q.join(rows.select(F.col("namespace").alias("ns")).distinct(), "ns")
    return search.no_match_report(q.select("query_id"), hits)


# ------------------------------------------------------------------ collection


def _event_records(e: DataFrame) -> DataFrame:
    """Events as records of one value, keyed by user, in a namespace per event type."""
    return collection.records(
        e,
        F.concat(F.lit("images/"), F.col("event_type"), F.lit("/u"), F.col("user_id").cast("string")),
        F.array(F.col("value")),
        F.col("ts"),
        F.col("event_id"),
    ).withColumn("_space", F.element_at(F.split("metadata.image_path", "/"), 2))


def _filled(spark, d, times: int = 1, fold: bool = False) -> str:
    path = scratch_path(prepare(spark), "collection")
    collection.ensure_collection(spark, path, 1, "events")
    rows = _event_records(table(spark, d, "events"))
    for _ in range(times):
        collection.upsert(spark, path, rows, F.col("_space"))
        if fold:
            collection.compact(spark, path)
    return path


def _record_rows(rows: DataFrame) -> DataFrame:
    return rows.select(
        "namespace", "id", F.col("source_seq").alias("event_id"), F.round(F.element_at("values", 1).cast("double"), 2).alias("value"),
        F.col("metadata.image_path").alias("image_path"), F.col("metadata.preprocess_time").alias("preprocess_time"),
    )


def upsert_latest(spark, d):
    return _record_rows(collection.read_collection(spark, _filled(spark, d)))


def upsert_rewritten(spark, d):
    """Every id written again with the same time and sequence and another value, one half after a compaction:
    the later write wins."""
    path = _filled(spark, d)
    rows = _event_records(table(spark, d, "events"))
    flipped = rows.withColumn("values", F.transform("values", lambda x: -x))
    collection.upsert(spark, path, flipped.where("source_seq % 2 = 0"), F.col("_space"))
    collection.compact(spark, path)
    collection.upsert(spark, path, flipped, F.col("_space"))
    return _record_rows(collection.read_collection(spark, path))


def upsert_replayed(spark, d):
    """The same batch twice with a compaction after each: nothing changes."""
    return _record_rows(collection.read_collection(spark, _filled(spark, d, 2, True)))


def read_namespace(spark, d):
    return _record_rows(collection.read_collection(spark, _filled(spark, d, 2), "purchase"))


def collection_describe(spark, d):
    path = scratch_path(prepare(spark), "collection")
    collection.ensure_collection(spark, path, 64, "vectors")
    e = table(spark, d, "embeddings")
    space = F.concat(F.lit("label-"), F.col("label").cast("string"))
    rows = e.select(
        F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("values"),
        F.struct(F.lit(None).cast("string").alias("image_path"), F.lit(None).cast("string").alias("preprocess_time")).alias("metadata"),
        F.lit("2024-01-01").cast("timestamp").alias("updated_at"), F.col("vec_id").alias("source_seq"), space.alias("_space"),
    )
    collection.upsert(spark, path, rows, F.col("_space"))
    return collection.describe_collection(spark, path)


# ------------------------------------------------------------------ records and paths


def record_id(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", records.record_id(F.col("url")).alias("id"))


def record_metadata(spark, d):
    e = table(spark, d, "events")
    path = F.concat(F.lit("images/"), F.col("event_type"), F.lit(".png"))
    both = e.select(
        "event_id",
        records.record_metadata(path, F.col("ts")).alias("m"),
        records.record_metadata(path, F.col("ts"), iso=True).alias("iso"),
    )
    return both.select("event_id", "m.image_path", "m.preprocess_time", F.col("iso.preprocess_time").alias("iso_time"))


def format_match(spark, d):
    """Event values as scores; views have no stored path."""
    e = table(spark, d, "events").withColumn(
        "metadata", F.struct(F.when(F.col("event_type") != "view", F.concat(F.lit("images/"), F.col("event_type"))).alias("image_path"))
    )
    path = records.resolve_path(F.col("metadata"), F.col("user_id").cast("string"))
    return e.select("event_id", path.alias("path"), records.format_match(F.col("event_type"), path, F.col("value")).alias("text"))


def resolve_existing_path(spark, d):
    """Documents name a file under their source. Some files exist there, some in the fallback folder, some
    nowhere."""
    docs = table(spark, d, "documents")
    name = F.concat(F.col("lang"), F.lit("-"), (F.col("doc_id") % 97).cast("string"), F.lit(".txt"))
    matches = docs.select("doc_id", F.concat(F.col("source"), F.lit("/"), name).alias("image_path"))
    files = docs.select(
        F.when(F.col("n_chars") % 2 == 0, F.concat(F.col("source"), F.lit("/"), name))
        .when(F.col("n_chars") % 3 == 0, F.concat(F.lit("images/"), name))
        .alias("path")
    ).where(F.col("path").isNotNull())
    return paths.resolve_existing_path(matches, files)


# ------------------------------------------------------------------ arrivals and run logs


def micro_batches(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("event_id").alias("id"), "ts")
    return arrivals.micro_batches(e, 3, SIX_HOURS, ["user_id"])


def micro_batches_unkeyed(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), "ts")
    return arrivals.micro_batches(e, 50, TEN_MINUTES)


def session_windows(spark, d):
    out = arrivals.session_windows(table(spark, d, "events"), SIX_HOURS, ["user_id"])
    return out.withColumns({"session_start": naive("session_start"), "session_end": naive("session_end")})


def throughput_windows(spark, d):
    out = arrivals.throughput(table(spark, d, "events"), TEN_MINUTES)
    return out.select(naive("period_start").alias("period_start"), "arrivals", F.round("rate", 8).alias("rate"))


def _hourly(spark, d):
    counts = arrivals.throughput(table(spark, d, "events"), timedelta(hours=1))
    number = (F.unix_micros("period_start") / F.lit(3_600_000_000)).cast("long")
    return counts.select(number.alias("line_number"), F.col("arrivals").cast("double").alias("throughput"))


def moving_average(spark, d):
    out = runlogs.moving_average(_hourly(spark, d))
    return out.withColumn("moving_average", F.round("moving_average", 6))


def moving_average_by_type(spark, d):
    e = table(spark, d, "events").select("event_type", "event_id", "value")
    out = runlogs.moving_average(e, 5, "event_id", "value", ["event_type"])
    return out.withColumn("moving_average", F.round("moving_average", 6))


def throughput_stats(spark, d):
    out = runlogs.throughput_stats(_hourly(spark, d))
    return out.select("points", F.round("average", 6).alias("average"), "largest", "smallest", "stats_text")


def _outcomes(spark, d):
    e = table(spark, d, "events")
    failed = F.col("event_type") == "error"
    return e.select(
        (~failed).alias("success"), F.col("event_id").alias("request_id"),
        F.when(failed, F.concat(F.lit("code "), (F.col("user_id") % 7).cast("string"))).alias("error_info"), "ts", "user_id",
    )


def run_summary(spark, d):
    return runlogs.run_summary(_outcomes(spark, d)).withColumn("requests_per_s", F.round("requests_per_s", 9))


def run_summary_by_user(spark, d):
    out = runlogs.run_summary(_outcomes(spark, d), group_by=["user_id"])
    return out.withColumn("requests_per_s", F.round("requests_per_s", 9))


def failure_breakdown(spark, d):
    return runlogs.failure_breakdown(_outcomes(spark, d))


def log_throughput(spark, d):
    """Events as log files in order of time, read back by line; positions run on from file to file."""
    e = table(spark, d, "events")
    line = F.when(
        F.col("event_type") == "view",
        F.format_string("INFO Throughput: % .2f requests/sec", F.col("value")),
    ).otherwise(F.concat(F.lit("INFO "), F.col("event_type")))
    path = scratch_path(spark, "logs")
    (
        e.select("ts", "event_id", line.alias("value"))
        .repartitionByRange("ts", "event_id")
        .sortWithinPartitions("ts", "event_id")
        .select("value")
        .write.text(path)
    )
    lines = logs.read_log_lines(spark, path)
    before = W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)
    files = lines.groupBy("file").agg(F.max("line_number").alias("n"))
    files = files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    found = runlogs.extract_throughput(lines).join(files, "file")
    return found.select((F.col("line_number") + F.col("before")).alias("position"), "throughput")


def batch_assign(spark, d):
    q = table(spark, d, "documents").select("doc_id")
    return runlogs.batch_assign(q, ["doc_id"], 50)


def batch_count(spark, d):
    return runlogs.batch_count(table(spark, d, "conversations"), 50)


# ------------------------------------------------------------------ envelopes


def _event_rows(spark, d):
    return heavy(spark, d, "events", "event_id", "user_id", "event_type", "props")


def _text(col: str) -> Column:
    return F.col(col).cast("string")


def encode_rows(spark, d):
    out = envelopes.encode_rows(_event_rows(spark, d), {"source": "events"}, "user_id", fmt=envelopes.FORMAT_BASE64)
    names = F.array_join(F.transform("headers", lambda h: h["key"]), ",")
    form = F.filter("headers", lambda h: h["key"] == "format")[0]["value"].cast("string")
    return out.select(_text("key").alias("key"), _text("value").alias("value"), names.alias("header_names"), form.alias("format"))


def encode_rows_indexed(spark, d):
    """`row_index` and the fixed metadata, read back from the headers."""
    rows = _event_rows(spark, d)
    time = F.lit("2024-02-03 04:05:06.000007").cast("timestamp")
    sent = envelopes.encode_rows(rows, {"source": "events"}, "event_id", time=time, order_by=["event_id"])
    back = envelopes.decode_rows(sent, rows.schema)
    return back.select(
        _text("key").alias("key"), F.col("row.event_id").alias("event_id"), F.col("metadata")["source"].alias("source"),
        F.col("metadata")["row_index"].cast("long").alias("row_index"), F.col("metadata")["timestamp"].alias("timestamp"),
    )


def decode_roundtrip(spark, d):
    """Every column type of the events table through a message and back."""
    rows = table(spark, d, "events")
    back = envelopes.decode_rows(envelopes.encode_rows(rows), rows.schema)
    return back.select("row.*")


def _damaged(spark, d):
    """Messages of all events in which clicks are cut and signups have no value."""
    rows = _event_rows(spark, d)
    sent = envelopes.encode_rows(rows, key_col="event_type", topic="t")
    value = F.when(F.col("key").cast("string") == "click", F.concat(F.lit("*"), _text("value")).cast("binary")).when(
        F.col("key").cast("string") != "signup", F.col("value")
    )
    return rows.schema, sent.withColumn("value", value)


def decode_failures(spark, d):
    schema, sent = _damaged(spark, d)
    good, bad = envelopes.readable_rows(envelopes.decode_rows(sent, schema))
    both = good.select(F.lit("ok").alias("reason")).unionByName(bad.select("reason"))
    return both.groupBy("reason").agg(F.count(F.lit(1)).alias("messages"))


def delivery_stats(spark, d):
    schema, sent = _damaged(spark, d)
    decoded = envelopes.decode_rows(sent.withColumn("topic", _text("key")), schema)
    return envelopes.delivery_stats(decoded, ["topic"])


def encode_json(spark, d):
    out = envelopes.encode_json(_event_rows(spark, d), F.lit("2024-02-03 04:05:06.000007").cast("timestamp"))
    return out.select("value")


def decode_json(spark, d):
    rows = table(spark, d, "events").withColumnRenamed("ts", "timestamp")
    back = envelopes.decode_json(envelopes.encode_json(rows), rows.schema)
    return back.select("row.*").withColumnRenamed("timestamp", "ts")


def decode_json_any(spark, d):
    """JSON texts of events, decoded without a schema; clicks are cut and signups are no objects."""
    e = table(spark, d, "events")
    text = F.concat(
        F.lit('{"id":'), F.col("event_id"), F.lit(',"who":{"user":'), F.col("user_id"), F.lit(',"did":["'), F.col("event_type"),
        F.lit('"]},"props":'), F.col("props"), F.when(F.col("event_type") == "view", F.lit(',"extra":null}')).otherwise(F.lit("}")),
    )
    value = F.when(F.col("event_type") == "click", F.expr("substring(text, 1, 12)")).when(F.col("event_type") == "signup", F.lit("[1]"))
    sent = e.withColumn("text", text).select("event_id", F.coalesce(value, F.col("text")).alias("value"))
    back = envelopes.decode_json_any(sent)
    return back.select(
        "event_id", F.col("row.id").alias("id"), F.col("row.who.user").alias("user"), F.col("row.who.did")[0].alias("did"),
        F.col("row.props.k").alias("k"), F.col("row.extra").alias("extra"), "error",
    )


def published_messages(spark, d):
    """Messages written by the executors and read again as a batch, counted per topic."""
    rows = _event_rows(spark, d)
    path = scratch_path(spark, "topic")
    envelopes.publish(envelopes.encode_rows(rows, key_col="event_id", topic="events"), "parquet", path)
    back = envelopes.decode_rows(read_envelopes(spark, "parquet", path=path, topics="events", streaming=False), rows.schema)
    return back.select(_text("key").alias("key"), "topic", "row.*")


def published_again(spark, d):
    """Two named batches of messages, each published twice as by a job that runs again: every message is there once."""
    rows = _event_rows(spark, d)
    path = scratch_path(spark, "topic")
    for _ in range(2):
        for half in (0, 1):
            sent = envelopes.encode_rows(rows.where(F.col("event_id") % 2 == half), key_col="event_id", topic="events")
            envelopes.publish(sent, "parquet", path, batch=f"half-{half}")
    back = envelopes.decode_rows(read_envelopes(spark, "parquet", path=path, topics="events", streaming=False), rows.schema)
    return back.select(_text("key").alias("key"), "topic", "row.*")


def stream_published(spark, d):
    """Messages that a stream publishes, read again as a batch."""
    rows = stream(spark, d, "events").select("event_id", "user_id", "event_type", "props")
    path = scratch_path(spark, "topic")
    sent = envelopes.encode_rows(rows, key_col="event_id", topic="events")
    writer = envelopes.publish_stream(sent, "parquet", scratch_path(spark, "progress"), path)
    finished(writer.trigger(availableNow=True).start())
    back = envelopes.decode_rows(read_envelopes(spark, "parquet", path=path, topics="events", streaming=False), rows.schema)
    return back.select(_text("key").alias("key"), "topic", "row.*")


def row_index(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return index_within(o, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "row_index")


def row_index_sliced(spark, d):
    """The same over range slices, as it runs when the order is too long for one task."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
    out = index_within(o, ["o_orderdate", "o_orderkey"], ["o_orderstatus"], group_rows=1000)
    return out.select("o_orderkey", "row_index")


# ------------------------------------------------------------------ texts


def split_rejects(spark, d):
    """Documents without a source in German, and without text where the length divides by seven."""
    docs = table(spark, d, "documents").select(
        "doc_id",
        F.struct(F.when(F.col("lang") != "de", F.col("source")).alias("origin")).alias("image"),
        F.when(F.col("n_chars") % 7 != 0, F.split("text", " ")).alias("tensors"),
    )
    good, bad = validate.split_rejects(docs)
    return good.select("doc_id", F.lit("ok").alias("reason")).unionByName(bad.select("doc_id", "reason"))


def valid_queries(spark, d):
    """Conversation turns as queries; user turns with an even number are blanks, of ASCII and beyond."""
    c = table(spark, d, "conversations")
    blank = (F.col("role") == "user") & (F.col("turn") % 2 == 0)
    text = F.when(blank, F.lit(" \u3000")).otherwise(F.concat(F.lit("\u00a0 "), F.col("text"), F.lit(" \u2009")))
    q = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), text.alias("text"))
    good, bad = text_queries.valid_queries(text_queries.read_queries(q))
    both = good.select("query_id", F.length("text").alias("n"), F.lit("ok").alias("reason"), F.lit(200).alias("code"))
    return both.unionByName(bad.select("query_id", F.length("text").alias("n"), "reason", "code"))


def _document_rows(spark, d):
    docs = heavy(spark, d, "documents", "doc_id", "text").withColumnRenamed("doc_id", "id")
    return embedding.embed_texts(docs, embedding.HashingTextEmbedder(DIM), out="values").select("id", "values")


def _benchmark_queries(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def text_embed(spark, d):
    out = embedding.sparse_counts(_document_rows(spark, d), "id", "values")
    return out.select(F.col("id").alias("doc_id"), "bucket", F.col("n").cast("long").alias("n"))


def text_embed_batched(spark, d):
    """The same through a model that is called with batches of 32 texts."""
    docs = heavy(spark, d, "documents", "doc_id", "text")
    out = embedding.sparse_counts(embedding.embed_texts(docs, embedding.HashingTextModel(DIM)), "doc_id")
    return out.select("doc_id", "bucket", F.col("n").cast("long").alias("n"))


def text_search_top1(spark, d):
    found, _ = ingest.answer_queries(
        _benchmark_queries(spark, d), _document_rows(spark, d), embedding.HashingTextEmbedder(DIM), include_metadata=False
    )
    return _ranked(found)


def text_search_top10(spark, d):
    found, _ = ingest.answer_queries(
        _benchmark_queries(spark, d), _document_rows(spark, d), embedding.HashingTextEmbedder(DIM), 10, include_metadata=False
    )
    return _ranked(found)


def topk_sparse(spark, d):
    """The ten best documents of every text through an inverted index of hashed counts."""
    model = embedding.SparseTextEmbedder(DIM)
    docs = heavy(spark, d, "documents", "doc_id", "text").select(F.col("doc_id").alias("id"), model.column(F.col("text")).alias("vector"))
    q = _benchmark_queries(spark, d).select("query_id", model.column(F.col("text")).alias("vector"))
    return _ranked(sparse.top_k_sparse(q, sparse.sparse_index(docs), 10))


# ------------------------------------------------------------------ images


def _rgba(spark, d, *more):
    """Each vector's 64 values as a 4 × 4 image with four channels (blue, green, red, alpha)."""
    e = heavy(spark, d, "embeddings", "vec_id", "embedding", *more)
    byte = F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 127.5).cast("int"))
    return e.select("vec_id", byte.alias("bytes"), *more)


def _image(origin: Column, height: Column, width: int, channels: int, mode: int, data: Column) -> Column:
    return F.struct(
        origin.alias("origin"), height.cast("int").alias("height"), F.lit(width).alias("width"),
        F.lit(channels).alias("nChannels"), F.lit(mode).alias("mode"), data.alias("data"),
    ).alias("image")


def _rgba_images(spark, d):
    hexes = F.array_join(F.transform("bytes", lambda b: F.lpad(F.hex(b), 2, "0")), "")
    origin = F.concat(F.lit("vectors/"), F.col("vec_id").cast("string"), F.lit(".png"))
    return _rgba(spark, d).select("vec_id", _image(origin, F.lit(4), 4, 4, 24, F.unhex(hexes)))


def _page_images(spark, d):
    """The bytes of each page, whole, as an image 16 pixels wide; the last row is filled with zeros."""
    p = heavy(spark, d, "pages", "page_id", "url", "html").withColumn("_rows", F.ceil(F.octet_length("html") / F.lit(48)).cast("int"))
    data = F.expr("rpad(encode(html, 'UTF-8'), _rows * 48, X'00')")
    return p.select("page_id", _image(F.col("url"), F.col("_rows"), 16, 3, 16, data))


def _as_bytes(df: DataFrame, key: str) -> DataFrame:
    """Normalised planes as whole byte values, one row per position."""
    plane = F.floor(F.col("pos") / 64).cast("int") + 1
    mean = F.element_at(F.array(*[F.lit(m) for m in MEAN]), plane)
    std = F.element_at(F.array(*[F.lit(s) for s in STD]), plane)
    out = df.select(key, F.posexplode("tensors").alias("pos", "v"))
    return out.select(key, "pos", F.round((F.col("v") * std + mean) * 255).cast("int").alias("byte"))


def normalize_pixels_sql(spark, d):
    rows = _rgba(spark, d).select("vec_id", F.posexplode(normalize_pixels(F.col("bytes"), 4)).alias("pos", "v"))
    return rows.select("vec_id", "pos", F.round("v", 6).alias("v"))


def preprocess_rgba(spark, d):
    """4 × 4 images with alpha enlarged to 8 × 8."""
    return _as_bytes(preprocess.preprocess_images(_rgba_images(spark, d), size=8), "vec_id")


def preprocess_rgb(spark, d):
    """Page images reduced to 8 pixels across and cut to their middle."""
    return _as_bytes(preprocess.preprocess_images(_page_images(spark, d), size=8), "page_id")


def preprocess_rows(spark, d):
    """Image columns after preprocessing: pixels gone, path, time and size of the tensor kept."""
    images = with_preprocess_time(with_image_path(_page_images(spark, d)), F.lit("2024-01-01").cast("timestamp"))
    out = preprocess.preprocess_images(images)
    return out.select(
        "page_id", "image_path", "image.*", F.size("tensors").alias("n"),
        naive("preprocess_time").alias("preprocess_time"), "error",
    )


def bad_images(spark, d):
    """Page images of which those of odd height lost a byte: they keep their row and get a reason."""
    images = _page_images(spark, d)
    cut = F.when(F.col("image.height") % 2 == 1, F.expr("substring(image.data, 1, octet_length(image.data) - 1)")).otherwise(F.col("image.data"))
    images = images.withColumn("image", F.col("image").withField("data", cut))
    out = preprocess.preprocess_images(images, size=8)
    good, bad = validate.split_rejects(out)
    return good.select("page_id", F.lit("ok").alias("reason")).unionByName(bad.select("page_id", "reason"))


def strip_image_pixels(spark, d):
    return strip_pixels(with_image_path(_page_images(spark, d))).select("page_id", "image_path", "image.*")


def tensor_to_image(spark, d):
    """Tensors turned back into image bytes, as they are stored: blue, green, red."""
    tensors = preprocess.preprocess_images(_page_images(spark, d), size=8).withColumn("path", F.col("image.origin"))
    back = preprocess.tensor_to_image(tensors.select("page_id", "path", "tensors"), size=8, origin="path")
    return back.select("page_id", "image.origin", "image.height", "image.mode", F.hex("image.data").alias("data"))


def embed_images(spark, d):
    """Tensors, then vectors, in two steps."""
    tensors = preprocess.preprocess_images(_page_images(spark, d), size=8)
    out = embedding.embed_images(tensors, embedding.PooledImageEmbedder(16, grid=2), size=8)
    values = out.select("page_id", F.posexplode_outer("embedding").alias("pos", "v"))
    return values.select("page_id", "pos", F.round(F.col("v").cast("double"), 3).alias("v"))


def _block_sums(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Means of normalised 4 × 4 blocks as whole sums of their bytes."""
    plane = F.floor(F.col("pos") / 4).cast("int") + 1
    mean = F.element_at(F.array(*[F.lit(m) for m in MEAN]), plane)
    std = F.element_at(F.array(*[F.lit(s) for s in STD]), plane)
    out = df.select(key, F.posexplode_outer(vector).alias("pos", "v"))
    return out.select(key, "pos", F.round((F.col("v") * std + mean) * 255 * 16).cast("int").alias("bytes"))


def embed_image_blocks(spark, d):
    """Tensors of 8 × 8 pixels, then a model of 2 × 2 block means, called with batches of 50."""
    tensors = preprocess.preprocess_images(_page_images(spark, d), size=8)
    return _block_sums(embedding.embed_images(tensors, embedding.BlockMeanEmbedder(2), size=8), "page_id", "embedding")


def embed_images_one_pass(spark, d):
    """The same without tensors between the two steps."""
    out = embedding.preprocess_and_embed(_page_images(spark, d), embedding.BlockMeanEmbedder(2), size=8)
    return _block_sums(out, "page_id", "embedding")


def image_ingest(spark, d):
    """Page images through preprocessing, model and upsert into a collection, then described."""
    path = scratch_path(prepare(spark), "collection")
    collection.ensure_collection(spark, path, 64, "images")
    time = F.lit("2024-01-01").cast("timestamp")
    ingest.ingest_images(
        spark, _page_images(spark, d), path, embedding.PooledImageEmbedder(64), id_col=F.col("page_id").cast("string"), time=time
    )
    return collection.describe_collection(spark, path)


def _bitmap_files(spark, d) -> str:
    """The vectors' pixels as image files written by the executors; those of label 1 hold no image, and those
    of label 0 are missing."""
    e = _rgba(spark, d, "label").where("vec_id IS NOT NULL AND label <> 0")
    # A bitmap file of 4 x 4 pixels, 24 bits each: its head is a fixed value, its rows go from bottom to top.
    head = "424D66000000000000003600000028000000040000000400000001001800000000003000000000000000000000000000000000000000"
    hexes = lambda i: F.lpad(F.hex(F.element_at("bytes", i + 1)), 2, "0")
    pixels = F.concat(*[hexes(16 * y + 4 * x + c) for y in reversed(range(4)) for x in range(4) for c in range(3)])
    body = F.when(F.col("label") == 1, F.lit("no image").cast("binary")).otherwise(F.unhex(F.concat(F.lit(head), pixels)))
    path = scratch_path(prepare(spark), "images")
    write_image_files(e.select(F.concat(F.col("vec_id"), F.lit(" x.bmp")).alias("name"), body.alias("data")), path)
    return path


def _read_images_of(images: DataFrame) -> DataFrame:
    """Number, size and pixels of images read from files, and their tensors' sizes or what is wrong."""
    out = preprocess.preprocess_images(images.withColumn("pixels", F.hex("image.data")), size=4)
    return out.select(
        F.regexp_extract("image.origin", r"name=(\d+)", 1).cast("long").alias("vec_id"),
        F.col("image.height").alias("height"), F.col("image.nChannels").alias("channels"), "pixels",
        F.when(F.col("tensors").isNull(), 0).otherwise(F.size("tensors")).alias("n"), F.col("error").isNotNull().alias("bad"),
    )


def read_image_files(spark, d):
    return _read_images_of(read_images(spark, _bitmap_files(spark, d), recursive=True))


def stream_image_files(spark, d):
    """The same folder as a stream of images; a long backlog is taken by one stream after the other, some folders each."""
    written = []
    for folders, triggers in image_backlogs(spark, _bitmap_files(spark, d), most_triggers=64):
        out = scratch_path(spark, "stream")
        with small_files(spark):
            images = read_image_stream(spark, folders, files_per_trigger=200, most_triggers=triggers)
            query = to_files(images, out, scratch_path(spark, "progress"))
        finished(query)
        written.append(spark.read.schema(IMAGE_SCHEMA).parquet(out))
    none = spark.createDataFrame([], IMAGE_SCHEMA)
    return _read_images_of(reduce(DataFrame.unionByName, written or [none]))


def resolve_image_files(spark, d):
    """The path of every vector's image as the image source gives it, against the files as they are listed;
    vectors of label 0 name a file that is not there."""
    root = _bitmap_files(spark, d)
    images = read_images(spark, root, recursive=True).select("image.origin")
    number = F.regexp_extract("origin", r"name=(\d+)", 1).cast("long")
    gone = F.concat(F.lit(f"file://{root}/name="), F.col("vec_id"), F.lit("%20x.bmp/gone"))
    matches = (
        table(spark, d, "embeddings").select("vec_id").join(images.select(number.alias("vec_id"), "origin"), "vec_id", "left")
        .select("vec_id", F.coalesce("origin", gone).alias("image_path"))
    )
    found = paths.resolve_existing_path(matches, paths.list_files(spark, root))
    return found.select("vec_id", F.coalesce(F.col("found_path") == F.col("image_path"), F.lit(False)).alias("there"))


# ------------------------------------------------------------------ streams


def _event_upsert(path: str):
    def handle(batch: DataFrame, batch_id: int) -> None:
        name = batch_name(batch, batch_id)
        collection.upsert(batch.sparkSession, path, _event_records(batch), F.col("_space"), name)

    return handle


def stream_consume(spark, d):
    """Events handed to an upsert per micro-batch."""
    path = scratch_path(prepare(spark), "collection")
    collection.ensure_collection(spark, path, 1, "events")

    finished(consume(stream(spark, d, "events"), _event_upsert(path), scratch_path(spark, "progress"), available_now=True))
    return _record_rows(collection.read_collection(spark, path))


def stream_replayed(spark, d):
    """The stream of events consumed from the start, folded, and consumed from the start again."""
    path = scratch_path(prepare(spark), "collection")
    collection.ensure_collection(spark, path, 1, "events")
    for _ in range(2):
        progress = scratch_path(spark, "progress")
        finished(consume(stream(spark, d, "events"), _event_upsert(path), progress, available_now=True))
        collection.compact(spark, path)
    return _record_rows(collection.read_collection(spark, path))


def _stream_rows(spark, df: DataFrame, mode: str = "append") -> DataFrame:
    out = scratch_path(spark, "stream")
    schema = df.schema
    finished(to_files(df, out, scratch_path(spark, "progress"), mode))
    return spark.read.schema(schema).parquet(out)


def stream_micro_batches(spark, d):
    e = stream(spark, d, "events").select("user_id", F.col("event_id").alias("id"), "ts")
    out = _stream_rows(spark, stream_arrivals.micro_batches_stream(e, 3, SIX_HOURS, ["user_id"]))
    return out.withColumn("ts", naive("ts"))


def stream_micro_batches_files(spark, d):
    """The same through the batch plan per micro-batch, with the state in files and the last rows closed."""
    e = stream(spark, d, "events").select("user_id", F.col("event_id").alias("id"), "ts")
    out, state, progress = (scratch_path(spark, name) for name in ("groups", "state", "progress"))
    finished(
        stream_arrivals.micro_batches_to_files(
            e, out, state, progress, 3, SIX_HOURS, ["user_id"], available_now=True, final=True
        )
    )
    return spark.read.parquet(out).drop("b").withColumn("ts", naive("ts"))


def stream_sessions(spark, d):
    out = _stream_rows(spark, stream_arrivals.session_windows_stream(stream(spark, d, "events"), SIX_HOURS, ["user_id"]))
    return out.withColumns({"session_start": naive("session_start"), "session_end": naive("session_end")})


def stream_throughput(spark, d):
    counts = _stream_rows(spark, stream_arrivals.period_counts_stream(stream(spark, d, "events"), TEN_MINUTES))
    out = arrivals.fill_periods(counts, TEN_MINUTES)
    return out.select(naive("period_start").alias("period_start"), "arrivals", F.round("rate", 8).alias("rate"))


def _ended_stream(spark, df: DataFrame, withheld) -> DataFrame:
    """What a stream that ends has emitted and, by `withheld(spark, checkpoint)`, what it has held back."""
    out, progress = scratch_path(spark, "stream"), scratch_path(spark, "progress")
    schema = df.schema
    finished(to_files(df, out, progress))
    return spark.read.schema(schema).parquet(out).unionByName(withheld(spark, progress))


def stream_micro_batches_final(spark, d):
    """All rows: those that the watermark has passed, and those that wait when the stream ends."""
    e = stream(spark, d, "events").select("user_id", F.col("event_id").alias("id"), "ts")
    out = _ended_stream(
        spark,
        stream_arrivals.micro_batches_stream(e, 3, SIX_HOURS, ["user_id"]),
        lambda s, at: stream_arrivals.final_micro_batches(s, at, 3, SIX_HOURS, ["user_id"]),
    )
    return out.withColumn("ts", naive("ts"))


def stream_micro_batches_bounded(spark, d):
    """Groups of sessions that are named by their first arrival, so that a key's state goes after an idle gap."""
    e = stream(spark, d, "events").select("user_id", F.col("event_id").alias("id"), "ts")
    out = _ended_stream(
        spark,
        stream_arrivals.micro_batches_stream(e, 3, SIX_HOURS, ["user_id"], by_first=True),
        lambda s, at: stream_arrivals.final_micro_batches(s, at, 3, SIX_HOURS, ["user_id"], by_first=True),
    )
    return out.withColumn("ts", naive("ts"))


def stream_throughput_live(spark, d):
    """Periods as they pass, the empty ones emitted by the stream itself; what it holds back at its end is added."""
    live = stream_arrivals.throughput_live(stream(spark, d, "events"), TEN_MINUTES)
    out, progress = scratch_path(spark, "stream"), scratch_path(spark, "progress")
    finished(to_files(live, out, progress))
    emitted = spark.read.schema(live.schema).parquet(out)
    rows = emitted.unionByName(stream_arrivals.final_live_periods(spark, progress, emitted, TEN_MINUTES))
    rate = F.round(F.col("arrivals") / F.lit(TEN_MINUTES.total_seconds()), 8)
    return rows.select(naive("period_start").alias("period_start"), "arrivals", rate.alias("rate"))


def stream_sessions_final(spark, d):
    """All sessions, those that are open when the stream ends too."""
    out = _ended_stream(
        spark,
        stream_arrivals.session_windows_stream(stream(spark, d, "events"), SIX_HOURS, ["user_id"]),
        lambda s, at: stream_arrivals.final_sessions(s, at, ["user_id"]),
    )
    return out.withColumns({"session_start": naive("session_start"), "session_end": naive("session_end")})


def stream_throughput_final(spark, d):
    """All periods, the last one too."""
    counts = _ended_stream(
        spark, stream_arrivals.period_counts_stream(stream(spark, d, "events"), TEN_MINUTES), stream_arrivals.final_period_counts
    )
    out = arrivals.fill_periods(counts, TEN_MINUTES)
    return out.select(naive("period_start").alias("period_start"), "arrivals", F.round("rate", 8).alias("rate"))


def stream_drop_repeats(spark, d):
    """Every event sent twice, kept once."""
    twice = stream(spark, d, "events").select("event_id", "ts", "value").withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1))))
    out = _stream_rows(spark, stream_arrivals.drop_repeats(twice, ["event_id"]).drop("_copy"))
    return out.withColumn("ts", naive("ts"))


VECTOR_PAYLOAD = T.StructType(
    [
        T.StructField("image", T.StructType([T.StructField("origin", T.StringType())])),
        T.StructField("tensors", T.ArrayType(T.FloatType())),
        T.StructField("preprocess_time", T.TimestampType()),
    ]
)


def stream_ingest(spark, d):
    """Vectors sent as messages, read as a stream, upserted; label 0 has no tensor and label 1 one that is too
    short, and both are rejected."""
    e = table(spark, d, "embeddings")
    rows = e.select(
        F.struct(F.concat(F.lit("images/"), F.col("vec_id").cast("string"), F.lit(".png")).alias("origin")).alias("image"),
        F.when(F.col("label") == 1, F.slice("embedding", 1, 63)).when(F.col("label") != 0, F.col("embedding")).alias("tensors"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("vec_id")).alias("preprocess_time"),
    )
    topic = scratch_path(spark, "topic")
    envelopes.publish(envelopes.encode_rows(rows, topic="images"), "parquet", topic)
    path, rejects = scratch_path(spark, "collection"), scratch_path(spark, "rejects")
    collection.ensure_collection(spark, path, 64, "images")
    source = read_envelopes(spark, "parquet", path=topic, topics="images")
    finished(
        jobs.ingest_stream(
            source, VECTOR_PAYLOAD, path, None, scratch_path(spark, "progress"), available_now=True, rejects_path=rejects
        )
    )
    good = collection.read_collection(spark, path).select(
        "id", F.col("metadata.image_path").alias("origin"), F.col("metadata.preprocess_time").alias("preprocess_time"),
        F.round(vectors.dot(F.col("values"), F.transform("values", lambda x: F.lit(1.0))), 5).alias("total"), F.lit("ok").alias("reason"),
    )
    bad = spark.read.schema("origin string, reason string").option("recursiveFileLookup", True).parquet(rejects)
    none = F.lit(None)
    return good.unionByName(
        bad.select(
            none.cast("string").alias("id"), "origin", none.cast("string").alias("preprocess_time"),
            none.cast("double").alias("total"), "reason",
        )
    )


def stream_ingest_images(spark, d):
    """Page images as tensors in messages, read as a stream, embedded and upserted."""
    tensors = preprocess.preprocess_images(_page_images(spark, d), size=8)
    rows = tensors.select(
        F.struct(F.concat(F.lit("pages/"), F.col("page_id").cast("string")).alias("origin")).alias("image"),
        "tensors",
        F.lit("2024-01-01").cast("timestamp").alias("preprocess_time"),
    )
    topic, path = scratch_path(spark, "topic"), scratch_path(spark, "collection")
    envelopes.publish(envelopes.encode_rows(rows, topic="images"), "parquet", topic)
    model = embedding.BlockMeanEmbedder(2)
    collection.ensure_collection(spark, path, model.dim, "images")
    source = read_envelopes(spark, "parquet", path=topic, topics="images")
    progress = scratch_path(spark, "progress")
    finished(jobs.ingest_stream(source, VECTOR_PAYLOAD, path, model, progress, available_now=True, size=8))
    rows = collection.read_collection(spark, path, collection.DEFAULT_NAMESPACE)
    return _block_sums(rows.select(F.col("id").cast("long").alias("page_id"), "values"), "page_id", "values")


def stream_delivery(spark, d):
    """Counters of a stream of messages, added up over more micro-batches than a stream keeps progress of."""
    schema, sent = _damaged(spark, d)
    topic, out, counters, progress = (scratch_path(spark, n) for n in ("topic", "stream", "counters", "progress"))
    envelopes.publish(sent.repartition(6, "key", F.octet_length("value")), "parquet", topic)
    kept = "spark.sql.streaming.numRecentProgressUpdates"
    before = spark.conf.get(kept)
    spark.conf.set(kept, 2)
    try:
        source = read_envelopes(spark, "parquet", {"maxFilesPerTrigger": 1}, topic, "t")
        finished(jobs.count_delivery(source, schema, out, counters, progress, available_now=True))
    finally:
        spark.conf.set(kept, before)
    return jobs.delivered(spark, counters)


def stream_delivery_reports(spark, d):
    """Counters reported by the running stream itself, which stops half-way and starts again."""
    schema, sent = _damaged(spark, d)
    topic, out, reported, at = (scratch_path(spark, n) for n in ("topic", "stream", "reports", "progress"))
    listener = progress.DeliveryReports(spark, reported)
    spark.streams.addListener(listener)
    try:
        for half in (0, 1):
            part = sent.where(F.pmod(F.xxhash64("value", "key"), F.lit(2)) == half)
            envelopes.publish(part.repartition(3, "key", F.octet_length("value")), "parquet", topic)
            source = read_envelopes(spark, "parquet", {"maxFilesPerTrigger": 1}, topic, "t")
            decoded = envelopes.observe_delivery(envelopes.decode_rows(source, schema))
            query = to_files(decoded.select("key", "row", "error"), out, at)
            finished(query)
            listener.wait(query)
    finally:
        spark.streams.removeListener(listener)
    return progress.totals(progress.reports(spark, reported))


def stream_search(spark, d):
    """Benchmark texts as a stream of queries against a collection of document vectors."""
    docs = _document_rows(spark, d)
    path, out = scratch_path(spark, "collection"), scratch_path(spark, "answers")
    collection.ensure_collection(spark, path, DIM, "documents")
    rows = docs.select(
        F.lpad(F.col("id").cast("string"), 12, "0").alias("id"), "values",
        F.struct(F.concat(F.lit("docs/"), F.col("id").cast("string")).alias("image_path"), F.lit(None).cast("string").alias("preprocess_time")).alias("metadata"),
        F.lit("2024-01-01").cast("timestamp").alias("updated_at"), F.col("id").alias("source_seq"),
    )
    collection.upsert(spark, path, rows, "texts")
    q = stream(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    finished(
        jobs.search_stream(
            q, path, embedding.HashingTextEmbedder(DIM), out, scratch_path(spark, "progress"), 2, "texts", available_now=True
        )
    )
    schema = "query_id long, rank int, id string, score double, image_path string"
    found = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{out}/matches")
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "id", F.round("score", 6).alias("score"), "image_path")


QUERIES = [
    topk_cosine, topk_cell_join, topk_many_queries, topk_grid, topk_approx, topk_approx_recall, topk_stored, topk_probed, topk_in_namespace, topk_with_values, cosine_to_label_mean, vector_profile, vector_dimension,
    vector_normalize, vector_conversion, check_dimension, valid_embeddings, no_match_report,
    upsert_latest, upsert_rewritten, upsert_replayed, read_namespace, collection_describe,
    record_id, record_metadata, format_match, resolve_existing_path,
    micro_batches, micro_batches_unkeyed, session_windows, throughput_windows, moving_average, moving_average_by_type,
    throughput_stats, run_summary, run_summary_by_user, failure_breakdown, log_throughput, batch_assign, batch_count,
    encode_rows, encode_rows_indexed, decode_roundtrip, decode_failures, delivery_stats, encode_json, decode_json, decode_json_any,
    published_messages, published_again, stream_published, row_index, row_index_sliced,
    split_rejects, valid_queries, text_embed, text_embed_batched, text_search_top1, text_search_top10, topk_sparse,
    normalize_pixels_sql, preprocess_rgba, preprocess_rgb, preprocess_rows, bad_images, strip_image_pixels, tensor_to_image,
    read_image_files, stream_image_files, resolve_image_files, embed_images, embed_image_blocks, embed_images_one_pass, image_ingest,
    stream_consume, stream_replayed, stream_micro_batches, stream_micro_batches_files,
    stream_sessions, stream_throughput, stream_micro_batches_final, stream_micro_batches_bounded, stream_throughput_live, stream_sessions_final, stream_throughput_final, stream_drop_repeats, stream_ingest,
    stream_ingest_images, stream_delivery, stream_delivery_reports, stream_search,
]


def queries():
    return {fn.__name__: fn for fn in QUERIES}
