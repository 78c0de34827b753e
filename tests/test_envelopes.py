import json
from datetime import datetime

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumirank.operators import envelopes, validate
from lumirank.sources.envelopes import kafka_options, read_envelopes
from lumirank.sources.queries import read_queries, valid_queries

NESTED_DDL = (
    "id int, user struct<name:string,email:string>, tags array<string>, "
    "metrics struct<visits:int,conversions:double>, timestamp timestamp, note string, raw binary, x float"
)


def nested(spark):
    row = (
        123, ("Test User", "u@example.com"), ["python", "spark", "kafka"], (42, 3.14),
        datetime(2023, 1, 1, 12, 0, 0, 123456), None, bytearray(b"\x00\xff"), 0.1,
    )
    return spark.createDataFrame([row], NESTED_DDL)


def simple(spark):
    return spark.createDataFrame([(1, "Test User", True)], "id int, name string, active boolean")


def headers(row):
    return {h["key"]: bytes(h["value"]).decode() for h in row["headers"]}


def test_simple_row_has_schema_and_format_headers(spark):
    row = envelopes.encode_rows(simple(spark)).first()
    found = headers(row)
    assert list(found) == ["schema", "format"] and found["format"] == "json_base64"
    about = json.loads(found["schema"])
    assert about["type"] == "spark_row" and "metadata" not in about
    datetime.fromisoformat(about["timestamp"])
    assert row["key"] is None


def test_metadata_is_in_the_header(spark):
    meta = {"source": "test", "version": "1.0", "priority": "high"}
    row = envelopes.encode_rows(simple(spark), meta).first()
    assert json.loads(headers(row)["schema"])["metadata"] == meta


@pytest.mark.parametrize("fmt", ["json_base64", "json"])
def test_nested_values_survive(spark, fmt):
    df = nested(spark)
    back = envelopes.decode_rows(envelopes.encode_rows(df, fmt=fmt), df.schema, fmt)
    assert back.select("row.*").collect() == df.collect()
    assert back.schema["row"].dataType == df.schema


def test_unknown_format_is_refused(spark):
    with pytest.raises(ValueError, match="unknown message format"):
        envelopes.encode_rows(simple(spark), fmt="pickle")


def test_decoded_metadata_has_the_timestamp(spark):
    sent = envelopes.encode_rows(simple(spark), {"source": "test"}, time=F.lit("2024-01-02 03:04:05.5").cast("timestamp"))
    row = envelopes.decode_rows(sent, simple(spark).schema).first()
    assert row["metadata"] == {"source": "test", "timestamp": "2024-01-02T03:04:05.500000"}
    assert row["error"] is None


def test_without_headers_metadata_is_empty(spark):
    sent = envelopes.encode_rows(simple(spark)).withColumn("headers", F.lit(None).cast("array<struct<key:string,value:binary>>"))
    row = envelopes.decode_rows(sent, simple(spark).schema).first()
    assert row["metadata"] == {} and row["row"]["name"] == "Test User"


@pytest.mark.parametrize(
    "value,reason", [(b"not base64!", "not base64"), (b"aW52YWxpZA==", "not a row"), (None, "empty message")]
)
def test_bad_payload_is_one_reject_and_does_not_fail(spark, value, reason):
    good = envelopes.encode_rows(simple(spark))
    bad = good.withColumn("value", F.lit(value).cast("binary") if value is not None else F.lit(None).cast("binary"))
    decoded = envelopes.decode_rows(good.unionByName(bad), simple(spark).schema)
    ok, rejects = envelopes.readable_rows(decoded)
    assert ok.count() == 1
    assert [r["reason"] for r in rejects.collect()] == [reason]
    stats = envelopes.delivery_stats(decoded).first()
    size = len(good.first()["value"])
    assert tuple(stats) == (2, 1, size + len(value or b""))


def test_key_and_row_index(spark):
    df = spark.createDataFrame([(i, f"n{i}") for i in range(30)], "id int, name string").repartition(4)
    sent = envelopes.encode_rows(df, {"a": "b"}, key_col="name", order_by=["id"])
    back = envelopes.decode_rows(sent, df.schema).collect()
    assert {(bytes(r["key"]).decode(), r["metadata"]["row_index"], r["metadata"]["a"]) for r in back} == {
        (f"n{i}", str(i), "b") for i in range(30)
    }
    assert envelopes.encode_rows(df, key_col="missing").where("key is not null").count() == 0


def test_vectors_travel_as_arrays(spark):
    df = spark.createDataFrame([(1, Vectors.dense([0.5, 1.5]))], ["id", "v"])
    schema = T.StructType.fromDDL("id long, v array<float>")
    assert envelopes.decode_rows(envelopes.encode_rows(df), schema).first()["row"]["v"] == [0.5, 1.5]


def test_json_gets_a_timestamp_only_where_there_is_none(spark):
    time = F.lit("2024-01-01").cast("timestamp")
    assert json.loads(envelopes.encode_json(simple(spark), time).first()["value"])["timestamp"] == "2024-01-01T00:00:00.000000"
    df = spark.createDataFrame([(1, "mine"), (2, None)], "id int, timestamp string")
    got = [json.loads(r["value"])["timestamp"] for r in envelopes.encode_json(df, time).collect()]
    assert got == ["mine", "2024-01-01T00:00:00.000000"]
    back = envelopes.decode_json(envelopes.encode_json(simple(spark)), simple(spark).schema).first()
    assert back["row"]["active"] is True and back["error"] is None


def test_publish_and_read_back(spark, tmp_path):
    path = str(tmp_path / "topic")
    df = spark.createDataFrame([(i,) for i in range(10)], "id int").repartition(3)
    for topic in ("a", "b"):
        envelopes.publish(envelopes.encode_rows(df, topic=topic), "parquet", path)
    read = read_envelopes(spark, "parquet", path=path, topics=["a"], streaming=False)
    assert read.count() == 10 and read.select("partition", "offset").distinct().count() == 10
    stats = envelopes.delivery_stats(envelopes.decode_rows(read, df.schema), ["topic", "partition"])
    assert sum(r["messages"] for r in stats.collect()) == 10


def test_counters_as_a_side_effect(spark):
    seen = Observation("seen")
    decoded = envelopes.decode_rows(envelopes.encode_rows(simple(spark)), simple(spark).schema)
    envelopes.observe_delivery(decoded, seen).collect()
    assert seen.get["messages"] == 1 and seen.get["errors"] == 0 and seen.get["bytes"] > 0


def test_kafka_options():
    got = kafka_options("h:9092", ["a", "b"], maxOffsetsPerTrigger="100")
    assert got["subscribe"] == "a,b" and got["startingOffsets"] == "earliest" and got["maxOffsetsPerTrigger"] == "100"


def test_queries_are_stripped_and_empty_ones_rejected(spark):
    rows = [(1, " a b\n"), (2, ""), (3, "  \t"), (4, None)]
    good, bad = valid_queries(read_queries(spark.createDataFrame(rows, "query_id int, text string")))
    assert [tuple(r) for r in good.collect()] == [(1, "a b")]
    assert {(r["query_id"], r["reason"], r["code"]) for r in bad.collect()} == {(i, "no text provided", 400) for i in (2, 3, 4)}


def test_split_rejects(spark):
    df = spark.createDataFrame([(("p",), [1.0]), (("",), [1.0]), (("q",), None), (None, None)], "image struct<origin:string>, tensors array<float>")
    good, bad = validate.split_rejects(df)
    assert good.count() == 1
    assert sorted(r["reason"] for r in bad.collect()) == ["missing image.origin", "missing image.origin", "missing tensors"]


def test_a_batch_published_again_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "topic")
    sent = envelopes.encode_rows(spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string"), topic="t")
    for batch in ("x", "y", "x"):
        envelopes.publish(sent, "parquet", path, batch=batch)
    envelopes.publish(sent.limit(1), "parquet", path)
    assert read_envelopes(spark, "parquet", path=path, topics="t", streaming=False).count() == 5
    with pytest.raises(ValueError, match="only files"):
        envelopes.publish(sent, "kafka", batch="x")
