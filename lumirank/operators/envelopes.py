"""Rows as messages: key, value and headers, as Spark's Kafka source and sink have them.

A value is the row as JSON, plain (`json`) or in base64 (`json_base64`). The `schema` header carries
type, timestamp and metadata, the `format` header the name of the format. Nothing is unpickled.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumirank.functions.vectors import to_array
from lumirank.operators.validate import split_by_reason
from lumirank.plans.ordered import index_within
from lumirank.plans.spread import spread

# Fixed values of the message format.
ROW_TYPE = "spark_row"
FORMAT_BASE64 = "json_base64"
FORMAT_JSON = "json"
ISO_MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"

JSON_OPTIONS = {"timestampFormat": ISO_MICROS + "XXX", "timestampNTZFormat": ISO_MICROS}
ENVELOPE_SCHEMA = (
    "key binary, value binary, headers array<struct<key:string,value:binary>>, topic string, "
    "partition int, offset long, timestamp timestamp"
)
_HEADER_SCHEMA = "type string, timestamp string, metadata map<string,string>"
_CORRUPT = "_corrupt_record"


def _plain_vectors(df: DataFrame) -> DataFrame:
    for field in df.schema:
        if isinstance(field.dataType, VectorUDT):
            df = to_array(df, field.name)
    return df


def _map_of(metadata: dict | None) -> Column | None:
    if not metadata:
        return None
    pairs = [F.lit(str(v)) for item in metadata.items() for v in item]
    return F.create_map(*pairs)


def message_key(df: DataFrame, key_col: str | None) -> Column:
    """The key column as bytes of its text; null if there is no such column."""
    if key_col is None or key_col not in df.columns:
        return F.lit(None).cast("binary")
    return F.col(key_col).cast("string").cast("binary")


def _payload(columns: Sequence[str], fmt: str) -> Column:
    text = F.to_json(F.struct(*columns), JSON_OPTIONS)
    if fmt == FORMAT_BASE64:
        one_line = F.translate(F.base64(text.cast("binary")), "\r\n", "")
        return one_line.cast("binary")
    if fmt == FORMAT_JSON:
        return text.cast("binary")
    raise ValueError(f"unknown message format {fmt!r}")


def encode_rows(
    df: DataFrame,
    metadata: dict | None = None,
    key_col: str | None = None,
    topic: str | None = None,
    fmt: str = FORMAT_BASE64,
    time: Column | None = None,
    order_by: Sequence[str] | None = None,
) -> DataFrame:
    """One message per row. With `order_by`, `row_index` in that order goes into the metadata."""
    rows = _plain_vectors(df)
    columns = rows.columns
    extra = _map_of(metadata)
    if order_by:
        rows = spread(index_within(rows, order_by, name="_row_index"))
        index = F.create_map(F.lit("row_index"), F.col("_row_index").cast("string"))
        extra = index if extra is None else F.map_concat(extra, index)
    stamp = F.date_format(F.current_timestamp() if time is None else time, ISO_MICROS)
    about = [F.lit(ROW_TYPE).alias("type"), stamp.alias("timestamp")]
    if extra is not None:
        about.append(extra.alias("metadata"))

    def header(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("key"), value.cast("binary").alias("value"))

    headers = F.array(header("schema", F.to_json(F.struct(*about))), header("format", F.lit(fmt)))
    out = [message_key(rows, key_col).alias("key"), _payload(columns, fmt).alias("value"), headers.alias("headers")]
    if topic is not None:
        out.append(F.lit(topic).alias("topic"))
    return rows.select(*out)


def _header(name: str) -> Column:
    return F.filter(F.col("headers"), lambda h: h["key"] == name)[0]["value"].cast("string")


def decode_rows(messages: DataFrame, schema: T.StructType, fmt: str = FORMAT_BASE64) -> DataFrame:
    """`row`, `metadata`, `error` and `bytes` of each message, next to its other columns.

    Metadata is what the `schema` header holds plus its timestamp, and empty without headers. A value
    that cannot be read gives a null row and an error; it never fails the job.
    """
    text = F.col("value").cast("string")
    if fmt == FORMAT_BASE64:
        text = F.try_to_binary(text, F.lit("base64")).cast("string")
    parsed = F.from_json(
        text,
        T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType())]),
        {**JSON_OPTIONS, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT},
    )
    about = F.from_json(_header("schema"), _HEADER_SCHEMA)
    metadata = F.when(
        about.isNotNull(),
        F.map_concat(
            F.coalesce(F.map_filter(about["metadata"], lambda k, v: k != "timestamp"), F.create_map().cast("map<string,string>")),
            F.create_map(F.lit("timestamp"), about["timestamp"]),
        ),
    ).otherwise(F.create_map().cast("map<string,string>"))
    error = (
        F.when(F.col("value").isNull(), F.lit("empty message"))
        .when(F.col("_text").isNull(), F.lit("not base64"))
        .when(F.col("_parsed").isNull() | F.col(f"_parsed.{_CORRUPT}").isNotNull(), F.lit("not a row"))
    )
    rest = [c for c in messages.columns if c not in ("value", "headers")]
    return (
        messages.withColumn("_text", text)
        .withColumn("_parsed", F.when(F.col("_text").isNotNull(), parsed))
        .withColumn("error", error)
        .select(
            *rest,
            F.when(F.col("error").isNull(), F.col("_parsed").dropFields(_CORRUPT)).alias("row"),
            metadata.alias("metadata"),
            "error",
            F.coalesce(F.octet_length("value"), F.lit(0)).alias("bytes"),
        )
    )


def readable_rows(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(decoded messages with a row, the others with the reason)."""
    good, bad = split_by_reason(decoded, F.col("error"))
    return good.drop("error"), bad.drop("error")


def encode_json(df: DataFrame, time: Column | None = None) -> DataFrame:
    """Each row as JSON text; a `timestamp` is added where the row has none."""
    rows = _plain_vectors(df)
    stamp = F.date_format(F.current_timestamp() if time is None else time, ISO_MICROS)
    if "timestamp" in rows.columns:
        kept = F.col("timestamp")
        if isinstance(rows.schema["timestamp"].dataType, (T.TimestampType, T.TimestampNTZType)):
            kept = F.date_format(kept, ISO_MICROS)
        stamp = F.coalesce(kept.cast("string"), stamp)
    columns = [F.col(c) for c in rows.columns if c != "timestamp"]
    return rows.select(F.to_json(F.struct(*columns, stamp.alias("timestamp")), JSON_OPTIONS).alias("value"))


def decode_json(df: DataFrame, schema: T.StructType) -> DataFrame:
    """`row` and `error` of each JSON text in `value`."""
    messages = df.withColumn("headers", F.lit(None).cast("array<struct<key:string,value:binary>>"))
    return decode_rows(messages, schema, FORMAT_JSON).drop("metadata")


def _variant(value: Column) -> Column:
    """JSON text as a variant; null for what is no JSON."""
    return F.try_parse_json(value.cast("string"))


def infer_schema(df: DataFrame) -> T.StructType:
    """The fields of all JSON objects in `value`, nested ones included.

    One aggregation: every task merges the types of its texts. A field of several types is a variant, one that is always
    null a string, a number with a point a double. Texts that are no JSON objects do not count; without any there are no fields.
    """
    parsed = _variant(F.col("value"))
    objects = df.select(parsed.alias("v")).where(F.schema_of_variant(F.col("v")).startswith("OBJECT"))
    text = objects.agg(F.schema_of_variant_agg("v")).first()[0]
    if not text or not text.startswith("OBJECT<"):
        return T.StructType([])
    return _named(T.DataType.fromDDL(_as_struct(text)))


# Names are quoted where they are not plain; types outside quotes are renamed.
_QUOTED = re.compile(r"(`(?:[^`]|``)*`)")


def _as_struct(text: str) -> str:
    parts = _QUOTED.split(text)
    return "".join(p if p.startswith("`") else p.replace("OBJECT<", "STRUCT<").replace("VOID", "STRING") for p in parts)


def _named(kind: T.DataType) -> T.DataType:
    """The type with every field nullable; JSON's broken numbers are doubles."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _named(f.dataType)) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_named(kind.elementType))
    return T.DoubleType() if isinstance(kind, T.DecimalType) else kind


def _ddl(kind: T.DataType) -> str:
    """The type as text, with names of any letters."""
    if isinstance(kind, T.StructType):
        quoted = (f.name.replace("`", "``") for f in kind.fields)
        return "struct<" + ",".join(f"`{name}`:{_ddl(f.dataType)}" for name, f in zip(quoted, kind.fields)) + ">"
    return f"array<{_ddl(kind.elementType)}>" if isinstance(kind, T.ArrayType) else kind.simpleString()


def decode_json_any(df: DataFrame, schema: T.StructType | None = None) -> DataFrame:
    """`row` and `error` of each JSON text in `value`, without a declared schema.

    The schema is inferred from all texts unless an inferred one is given, as a stream needs it. Fields a
    text lacks are null, and so are values that do not fit a given schema. What is no JSON object is a reject with a reason.
    """
    schema = infer_schema(df) if schema is None else schema
    parsed = df.withColumn("_variant", _variant(F.col("value")))
    error = (
        F.when(F.col("value").isNull(), F.lit("empty message"))
        .when(F.col("_variant").isNull(), F.lit("not JSON"))
        .when(~F.schema_of_variant(F.col("_variant")).startswith("OBJECT"), F.lit("not a row"))
    )
    rest = [c for c in df.columns if c != "value"]
    if schema.fields:
        row = F.try_variant_get("_variant", "$", _ddl(schema))
    else:
        row = F.lit(None).cast("struct<>")
    return parsed.withColumn("error", error).select(*rest, F.when(F.col("error").isNull(), row).alias("row"), "error")


def _as_stored(messages: DataFrame) -> DataFrame:
    """Messages with the columns a broker would add: the writing task and the place in its output.

    Spark numbers no rows in a stream, so streamed files leave these two empty.
    """
    partition, offset = F.lit(None).cast("int"), F.lit(None).cast("long")
    if not messages.isStreaming:
        partition = F.spark_partition_id()
        offset = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    topic = F.col("topic") if "topic" in messages.columns else F.lit(None).cast("string")
    return messages.select(
        "key",
        "value",
        "headers",
        topic.alias("topic"),
        partition.alias("partition"),
        offset.alias("offset"),
        F.current_timestamp().alias("timestamp"),
    )


def publish(
    messages: DataFrame, fmt: str, path: str | None = None, options: dict | None = None, batch: str | None = None
) -> None:
    """Write messages from the executors: to Kafka, or as files with the columns Kafka would add.

    Files of a named `batch` go to a folder of their own, `<path>/b=NAME`: a job that runs again replaces what it published.
    Without a name they are added, as they always are to a topic, which has no way to take messages back.
    """
    rows = messages if fmt == "kafka" else _as_stored(messages)
    writer = rows.write.format(fmt).options(**(options or {}))
    if batch is None:
        writer = writer.mode("append")
        writer.save(path) if path else writer.save()
        return
    if fmt == "kafka" or not path:
        raise ValueError("only files under a path can be replaced by the name of their batch")
    writer.mode("overwrite").save(f"{path}/b={batch}")


def publish_stream(messages: DataFrame, fmt: str, checkpoint: str, path: str | None = None, options: dict | None = None):
    """The streaming form of `publish`; returns a writer that is ready to start."""
    rows = messages if fmt == "kafka" else _as_stored(messages)
    writer = rows.writeStream.format(fmt).option("checkpointLocation", checkpoint).options(**(options or {}))
    return writer.option("path", path) if path else writer


def delivery_stats(decoded: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Messages, errors and bytes of decoded messages, in all or per topic and partition."""
    return decoded.groupBy(*by).agg(*_counters())


def observe_delivery(decoded: DataFrame, name: str | Observation = "delivery") -> DataFrame:
    """The same counters as a side effect of whatever the rows are used for (also in streams)."""
    return decoded.observe(name, *_counters())


def _counters() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("messages"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
        F.coalesce(F.sum(F.col("bytes").cast("long")), F.lit(0)).alias("bytes"),
    ]
