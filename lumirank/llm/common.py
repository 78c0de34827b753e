"""Small helpers the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lumirank import prepare
from lumirank.plans.scratch import scratch_table

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words are runs of anything but the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes of an Arrow batch and rows worked on at a time: texts are long, and a worker holds a batch's inputs and outputs.
BATCH_BYTES = 8 << 20
SLICE_ROWS = 256


def ready(spark: SparkSession) -> SparkSession:
    """The session with this package on its executors and batches of texts of bounded size."""
    prepare(spark).conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder."""
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, _UPPER, _UPPER.lower())


#: The same in Python, for `str.translate`.
ASCII_LOWER = str.maketrans(_UPPER, _UPPER.lower())


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def free_name(df: DataFrame, name: str) -> str:
    """`name`, lengthened until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_key(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a key of their own, and the key's name.

    Ids that are unique and not null, which a look at that column alone tells, are the key; otherwise the
    rows are numbered and written once, so that the numbers stay the same.
    """
    key = free_name(docs, "_key")
    clash = docs.groupBy("doc_id").count().where((F.col("count") > 1) | F.col("doc_id").isNull()).limit(1).count()
    if clash:
        return scratch_table(docs.withColumn(key, F.monotonically_increasing_id()), "numbered"), key
    return docs.withColumn(key, F.col("doc_id").cast("long")), key


def map_batches(
    df: DataFrame,
    fn: Callable[[Iterator[dict]], Iterator[dict]],
    schema: T.StructType,
    barrier: bool = False,
) -> DataFrame:
    """`mapInArrow` over dicts of Arrow arrays; `fn` yields dicts of arrays in the order of `schema`."""
    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = (dict(zip(b.schema.names, b.columns)) for b in batches if b.num_rows)
        for made in fn(named):
            arrays = [made[f.name] if isinstance(made[f.name], pa.Array) else pa.array(made[f.name], f.type) for f in out]
            yield pa.RecordBatch.from_arrays(arrays, schema=out)

    return df.mapInArrow(run, schema, barrier)


def with_columns_from(
    df: DataFrame,
    inputs: Sequence[str],
    fields: Sequence[T.StructField],
    make: Callable[[], Callable[..., Sequence]],
    rows: int = SLICE_ROWS,
) -> DataFrame:
    """Add columns computed batch by batch from `inputs`; a column of the same name is replaced.

    `make` runs once per task and returns the function from input arrays to output arrays, at most `rows` long.
    """
    new = [f.name for f in fields]
    kept = [f for f in df.schema.fields if f.name not in new]
    schema = T.StructType([*kept, *fields])
    carried = [f.name for f in kept]
    given = [free_name(df, f"_in{i}") for i in range(len(inputs))]
    frame = df.select(*[F.col(f"`{c}`") for c in carried], *[F.col(f"`{c}`").alias(g) for g, c in zip(given, inputs)])

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        fn = make()
        for b in batches:
            for at in range(0, len(next(iter(b.values()))), rows):
                part = {c: a.slice(at, rows) for c, a in b.items()}
                made = fn(*[part[g] for g in given])
                yield {**{c: part[c] for c in carried}, **dict(zip(new, made))}

    return map_batches(frame, run, schema)
