"""Dense positions and trailing windows over orders of any length.

A window over a whole table, or over one hot key, is one task. Here such an order is first cut into
range-partitioned slices of even size; positions inside a slice are local, and one summary row per
slice carries the rest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumirank.plans.scratch import scratch_table

# Largest group that is left to one task.
GROUP_ROWS = 2_000_000
_LOW_33_BITS = (1 << 33) - 1


def key_struct(keys: Sequence[str]) -> Column:
    """The keys as one struct: it groups, joins and partitions with nulls equal to nulls."""
    return F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("all"))


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the largest key group (of the table if there are no keys)."""
    if not keys:
        return df.count()
    biggest = df.groupBy(*keys).count().agg(F.max("count").alias("n")).first()
    return biggest["n"] or 0


def index_within(
    df: DataFrame,
    order_by: Sequence[str | Column],
    partition_by: Sequence[str] = (),
    name: str = "row_index",
    group_rows: int = GROUP_ROWS,
    largest: int | None = None,
) -> DataFrame:
    """Add the 0-based position of each row in its group; `order_by` must be a total order.

    Groups of checked size use one window; otherwise the rows are range-partitioned and written
    once, so that a hot group spreads over as many slices as it needs. `largest` is the size of the
    largest group where it is known already.
    """
    keys = list(partition_by)
    if largest is None:
        largest = largest_group(df, keys)
    if largest <= group_rows:
        w = W.partitionBy(*keys).orderBy(*order_by)
        return df.withColumn(name, F.row_number().over(w).cast("long") - 1)

    order = [*keys, *order_by]
    sliced = scratch_table(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_slice", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW_33_BITS)))
        .withColumn("_group", key_struct(keys)),
        "slices",
    )
    parts = sliced.groupBy("_slice", "_group").agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    slices = (
        parts.groupBy("_slice")
        .agg(F.sum("_n").alias("_n"))
        .select("_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    parts = parts.join(slices, "_slice")
    starts = parts.groupBy("_group").agg(F.min(F.col("_offset") + F.col("_first")).alias("_start"))
    shift = parts.join(starts, "_group").select("_slice", "_group", (F.col("_offset") - F.col("_start")).alias("_shift"))
    return (
        sliced.join(shift, ["_slice", "_group"])
        .withColumn(name, F.col("_pos") + F.col("_shift"))
        .select(*df.columns, name)
    )


def with_halo(
    df: DataFrame, index: str, halo: int, block_rows: int = GROUP_ROWS
) -> DataFrame:
    """Cut an indexed order into blocks, each starting with copies of the `halo` rows before it.

    Adds `_block` and `_halo`; a trailing frame of up to `halo` + 1 rows may then be taken per block,
    after which the rows with `_halo` are dropped.
    """
    if block_rows <= halo:
        raise ValueError("a block must be longer than its halo")
    block = F.floor(F.col(index) / F.lit(block_rows)).cast("long")
    own = F.struct(block.alias("b"), F.lit(False).alias("h"))
    copy = F.struct((block + 1).alias("b"), F.lit(True).alias("h"))
    near_end = F.col(index) % F.lit(block_rows) >= F.lit(block_rows - halo)
    return (
        df.withColumn("_at", F.explode(F.when(near_end, F.array(own, copy)).otherwise(F.array(own))))
        .withColumn("_block", F.col("_at.b"))
        .withColumn("_halo", F.col("_at.h"))
        .drop("_at")
    )
