"""Dealing a small input over all cores before work that is heavy per row."""

from __future__ import annotations

from pyspark.sql import DataFrame

# An input estimated at less than this per core may lie in fewer splits than there are cores.
BYTES_PER_CORE = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a small table to all cores; a larger one has splits enough and is left alone."""
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(cores) if int(str(size)) < cores * BYTES_PER_CORE else df
