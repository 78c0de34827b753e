"""Splitting a table into rows to keep and rows to report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_by_reason(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(rows whose `reason` is null, the others with the reason)."""
    marked = df.withColumn("reason", reason)
    return marked.where(F.col("reason").isNull()).drop("reason"), marked.where(F.col("reason").isNotNull())


def split_rejects(
    df: DataFrame, path: str = "image.origin", payload: str = "tensors", size: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Rows with a path and a payload, and the others with the reason.

    With `size`, a payload must have that many values and none of them null.
    """
    no_path = F.coalesce(F.length(F.col(path)), F.lit(0)) == 0
    reason = F.when(no_path, F.lit(f"missing {path}")).when(F.col(payload).isNull(), F.lit(f"missing {payload}"))
    if size is not None:
        found = F.size(F.col(payload))
        reason = reason.when(
            found != size, F.concat(F.lit(f"{payload} of "), found.cast("string"), F.lit(f" values, expected {size}"))
        ).when(F.exists(payload, lambda x: x.isNull()), F.lit(f"null among {payload}"))
    return split_by_reason(df, reason)


def valid_embeddings(df: DataFrame, col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """Rows that have an embedding, and the others with the reason."""
    none = F.col(col).isNull() | (F.size(col) <= 0)
    return split_by_reason(df, F.when(none, F.lit("no embedding returned")))


def check_dimension(df: DataFrame, dim: int, col: str = "values") -> tuple[DataFrame, DataFrame]:
    """Rows whose vector has `dim` values, and the others with the reason."""
    size = F.coalesce(F.size(col), F.lit(-1))
    reason = F.when(
        size != dim, F.concat(F.lit("dimension "), size.cast("string"), F.lit(f", expected {dim}"))
    )
    return split_by_reason(df, reason)


def require_dimension(df: DataFrame, dim: int, col: str = "values") -> DataFrame:
    """The same rows; the job fails on a vector of another dimension."""
    size = F.coalesce(F.size(col), F.lit(-1))
    message = F.concat(F.lit("vector of dimension "), size.cast("string"), F.lit(f" in a collection of {dim}"))
    return df.withColumn(col, F.when(size == dim, F.col(col)).otherwise(F.raise_error(message)))
