"""Vector columns: conversion, norms, cosine, size."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_array(df: DataFrame, col: str, dtype: str = "float32") -> DataFrame:
    """Turn an ML vector column into an array; an array column is cast."""
    if isinstance(df.schema[col].dataType, VectorUDT):
        return df.withColumn(col, vector_to_array(F.col(col), dtype))
    return df.withColumn(col, F.col(col).cast("array<float>" if dtype == "float32" else "array<double>"))


def to_vector(df: DataFrame, col: str) -> DataFrame:
    """Turn an array column into an ML vector column."""
    return df.withColumn(col, array_to_vector(F.col(col)))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double; null when the lengths differ."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm_l2(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double; null if either vector has no length."""
    norms = norm_l2(a) * norm_l2(b)
    return F.when(norms > 0, dot(a, b) / norms)


def normalize_l2(a: Column) -> Column:
    """The vector scaled to length 1; null if it has no length."""
    length = norm_l2(a)
    return F.when(length > 0, F.transform(a, lambda x: x.cast("double") / length))


def vector_dim(df: DataFrame, col: str, strict: bool = False) -> int | None:
    """Dimension of a vector column: that of the first vector, or (strict) the one they all share."""
    sizes = df.where(F.col(col).isNotNull()).select(F.size(col).alias("n"))
    if not strict:
        first = sizes.first()
        return first["n"] if first else None
    span = sizes.agg(F.min("n").alias("low"), F.max("n").alias("high")).first()
    if span["low"] != span["high"]:
        raise ValueError(f"vectors have between {span['low']} and {span['high']} values")
    return span["low"]
