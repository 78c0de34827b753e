"""Text queries and their validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumirank.operators.validate import split_by_reason


# Everything that counts as a blank at the ends of a text, ASCII or not.
BLANK = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def read_queries(df: DataFrame, query_id: str = "query_id", text: str = "text") -> DataFrame:
    """Any table or stream of texts as (query_id, text)."""
    return df.select(F.col(query_id).cast("long").alias("query_id"), F.col(text).alias("text"))


def valid_queries(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(queries with stripped text, rejected queries with code and reason)."""
    text = F.regexp_replace("text", f"^{BLANK}+|{BLANK}+$", "")
    empty = F.coalesce(F.length(text), F.lit(0)) == 0
    good, bad = split_by_reason(queries, F.when(empty, F.lit("no text provided")))
    return good.withColumn("text", text), bad.withColumn("code", F.lit(400))
