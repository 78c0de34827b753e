"""Finding the file behind a match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumirank.functions.records import record_id


def list_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """Paths of the files under `path`; their contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    return reader.load(path).select("path")


def plain_path(path: Column) -> Column:
    """One form for the ways sources write a path: `file:/d/a%20b`, `file:///d/a b` and `/d/a b` are the same.

    The file scheme goes, three slashes after another scheme become one, percent signs are decoded.
    """
    bare = F.regexp_replace(F.regexp_replace(path, "^file:/+", "/"), "^([A-Za-z][A-Za-z0-9+.-]*):///+", "$1:/")
    return F.coalesce(F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B"))), bare)


def resolve_existing_path(
    matches: DataFrame, files: DataFrame, fallback_dir: str = "images", path: str = "image_path"
) -> DataFrame:
    """Add `found_path`: the stored path if that file exists, else its name in `fallback_dir`, else null.

    Paths are compared in their plain form, so listings and stored paths may come from different sources.
    A fallback folder that is relative is looked for at the end of the listed paths; what is found there
    is given as it is listed, the smallest of several. Each file path is looked up once, whatever number
    of matches point at it.
    """
    folder = fallback_dir.rstrip("/")
    relative = not folder.startswith("/") and ":" not in folder
    depth = folder.count("/") + 2
    listed = files.select(F.col("path").alias("_listed")).distinct().withColumn("_plain", plain_path(F.col("_listed")))
    # A listed path is found by its whole plain form and, for a relative folder, by its last parts.
    keys = [F.struct(F.lit(0).alias("turn"), F.col("_plain").alias("key"))]
    if relative:
        tail = F.array_join(F.slice(F.split("_plain", "/"), -depth, depth), "/")
        keys.append(F.struct(F.lit(1).alias("turn"), F.when(F.size(F.split("_plain", "/")) >= depth, tail).alias("key")))
    else:
        keys.append(F.struct(F.lit(1).alias("turn"), F.col("_plain").alias("key")))
    known = listed.select("_listed", F.explode(F.array(*keys)).alias("_k")).where("_k.key IS NOT NULL")
    known = known.groupBy("_k").agg(F.min("_listed").alias("_listed"))

    wanted = matches.select(F.col(path).alias("_stored")).distinct()
    local = F.concat(plain_path(F.lit(folder + "/")), record_id(plain_path(F.col("_stored"))))
    tries = F.array(F.struct(F.lit(0).alias("turn"), plain_path(F.col("_stored")).alias("key")), F.struct(F.lit(1).alias("turn"), local.alias("key")))
    given = F.when(F.col("_k.turn") == 0, F.col("_stored")).otherwise(F.col("_listed"))
    found = (
        wanted.select("_stored", F.explode(tries).alias("_k"))
        .join(known, "_k")
        .groupBy("_stored")
        .agg(F.min(F.struct("_k.turn", given.alias("p")))["p"].alias("found_path"))
    )
    return matches.join(found, matches[path] == F.col("_stored"), "left").drop("_stored")
