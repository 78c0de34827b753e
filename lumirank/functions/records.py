"""Record ids, metadata and match texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed formats: the stored preprocess time, and the text of a match.
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"
ISO_TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
MATCH_FORMAT = "Original query: %s\n Displayed `%s` (score: %.4f)"


def record_id(path: Column) -> Column:
    """Last component of a path; empty if the path ends in a slash."""
    return F.regexp_extract(path, r"([^/]*)$", 1)


def record_metadata(path: Column, time: Column, iso: bool = False) -> Column:
    """struct(image_path, preprocess_time) with the time as text to the microsecond."""
    return F.struct(
        path.alias("image_path"),
        F.date_format(time, ISO_TIME_FORMAT if iso else TIME_FORMAT).alias("preprocess_time"),
    )


def resolve_path(metadata: Column, id_: Column) -> Column:
    """The stored image path, or the id where none was stored."""
    return F.coalesce(metadata["image_path"], id_)


def format_match(query: Column, path: Column, score: Column) -> Column:
    """One-line text of a match with its score to four decimals."""
    return F.format_string(MATCH_FORMAT, query, path, score)
