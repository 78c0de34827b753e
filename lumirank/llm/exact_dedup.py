"""Exact duplicates through a sharded cuckoo filter over the digests that are alive.

Every shard keeps a filter of short fingerprints and, beside it, the full keys of each of its buckets
with what is known of them: the row that stays and the size of the group. A digest is looked for in the
filter; a hit counts only once the bucket's full key is the same, so a clash of fingerprints never joins
two texts. When a copy arrives, what stands with the key is replaced. A filter that overflows is built
again, twice as large, from the keys. The buckets are the only store: results are read out of them.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumirank.llm.common import ascii_lower, map_batches, ready, with_key
from lumirank.plans.scratch import scratch_table

SLOTS = 4  # entries per bucket
KICKS = 200  # moves tried before the filter counts as full
LOCAL_KEYS = 200_000  # digests a task aggregates before it passes them on


class CuckooIndex:
    """Fingerprints of live keys in two possible buckets each, with the full keys and their values stored per bucket."""

    def __init__(self, buckets: int = 1024):
        self.resized = 0
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.prints: list[list[int]] = [[] for _ in range(buckets)]
        self.keys: list[list[bytes]] = [[] for _ in range(buckets)]
        self.values: list[list[tuple | None]] = [[] for _ in range(buckets)]
        self.size = 0

    @staticmethod
    def _print_of(key: bytes) -> int:
        return int.from_bytes(key[:2], "little") or 1

    def _places(self, key: bytes) -> tuple[int, int, int]:
        mark = self._print_of(key)
        one = int.from_bytes(key[2:10], "little") & self.mask
        return mark, one, self._other(one, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & self.mask

    def find(self, key: bytes) -> tuple[int, int] | None:
        """Bucket and slot of a key that is alive: the fingerprint is tried first, the stored key decides."""
        mark, one, two = self._places(key)
        for b in (one, two):
            if mark in self.prints[b] and key in self.keys[b]:
                return b, self.keys[b].index(key)
        return None

    def __contains__(self, key: bytes) -> bool:
        return self.find(key) is not None

    def value(self, at: tuple[int, int]) -> tuple | None:
        return self.values[at[0]][at[1]]

    def replace(self, at: tuple[int, int], value: tuple) -> None:
        self.values[at[0]][at[1]] = value

    def items(self) -> Iterator[tuple[bytes, tuple | None]]:
        """Every key that is alive, with its value."""
        for keys, values in zip(self.keys, self.values):
            yield from zip(keys, values)

    def _append(self, b: int, mark: int, key: bytes, value: tuple | None) -> bool:
        if len(self.prints[b]) == SLOTS:
            return False
        self.prints[b].append(mark)
        self.keys[b].append(key)
        self.values[b].append(value)
        return True

    def insert(self, key: bytes, value: tuple | None = None) -> None:
        """Add a key that is not in the index."""
        self.size += 1
        mark, one, two = self._places(key)
        if self._append(one, mark, key, value) or self._append(two, mark, key, value):
            return
        at = two
        for turn in range(KICKS):
            slot = turn % SLOTS
            mark, self.prints[at][slot] = self.prints[at][slot], mark
            key, self.keys[at][slot] = self.keys[at][slot], key
            value, self.values[at][slot] = self.values[at][slot], value
            at = self._other(at, mark)
            if self._append(at, mark, key, value):
                return
        self._grow(key, value)

    def _grow(self, *left_over) -> None:
        stored = [*self.items(), left_over]
        self.resized += 1
        self._clear(2 * (self.mask + 1))
        for key, value in stored:
            self.insert(key, value)

    def delete(self, key: bytes) -> bool:
        """Remove a key; False if it is not alive."""
        at = self.find(key)
        if at is None:
            return False
        b, slot = at
        del self.prints[b][slot], self.keys[b][slot], self.values[b][slot]
        self.size -= 1
        return True


_LIVE = T.StructType(
    [
        T.StructField("digest", T.BinaryType()),
        T.StructField("keep_id", T.LongType()),
        T.StructField("keep_row", T.LongType()),
        T.StructField("group_size", T.LongType()),
    ]
)


def _rank(doc_id: int | None, row: int) -> tuple:
    return (doc_id is not None, doc_id or 0, row)


def _batch(found: dict[bytes, tuple]) -> dict:
    return {
        "digest": pa.array(list(found), pa.binary()),
        "keep_id": pa.array([v[0] for v in found.values()], pa.int64()),
        "keep_row": pa.array([v[1] for v in found.values()], pa.int64()),
        "group_size": pa.array([v[2] for v in found.values()], pa.int64()),
    }


def _rows(b: dict) -> Iterator[tuple]:
    return zip(*[b[f.name].to_pylist() for f in _LIVE.fields])


def _combine_locally(batches: Iterator[dict]) -> Iterator[dict]:
    """One row per digest and run of rows: a hot group leaves each task as a few rows."""
    found: dict[bytes, tuple] = {}
    for b in batches:
        for key, doc_id, row, n in _rows(b):
            old = found.get(key)
            if old is None:
                found[key] = (doc_id, row, n)
            elif _rank(doc_id, row) > _rank(*old[:2]):
                found[key] = (doc_id, row, n + old[2])
            else:
                found[key] = (*old[:2], n + old[2])
        if len(found) > LOCAL_KEYS:
            yield _batch(found)
            found = {}
    if found:
        yield _batch(found)


def _index_shard(batches: Iterator[dict]) -> Iterator[dict]:
    """Run the arrivals of a shard through its index; what lives at the end is the result."""
    index = CuckooIndex()
    for b in batches:
        for key, doc_id, row, n in _rows(b):
            if n < 0:  # a digest that is taken out
                index.delete(key)
                continue
            at = index.find(key)
            if at is None:
                index.insert(key, (doc_id, row, n))
                continue
            old = index.value(at)
            n += old[2]
            index.replace(at, (*old[:2], n) if _rank(doc_id, row) < _rank(*old[:2]) else (doc_id, row, n))
    alive = index.items()
    while part := dict(itertools.islice(alive, 50_000)):
        yield _batch(part)


def live_digests(arrivals: DataFrame, shards: int | None = None) -> DataFrame:
    """Digests alive after all arrivals: (digest, keep_id, keep_row, group_size).

    `arrivals` has those columns; a negative group_size deletes the digest. Inserts commute, so their
    order does not matter; a deletion must be the only row of its digest in one call, since arrivals of
    a shard come in no order. Rows of earlier calls may be passed in again as arrivals, which is how an
    index is kept over time. Give `shards` so that a shard's digests (about 300 bytes each) fit a task.
    """
    local = map_batches(arrivals.select(*_LIVE.names), _combine_locally, _LIVE)
    keyed = local.repartition(shards, "digest") if shards else local.repartition("digest")
    return map_batches(keyed, _index_shard, _LIVE)


SHARD_KEYS = 1_000_000  # documents per shard


def _shards(spark: SparkSession, rows: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // SHARD_KEYS)


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Which row of each group of equal texts stays: one row per document, dropped ones too.

    Texts are equal when they are identical after A-Z are lower-cased. The row with the largest id stays;
    null ids rank below all others, and of rows repeated with the same id exactly one stays. A null text
    counts as empty. Columns: doc_id, keep_id, group_size, kept, text_sha256; other columns are ignored.
    An empty table gives no rows. Equality is that of the SHA-256 digests of the whole texts.
    """
    spark = ready(docs.sparkSession)
    normal = ascii_lower(F.coalesce(F.col(text), F.lit(""))).cast("binary")
    digests = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.unhex(F.sha2(normal, 256)).alias("digest"))
    # Written once: the text is read once, and a row's number stays the same when tasks run again.
    rows = scratch_table(digests.withColumn("row", F.monotonically_increasing_id()), "digests")
    live = live_digests(
        rows.select("digest", F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"), F.lit(1).cast("long").alias("group_size")),
        _shards(spark, rows.count()),
    )
    return rows.join(live, "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "row",
    ).drop("row")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns; see `exact_groups` for the rule."""
    rows, key = with_key(docs)
    normal = ascii_lower(F.coalesce(F.col("text"), F.lit(""))).cast("binary")
    arrivals = rows.select(
        F.unhex(F.sha2(normal, 256)).alias("digest"),
        F.col("doc_id").cast("long").alias("keep_id"),
        F.col(key).alias("keep_row"),
        F.lit(1).cast("long").alias("group_size"),
    )
    keep = live_digests(arrivals, _shards(docs.sparkSession, rows.count())).select(F.col("keep_row").alias(key))
    return rows.join(keep, key, "left_semi").select(*docs.columns)
