"""Repeated byte strings across all documents by prefix doubling.

Every start of a string has a rank that stands for the string's first 2, 4, 8, ... bytes: the pair of ranks
at a start and one length further on gives the rank of twice the length. Ranks are 64-bit names made from
the pair, so the short lengths are doubled inside a document's own task; a length that needs other
documents is ranked by Spark, which sorts the names of all documents together.

Sorting every start at every length would move each byte of the corpus many times over. Two facts spare
that without losing a start. First, of the 69 32-byte strings inside a 100-byte string, take the one with
the smallest name (the leftmost of equals): equal 100-byte strings take it at the same place. So a start's
fate hangs on its anchor, and only anchors, about one in 35, are sorted. An anchor whose 32-byte
name is unique settles all the starts it stands for. Second, starts of one anchor are neighbours: the
stretch of text they span has one name (again a pair of ranks), and anchors with equal stretches are equal
in all their starts. Only where the 32-byte name is shared but the stretch is not, at the edges of what
is repeated, are single starts ranked at length 100.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumirank.llm.common import map_batches, ready
from lumirank.plans.scratch import release, scratch_table

LENGTH = 100  # bytes of a string that counts as repeated
ANCHOR = 32  # bytes of an anchor's string, a power of two below LENGTH
BLOCK_STARTS = 1 << 16  # starts worked on at a time
CROWD = 20_000  # anchors of one name from which on their starts are dealt out one by one
LOCAL_ANCHORS = 300_000  # anchors a task compares with each other before it passes them on

_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
#: Names of single bytes.
_BYTES = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def pair_rank(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The name of a pair of ranks."""
    x = first * _K1
    x += second ^ (second >> np.uint64(29))
    x *= _K2
    x ^= x >> np.uint64(32)
    return x


def ranks(text: np.ndarray, length: int) -> np.ndarray:
    """The rank of the `length` bytes at every start, by doubling; `length` need not be a power of two."""
    rank, done = _BYTES[text], 1
    while done < length:
        step = min(done, length - done)
        rank = pair_rank(rank[:-step], rank[step:])
        done += step
    return rank


def anchors_of(rank: np.ndarray, width: int) -> np.ndarray:
    """For every window of `width` ranks, the place of its smallest, the leftmost of equals."""
    least, place, done = rank, np.arange(len(rank)), 1
    while done < width:
        step = min(done, width - done)
        right = least[step:] < least[:-step]
        place = np.where(right, place[step:], place[:-step])
        least = np.minimum(least[step:], least[:-step])
        done += step
    return place


def stretches(text: bytes) -> Iterator[tuple[np.ndarray, ...]]:
    """Anchors of a document: names of anchor and stretch, first start, and shape.

    The shape is 128 times the way from the first start to the anchor plus the way to the last start.

    Works through blocks of starts, so a document of any length needs little memory. An anchor that
    stands for starts of two blocks appears once for each.
    """
    raw = np.frombuffer(text, np.uint8)
    width = LENGTH - ANCHOR + 1
    for begin in range(0, len(raw) - LENGTH + 1, BLOCK_STARTS):
        block = raw[begin : begin + BLOCK_STARTS + LENGTH - 1]
        short = ranks(block, ANCHOR)
        place = anchors_of(short, width)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        last = np.append(first[1:], len(place)) - 1
        twice = pair_rank(short[:-ANCHOR], short[ANCHOR:])
        step = LENGTH - 2 * ANCHOR
        whole = pair_rank(twice[:-step], twice[step:])
        at = place[first]
        shape = (at - first) * 128 + (last - first)
        yield short[at], pair_rank(pair_rank(whole[first], whole[last]), shape.astype(np.uint64) * _K3), first + begin, shape


#: `place` holds the first start, the shape and whether the anchor is settled: (start * 2**14 + shape) * 2 + settled.
_ANCHORS = T.StructType([T.StructField(n, T.LongType()) for n in ("name", "stretch", "doc", "tie", "place")])


def _anchors(batches: Iterator[dict]) -> Iterator[dict]:
    """Anchors of a task's documents; a stretch that occurs again inside the task is settled here."""
    held: list[np.ndarray] = []
    size = 0

    def settle() -> dict:
        name, stretch, doc, tie, place, known = a = np.concatenate(held, axis=1)
        # By name and stretch, then in document order: all but the first of equals repeat something earlier.
        order = np.lexsort((place, tie, doc, known, stretch, name))
        name, stretch, doc, tie, place, known = a = a[:, order]
        same = np.zeros(len(name), bool)
        # Rows of one repeated row are one place: they stay together.
        same[1:] = (a[:2, 1:] == a[:2, :-1]).all(0) & ~(a[2:, 1:] == a[2:, :-1]).all(0)
        spread = np.where(same, stretch ^ doc ^ (place << 20), name)
        return {"name": pa.array(spread), "stretch": pa.array(stretch), "doc": pa.array(doc, mask=known == 0), "tie": pa.array(tie), "place": pa.array(place + same)}

    for b in batches:
        for doc, tie, text in zip(b["doc"].to_pylist(), b["tie"].to_pylist(), b["text"]):
            for name, stretch, start, shape in stretches(text.as_buffer().to_pybytes()):
                row = np.empty((6, len(name)), np.int64)
                row[0], row[1], row[4] = name.view(np.int64), stretch.view(np.int64), (start << 14 | shape) << 1
                row[2], row[3], row[5] = doc or 0, tie, doc is not None
                held.append(row)
                size += len(name)
            if size >= LOCAL_ANCHORS:
                yield settle()
                held, size = [], 0
    if held:
        yield settle()


_STARTS = T.StructType(
    [
        T.StructField("name", T.LongType()),
        T.StructField("crowd", T.BooleanType()),
        T.StructField("doc", T.LongType()),
        T.StructField("tie", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("lead", T.LongType()),
        T.StructField("ranks", T.ArrayType(T.LongType(), False)),
    ]
)


def _ranked_starts(batches: Iterator[dict]) -> Iterator[dict]:
    """Anchors that are asked for, with the ranks at full length of all their starts."""
    for b in batches:
        for at in range(0, len(b["text"]), 64):
            out: dict[str, list] = {n: [] for n in _STARTS.names}
            part = {c: a.slice(at, 64) for c, a in b.items()}
            for doc, tie, text, asked in zip(part["doc"].to_pylist(), part["tie"].to_pylist(), part["text"], part["asked"].to_pylist()):
                raw = np.frombuffer(text.as_buffer().to_pybytes(), np.uint8)
                spans = [(a["place"] >> 15, (a["place"] >> 15) + (a["place"] >> 1 & 127) + 1) for a in asked]
                made: dict[int, tuple[int, np.ndarray]] = {}
                for begin, end in _joined(spans):
                    for to in range(begin, end, BLOCK_STARTS):
                        made[to] = (to, ranks(raw[to : min(end, to + BLOCK_STARTS) + LENGTH - 1], LENGTH).view(np.int64))
                firsts = sorted(made)
                for a, (begin, end) in zip(asked, spans):
                    found = []
                    while begin < end:
                        to, values = made[firsts[bisect_right(firsts, begin) - 1]]
                        found.append(values[begin - to : end - to])
                        begin += len(found[-1])
                    for n, v in zip(_STARTS.names, (a["name"], a["crowd"], doc, tie, a["place"] >> 15, a["place"] >> 8 & 127, np.concatenate(found))):
                        out[n].append(v)
            yield out


def _joined(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Overlapping and touching spans as one."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


_CUT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("n_spans", T.LongType()),
        T.StructField("kept", T.BinaryType()),
    ]
)


def _cut(batches: Iterator[dict]) -> Iterator[dict]:
    for b in batches:
        for at in range(0, len(b["text"]), 64):
            part = {c: a.slice(at, 64) for c, a in b.items()}
            out: dict[str, list] = {k: [] for k in _CUT.names}
            for doc, text, again, found in zip(part["doc"].to_pylist(), part["text"], part["again"].to_pylist(), part["found"].to_pylist()):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                spans = [(f >> 15, (f >> 15) + (f >> 1 & 127) + LENGTH) for f in found or []]
                if again and len(raw) >= LENGTH:
                    spans = [(0, len(raw))]
                spans = _joined(spans)
                edges = [0, *(x for s in spans for x in s), len(raw)]
                out["doc_id"].append(doc)
                out["n_bytes"].append(len(raw))
                out["n_removed"].append(sum(e - s for s, e in spans))
                out["n_spans"].append(len(spans))
                out["kept"].append(b"".join(raw[s:e] for s, e in zip(edges[::2], edges[1::2])))
            yield out


def _with(docs: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    named = lists.withColumnsRenamed({"doc": "_doc", "tie": "_tie"})
    return docs.join(named, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("tie") == F.col("_tie")), how).drop("_doc", "_tie")


def drop_repeated_strings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Remove every byte covered by a 100-byte string that also starts earlier.

    Earlier is a smaller doc_id, or an earlier start in the same document; null ids come first. Matches do
    not cross documents, may overlap themselves, and are judged on the input. Columns: doc_id, n_bytes,
    n_removed, n_spans (maximal removed runs) and kept (the other bytes, binary). A null text is empty;
    texts below 100 bytes stay whole. Rows that repeat an id with another text are ordered by a hash of the
    text; of rows equal in id and text one is the first, and the others repeat it whole. Other columns are
    ignored; an empty table gives no rows.
    """
    ready(docs.sparkSession)
    plain = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).cast("binary").alias("text"))
    # Where ids are unique, which a look at that column alone tells, they name documents by themselves.
    clash = plain.groupBy("doc").count().where((F.col("count") > 1) | F.col("doc").isNull()).limit(1).count()
    tie: Column = F.coalesce(F.xxhash64("text"), F.lit(0)).cast("long") if clash else F.lit(0).cast("long")
    plain = plain.withColumn("tie", tie)

    found = map_batches(plain.where(F.octet_length("text") >= LENGTH), _anchors, _ANCHORS)
    by_name = W.partitionBy("name")
    order = [F.col("doc").asc_nulls_first(), "tie", "place"]
    # One exchange serves all of this, and what is written is only what is asked for: where anchors that repeat
    # something lie, which is most of them, and besides the names of those whose starts are to be ranked.
    shared = (
        found.withColumn("members", F.count(F.lit(1)).over(by_name))
        .withColumn("settled", F.col("place") % 2 == 1)
        .where("members > 1 OR settled")
        .withColumn("edge", F.min("stretch").over(by_name) != F.max("stretch").over(by_name))
        .withColumn("repeats", F.col("settled") | (F.rank().over(W.partitionBy("name", "stretch").orderBy(*order)) > 1))
        .where("repeats OR edge")
        .select("doc", "tie", "place", *[F.when(~F.col("repeats"), c).alias(n) for n, c in (("name", F.col("name")), ("crowd", F.col("members") > CROWD))])
    )
    shared = scratch_table(shared, "anchors", drop_shuffles=True)
    repeated = shared.where("name IS NULL").select("doc", "tie", "place")

    # One list for each document, of as many anchors as it has bytes at most.
    edges = shared.where("name IS NOT NULL").groupBy("doc", "tie").agg(F.collect_set(F.struct("name", "crowd", "place")).alias("asked"))
    ranked = map_batches(_with(plain, edges, "inner").select("doc", "tie", "text", "asked"), _ranked_starts, _STARTS)
    ranked = scratch_table(ranked, "starts", drop_shuffles=True)
    crowds = shared.where("crowd").limit(1).count() > 0

    def singles(anchors: DataFrame) -> DataFrame:
        """Starts of which an equal one comes earlier; equal starts have one name and one way to their anchor."""
        each = anchors.select("name", "doc", "tie", "start", "lead", F.posexplode("ranks").alias("i", "rank"))
        each = each.select("name", "doc", "tie", "rank", (F.col("lead") - F.col("i")).alias("way"), (F.col("start") + F.col("i")).alias("at"))
        turn = F.rank().over(W.partitionBy("name", "way", "rank").orderBy(F.col("doc").asc_nulls_first(), "tie", "at"))
        return each.withColumn("turn", turn).where("turn > 1").select("doc", "tie", F.shiftleft("at", 15).alias("place"))

    # Anchors of one name meet in one task before their starts are told apart; those of a crowd are told apart first.
    single = singles(ranked.where("NOT crowd").repartition("name"))
    if crowds:
        single = single.unionByName(singles(ranked.where("crowd")))
    spans = repeated.unionByName(single).groupBy("doc", "tie").agg(F.collect_set("place").alias("found"))
    spans = scratch_table(spans, "spans", drop_shuffles=True)
    release(shared)
    release(ranked)

    again = F.row_number().over(W.partitionBy("doc", "tie").orderBy(F.lit(1))) > 1 if clash else F.lit(False)
    listed = _with(plain, spans, "left").withColumn("again", again)
    return map_batches(listed.select("doc", "text", "again", "found"), _cut, _CUT)


def repeated_report(docs: DataFrame) -> DataFrame:
    """Per document: bytes, removed bytes, removed runs and the digest of what is left."""
    cut = drop_repeated_strings(docs)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
