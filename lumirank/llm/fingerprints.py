"""Fingerprints of documents from closed syncmers, and how alike two fingerprints are.

A k-mer, here K letters in a row, is an anchor if of the S-letter substrings in it the one with the smallest hash is
its first or its last. That depends on the k-mer alone: anchors inside a passage are the same wherever the passage
stands, and any K - S + 1 k-mers in a row hold at least one. A text is read with K - 1 marks in front, so it has as many
k-mers as letters and short texts have anchors too; a text without one is an anchor as a whole.

A fingerprint lists all anchors in order, six letters of base 64 each: five for 30 bits of the anchor's hash, one for the
distance to the anchor before. Two fingerprints are compared by position: equal anchors are paired in the
order in which they occur, and the longest chain of pairs that goes forward in both counts, as twice its length over
the number of anchors of both.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumirank.llm.common import map_batches, ready

K, S = 24, 6
WINDOW = K - S + 1
HASH_BITS = 30
#: Letters and documents worked on at a time; a longer text is one piece.
PIECE_LETTERS, PIECE_DOCS = 1 << 18, 256

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: Digits of the fingerprints, in their order. Fixed value.
DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"
_DIGIT = np.frombuffer(DIGITS.encode(), np.uint8)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M2
    return x ^ (x >> np.uint64(29))


def _letters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _powers(n: int) -> np.ndarray:
    return np.array([pow(int(_M1), n - i, 1 << 64) for i in range(n)], np.uint64)


_K_POWERS, _S_POWERS = _powers(K), _powers(S)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each `width` numbers in a row."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[:-step], x[step:])
        done += step
    return x


def syncmers(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes (HASH_BITS bits) of the closed syncmers of a series of letters, marks included."""
    if len(letters) < K:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    letters = letters.astype(np.uint64) + np.uint64(1)
    inner = np.zeros(len(letters) - S + 1, np.uint64)
    for i, power in enumerate(_S_POWERS):
        inner += letters[i : i + len(inner)] * power
    inner = _mixed(inner)
    # All but the last of a window, then all; of equal ones the first is the smallest.
    most = _least(inner, WINDOW - 1)[: len(letters) - K + 1]
    last = inner[WINDOW - 1 :]
    starts = np.flatnonzero((inner[: len(last)] == np.minimum(most, last)) | (last < most))
    hashes = np.zeros(len(starts), np.uint64)
    for i, power in enumerate(_K_POWERS):
        hashes += letters[starts + i] * power
    return starts, (_mixed(hashes) >> np.uint64(64 - HASH_BITS)).astype(np.int64)


class Anchors:
    """Anchors of one text: `ends`, the number of letters up to the end of each, and `hashes`."""

    def __init__(self, ends: np.ndarray, hashes: np.ndarray):
        self.ends, self.hashes = ends, hashes

    def fingerprint(self) -> str:
        gaps = np.diff(self.ends, prepend=0)
        # Only the anchor of a text that has no other lies further from the one before than 63 letters.
        gaps = np.minimum(gaps, 63)
        digits = np.stack([*((self.hashes >> shift) & 63 for shift in (24, 18, 12, 6, 0)), gaps], axis=1)
        return _DIGIT[digits].tobytes().decode()


def _whole(text: str) -> Anchors:
    """The anchor of a text that has no syncmer; none for an empty one."""
    if not text:
        return Anchors(np.zeros(0, np.int64), np.zeros(0, np.int64))
    digest = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest()
    return Anchors(np.array([len(text)]), np.array([int.from_bytes(digest, "little") >> (64 - HASH_BITS)]))


def _many(pieces: list[np.ndarray]) -> list[Anchors]:
    """Syncmers of several series of letters, each with its marks, found in one go."""
    sizes = np.array([len(p) for p in pieces])
    starts, hashes = syncmers(np.concatenate(pieces))
    begins = np.cumsum(sizes) - sizes
    # A k-mer belongs to a series if it ends there too.
    lows = np.searchsorted(starts, begins)
    highs = np.maximum(lows, np.searchsorted(starts, begins + sizes - K, "right"))
    return [Anchors(starts[a:b] - begin + 1, hashes[a:b]) for a, b, begin in zip(lows, highs, begins)]


_MARKS = np.zeros(K - 1, np.uint32)


def found_anchors(texts: list[str]) -> list[Anchors]:
    """Syncmers of each text, without the anchor of texts that have none."""
    out: list[Anchors] = []
    held: list[np.ndarray] = []
    size = 0
    for text in texts:
        letters = np.concatenate([_MARKS, _letters(text)])
        if held and size + len(letters) > PIECE_LETTERS:
            out += _many(held)
            held, size = [], 0
        held.append(letters)
        size += len(letters)
    return out + _many(held) if held else out


def anchors(texts: list[str]) -> list[Anchors]:
    """Anchors of each text."""
    return [a if len(a.ends) else _whole(t) for a, t in zip(found_anchors(texts), texts)]


def likeness(a: Anchors, b: Anchors) -> float:
    """Twice the length of the longest common chain over the number of anchors; 1 for two empty fingerprints."""
    if not len(a.hashes) or not len(b.hashes):
        return float(len(a.hashes) == len(b.hashes))
    if len(a.hashes) == len(b.hashes) and (a.hashes == b.hashes).all():
        return 1.0
    shared = np.isin(b.hashes, a.hashes)
    if not shared.any():
        return 0.0
    places = defaultdict(list)
    for place, h in zip(np.flatnonzero(shared).tolist(), b.hashes[shared].tolist()):
        places[h].append(place)
    # The n-th of several equal anchors meets the n-th.
    tails: list[int] = []
    used: dict[int, int] = {}
    for h in a.hashes[np.isin(a.hashes, b.hashes)].tolist():
        nth = used.get(h, 0)
        used[h] = nth + 1
        if nth < len(places[h]):
            place = places[h][nth]
            at = bisect_left(tails, place)
            tails[at : at + 1] = [place]
    return 2 * len(tails) / (len(a.hashes) + len(b.hashes))


def edited_text(text: str, following: str) -> tuple[str, int, int]:
    """The text with its last half replaced by the first letters of the next, and how many letters are of each."""
    taken = following[: len(text) // 2]
    keep = len(text) - len(text) // 2
    return text[:keep] + taken, keep, len(taken)


def joined_anchors(first: list[tuple[str, Anchors]], second: list[tuple[str, Anchors]], kept: list[tuple[int, int]]) -> list[Anchors]:
    """Syncmers of texts put together from the beginnings of two each.

    The anchors of either part are known: they depend on nothing outside it. Only k-mers across the seam are looked at.
    """
    seams = []
    for (text, _), (following, _), (keep, taken) in zip(first, second, kept):
        left = _letters(text[max(0, keep - K + 1) : keep])
        seams.append(np.concatenate([_MARKS[: K - 1 - len(left)], left, _letters(following[: min(taken, K - 1)])]))
    out = []
    for (_, a), (_, b), (keep, taken), seam in zip(first, second, kept, _many(seams) if seams else []):
        left = np.searchsorted(a.ends, keep, "right")
        low, high = np.searchsorted(b.ends, K, "left"), np.searchsorted(b.ends, taken, "right")
        high = max(low, high)
        ends = np.concatenate([a.ends[:left], seam.ends + keep, b.ends[low:high] + keep])
        out.append(Anchors(ends, np.concatenate([a.hashes[:left], seam.hashes, b.hashes[low:high]])))
    return out


# ---------------------------------------------------------------- documents with their next


_LOWEST = -(1 << 63)
_REPORT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()),
        T.StructField("near_next", T.DoubleType()),
    ]
)


def _in_order(docs: DataFrame) -> DataFrame:
    """(part, border, doc_id, text): ranges of documents in order, each followed by the first one of the next range.

    The texts are moved once. The driver sees one id per range.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    place = F.coalesce("doc_id", F.lit(_LOWEST))
    ids = plain.select("doc_id", place.alias("place"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = ids.agg(F.percentile_approx("place", [i / ranges for i in range(1, ranges)] or [0.5], 10_000)).first()[0] or []
    bounds = np.unique(np.array(cuts, np.int64))

    @F.arrow_udf("int")
    def range_of(places: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(bounds, places.to_numpy(), "left").astype(np.int32))

    firsts = ids.groupBy(range_of("place").alias("part")).agg(F.min("place").alias("first")).orderBy("part").collect()
    # The first document of a range is also the next one of the last document of the range before.
    borders = {b["first"]: a["part"] for a, b in zip(firsts, [*firsts[1:], *firsts[:1]])}

    @F.arrow_udf("array<int>")
    def parts_of(places: pa.Array) -> pa.Array:
        values = places.to_numpy()
        own = np.searchsorted(bounds, values, "left").tolist()
        return pa.array([[p] if (more := borders.get(v)) is None else [p, more] for p, v in zip(own, values.tolist())], pa.list_(pa.int32()))

    dealt = plain.withColumn("place", place).select("doc_id", "place", "text", F.posexplode(parts_of("place")).alias("border", "part"))
    return dealt.repartition("part").sortWithinPartitions("part", "border", "place", F.col("doc_id").isNotNull(), "text").select("part", "border", "doc_id", "text")


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last half (rounded down) replaced by as many first letters of the next document, or all
    of them; documents follow each other by ascending id, and the first follows the last. Null ids come first, and equal ids go by
    their texts. A null text counts as empty; an empty text has an empty fingerprint, and two empty fingerprints are alike by 1. A
    single document follows itself. Other columns are ignored; an empty table gives no rows.
    """
    ready(docs.sparkSession)

    def report(batches: Iterator[dict]) -> Iterator[dict]:
        held: list[tuple] = []  # the last document, which still waits for its next
        for b in batches:
            for at in range(0, len(b["text"]), PIECE_DOCS):
                part = {c: a.slice(at, PIECE_DOCS) for c, a in b.items()}
                texts = part["text"].to_pylist()
                found = [a if len(a.ends) else _whole(t) for a, t in zip(found_anchors(texts), texts)]
                rows = held + list(zip(part["border"].to_pylist(), part["doc_id"].to_pylist(), texts, found))
                held = rows[-1:]
                yield _reported([(x, y) for x, y in zip(rows, rows[1:]) if not x[0]])

    return map_batches(_in_order(docs), report, _REPORT)


def _reported(pairs: list[tuple]) -> dict:
    made = [edited_text(x[2], y[2]) for x, y in pairs]
    first, second = [(x[2], x[3]) for x, _ in pairs], [(y[2], y[3]) for _, y in pairs]
    edited = [a if len(a.ends) else _whole(m[0]) for a, m in zip(joined_anchors(first, second, [m[1:] for m in made]), made)]
    return {
        "doc_id": [x[1] for x, _ in pairs],
        "n_chars": [len(x[2]) for x, _ in pairs],
        "edited_sha256": [hashlib.sha256(m[0].encode("utf-8", "surrogatepass")).hexdigest() for m in made],
        "fingerprint": [x[3].fingerprint() for x, _ in pairs],
        "edited_fingerprint": [e.fingerprint() for e in edited],
        "near_edited": [likeness(x[3], e) for (x, _), e in zip(pairs, edited)],
        "near_next": [likeness(x[3], y[3]) for x, y in pairs],
    }
