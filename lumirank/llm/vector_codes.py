"""Vectors as short codes: product quantisation in whole numbers.

Components become integers, vectors are cut into parts, and every part is named by the nearest entry of its
codebook. Codebooks are fitted by rounds of assigning all parts and taking floors of means.

Nearest entries are found after a Walsh-Hadamard transform, in integers throughout. Parts and entries are padded with
zeros to P components, a power of two; the transform H keeps distances up to the factor P, as
|Hx - He|^2 = P |x - e|^2. Squared differences are added up coefficient by coefficient in the order of sequency
(number of sign changes), where smooth vectors have most of their weight in front. A partial sum is a lower bound,
so an entry whose partial sum exceeds the whole sum of another is out; equal sums stay, and the lowest index wins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumirank.llm.common import map_batches, ready
from lumirank.plans.scratch import scratch_table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows whose distances to all entries are held at once.
TILE_ROWS = 2048
#: Share of pairs still open below which they are listed one by one.
FEW = 0.2


def sequency_order(size: int) -> np.ndarray:
    """Rows of the natural Hadamard matrix by their number of sign changes: bit-reversed Gray codes."""
    bits = size.bit_length() - 1
    gray = np.arange(size) ^ (np.arange(size) >> 1)
    return sum((((gray >> b) & 1) << (bits - 1 - b) for b in range(bits)), np.zeros(size, np.int64))


def transformed(values: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row, zero-padded to a power of two, in sequency order."""
    n, width = values.shape
    size = 1 << max(0, width - 1).bit_length()
    x = np.zeros((n, size), values.dtype)
    x[:, :width] = values
    half = 1
    while half < size:
        pairs = x.reshape(n, -1, 2, half)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, size)
        half *= 2
    return x[:, sequency_order(size)]


def _number(most: int, size: int) -> type:
    """The integer type that holds every sum of squared differences of components up to `most`."""
    bound = (2 * most * size) ** 2
    if bound >= 1 << 62:
        raise ValueError(f"components of {most} in whole numbers are too large for 64-bit distances")
    return np.int32 if bound < 1 << 31 else np.int64


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of, and squared distance to, the nearest entry of every row; both are integers of one width."""
    if not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    size = 1 << max(0, x.shape[1] - 1).bit_length()
    kind = _number(most, size)
    books = transformed(entries.astype(kind))
    index, distance = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    for at in range(0, len(x), TILE_ROWS):
        tile = slice(at, at + TILE_ROWS)
        index[tile], scaled = _nearest(transformed(x[tile].astype(kind)), books)
        distance[tile] = scaled // size
    return index, distance


def _nearest(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n, size = x.shape
    looks = {max(1, size // 8), max(1, size // 4), size // 2, 3 * size // 4}
    sums = np.zeros((n, len(books)), x.dtype)
    bound = np.full(n, np.iinfo(x.dtype).max, x.dtype)
    rows = np.arange(n)
    for at in range(size):
        step = x[:, at, None] - books[None, :, at]
        sums += step * step
        if at + 1 in looks:
            # The entry ahead so far gives a whole sum nobody may exceed.
            ahead = sums.argmin(axis=1)
            whole = x - books[ahead]
            bound = np.minimum(bound, (whole * whole).sum(axis=1, dtype=x.dtype))
            alive = sums <= bound[:, None]
            if alive.mean() < FEW:
                return _finish(x, books, sums, bound, alive, at + 1)
    index = sums.argmin(axis=1)
    return index, sums[rows, index]


def _finish(x, books, sums, bound, alive, at: int) -> tuple[np.ndarray, np.ndarray]:
    """The coefficients from `at` on, for the pairs that are still open."""
    row, entry = np.nonzero(alive)
    total = sums[row, entry]
    for c in range(at, x.shape[1]):
        step = x[row, c] - books[entry, c]
        total = total + step * step
        stay = total <= bound[row]
        row, entry, total = row[stay], entry[stay], total[stay]
    # The entry that gave the bound stays, so every row has one; of equal sums the first has the lowest index.
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    least = np.minimum.reduceat(total, first)
    hit = np.flatnonzero(total == np.repeat(least, np.diff(np.append(first, len(row)))))
    winner = hit[np.unique(row[hit], return_index=True)[1]]
    return entry[winner], total[winner]


@dataclass
class Codebooks:
    """Integer entries (parts, entries, width) for vectors of `dim` components, times `scale` and floored."""

    entries: np.ndarray
    dim: int
    scale: int = SCALE

    def sha256(self) -> str:
        """Digest of all components in decimal, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def assign(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry indexes (rows, parts) and squared distances summed over the parts."""
        index = np.empty((len(values), len(self.entries)), np.int64)
        error = np.zeros(len(values), np.int64)
        for p, (own, book) in enumerate(zip(np.split(values, len(self.entries), axis=1), self.entries)):
            index[:, p], distance = nearest(own, book)
            error += distance
        return index, error


def _integers(vectors: pa.Array, width: int, scale: int) -> np.ndarray:
    """Floors of `scale` times the components; shorter vectors end in zeros."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    if len(flat) and np.abs(flat).max() >= 1 << 31:
        raise ValueError("components are too large for 64-bit distances")
    flat = flat.astype(np.int64)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(vectors), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _kept(rows: DataFrame, vec: str) -> DataFrame:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return rows.where(F.col(vec).isNotNull() & ~F.exists(F.col(vec).cast("array<double>"), bad))


_SUM = T.StructType([T.StructField(n, T.LongType()) for n in ("part", "entry", "at", "total", "members")])


def fit_codebooks(
    rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES,
    rounds: int = ROUNDS, scale: int = SCALE,
) -> Codebooks:
    """Codebooks from all rows: `rounds` times assign every part, then replace each entry by the floor of its mean.

    They start as the parts of the `entries` smallest ids; an entry nobody is nearest to stays. Each round
    is one scan: tasks add up integers per entry and position, Spark adds those up, and the driver sees
    parts * entries * width sums, whatever the number of rows.
    """
    kept = _kept(rows, vec_col).select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
    dim = kept.agg(F.max(F.size("v"))).first()[0] or 0
    width = -(-dim // parts)
    seeds = kept.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").toArrow()["v"].combine_chunks()
    values = _integers(seeds, parts * width, scale) if len(seeds) else np.zeros((0, parts * width), np.int64)
    books = Codebooks(values.reshape(len(values), parts, width).transpose(1, 0, 2).copy(), dim, scale)
    if not books.entries.size:
        return books
    for _ in range(rounds):
        books = _round(kept, books)
    return books


def _round(kept: DataFrame, books: Codebooks) -> Codebooks:
    parts, entries, width = books.entries.shape

    def add_up(batches: Iterator[dict]) -> Iterator[dict]:
        total = np.zeros(books.entries.shape, np.int64)
        members = np.zeros((parts, entries), np.int64)
        for b in batches:
            values = _integers(b["v"], parts * width, books.scale)
            index, _ = books.assign(values)
            for p, own in enumerate(np.split(values, parts, axis=1)):
                np.add.at(total[p], index[:, p], own)
                members[p] += np.bincount(index[:, p], minlength=entries)
        part, entry = np.nonzero(members)
        every = np.arange(width)
        yield {
            "part": np.repeat(part, width),
            "entry": np.repeat(entry, width),
            "at": np.tile(every, len(part)),
            "total": total[part, entry].ravel(),
            "members": np.repeat(members[part, entry], width),
        }

    sums = map_batches(kept.select("v"), add_up, _SUM).groupBy("part", "entry", "at")
    found = sums.agg(F.sum("total").alias("total"), F.sum("members").alias("members")).toArrow()
    part, entry, at, total, members = (found[c].to_numpy() for c in _SUM.fieldNames())
    new = books.entries.copy()
    new[part, entry, at] = total // members
    return Codebooks(new, books.dim, books.scale)


def encode_vectors(rows: DataFrame, books: Codebooks, vec_col: str = "embedding", carry: tuple[str | Column, ...] = ()) -> DataFrame:
    """The `carry` columns of every row whose vector can be encoded, `code` (one byte a part) and `error`."""
    frame = _kept(rows, vec_col).select(*carry, F.col(vec_col).alias("_vector"))
    carried = [f for f in frame.schema.fields if f.name != "_vector"]
    schema = T.StructType([*carried, T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())])
    parts, entries, width = books.entries.shape
    if entries > 256:
        raise ValueError("a byte a part tells 256 entries apart")
    if not books.entries.size:
        # Without a component all vectors are one and nothing is lost; without rows there is none.
        return frame.select(*[f.name for f in carried], F.lit(bytes(parts)).alias("code"), F.lit(0).cast("long").alias("error"))

    def encode(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            index, error = books.assign(_integers(b["_vector"], parts * width, books.scale))
            flat = index.astype(np.uint8).tobytes()
            codes = pa.FixedSizeBinaryArray.from_buffers(pa.binary(parts), len(error), [None, pa.py_buffer(flat)]).cast(pa.binary())
            yield {**{f.name: b[f.name] for f in carried}, "code": codes, "error": error}

    return map_batches(frame, encode, schema)


def vector_code_report(rows: DataFrame, **options) -> DataFrame:
    """Per kept row: vec_id, code, error, label_error, codebooks_sha256.

    Rows whose vector is null or holds a null or a component that is not finite are left out. Vectors shorter than the
    longest kept one, and parts that do not come out even, end in zeros. Null ids rank after all
    others, equal ids by their vectors; repeated rows count each. Errors of one label, nulls being one too, are
    added up. Other columns are ignored; an empty table gives no rows. Components of 2^21 or more in size, whose
    distances do not fit 64 bits, are an error.
    """
    ready(rows.sparkSession)
    books = fit_codebooks(rows, **options)
    coded = scratch_table(encode_vectors(rows, books, carry=("vec_id", "label")), "codes")
    totals = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(totals, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256")
    )
