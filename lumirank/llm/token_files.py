"""Token ids in binary files with Elias-Fano document boundaries.

One file holds the ids of consecutive documents end to end. Where each document starts is a growing
series of numbers, kept as an Elias-Fano code: the low bits of every number side by side, the high bits
in unary, and the position of every 256th one bit, from which `select` finds a boundary without a table
of 64-bit offsets.

A file, all numbers little-endian unless said otherwise (fixed values):

    8   b"LUMIIDS1"
    8   number of ids, big-endian            8   number of documents, big-endian
    8   bytes per id: 2 or 4, big-endian
    8   bytes of the boundary code, big-endian
    ..  document ids, 8 bytes each; then one byte each, 1 where the id is null
    ..  boundary code
    ..  ids
    1   a line feed that Spark's text writer adds

Spark's text writer makes the files and its binaryFile source reads them, so they may live in any store
Spark reaches, and a lost executor only repeats its tasks.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumirank.llm.common import map_batches, ready, with_columns_from
from lumirank.plans.scratch import scratch_path

MAGIC = b"LUMIIDS1"
FILE_IDS = 16_000_000  # ids after which a task starts its next file
SAMPLE = 256  # one bits between two stored positions
CACHE_WORDS = 800_000
CACHED_WORD = 64
BATCH_ROWS = 4096  # texts worked on at a time, if their batch is not smaller

_HEAD = struct.Struct(">8sQQQQ")
_CODE = struct.Struct("<QQQ")


class EliasFano:
    """A non-decreasing series of whole numbers in about two bits plus log2(last / count) bits each."""

    def __init__(self, count: int, low_bits: int, high: np.ndarray, low: np.ndarray, samples: np.ndarray):
        self.count, self.low_bits, self.high, self.low, self.samples = count, low_bits, high, low, samples

    @classmethod
    def of(cls, values: np.ndarray) -> "EliasFano":
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        places = (values >> low_bits) + np.arange(n)
        bits = np.zeros((int(places[-1]) + 1) if n else 0, np.uint8)
        bits[places] = 1
        low = ((values[:, None] >> np.arange(low_bits)) & 1).astype(np.uint8)
        return cls(n, low_bits, np.packbits(bits, bitorder="little"), np.packbits(low.ravel(), bitorder="little"), places[::SAMPLE].astype("<u4" if n == 0 or places[-1] < 1 << 32 else "<u8"))

    def to_bytes(self) -> bytes:
        wide = self.samples.dtype.itemsize == 8
        head = _CODE.pack(self.count, self.low_bits | (256 if wide else 0), len(self.high))
        return head + self.samples.tobytes() + self.high.tobytes() + self.low.tobytes()

    @classmethod
    def from_bytes(cls, code: bytes) -> "EliasFano":
        count, kind, n_high = _CODE.unpack_from(code)
        kept = -(-count // SAMPLE)
        width = 8 if kind & 256 else 4
        at = _CODE.size + kept * width
        samples = np.frombuffer(code, f"<u{width}", kept, _CODE.size)
        return cls(count, kind & 255, np.frombuffer(code, np.uint8, n_high, at), np.frombuffer(code, np.uint8, offset=at + n_high), samples)

    def select(self, i: int) -> int:
        """Number i, found from the nearest stored position."""
        place = int(self.samples[i // SAMPLE])
        need = i % SAMPLE
        at = place // 8
        byte = int(self.high[at]) >> (place % 8) << (place % 8)
        while (ones := byte.bit_count()) <= need:
            need -= ones
            at += 1
            byte = int(self.high[at])
        for _ in range(need):
            byte &= byte - 1
        place = at * 8 + (byte & -byte).bit_length() - 1
        first = i * self.low_bits
        chunk = int.from_bytes(self.low[first // 8 : (first + self.low_bits + 7) // 8].tobytes(), "little")
        return (place - i) << self.low_bits | (chunk >> (first % 8)) & ((1 << self.low_bits) - 1)

    def all(self) -> np.ndarray:
        """Every number, in order."""
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.count]
        values = (places - np.arange(self.count)) << self.low_bits
        if self.low_bits and self.count:
            bits = np.unpackbits(self.low, bitorder="little")[: self.count * self.low_bits].reshape(self.count, -1)
            values = values | bits.astype(np.int64) @ (np.int64(1) << np.arange(self.low_bits))
        return values


def pack_file(doc_ids: list, lengths: list[int], ids: bytes, width: int) -> bytes:
    """A file's bytes: `lengths` ids per document, `ids` end to end, `width` bytes each."""
    bounds = np.concatenate([[0], np.cumsum(np.array(lengths, np.int64))])
    code = EliasFano.of(bounds).to_bytes()
    names = np.array([d or 0 for d in doc_ids], "<i8").tobytes() + bytes(d is None for d in doc_ids)
    return _HEAD.pack(MAGIC, int(bounds[-1]), len(doc_ids), width, len(code)) + names + code + ids


class TokenFile:
    """A file read back."""

    def __init__(self, body: bytes):
        magic, self.n_ids, self.n_docs, width, n_code = _HEAD.unpack_from(body)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = _HEAD.size
        names = np.frombuffer(body, "<i8", self.n_docs, at).tolist()
        missing = body[at + 8 * self.n_docs : at + 9 * self.n_docs]
        self.doc_ids = [None if m else d for d, m in zip(names, missing)]
        at += 9 * self.n_docs
        self.bounds = EliasFano.from_bytes(body[at : at + n_code])
        self.ids = np.frombuffer(body, f"<u{width}", self.n_ids, at + n_code)

    def document(self, i: int) -> np.ndarray:
        """The ids of document i of this file."""
        return self.ids[self.bounds.select(i) : self.bounds.select(i + 1)]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Name, start and ids (32 bits wide) of each document; the boundaries are looked up, not unpacked."""
        wide = self.ids.astype("<u4")
        start = self.bounds.select(0)
        for i, doc_id in enumerate(self.doc_ids):
            end = self.bounds.select(i + 1)
            yield doc_id, start, wide[start:end]
            start = end


# Characters that the tokenizer's normal form leaves alone and that `re` and the tokenizer class alike:
# ASCII without control blanks, and the Latin letters and signs up to U+017F but for a few.
_PLAIN = re.compile(r"[\x00-\x1b\x20-\x7f\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-\u012f\u0131-\u0148\u014a-\u017f]*")
# What the tokenizer's own cut of a text finds between runs of letters, as far as plain characters go. Fixed value, for RE2.
_MARKS = r"'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\p{L}0-9\t-\r \x{a0}]+"
_CHUNKS = re.compile(r"\S+")
_CONTROL = re.compile(r"[\x1c-\x1f]")  # blanks to `re`, not to the tokenizer
ASKED = 2_000  # words put to the library as one text


def _is_plain(text: str) -> bool:
    """Whether all characters are plain ones; for ASCII texts that is quickly seen."""
    if "<|" in text:
        return False
    if text.isascii():
        return not ("\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text)
    return _PLAIN.fullmatch(text) is not None


def _without_cut(tokenizer: str) -> str | None:
    """The tokenizer for words in normal form between white space, if its cut is one step followed by a step per byte."""
    config = json.loads(tokenizer)
    steps = (config["pre_tokenizer"] or {}).get("pretokenizers") or []
    if [s["type"] for s in steps] != ["Split", "ByteLevel"] or steps[1]["use_regex"] or steps[1]["add_prefix_space"] or config["post_processor"]:
        return None
    steps[0] = {"type": "WhitespaceSplit"}
    return json.dumps({**config, "normalizer": None, "added_tokens": []})


class LibraryEncoder:
    """A tokenizer that lower-cases and drops white space, asked once per distinct word.

    Words are remembered up to a bound. New words go to the library many at a time, as one text with line
    feeds between; the mark at the end of each word's last token tells its ids apart.
    """

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        vocab = self.library.get_vocab()
        suffix = json.loads(self.library.to_str())["model"].get("end_of_word_suffix")
        self.ends = np.zeros(1 + max(vocab.values()), bool)
        if suffix:
            self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        # Words that are cut and lower-cased already need no more than the steps after the library's own cut.
        self.cut = Tokenizer.from_str(quick) if (quick := _without_cut(self.library.to_str())) else self.library
        self.width = 2 if max(len(self.ends), end_id + 1) <= 1 << 16 else 4
        self.end = end_id.to_bytes(self.width, "little")
        # Of what is remembered the older half goes when there is too much; what was used since has moved to the younger one.
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def _ask(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, f"<u{self.width}").tobytes() for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def _ask_words(self, words: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for i in range(0, len(words), ASKED):
            part = words[i : i + ASKED]
            ids = np.array(self.cut.encode("\n".join(part), add_special_tokens=False).ids, f"<u{self.width}")
            ends = (np.flatnonzero(self.ends[ids]) + 1) * self.width
            if len(ends) == len(part):
                raw, bounds = ids.tobytes(), [0, *ends.tolist()]
                out += [raw[s:e] for s, e in zip(bounds, bounds[1:])]
            else:
                out += self._ask(part)
        return out

    def _ids_of(self, words: list[str], ask: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """Ids of distinct words; those that are not remembered are asked for."""
        found = list(map(self.known.get, words))
        if None not in found:
            return found
        missing = [w for w, ids in zip(words, found) if ids is None]
        new = {w: ids for w in missing if (ids := self.older.get(w)) is not None}
        unknown = [w for w in missing if w not in new]
        new.update(zip(unknown, ask(unknown)))
        self.known.update((w, ids) for w, ids in new.items() if len(w) <= CACHED_WORD)
        return [new[w] if ids is None else ids for w, ids in zip(words, found)]

    def _encode_plain(self, texts: pa.Array) -> list[bytes]:
        """Ids of plain texts: Arrow cuts them and numbers the distinct words, so a word is looked up once per batch."""
        cut = pc.utf8_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(texts), _MARKS, r" \0 "))
        words = cut.flatten().dictionary_encode()
        names = pa.ListArray.from_arrays(pa.array([0, len(words.dictionary)], pa.int32()), words.dictionary.cast(pa.string()))
        # No word holds a line feed. The empty one stands before and after blanks and has no ids.
        known = self._ids_of(pc.binary_join(names, "\n")[0].as_py().split("\n"), self._ask_words)
        each = pa.array(known, pa.large_binary()).take(words.indices)
        _, at, ids = each.buffers()
        ends = np.frombuffer(at, np.int64)[cut.offsets.to_numpy()].tolist()
        raw = ids.to_pybytes() if ids else b""
        return [raw[s:e] for s, e in zip(ends, ends[1:])]

    def encode(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """Ids of each text with the end id, packed."""
        if len(self.known) > CACHE_WORDS // 2:
            self.known, self.older = {"": b""}, self.known
        column = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        whole = column.to_pylist()
        plain = [bool(t) and _is_plain(t) for t in whole]
        quick = iter(self._encode_plain(column.filter(pa.array(plain, pa.bool_()))) if any(plain) else [])
        out: list[bytes] = []
        for text, simple in zip(whole, plain):
            if simple:
                ids = next(quick)
            elif text:
                # No word crosses white space, so its pieces stand for themselves.
                pieces = [text] if _CONTROL.search(text) else _CHUNKS.findall(text)
                distinct = list(dict.fromkeys(pieces))
                found = dict(zip(distinct, self._ids_of(distinct, self._ask)))
                ids = b"".join([found[w] for w in pieces])
            else:
                ids = b""
            out.append(ids + self.end)
        return out


_ENCODERS: dict[tuple, LibraryEncoder] = {}


def _encoder(path: str, end_id: int) -> LibraryEncoder:
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = LibraryEncoder(path, end_id)
    return _ENCODERS[path, end_id]


def write_token_files(docs: DataFrame, out: str, tokenizer: str, end_id: int, file_ids: int = FILE_IDS) -> None:
    """Write the ids of every text, each followed by `end_id`, in ascending doc_id order under `out`.

    `tokenizer` is a tokenizers file that drops white space; texts are encoded whole, without special
    tokens. A null or empty text is the end id alone. Null doc_ids come first; of rows with one doc_id
    the order is that of their packed ids. Files are named by range and number, so that names sort as the documents do.
    An empty table writes a folder without files. Only doc_id and text are read.
    """

    spark = ready(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Ranges of even numbers of documents, from the ids alone: the texts are read, encoded and moved once.
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = plain.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)] or [0.5], 10_000)).first()[0] or []
    bounds = np.unique(np.array(cuts, np.int64))

    def make():
        encode = _encoder(tokenizer, end_id).encode

        def run(doc_ids, texts):
            ids = pc.fill_null(doc_ids, -(1 << 63)).to_numpy()
            return [pa.array(encode(texts), pa.binary()), pa.array(np.searchsorted(bounds, ids, "left"))]

        return run

    packed = with_columns_from(plain, ["doc_id", "text"], [T.StructField("ids", T.BinaryType()), T.StructField("part", T.LongType())], make, BATCH_ROWS)
    ordered = packed.select("part", "doc_id", "ids").repartition("part").sortWithinPartitions("part", "doc_id", "ids")

    def pack(batches: Iterator[dict]) -> Iterator[dict]:
        width = _encoder(tokenizer, end_id).width
        now, number, held = -1, 0, 0
        doc_ids: list = []
        bodies: list[bytes] = []

        def file() -> dict:
            body = pack_file(doc_ids, [len(b) // width for b in bodies], b"".join(bodies), width)
            return {"value": pa.array([body], pa.binary()), "file": [f"ids-{now:08d}-{number:08d}"]}

        for b in batches:
            for part, doc_id, ids in zip(b["part"].to_pylist(), b["doc_id"].to_pylist(), b["ids"].to_pylist()):
                if bodies and (held >= file_ids or part != now):
                    yield file()
                    doc_ids, bodies, held, number = [], [], 0, number + 1
                if part != now:
                    now, number = part, 0
                doc_ids.append(doc_id)
                bodies.append(ids)
                held += len(ids) // width
        if bodies:
            yield file()

    schema = T.StructType([T.StructField("value", T.BinaryType()), T.StructField("file", T.StringType())])
    files = map_batches(ordered, pack, schema)
    files.select(F.col("value").cast("string"), "file").write.partitionBy("file").text(out)


_FOUND = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("local_start", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files alone: doc_id, start, n_tokens, ids_crc32.

    `start` counts the ids of all documents before it, n_tokens includes the end id, ids_crc32 is the
    unsigned crc32 of the ids as little-endian unsigned 32-bit integers.
    """
    files = (
        spark.read.schema("path string, modificationTime timestamp, length long, content binary")
        .format("binaryFile")
        .option("pathGlobFilter", "part-*")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select(F.regexp_extract("path", r"file=(ids-\d+-\d+)/", 1).alias("file"), "content")
    )
    # Each file's number of ids stands in its head: bytes 9 to 16, big-endian.
    counted = files.select("file", F.conv(F.hex(F.substring("content", 9, 8)), 16, 10).cast("long").alias("n"))
    # A row per file: one task adds up as many rows as there are files.
    before = W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)
    offsets = counted.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))

    def documents(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            for name, body in zip(b["file"], b["content"]):
                found = TokenFile(body.as_py())
                rows = [(doc_id, start, len(ids), zlib.crc32(ids)) for doc_id, start, ids in found.documents()]
                doc_ids, starts, sizes, sums = zip(*rows) if rows else ((), (), (), ())
                yield {
                    "file": [name.as_py()] * found.n_docs,
                    "doc_id": pa.array(doc_ids, pa.int64()),
                    "local_start": pa.array(starts, pa.int64()),
                    "n_tokens": pa.array(sizes, pa.int64()),
                    "ids_crc32": pa.array(sums, pa.int64()),
                }

    return (
        map_batches(files, documents, _FOUND)
        .join(offsets, "file")
        .select("doc_id", (F.col("offset") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
    )


def token_file_report(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write the files of `docs` to the scratch folder and read them back."""
    out = scratch_path(docs.sparkSession, "token-files")
    write_token_files(docs, out, tokenizer, end_id)
    return read_token_files(docs.sparkSession, out)
