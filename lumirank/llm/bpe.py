"""Byte-pair encoding and decoding of texts by the merges of a public tokenizer file.

A word is merged on two plain lists that shrink together: the boundaries of its parts and the rank of
each adjacent pair. The lowest rank is found by a scan, its inner boundary is deleted and the ranks
left and right of it are refreshed. That suits the few bytes of a word; a longer run uses a heap with
the same order of merges. Words are remembered per task up to a bound, so most cost one lookup.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumirank.llm.common import with_columns_from

# The pattern that cuts text into words is part of the tokenizer's format: fixed value.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

SHORT_WORD = 200  # bytes up to which the minimum is found by a scan
CACHED_WORD = 64  # characters up to which a word is remembered
CACHE_WORDS = 200_000
SEGMENT = 1 << 20  # characters worked on at a time

_NO_RANK = 1 << 60
# No word holds anything else followed by a blank, so blanks and what follows them stand for themselves.
_CHUNKS = re.compile(r"\s*\S+|\s+")
_CONTROL_BLANK = re.compile(r"[\x1c-\x1f]")  # blanks to `re` only


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + hidden.index(b)) for b in range(256)]


class UnknownCharacter(Exception):
    """A character the regular expression's and the tokenizer's Unicode versions may class differently."""


class Merger:
    """Merge ranks and pieces of a byte-level BPE file."""

    def __init__(self, spec: dict):
        model = spec["model"]
        vocab = model["vocab"]
        letters = byte_alphabet()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.byte_ids = [vocab[c] for c in letters]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank_of = {(vocab[a], vocab[b]): rank for rank, (a, b) in enumerate(pairs)}.get
        self.made = [vocab[a + b] for a, b in pairs]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.pieces = [b""] * size
        for piece, i in vocab.items():
            self.pieces[i] = bytes(byte_of[c] for c in piece)
        for piece, i in self.special.items():
            self.pieces[i] = piece.encode()

    def merge_short(self, word: bytes) -> list[int]:
        """Parts of a word: `bounds[i]` to `bounds[i + 1]` is part i, `ranks[i]` that of parts i and i + 1."""
        bounds = list(range(len(word) + 1))
        ids = [*map(self.byte_ids.__getitem__, word)]
        rank_of = self.rank_of
        ranks = [rank_of(pair, _NO_RANK) for pair in zip(ids, ids[1:])]
        while ranks and (lowest := min(ranks)) != _NO_RANK:
            i = ranks.index(lowest)
            ids[i] = made = self.made[lowest]
            del bounds[i + 1], ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank_of((ids[i - 1], made), _NO_RANK)
            if i < len(ranks):
                ranks[i] = rank_of((made, ids[i + 1]), _NO_RANK)
        return ids

    def merge_long(self, word: bytes) -> list[int]:
        """The same merges for runs of any length: a heap of pairs over a linked list of parts."""
        ids = [*map(self.byte_ids.__getitem__, word)]
        end = len(ids)
        after = list(range(1, end + 1))
        before = list(range(-1, end - 1))
        rank_of = self.rank_of
        heap = [(r, i) for i, pair in enumerate(zip(ids, ids[1:])) if (r := rank_of(pair, _NO_RANK)) != _NO_RANK]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= end or rank_of((ids[i], ids[j])) != rank:
                continue
            ids[i], ids[j] = self.made[rank], -1
            after[i] = k = after[j]
            if k < end:
                before[k] = i
                if (r := rank_of((ids[i], ids[k]), _NO_RANK)) != _NO_RANK:
                    heapq.heappush(heap, (r, i))
            k = before[i]
            if k >= 0 and (r := rank_of((ids[k], ids[i]), _NO_RANK)) != _NO_RANK:
                heapq.heappush(heap, (r, k))
        return [i for i in ids if i >= 0]

    def word(self, text: str) -> bytes:
        raw = text.encode("utf-8")
        ids = self.merge_short(raw) if len(raw) <= SHORT_WORD else self.merge_long(raw)
        return struct.pack(f"<{len(ids)}I", *ids)


class _Remembered(dict):
    """Packed ids of strings met before; cleared when it holds too many."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> bytes:
        made = self.make(key)
        if len(key) <= CACHED_WORD:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[key] = made
        return made


def segments(text: str, size: int = SEGMENT) -> Iterator[str]:
    """Cut a long text before blanks that follow something else; no word crosses such a place."""
    start = 0
    edge = regex.compile(r"\S(?=\s)")
    while len(text) - start > size:
        found = edge.search(text, start + size)
        if not found:
            break
        yield text[start : found.end()]
        start = found.end()
    yield text[start:] if start else text


class Encoder:
    """Encode and decode as the tokenizers library does with the same file and no special tokens added."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        before = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex"):
            raise ValueError(f"{path} is not a byte-level BPE file of the kind this encoder reads")
        self.path = path
        self.merger = Merger(spec)
        self.pattern = regex.compile(WORDS)
        self.words = _Remembered(self.merger.word)
        self.chunks = _Remembered(self._chunk)
        names = sorted(self.merger.special, key=len, reverse=True)
        self.split = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; a null text has none."""
        if not text:
            return b""
        out = []
        for k, part in enumerate(self.split.split(text) if self.split else [text]):
            if k % 2:
                out.append(struct.pack("<I", self.merger.special[part]))
                continue
            for segment in segments(part):
                try:
                    out.append(b"".join(map(self.chunks.__getitem__, _CHUNKS.findall(segment))))
                except UnknownCharacter:
                    out.append(b"".join(self.merger.word(w) for w in self._cut_by_library(segment)))
        return b"".join(out)

    def _chunk(self, chunk: str) -> bytes:
        if not chunk.isascii() and max(chunk) > "Ѐ" and any(unicodedata.category(c) == "Cn" for c in chunk):
            raise UnknownCharacter
        if _CONTROL_BLANK.search(chunk):
            raise UnknownCharacter
        return b"".join(map(self.words.__getitem__, self.pattern.findall(chunk)))

    def _cut_by_library(self, text: str) -> list[str]:
        from tokenizers import Tokenizer

        if not hasattr(self, "_library"):
            self._library = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]

    def decode(self, ids: bytes | None) -> str:
        """Text of packed ids, special tokens included."""
        if not ids:
            return ""
        pieces = self.merger.pieces
        return b"".join(map(pieces.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per file and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode_texts(df: DataFrame, path: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """Add `ids`, binary: the ids of the whole text as little-endian unsigned 32-bit integers.

    `path` is a byte-level BPE file every executor can open. A null or empty text gives no ids; texts of
    any length are cut into words segment by segment; rows, repeated or not, are independent; a column
    that has the name of `ids` is replaced and the others stay. An empty table gives an empty table.
    """

    def make():
        encode = encoder(path).encode
        return lambda texts: [pa.array([encode(t) for t in texts.to_pylist()], pa.binary())]

    return with_columns_from(df, [text], [T.StructField(ids, T.BinaryType())], make)


def decode_ids(df: DataFrame, path: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """Add `text`: the ids turned back into text, special tokens included; null ids give an empty text."""

    def make():
        decode = encoder(path).decode
        return lambda packed: [pa.array([decode(p) for p in packed.to_pylist()], pa.string())]

    return with_columns_from(df, [ids], [T.StructField(text, T.StringType())], make)


def round_trip(df: DataFrame, path: str, text: str = "text", ids: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    """Both at once, in one pass and one Python worker per core: add `ids` and the text decoded from them."""

    def make():
        both = encoder(path)

        def run(texts):
            packed = [both.encode(t) for t in texts.to_pylist()]
            return [pa.array(packed, pa.binary()), pa.array([both.decode(p) for p in packed], pa.string())]

        return run

    return with_columns_from(df, [text], [T.StructField(ids, T.BinaryType()), T.StructField(decoded, T.StringType())], make)


def token_report(docs: DataFrame, path: str) -> DataFrame:
    """Per document: number of ids, digest of the ids and digest of the text decoded from them."""
    return round_trip(docs.select("doc_id", "text"), path).select(
        "doc_id",
        (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
