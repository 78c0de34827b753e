"""Hashed token counts of a text."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Runs of anything but ASCII letters and digits separate tokens.
SEPARATORS = "[^a-z0-9]+"


def _places(lowered: pa.Array, dim: int) -> np.ndarray:
    """Row * `dim` + bucket of every token.

    A token's bucket is the first eight hex digits of its MD5, modulo `dim`; each is worked out once per batch.
    """
    words = pc.split_pattern_regex(pc.fill_null(lowered, ""), SEPARATORS)
    owner = np.repeat(np.arange(len(lowered)), np.diff(words.offsets.to_numpy()))
    coded = words.flatten().dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    digests = [hashlib.md5(word.encode()).digest()[:4] for word in distinct]
    bucket_of = np.array([int.from_bytes(digest, "big") % dim for digest in digests], dtype=np.int64)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    keep = np.array([word != "" for word in distinct], dtype=bool)[codes]
    return owner[keep] * dim + bucket_of[codes[keep]]


def _one_array(lowered: pa.Array) -> pa.Array:
    return lowered.combine_chunks() if isinstance(lowered, pa.ChunkedArray) else lowered


def bucket_counts(lowered: pa.Array, dim: int) -> pa.Array:
    """Token counts per bucket of each (already lower-case) text; null for null."""
    lowered = _one_array(lowered)
    n = len(lowered)
    dense = np.bincount(_places(lowered, dim), minlength=n * dim).astype(np.float32)
    offsets = pa.array(np.arange(n + 1, dtype=np.int32) * dim)
    return pa.ListArray.from_arrays(offsets, pa.array(dense), mask=lowered.is_null())


def bucket_lists(lowered: pa.Array, dim: int) -> pa.StructArray:
    """The same counts without the zeros: lists of `buckets`, ascending, and `weights`; null for null."""
    lowered = _one_array(lowered)
    places, counts = np.unique(_places(lowered, dim), return_counts=True)
    offsets = pa.array(np.searchsorted(places, np.arange(len(lowered) + 1) * dim).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in ((places % dim).astype(np.int32), counts.astype(np.float64))]
    return pa.StructArray.from_arrays(lists, ["buckets", "weights"], mask=lowered.is_null())
