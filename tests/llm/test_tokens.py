import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lumirank.llm import token_files
from lumirank.llm.bpe import Encoder, decode_ids, encode_texts, token_report
from lumirank.llm.token_files import EliasFano, LibraryEncoder, TokenFile, pack_file, token_file_report

BYTE = public_tokenizers.path("byte_bpe_50k.json")
WORD = public_tokenizers.path("word_bpe_49k.json")
LETTERS = [*"aAbcdhlstmv  \n\tS'éÉß中文1٣²!?_\U0001F600́İœ\x85\xa0\xad.,", "<|endoftext|>", "<|", "꟎", "\x1c", "'s", "'LL", "the ", " and"]


def samples(n: int) -> list[str]:
    rng = random.Random(1)
    made = ["".join(rng.choices(LETTERS, k=rng.randint(0, 60))) for _ in range(n)]
    return [*made, "x" * 3000, "".join(rng.choices("abcdefgh", k=3000)), "word " * 500]


def test_ids_and_text_as_the_library_makes_them():
    ours, library = Encoder(BYTE), Tokenizer.from_file(BYTE)
    for text in samples(1500):
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ours.encode(text), "<u4").tolist() == ids, repr(text)
        assert ours.decode(ours.encode(text)) == library.decode(ids, skip_special_tokens=False) == text


def test_scan_and_heap_merge_alike():
    merger = Encoder(BYTE).merger
    rng = random.Random(2)
    for n in (0, 1, 2, 3, 10, 150, 199):
        for _ in range(20):
            word = bytes(rng.choices(b"theanding ", k=n))
            assert merger.merge_short(word) == merger.merge_long(word)


def test_broken_ids_decode_as_the_library_decodes_them():
    ours, library = Encoder(BYTE), Tokenizer.from_file(BYTE)
    rng = random.Random(4)
    for _ in range(200):
        ids = [rng.randrange(50257) for _ in range(8)]
        assert ours.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)


def test_report_over_awkward_rows(docs, rows):
    library = Tokenizer.from_file(BYTE)
    want = []
    for doc_id, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert sorted(map(tuple, token_report(docs, BYTE).collect()), key=str) == sorted(want, key=str)


def test_other_columns_stay(docs, no_docs):
    done = decode_ids(encode_texts(docs, BYTE), BYTE)
    assert done.columns == [*docs.columns, "token_ids", "decoded"]
    assert done.where(F.coalesce("text", F.lit("")) != F.col("decoded")).count() == 0
    assert token_report(no_docs, BYTE).count() == 0
    replaced = encode_texts(docs.withColumn("token_ids", F.lit("old")), BYTE)
    assert dict(replaced.dtypes)["token_ids"] == "binary"


@pytest.mark.parametrize("count", [0, 1, 2, 257, 3000])
@pytest.mark.parametrize("top", [1, 9, 10**6, 10**11])
def test_elias_fano(count, top):
    values = np.sort(np.random.default_rng(count + top).integers(0, top, count))
    code = EliasFano.from_bytes(EliasFano.of(values).to_bytes())
    assert (code.all() == values).all()
    assert all(code.select(i) == values[i] for i in range(count))


def test_boundary_code_is_small():
    bounds = np.cumsum(np.random.default_rng(1).integers(1, 900, 10_000))
    assert len(EliasFano.of(bounds).to_bytes()) * 8 / len(bounds) < 12.5


def test_file_gives_back_documents():
    ids = np.arange(10, dtype="<u2")
    file = TokenFile(pack_file([5, None, 7], [4, 0, 6], ids.tobytes(), 2) + b"\n")
    assert file.doc_ids == [5, None, 7]
    assert [file.document(i).tolist() for i in range(3)] == [[0, 1, 2, 3], [], [4, 5, 6, 7, 8, 9]]


def test_documents_are_read_without_unpacking_the_boundaries(monkeypatch):
    sizes = np.random.default_rng(2).integers(0, 9, 700)
    ids = np.arange(sizes.sum(), dtype="<u2")
    file = TokenFile(pack_file([None, *range(1, 700)], sizes.tolist(), ids.tobytes(), 2) + b"\n")
    monkeypatch.delattr(EliasFano, "all")
    got = [(doc_id, start, part.tolist()) for doc_id, start, part in file.documents()]
    ends = np.cumsum(sizes).tolist()
    assert got == [(i or None, e - n, list(range(e - n, e))) for i, (n, e) in enumerate(zip(sizes.tolist(), ends))]
    assert not list(TokenFile(pack_file([], [], b"", 2) + b"\n").documents())


def test_word_ids_as_the_library_makes_them():
    ours, library = LibraryEncoder(WORD, 2), Tokenizer.from_file(WORD)
    texts = [*samples(2500), None, ""]
    for text, packed in zip(texts, ours.encode(texts)):
        assert np.frombuffer(packed, "<u2").tolist() == [*library.encode(text or "", add_special_tokens=False).ids, 2], repr(text)


def test_words_in_use_are_asked_once_and_the_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(token_files, "CACHE_WORDS", 40)
    ours, library = LibraryEncoder(WORD, 2), Tokenizer.from_file(WORD)
    asked, ask = [], ours._ask_words
    monkeypatch.setattr(ours, "_ask_words", lambda words: asked.extend(words) or ask(words))
    for i in range(20):
        fresh = "".join("abcdefghij"[int(d)] for d in f"{i:03d}")
        texts = [f"It's the_same, ALWAYS! {fresh}x {fresh}y,{fresh}z", "the\u00a0\u00c9cole the 'S 1st 22", " \x0b\n", f"\u4e2d {fresh}"]
        for text, packed in zip(texts, ours.encode(pa.array(texts))):
            assert np.frombuffer(packed, "<u2").tolist() == [*library.encode(text, add_special_tokens=False).ids, 2], repr(text)
        assert len(ours.known) + len(ours.older) <= 80
    assert len(asked) == len(set(asked))


def test_files_of_awkward_rows(docs, rows, no_docs):
    library = Tokenizer.from_file(WORD)
    made = []
    for doc_id, text, *_ in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        made.append((doc_id is not None, doc_id or 0, ids.astype("<u2").tobytes(), ids))
    at, want = 0, []
    for known, doc_id, _, ids in sorted(made, key=lambda m: m[:3]):
        want.append((doc_id if known else None, at, len(ids), zlib.crc32(ids)))
        at += len(ids)
    assert sorted(map(tuple, token_file_report(docs, WORD).collect()), key=lambda r: r[1]) == want
    assert token_file_report(no_docs, WORD).count() == 0
