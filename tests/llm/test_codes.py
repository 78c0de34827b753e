"""Vector codes, spelling variants and fingerprints against slow forms."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import types as T

from lumirank.llm import fingerprints, spelling, vector_codes

# ---------------------------------------------------------------- vectors

VECTORS = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("label", T.IntegerType()),
        T.StructField("code", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("_vector", T.StringType()),
    ]
)


def slow_codes(rows, dim, parts=4, entries=256, rounds=4):
    """rows: (vec_id, components, label), ids without nulls. Plain whole-number loops over numpy rows."""
    width = -(-dim // parts)
    kept = [(i, [*v, *[0.0] * (parts * width - len(v))], l) for i, v, l in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    whole = [[int(np.floor(1024 * np.float64(np.float32(x)))) for x in v] for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, kept[r][0] or 0, kept[r][1]))
    books = [[whole[r][p * width : (p + 1) * width] for r in order[:entries]] for p in range(parts)]

    def assigned():
        index, error = [], [0] * len(whole)
        for p in range(parts):
            x, b = np.array([w[p * width : (p + 1) * width] for w in whole]), np.array(books[p])
            d = ((x[:, None] - b[None]) ** 2).sum(axis=2)
            index.append(d.argmin(axis=1))
            error = [e + int(m) for e, m in zip(error, d.min(axis=1))]
        return index, error

    for _ in range(rounds):
        index, _ = assigned()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [whole[r][p * width : (p + 1) * width] for r in np.flatnonzero(index[p] == e)]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    index, error = assigned()
    total = Counter()
    for (_, _, label), e in zip(kept, error):
        total[label] += e
    digest = hashlib.sha256(",".join(str(c) for b in books for row in b for c in row).encode()).hexdigest()
    return Counter((i, "".join(f"{index[p][r]:02x}" for p in range(parts)), error[r], total[l], digest) for r, (i, _, l) in enumerate(kept))


def vector_rows(n=700, dim=64, seed=5):
    rng = np.random.default_rng(seed)
    rows = [(int(i), (rng.normal(size=dim) / 8).astype(np.float32).tolist(), int(i) % 3 if i % 7 else None) for i in rng.permutation(n)]
    rows[3] = (rows[3][0], None, 1)
    rows[4] = (rows[4][0], [float("nan"), *rows[4][1][1:]], 1)
    rows[5] = (rows[5][0], [None, *rows[5][1][1:]], 1)
    rows[6] = (rows[6][0], [float("-inf"), *rows[6][1][1:]], 1)
    rows[7] = (rows[7][0], [0.0] * dim, None)
    rows += [rows[0], rows[0], (rows[0][0], rows[1][1], 2), (None, rows[2][1], 0)]  # repeated rows and ids
    return rows


@pytest.mark.parametrize("dim", [64, 10])
def test_codes_equal_a_slow_form(spark, dim):
    rows = vector_rows(dim=dim)
    frame = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], VECTORS).repartition(6)
    got = vector_codes.vector_code_report(frame).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    assert Counter(tuple(r) for r in got) == slow_codes(rows, dim)


def test_few_vectors_and_none(spark):
    rows = [(1, [0.5] * 8, None), (2, [], None), (3, [0.25], 4)]
    got = vector_codes.vector_code_report(spark.createDataFrame([(*r, "", "", "", "") for r in rows], VECTORS)).collect()
    assert Counter(tuple(r) for r in got) == slow_codes(rows, 8)
    assert vector_codes.vector_code_report(spark.createDataFrame([], VECTORS)).collect() == []
    nulls = spark.createDataFrame([(None, None, None, None, None, None, None)], VECTORS)
    assert vector_codes.vector_code_report(nulls).collect() == []


def test_sequency_order_and_early_endings():
    for size in (1, 2, 8, 16, 64):
        h = vector_codes.transformed(np.eye(size, dtype=np.int64)).T
        assert (h @ h.T == size * np.eye(size, dtype=np.int64)).all()
        assert ((np.diff(np.sign(h), axis=1) != 0).sum(axis=1) == np.arange(size)).all()
    rng = np.random.default_rng(1)
    for smooth in (False, True):
        x, books = rng.integers(-900, 900, (3000, 16)), rng.integers(-900, 900, (256, 16))
        if smooth:  # weight in the first coefficients, so that entries go early
            x, books = x[:, :1] + x // 50, books[:, :1] + books // 50
        books[9] = books[200] = x[17]
        d = ((x[:, None] - books[None]) ** 2).sum(axis=2)
        index, distance = vector_codes.nearest(x, books)
        assert (index == d.argmin(axis=1)).all() and (distance == d.min(axis=1)).all()
    big = rng.integers(-(1 << 20), 1 << 20, (50, 16))
    assert (vector_codes.nearest(big, big[::-1])[0] == np.arange(50)[::-1]).all()
    with pytest.raises(ValueError):
        vector_codes.nearest(big << 20, big)


# ---------------------------------------------------------------- words


def slow_words(rows, min_length=7):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    n = {w: c for w, c in count.items() if c >= 2 and len(w) >= min_length}
    near = defaultdict(set)
    around = defaultdict(set)
    for w in n:
        for i in range(len(w)):
            around[w[:i], w[i + 1 :]].add(w)
            less = w[:i] + w[i + 1 :]
            if less in n:
                near[w].add(less)
                near[less].add(w)
    for group in around.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w in n:
        best = min(near[w], key=lambda o: (-n[o], o), default=None)
        if best and n[best] >= 10 * n[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, c, len(near[w]), form.get(w), n.get(form.get(w)), root(w)) for w, c in n.items()}


def reported(frame):
    got = frame.select("word", "n", "n_near", "form", "form_n", "root").collect()
    assert len({r["word"] for r in got}) == len(got)
    return {tuple(r) for r in got}


def test_words_equal_a_slow_form(spark, docs, rows, no_docs):
    assert reported(spelling.spelling_report(docs)) == slow_words([r[:2] for r in rows])
    assert spelling.spelling_report(no_docs).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_variants_of_made_words(spark, seed):
    rng = random.Random(seed)
    letters = "abé" if seed else "aaaaab"  # runs of equal letters meet themselves in several places
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(7, 11))) for _ in range(60)]
    base += ["a" * k for k in range(6, 12)] + ["prefixprefix" * 9 + c for c in "abc"] + ["b" * 4000, "b" * 4001, "é" + "b" * 4000]
    words = []
    for w in base:
        words += [w] * rng.choice([1, 2, 3, 30, 400])
    rng.shuffle(words)
    rows = [(i, " ".join(words[i::9]).upper() if i == 4 else "×, ".join(words[i::9])) for i in range(9)]
    rows += [(None, "chainwordx chainwordx"), (50, None), (51, "")]
    rows += [(60 + i, "chainword " * 25) for i in range(1)] + [(70, "chainwor " * 300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS word", "'y' AS n", "'z' AS id").repartition(3)
    want = slow_words(rows)
    assert reported(spelling.spelling_report(frame)) == want
    assert any(root != form for *_, form, _, root in want if form)


def test_trie_nodes_tell_prefixes_apart():
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(0, 9))).encode() for _ in range(300)})
    slices = spelling.Slices(rng.sample(words, 40), 7)
    walk, number = spelling.Walk(slices), {}
    for w in words:
        for size, node in enumerate(walk.nodes(slices.of(w), w).tolist()):
            assert number.setdefault(w[:size], node) == node
    assert len(set(number.values())) == len(number) and len(slices.cuts) > 2


# ---------------------------------------------------------------- fingerprints


def slow_syncmers(text):
    """(end, hash) of each closed syncmer, k-mer by k-mer."""
    f = fingerprints
    marked = "\0" * (f.K - 1) + text

    def value(part, powers):
        total = sum((ord(c) + 1) * int(p) for c, p in zip(part, powers)) & ((1 << 64) - 1)
        return int(f._mixed(np.array([total], np.uint64))[0])

    inner = [value(marked[i : i + f.S], f._S_POWERS) for i in range(len(marked) - f.S + 1)]
    out = []
    for i in range(len(marked) - f.K + 1):
        window = inner[i : i + f.WINDOW]
        if window.index(min(window)) in (0, len(window) - 1):
            out.append((i + 1, value(marked[i : i + f.K], f._K_POWERS) >> (64 - f.HASH_BITS)))
    return out


def slow_likeness(a, b):
    """The longest chain by the table of all pairs."""
    if not a or not b:
        return float(len(a) == len(b))

    def named(hashes):
        seen = Counter()
        return [(h, seen.update([h]) or seen[h]) for h in hashes]

    a, b = named(a), named(b)
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
    return 2 * int(table[-1, -1]) / (len(a) + len(b))


TEXTS = ["", "a", "abc", "a" * 100, "The quick brown fox jumps over the lazy dog. " * 8, "ünï 中文 \U0001f600 " * 9, "line\n" * 40 + "other line\n" * 9]


@pytest.mark.parametrize("text", TEXTS)
def test_syncmers_equal_a_slow_form(text):
    found = fingerprints.found_anchors([text, *TEXTS])
    assert list(zip(found[0].ends.tolist(), found[0].hashes.tolist())) == slow_syncmers(text)
    if len(found[0].ends):
        assert max(np.diff(found[0].ends, prepend=0)) <= fingerprints.WINDOW


def test_likeness_is_the_longest_chain():
    rng = random.Random(4)
    for _ in range(60):
        a = [rng.randint(0, 30) for _ in range(rng.randint(0, 40))]
        b = [rng.randint(0, 30) for _ in range(rng.randint(0, 40))] if rng.random() < 0.5 else a[rng.randint(0, 9) :] + a[:3]
        made = [fingerprints.Anchors(np.arange(len(x)), np.array(x, np.int64)) for x in (a, b)]
        assert fingerprints.likeness(*made) == pytest.approx(slow_likeness(a, b))


def slow_report(rows):
    f = fingerprints
    order = sorted(((i is not None, i or 0, t or "", i) for i, t in rows))
    texts, ids = [o[2] for o in order], [o[3] for o in order]
    out = Counter()
    found = f.anchors(texts)
    for k, text in enumerate(texts):
        following = texts[(k + 1) % len(texts)]
        edited = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        e = f.anchors([edited])[0]
        near = f.likeness(found[k], e), f.likeness(found[k], found[(k + 1) % len(texts)])
        out[ids[k], len(text), hashlib.sha256(edited.encode()).hexdigest(), found[k].fingerprint(), e.fingerprint(), *near] += 1
    return out


def columns(frame):
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return Counter(tuple(r) for r in frame.select(*names).collect())


def test_fingerprints_equal_a_slow_form(spark, docs, rows, no_docs):
    assert columns(fingerprints.fingerprint_report(docs)) == slow_report([r[:2] for r in rows])
    assert fingerprints.fingerprint_report(no_docs).collect() == []
    rng = random.Random(8)
    more = [(i * 3, "".join(rng.choice("abc def\n") for _ in range(rng.choice([0, 1, 2, 5, 23, 24, 30, 60, 400])))) for i in range(700)]
    frame = spark.createDataFrame(more, "doc_id long, text string").selectExpr("*", "1 AS part", "2 AS border", "3 AS place").repartition(5)
    assert columns(fingerprints.fingerprint_report(frame)) == slow_report(more)
    one = spark.createDataFrame([(7, "just one document, which follows itself")], "doc_id long, text string")
    assert columns(fingerprints.fingerprint_report(one)) == slow_report([(7, "just one document, which follows itself")])


def test_half_of_a_text_is_half_alike(spark):
    rng = random.Random(9)
    rows = [(i, " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(200))) for i in range(20)]
    got = fingerprints.fingerprint_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(0.4 < r["near_edited"] < 0.65 and r["near_next"] < 0.05 for r in got)
    same = fingerprints.anchors(["one text here", "one text here"])
    assert same[0].fingerprint() == same[1].fingerprint()
