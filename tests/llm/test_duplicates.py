import collections
import hashlib
import random
import re
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumirank.llm import jaccard, suffix_dedup
from lumirank.llm.common import ASCII_LOWER
from lumirank.llm.exact_dedup import SLOTS, CuckooIndex, drop_copies, exact_groups, live_digests
from lumirank.llm.jaccard import components, keep_one, signatures, similar_groups
from lumirank.llm.suffix_dedup import drop_repeated_strings


def key(n: int) -> bytes:
    return hashlib.sha256(str(n).encode()).digest()


def test_cuckoo_index_follows_a_set():
    index, alive, rng = CuckooIndex(4), set(), random.Random(5)
    for _ in range(20_000):
        k = key(rng.randrange(3000))
        assert (k in index) == (k in alive)
        if k in alive and rng.random() < 0.6:
            assert index.delete(k)
            alive.discard(k)
        elif k not in alive:
            index.insert(k)
            alive.add(k)
    assert index.resized and index.size == len(alive)
    assert max(map(len, index.prints)) <= SLOTS
    assert not index.delete(key(10**9))


def test_equal_prints_are_told_apart_by_the_key():
    index = CuckooIndex(2)
    one, two = b"\1\0" + b"\0" * 30, b"\1\0" + b"\0" * 29 + b"\1"
    index.insert(one)
    assert one in index and two not in index
    index.insert(two)
    index.delete(one)
    assert one not in index and two in index


def test_the_index_keeps_and_gives_the_rows():
    index, want, rng = CuckooIndex(2), {}, random.Random(6)
    for n in range(5000):
        k = key(rng.randrange(1500))
        at = index.find(k)
        assert (at is not None) == (k in want)
        if at is None:
            index.insert(k, (n,))
            want[k] = (n,)
        elif rng.random() < 0.3:
            index.delete(k)
            del want[k]
        else:
            assert index.value(at) == want[k]
            index.replace(at, (*want[k], n))
            want[k] = (*want[k], n)
    assert index.resized and dict(index.items()) == want and index.size == len(list(index.items()))


def exact_by_hand(rows):
    groups = collections.defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[(text or "").translate(ASCII_LOWER)].append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        stays = [True] + [False] * (len(ids) - 1)
        order = sorted(ids, key=lambda i: (i != keep, str(i)))
        digest = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, keep, len(ids), s, digest) for i, s in zip(order, stays)]
    return sorted(out, key=str)


def test_exact_groups_of_awkward_rows(docs, rows, no_docs):
    assert sorted(map(tuple, exact_groups(docs).collect()), key=str) == exact_by_hand(rows)
    assert exact_groups(no_docs).count() == 0
    kept = drop_copies(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({(r[1] or "").translate(ASCII_LOWER) for r in rows})


def test_digests_can_be_taken_out(spark):
    rows = [(key(n), n, n, 1) for n in range(100)]
    schema = "digest binary, keep_id long, keep_row long, group_size long"
    live = live_digests(spark.createDataFrame(rows, schema))
    gone = spark.createDataFrame([(key(n), None, None, -1) for n in range(0, 100, 2)], schema)
    # The index goes on from its stored rows; what is taken out comes after them.
    left = live_digests(live.unionByName(spark.createDataFrame([(key(7), 500, 500, 1)], schema)))
    assert left.where(F.col("digest") == F.lit(key(7))).first()["keep_id"] == 500
    assert live_digests(gone).count() == 0


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII_LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def groups_by_hand(rows):
    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return sorted(((r[0], len(sets[i]), least.get(root(i)) if sets[i] else r[0]) for i, r in enumerate(rows)), key=str)


def test_groups_of_awkward_rows(docs, rows, no_docs):
    got = similar_groups(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == groups_by_hand(rows)
    assert similar_groups(no_docs).count() == 0
    assert keep_one(docs).columns == docs.columns


def family(rng, size):
    """A text with copies that differ a little, a lot, in length, and chains of them."""
    base = [f"w{rng.randrange(5000)}" for _ in range(size)]
    out = [base]
    for _ in range(6):
        new = list(rng.choice(out))
        for _ in range(rng.randint(0, max(1, size // 40))):
            at = rng.randrange(len(new))
            what = rng.random()
            if what < 0.4:
                new[at] = f"w{rng.randrange(5000)}"
            elif what < 0.7:
                del new[at]
            else:
                new.insert(at, f"w{rng.randrange(5000)}")
            new = new or ["w"]
        out.append(new)
    return [" ".join(t) for t in out]


@pytest.mark.parametrize("block", [jaccard.BLOCK_BYTES, 4000])
def test_no_link_is_lost(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", block)  # small ones cut clusters into several blocks
    rng = random.Random(8)
    texts = [t for size in (1, 3, 5, 6, 8, 9, 11, 14, 20, 33, 64, 120, 250) for _ in range(4) for t in family(rng, size)]
    # A passage that many texts share, and one word over and over.
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [passage + " " + " ".join(f"q{i}_{j}" for j in range(rng.randint(5, 40))) for i in range(40)]
    texts += ["again " * n for n in (1, 4, 5, 6, 50)]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect()), key=str) == groups_by_hand(rows)


def test_bitmaps_never_reject_similar_sets():
    rng = np.random.default_rng(6)
    for n in (1, 3, 9, 60, 400, 3000):
        for _ in range(60):
            x = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
            lose, gain = rng.integers(0, len(x) // 5 + 1), rng.integers(0, len(x) // 5 + 1)
            y = np.unique(np.concatenate([rng.permutation(x)[lose:], rng.integers(0, 1 << 64, gain, dtype=np.uint64)]))
            differ = int(np.bitwise_count((jaccard.bitmap(x) ^ jaccard.bitmap(y)).view(np.uint64)).sum())
            if jaccard.linked(x, y):
                assert differ * 180 <= (len(x) + len(y)) * 20


def test_similar_sets_share_what_one_asks_for():
    rng = np.random.default_rng(4)
    for n in [*range(1, 40), 63, 64, 65, 127, 128, 200, 511, 512, 900]:
        for _ in range(12):
            x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            lose = rng.integers(0, len(x) // 9 + 1)
            gain = rng.integers(0, len(x) // 9 + 1)
            y = np.unique(np.concatenate([rng.permutation(x)[lose:], rng.integers(0, 1 << 63, gain, dtype=np.uint64)]))
            both = len(np.intersect1d(x, y))
            if 5 * both < 4 * (len(x) + len(y) - both):
                continue
            band = max(len(x), len(y)).bit_length() - 1
            assert len(np.intersect1d(signatures(x, band)[0], signatures(y, band)[0]))


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), *[(i, i + 1) for i in range(100, 140)], (50, 60), (60, 40), (7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, 40: 40, 50: 40, 60: 40, **dict.fromkeys(range(100, 141), 100)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def cut_by_hand(rows):
    """Every 100-byte string in order, against all that start earlier."""
    seen, out = {}, []
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    for i in order:
        raw = (rows[i][1] or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 99):
            s = raw[p : p + 100]
            if s in seen:
                gone[p : p + 100] = b"\1" * 100
            else:
                seen[s] = i
        runs = len(re.findall(b"\1+", bytes(gone)))
        out.append((rows[i][0], len(raw), sum(gone), runs, bytes(x for x, g in zip(raw, gone) if not g)))
    return out


@pytest.mark.parametrize("block,crowd", [(1 << 16, 20_000), (64, 2)])
def test_repeated_strings(spark, rows, block, crowd, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK_STARTS", block)
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    rng = random.Random(9)
    part = "".join(rng.choices("abcdefgh é", k=260))
    more = [
        (100 + i, t, *[None] * 7)
        for i, t in enumerate(
            [part, part[:99], part[:100], "x" + part[30:200] + "y" + part, "ab" * 300, "ab" * 60, "z" * 150 + part[100:] + "z" * 150, part * 3]
        )
    ]
    # Ids that are there once only: the rule for repeated ids has a test of its own.
    once = [r for r in rows if r[0] is not None and r[0] != 9] + [r for r in rows if r[0] is None][:1]
    table = [(*r[:2], "x") for r in once + more]
    got = drop_repeated_strings(spark.createDataFrame(table, "doc_id long, text string, n_bytes string").repartition(4)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(cut_by_hand(table), key=str)


def test_rows_with_one_id_and_text_repeat_it(spark, no_docs):
    text = "".join(random.Random(1).choices("abcdef", k=150))
    got = drop_repeated_strings(spark.createDataFrame([(1, text), (1, text), (1, "short"), (1, "short")], "doc_id long, text string"))
    assert sorted((r["n_removed"], r["n_bytes"]) for r in got.collect()) == [(0, 5), (0, 5), (0, 150), (150, 150)]
    assert drop_repeated_strings(no_docs).count() == 0


def test_repeated_strings_leave_little_on_disk(spark, monkeypatch):
    rng = random.Random(12)
    texts = ["".join(rng.choices("abcdefgh é", k=4000)) for _ in range(25)]
    # Half of each text from its neighbour, so that some anchors are asked for and most just repeat.
    table = [(8 * i + j, t if j else t[:2000] + texts[i - 1][2000:]) for i, t in enumerate(texts) for j in range(8)]
    blocks = Path(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0])
    kept, write = {}, suffix_dedup.scratch_table

    def shuffles():
        return {f.name for f in blocks.rglob("shuffle_*")}

    def watched(df, name, **how):
        before, plan = shuffles(), df._jdf.queryExecution().toString()
        out = write(df, name, **how)
        for _ in range(50):
            left = shuffles() - before
            if not left:
                break
            time.sleep(0.1)
        kept[name] = (out.columns, out.count(), len(left), plan.count("Window "))
        return out

    monkeypatch.setattr(suffix_dedup, "scratch_table", watched)
    got = drop_repeated_strings(spark.createDataFrame(table, "doc_id long, text string").repartition(4)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(cut_by_hand(table), key=str)
    assert list(kept) == ["anchors", "starts", "spans"]
    assert [left for _, _, left, _ in kept.values()] == [0, 0, 0]
    # Anchors are put in order once, and no names of stretches are written.
    assert "stretch" not in kept["anchors"][0] and kept["starts"][3] == 0
    assert kept["anchors"][1] > 0 and kept["starts"][1] > 0
