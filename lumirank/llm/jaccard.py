"""Sets of five-word shingles joined on Jaccard similarity, exactly.

The universe of shingles is partitioned by hash into as many segments as a band of set sizes calls for.
If two sets differ in at most H elements, then of any H + 1 segments that are not empty at least one is
the same in both: the segment subsets are the index. Which H + 1 a document asks for is its choice, and it
takes those that few others share; segments nobody shares cost nothing. A document with too few
segments that are not empty also uses their one-deletion neighbourhoods, and the rare one for which even
that gives no guarantee uses its single shingles. Every candidate is verified on the whole sets.

Why no link is lost. J(x, y) >= 0.8 bounds the elements in which x and y differ by a quarter of either
set's size, so H = n // 4, and the sizes by the factor 1.25, so a band and its neighbour are enough.
(a) If x has H + 1 segments that are not empty and asks for them, y lists all of its own, and one is equal.
(b) If both have fewer, both list subsets and one-deletion neighbourhoods. A segment with two or more
elements meets another at distance 0 or 1, one with a single element at distance 0, so the guarantee
holds if 2 * (segments with two or more) + (segments with one) > H for either of them.
(c) If it holds for neither, both list their shingles, and similar sets share one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumirank.llm.common import map_batches, ready, with_key
from lumirank.plans.scratch import release, scratch_table

SHINGLE = 5
#: Similarity at which two sets link, as a fraction. The bounds above are for this value.
LINK = (80, 100)
PARTNERS = 4  # rows of other components a row is compared with in a turn
BLOCK_BYTES = 8 << 20  # sets of a cluster that meet in one task, from either side
BITS = 512  # of the bitmap of a set
CACHE_WORDS = 200_000
CACHED_WORD = 40
LOCAL_SETS = 200_000

_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _K2
    x = (x ^ (x >> np.uint64(27))) * _K3
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    """64-bit hashes of words; cleared when it holds too many."""

    def __missing__(self, word: bytes) -> int:
        made = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= CACHED_WORD:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = made
        return made


class Shingler:
    """Distinct shingles of texts, in UTF-8, as sorted 64-bit hashes."""

    def __init__(self, words: int = SHINGLE):
        self.words = words
        self.factors = [np.uint64(pow(int(_K1), i + 1, 1 << 64)) for i in range(words)]
        self.look = _Hashes().__getitem__

    def __call__(self, text: bytes | None) -> np.ndarray:
        # For bytes, lower() touches A-Z only and split() knows the six ASCII blanks only.
        words = text.lower().split() if text else []
        if not words:
            return np.zeros(0, np.uint64)
        each = np.fromiter(map(self.look, words), np.uint64, len(words))
        n = max(1, len(each) - self.words + 1)
        out = np.full(n, np.uint64(min(len(each), self.words)))
        for factor, i in zip(self.factors, range(len(each))):
            out += each[i : i + n] * factor
        return np.unique(_mixed(out))


def segments_of_band(band: int) -> int:
    """Segments for sets of 2**band to 2**(band + 1) - 1 elements: enough that H + 1 are hardly ever empty."""
    return -(-28 * (2 ** (band + 1) - 1) // 100) + 2


def signatures(shingles: np.ndarray, band: int) -> tuple[np.ndarray, bool]:
    """What a set lists in a band, and whether it must ask for all of it."""
    m = segments_of_band(band)
    need = len(shingles) // 4 + 1
    segment = (((shingles * _K3) >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.uint16 if m <= 1 << 16 else np.int64)
    order = np.argsort(segment, kind="stable")
    segment, element = segment[order], shingles[order] * _K1
    first = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
    total = np.add.reduceat(element, first)
    place = segment[first].astype(np.uint64) * _K2 + np.uint64(band)
    whole = _mixed(total + place)
    if len(whole) >= need:
        return whole, False
    count = np.diff(np.append(first, len(segment)))
    several = np.repeat(count > 1, count)
    less = _mixed((np.repeat(total, count) - element + np.repeat(place, count))[several])
    listed = [whole, less]
    if 2 * (count > 1).sum() + (count == 1).sum() < need:
        listed.append(_mixed(element ^ np.uint64(band)))
    return np.unique(np.concatenate(listed)), True


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """Which of BITS values the top bits of the hashes take, as 64-bit numbers."""
    taken = np.zeros(BITS, np.uint8)
    taken[shingles >> np.uint64(64 - (BITS.bit_length() - 1))] = 1
    return np.packbits(taken).view(np.int64)


_HEAD = T.StructType(
    [
        T.StructField("row", T.LongType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("text_key", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField("print", T.BinaryType()),
        T.StructField("bits", T.ArrayType(T.LongType(), False)),
        T.StructField("lists", T.BooleanType()),
        T.StructField("own", T.ArrayType(T.LongType(), False)),
        T.StructField("own_all", T.BooleanType()),
        T.StructField("next", T.ArrayType(T.LongType(), False)),
        T.StructField("next_all", T.BooleanType()),
    ]
)


def _heads(batches: Iterator[dict]) -> Iterator[dict]:
    shingler, seen = Shingler(), set()
    for b in batches:
        for at in range(0, len(b["text"]), 256):
            part = {c: a.slice(at, 256) for c, a in b.items()}
            out: dict[str, list] = {k: [] for k in ("n", "print", "bits", "lists", "own", "own_all", "next", "next_all")}
            for text in part["text"].cast(pa.binary()).to_pylist():
                s = shingler(text)
                mark = hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None
                lists = mark is not None and mark not in seen
                bits = bitmap(s) if lists else None
                own, own_all, nxt, next_all = np.zeros(0, np.uint64), False, np.zeros(0, np.uint64), False
                if lists:
                    if len(seen) >= LOCAL_SETS:
                        seen.clear()
                    seen.add(mark)
                    band = len(s).bit_length() - 1
                    own, own_all = signatures(s, band)
                    if 5 * len(s) // 4 >= 2 ** (band + 1):
                        nxt, next_all = signatures(s, band + 1)
                for k, v in zip(out, (len(s), mark, bits, lists, own.view(np.int64), own_all, nxt.view(np.int64), next_all)):
                    out[k].append(v)
            yield {**{c: part[c] for c in ("row", "doc_id", "text_key")}, **out}


_SET = T.StructType([T.StructField("row", T.LongType()), T.StructField("shingles", T.BinaryType())])


def _sets(batches: Iterator[dict]) -> Iterator[dict]:
    shingler = Shingler()
    for b in batches:
        for at in range(0, len(b["text"]), 256):
            texts = b["text"].slice(at, 256).cast(pa.binary()).to_pylist()
            yield {"row": b["row"].slice(at, 256), "shingles": pa.array([shingler(t).tobytes() for t in texts], pa.binary())}


_LINK = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets reach the similarity."""
    if not len(x) or not len(y):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return LINK[1] * both >= LINK[0] * (len(x) + len(y) - both)


def _verify(batches: Iterator[dict]) -> Iterator[dict]:
    for b in batches:
        keep = [
            linked(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) for x, y in zip(b["x"], b["y"])
        ]
        mask = pa.array(keep, pa.bool_())
        yield {"a": b["a"].filter(mask), "b": b["b"].filter(mask)}


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets link; written once."""
    both = (
        pairs.join(sets.select(F.col("row").alias("a"), F.col("shingles").alias("x")), "a")
        .join(sets.select(F.col("row").alias("b"), F.col("shingles").alias("y")), "b")
        .select("a", "b", "x", "y")
    )
    return scratch_table(map_batches(both, _verify, _LINK), "links")


def _sets_of(rows: DataFrame, heads: DataFrame, plain: DataFrame) -> DataFrame:
    """The sets of some rows: (row, shingles)."""
    wanted = rows.join(heads.select("row", "text_key", F.col("doc_id").alias("id")), "row")
    texts = (
        plain.join(wanted, "text_key")
        .where(F.col("doc_id").eqNullSafe(F.col("id")))
        .select("text_key", "row", "text")
        .dropDuplicates(["text_key", "row"])
    )
    return scratch_table(map_batches(texts.select("row", "text"), _sets, _SET), "sets")


def _partners(open_: DataFrame, turn: int = 0) -> DataFrame:
    """At most PARTNERS pairs (a, b) per row, of rows that share a bucket, have different labels and may be similar.

    Labels and rows stand in orders by hash, others each turn, that are the same in all buckets: a bucket proposes the first row
    of its first label to rows of other labels and the last row of its last label to those of the first, and a
    row takes the proposals that come first. So members of a large group, which share many buckets, ask for the same few rows.
    """
    member = F.struct("row", "n", "asks", "label", "bits")
    ends = []
    for k in (2 * turn, 2 * turn + 1):
        order = F.struct(F.xxhash64("label", F.lit(k)), F.xxhash64("row", F.lit(k)), "row")
        ends += [F.min_by(member, order).alias(f"first{k}"), F.max_by(member, order).alias(f"last{k}")]
    proposed = open_.groupBy("sig").agg(*ends)
    names = [c for c in proposed.columns if c != "sig"]
    met = open_.select("sig", member.alias("x")).join(proposed, "sig").select("x", F.explode(F.array(*names)).alias("y"))
    fit = met.where((F.col("x.label") != F.col("y.label")) & _fits("x", "y"))
    picks = [F.min_by("y.row", F.xxhash64("y.row", F.lit(turn), F.lit(k))).alias(f"p{k}") for k in range(PARTNERS)]
    asked = fit.groupBy("x.row").agg(*picks).select("row", F.explode(F.array_distinct(F.array(*[f"p{k}" for k in range(PARTNERS)]))).alias("p"))
    return asked.select(F.least("row", "p").alias("a"), F.greatest("row", "p").alias("b")).distinct()


def _still_open(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """The buckets that hold rows of different labels, with the labels; written once. A row without a label is its own."""
    placed = buckets.join(labels.withColumnRenamed("node", "row"), "row", "left").withColumn("label", F.coalesce("label", "row"))
    split = placed.groupBy("sig").agg((F.min("label") != F.max("label")).alias("open")).where("open").select("sig")
    return scratch_table(placed.join(split, "sig", "left_semi"), "open")


class _Roots:
    """Which rows of a task are known to be in one component."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, x: int, y: int) -> None:
        self.up[self.find(x)] = self.find(y)


def _links_in_group(group: list[tuple]) -> Iterator[tuple[int, int]]:
    """Links that join the components of some rows (row, label, n, bits, shingles, side): no more than rows.

    A pair is verified unless its rows are known to be connected. Rows of one side do not meet where there are two.
    """
    roots = _Roots()
    row, label, n, bits, shingles, side = (list(c) for c in zip(*group))
    n, side = np.array(n), np.array(side)
    bits = np.frombuffer(b"".join(bits), np.uint64).reshape(len(group), -1)
    own = side.max() == side.min()
    for i in range(len(group)):
        rest = slice(i + 1, len(group))
        may = np.minimum(n[rest], n[i]) * LINK[1] >= np.maximum(n[rest], n[i]) * LINK[0]
        differ = np.bitwise_count(bits[rest] ^ bits[i]).sum(axis=1, dtype=np.int64)
        may &= differ * (LINK[1] + LINK[0]) <= (n[rest] + n[i]) * (LINK[1] - LINK[0])
        if not own:
            may &= side[rest] != side[i]
        for j in (np.flatnonzero(may) + i + 1).tolist():
            x, y = roots.find(label[i]), roots.find(label[j])
            if x != y and linked(np.frombuffer(shingles[i], np.uint64), np.frombuffer(shingles[j], np.uint64)):
                roots.join(x, y)
                yield row[i], row[j]


def _block_links(open_: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that join the components of all similar rows in open buckets; written once.

    Rows that no other row of their bucket may be similar to are left out. The rest are put together by the buckets
    they share, and each such cluster meets inside tasks, in blocks of BLOCK_BYTES: a set travels once per block of its
    cluster, and no pair becomes a row of a table.
    """
    x, y = open_.alias("x"), open_.alias("y")
    meet = (F.col("x.sig") == F.col("y.sig")) & (F.col("x.label") != F.col("y.label")) & _fits("x", "y")
    active = scratch_table(x.join(y, meet, "left_semi"), "active")
    first = active.groupBy("sig").agg(F.min("row").alias("b"))
    clusters = components(active.select("sig", F.col("row").alias("a")).join(first, "sig").select("a", "b"))
    hexes = F.concat(*[F.lpad(F.hex(f"bits.b{i}"), 16, "0") for i in range(BITS // 64)])
    rows = active.groupBy("row").agg(F.first("label").alias("label"), F.first("n").alias("n"), F.first(F.to_binary(hexes, F.lit("hex"))).alias("bits"))
    placed = scratch_table(rows.join(clusters.select(F.col("node").alias("row"), F.col("label").alias("cluster")), "row"), "clusters")
    release(active)
    release(clusters)
    load = placed.groupBy("cluster").agg(F.ceil(F.sum(F.col("n") * 8) / F.lit(BLOCK_BYTES)).cast("int").alias("blocks")).where("blocks > 1")
    dealt = (
        placed.join(load, "cluster", "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("mine", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("cluster", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "row", "label", "n", "bits")
        .join(sets, "row")
    )
    keys = ["cluster", "i", "j"]
    ordered = dealt.repartition(*keys).sortWithinPartitions(*keys, "row")

    def verify(batches: Iterator[dict]) -> Iterator[dict]:
        key, group = None, []

        def links() -> dict:
            found = list(_links_in_group(group)) if len(group) > 1 else []
            return {"a": [p[0] for p in found], "b": [p[1] for p in found]}

        for b in batches:
            names = ("row", "label", "n", "bits", "shingles", "mine")
            for now, member in zip(zip(*(b[k].to_pylist() for k in keys)), zip(*(b[c].to_pylist() for c in names))):
                if now != key:
                    yield links()
                    key, group = now, []
                group.append(member)
        yield links()

    found = scratch_table(map_batches(ordered, verify, _LINK), "links")
    release(placed)
    return found


def _joined_rows(buckets: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, label) of the rows that link with others, directly or through others.

    First every row is compared with a few rows it shares buckets with, and what links is contracted: at most PARTNERS
    pairs a row, whatever the sizes of the groups. What may still be similar in buckets with several components is compared in blocks.
    """
    links = _links(_partners(buckets.withColumn("label", F.col("row"))), sets)
    labels = components(links)
    open_ = _still_open(buckets, labels)
    if not open_.limit(1).count():
        release(open_)
        return labels
    more = _block_links(open_, sets)
    release(open_)
    release(labels)
    labels = components(links.unionByName(more))
    release(links)
    release(more)
    return labels


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable over the edges (a, b), for every node with an edge.

    Alternates two contractions: every node hands its larger neighbours, then its smaller ones, to the
    smallest it knows. Each round is two joins; the edges are written after each, until a round changes nothing.
    """
    edges = scratch_table(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    total = None
    while True:
        around = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = around.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        then = scratch_table(small.where("u <> v").distinct(), "edges")
        release(edges)
        edges = then
        now = edges.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first()
        if now == total:
            break
        total = now
    # All edges are now (node, smallest); the smallest names itself.
    out = scratch_table(
        edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
            edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
        ),
        "labels",
    )
    release(edges)
    return out


def _fits(x: str, y: str) -> Column:
    """Whether one of two members of a bucket asks for the other, and their sizes and bitmaps allow the similarity.

    Every bit in which two bitmaps differ is an element in which the sets differ; of those there are at most
    (1 - s) / (1 + s) times both sizes at a similarity of s, one ninth at 0.8.
    """
    col = lambda side, name: F.col(f"{side}.{name}")
    n = lambda side: col(side, "n")
    differ = sum((F.bit_count(col(x, f"bits.b{i}").bitwiseXOR(col(y, f"bits.b{i}"))) for i in range(BITS // 64)), F.lit(0))
    sizes = F.least(n(x), n(y)) * LINK[1] >= F.greatest(n(x), n(y)) * LINK[0]
    return (col(x, "asks") | col(y, "asks")) & sizes & (differ * (LINK[1] + LINK[0]) <= (n(x) + n(y)) * (LINK[1] - LINK[0]))


def similar_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, class_id and `print`, the digest of its set.

    A set is the distinct five-word shingles of the whole lower-cased text, the whole sequence where there
    are fewer words. Documents link at a similarity of 0.8 or more, and component_id is the smallest
    doc_id reachable over links, the document's own included. Documents without words have an empty set,
    link with nothing and are their own component. Equal sets are one class from the start, named by its smallest doc_id, so
    copies are never paired. Null ids count as larger than all others: a component of null ids only has a null
    component_id. Repeated rows are members of one class. Other columns are ignored; an empty table gives
    no rows. Sets are kept as 64-bit hashes of the shingles.
    """
    ready(docs.sparkSession)
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("text_key", F.xxhash64("text"))
    numbered = plain.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "text_key", "text")
    listed = scratch_table(map_batches(numbered, _heads, _HEAD), "listed")
    heads = scratch_table(
        listed.withColumn("n_own", F.size("own")).withColumn("n_next", F.size("next")).drop("own", "next"), "heads"
    )
    classes = scratch_table(
        heads.where("n > 0").groupBy("print").agg(F.min("doc_id").alias("first_id"), F.min(F.when(F.col("lists"), F.col("row"))).alias("row")),
        "classes",
    )

    # A listing is (signature, 2 * row + band), the band 0 for the document's own and 1 for the next.
    def of_band(name: str, k: int) -> Column:
        return F.transform(name, lambda sig: F.struct(sig.alias("sig"), (F.col("row") * 2 + k).alias("who")))

    entries = listed.where("lists").select(F.inline(F.concat(of_band("own", 0), of_band("next", 1))))
    by_sig = W.partitionBy("sig")
    shared = scratch_table(entries.withColumn("members", F.count(F.lit(1)).over(by_sig)).where("members > 1").select("sig", "who"), "shared")
    release(listed)
    # Of each class one member lists; what copies in other tasks listed goes now.
    of_class = (
        shared.withColumn("row", F.shiftright("who", 1))
        .join(classes.select("row"), "row", "left_semi")
        .withColumn("members", F.count(F.lit(1)).over(by_sig))
        .where("members > 1")
        .join(heads.where("lists").select("row", "n", "n_own", "n_next", "own_all", "next_all"), "row")
    )
    of_doc = W.partitionBy("who")
    mine = lambda own, nxt: F.when(F.col("who") % 2 == 0, F.col(own)).otherwise(F.col(nxt))
    free = mine("n_own", "n_next") - F.count(F.lit(1)).over(of_doc)
    rank = F.row_number().over(of_doc.orderBy("members", "sig"))
    asks = mine("own_all", "next_all") | (rank <= F.floor(F.col("n") / 4) + 1 - free)
    listed_by = scratch_table(of_class.withColumn("asks", asks).select("sig", "row", "n", "asks"), "buckets")
    release(shared)
    # A bucket nobody asks for has no pairs.
    asked = listed_by.groupBy("sig").agg(F.max("asks").alias("asked")).where("asked").select("sig")
    bits = F.struct(*[F.get("bits", F.lit(i)).alias(f"b{i}") for i in range(BITS // 64)]).alias("bits")
    maps = heads.where("lists").select("row", bits)
    buckets = scratch_table(listed_by.join(asked, "sig", "left_semi").join(maps, "row"), "asked")
    release(listed_by)

    # Sets of all rows that may meet another, made from their texts once more.
    sets = _sets_of(buckets.select("row").distinct(), heads, plain)
    labels = _joined_rows(buckets, sets)
    release(sets)
    release(buckets)

    named = classes.join(labels.withColumnRenamed("node", "row"), "row", "left").withColumn("label", F.coalesce("label", "row"))
    smallest = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    groups = named.join(smallest, "label").select("print", "component_id", F.col("first_id").alias("class_id"))
    return (
        heads.select("doc_id", "n", "print")
        .join(groups, "print", "left")
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            *[F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col(c)).alias(c) for c in ("component_id", "class_id")],
            "print",
        )
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group of linked ones, with all columns: the one with the smallest id.

    Null ids rank above all others, and of rows repeated with one id one stays. Documents without words
    are linked with nothing, so each of them stays.
    """
    rows, key = with_key(docs)
    groups = similar_groups(rows.select(F.col(key).alias("doc_id"), "text")).select(F.col("doc_id").alias(key), "component_id")
    ids = rows.select(key, F.col("doc_id").alias("id"))
    place = F.struct(F.col("id").isNull().alias("missing"), "id", F.col(key).alias("row"))
    stay = groups.join(ids, key).groupBy("component_id").agg(F.min(place)["row"].alias(key)).select(key)
    return rows.join(stay, key, "left_semi").select(*docs.columns)
