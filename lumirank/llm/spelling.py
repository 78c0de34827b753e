"""Words of a corpus and the words one letter away, through pairs of trie nodes.

The vocabulary is put in two tries, one over the words and one over the reversed words, and their nodes are
numbered. A word cut at a place is the pair (node of what stands before, node of what stands after). A pair
of numbers tells a pair of strings, so, exactly:

* two words differ by a replaced letter where their pairs around a skipped position are equal,
* they differ by an inserted or deleted letter where the pair of one around a skipped position equals a pair of the
  other between two positions. Of a run of equal letters only the first is skipped for that, so that two
  words meet in one place only.

All words with one pair differ in one place, so a pair has no more words than there are letters, and one more.

Numbering needs sorted words, not strings of all prefixes. Words are dealt to slices by cut words; every prefix that
two slices share is a prefix of a cut word, and those are numbered beforehand. All other nodes belong to one
slice, which numbers them while it walks its words in order: a word brings new nodes for what it does not
share with the word before.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumirank.llm.common import ascii_lower, map_batches, ready
from lumirank.plans.scratch import release, scratch_table

RUN = r"[A-Za-zÀ-ÿ]+"
MIN_LENGTH, MIN_COUNT, EDITED, FORM_RATIO = 7, 2, 31, 10
#: Cut words are chosen from this many words a slice, by a hash, and are cut to so many letters.
SAMPLED_A_SLICE, CUT_LENGTH = 32, 64
#: Rows of pairs made at a time.
PAIR_ROWS = 200_000
_SLICE_BITS = 40


def counted_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): runs of letters in lower case, some with one letter deleted, that are long and frequent enough.

    Where 31 divides h, the crc32 of `<doc_id>:<run>`, the letter at h % length goes. A null id is written as nothing.
    """
    run = F.explode(F.regexp_extract_all(ascii_lower(F.col(text)), F.lit(RUN), F.lit(0)))
    runs = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), run.alias("run"))
    # Shorter ones are no words with or without the deletion.
    runs = runs.where(F.length("run") >= min_length)
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.withColumn("h", h).select(F.when(F.col("h") % EDITED == 0, less).otherwise(F.col("run")).alias("word"))
    counts = words.where(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= min_count)


# ---------------------------------------------------------------- numbered trie nodes


class Slices:
    """Cut words in order, the number of every prefix of one, and the slice of a word."""

    def __init__(self, sample: list[bytes], slices: int):
        sample = sorted({w[:CUT_LENGTH] for w in sample})
        self.cuts = sorted({sample[len(sample) * i // slices] for i in range(1, slices)}) if sample else []
        self.shared = {p: i for i, p in enumerate(sorted({c[:k] for c in self.cuts for k in range(len(c) + 1)} | {b""}))}

    def of(self, word: bytes) -> int:
        return bisect_right(self.cuts, word)


def _common(a: bytes, b: bytes) -> int:
    """Length of the common beginning."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low + 1 < high:
        middle = (low + high) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle)
    return low


class Walk:
    """Numbers the nodes of words that come in order, slice after slice."""

    def __init__(self, slices: Slices):
        self.shared, self.slice = slices.shared, -1

    def nodes(self, number: int, word: bytes) -> np.ndarray:
        """Nodes of all beginnings of the word, from the empty one to the whole."""
        if number != self.slice:
            self.slice, self.word, self.path = number, b"", np.zeros(1, np.int64)
            self.next = (number + 1) << _SLICE_BITS
        path = np.empty(len(word) + 1, np.int64)
        same = _common(self.word, word)
        path[: same + 1] = self.path[: same + 1]
        at = same + 1
        while at <= len(word) and (known := self.shared.get(word[:at])) is not None:
            path[at] = known
            at += 1
        path[at:] = np.arange(self.next, self.next + len(word) + 1 - at)
        self.next += len(word) + 1 - at
        self.word, self.path = word, path
        return path


def _sliced(words: DataFrame, key: Column) -> tuple[DataFrame, Slices]:
    """The words in order within slices of even size: `slice` and `key` are added. The driver sees a bounded sample."""
    spark = words.sparkSession
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = words.withColumn("key", key)
    sample = keyed.select(F.substring("key", 1, CUT_LENGTH).alias("c"), F.xxhash64("key").alias("h")).orderBy("h", "c").limit(slices * SAMPLED_A_SLICE)
    made = Slices([r["c"].encode("latin-1") for r in sample.collect()], slices)

    @F.arrow_udf("int")
    def slice_of(column: pa.Array) -> pa.Array:
        return pa.array([made.of(w.encode("latin-1")) for w in column.to_pylist()], pa.int32())

    dealt = keyed.withColumn("slice", slice_of("key")).repartition("slice")
    return dealt.sortWithinPartitions("slice", "key"), made


_NODES = T.ArrayType(T.LongType(), False)
_NUMBERED = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("word", T.StringType()), T.StructField("n", T.LongType()), T.StructField("before", _NODES)]
)


def _lists(paths: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in paths])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(paths)))


def _slices_of(batch: dict, rows: int = 4096) -> Iterator[dict]:
    for at in range(0, len(next(iter(batch.values()))), rows):
        yield {c: a.slice(at, rows) for c, a in batch.items()}


def numbered_words(words: DataFrame) -> DataFrame:
    """(id, word, n, before): ids in code-point order of the words, and the nodes of each word's beginnings."""
    ordered, slices = _sliced(words.select("word", "n"), F.col("word"))

    def number(batches: Iterator[dict]) -> Iterator[dict]:
        walk, rank = Walk(slices), {}
        for b in batches:
            for part in _slices_of(b):
                ids, paths = [], []
                for s, word in zip(part["slice"].to_pylist(), part["word"].to_pylist()):
                    paths.append(walk.nodes(s, word.encode("latin-1")))
                    rank[s] = rank.get(s, -1) + 1
                    ids.append((s << _SLICE_BITS) + rank[s])
                yield {"id": ids, "word": part["word"], "n": part["n"], "before": _lists(paths)}

    return map_batches(ordered.select("slice", "word", "n"), number, _NUMBERED)


_SPLIT, _SKIP, _SKIP_IN_RUN = 0, 1, 2
_PAIR = T.StructType(
    [
        T.StructField("before", T.LongType()),
        T.StructField("after", T.LongType()),
        T.StructField("kind", T.IntegerType()),
        T.StructField("id", T.LongType()),
        T.StructField("n", T.LongType()),
    ]
)


def node_pairs(numbered: DataFrame) -> DataFrame:
    """Every word's pairs of nodes: between two positions, and around a skipped one (in a run: 2 but for its first)."""
    ordered, slices = _sliced(numbered, F.reverse("word"))

    def pairs(batches: Iterator[dict]) -> Iterator[dict]:
        walk = Walk(slices)
        held: list[tuple] = []
        rows = 0
        for b in batches:
            for part in _slices_of(b):
                for s, key, before, word_id, n in zip(*(part[c].to_pylist() for c in ("slice", "key")), part["before"], part["id"].to_pylist(), part["n"].to_pylist()):
                    backward = key.encode("latin-1")
                    after, size = walk.nodes(s, backward)[::-1], len(backward)
                    before = before.values.to_numpy()
                    letters = np.frombuffer(backward, np.uint8)[::-1]
                    kind = np.concatenate([np.full(size + 1, _SPLIT), [_SKIP], np.where(letters[1:] == letters[:-1], _SKIP_IN_RUN, _SKIP)])
                    held.append((np.concatenate([before, before[:-1]]), np.concatenate([after, after[1:]]), kind, np.full(len(kind), word_id), np.full(len(kind), n)))
                    rows += len(kind)
                    if rows >= PAIR_ROWS:
                        yield dict(zip(_PAIR.fieldNames(), _joined(held)))
                        held, rows = [], 0
        if held:
            yield dict(zip(_PAIR.fieldNames(), _joined(held)))

    return map_batches(ordered.select("slice", "key", "before", "id", "n"), pairs, _PAIR)


def _joined(held: list[tuple]) -> list[np.ndarray]:
    before, after, kind, ids, n = (np.concatenate(c) for c in zip(*held))
    return [before, after, kind.astype(np.int32), ids, n]


def near_words(numbered: DataFrame) -> DataFrame:
    """Per word with a near one: id, n_near and `best`, the near word of largest n, of equal ones the first in order.

    A pair's words are gathered, of which there are never more than letters and one more; most pairs have one.
    """
    member = F.struct((-F.col("n")).alias("less"), "id", "kind")
    groups = node_pairs(numbered).groupBy("before", "after").agg(F.sort_array(F.collect_list(member)).alias("words")).where(F.size("words") > 1)
    own = groups.select("words", F.explode("words").alias("w"))
    # A skipped position meets another's, and one between two positions unless it is inside a run.
    meets = lambda o: (o["id"] != F.col("w.id")) & ((o["kind"] + F.col("w.kind") == 1) | ((o["kind"] > 0) & (F.col("w.kind") > 0)))
    met = own.select(F.col("w.id").alias("id"), F.filter("words", meets).alias("near")).where(F.size("near") > 0)
    first = F.struct(F.col("near")[0]["less"].alias("less"), F.col("near")[0]["id"].alias("id"))
    return met.groupBy("id").agg(F.sum(F.size("near")).cast("long").alias("n_near"), F.min(first).alias("best"))


def _followed(forms: DataFrame) -> DataFrame:
    """(id, root) of the rows (id, to): where following `to` ends. n grows tenfold a step, so chains are short.

    Every round doubles the steps taken, until no root has a form itself.
    """
    now = scratch_table(forms.select("id", F.col("to").alias("root")), "roots")
    while True:
        onward = now.select(F.col("id").alias("root"), F.col("root").alias("further"))
        then = scratch_table(now.join(onward, "root", "left").select("id", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        release(now)
        now = then.select("id", "root")
        if not then.where("moved").limit(1).count():
            return now


def spelling_variants(words: DataFrame, ratio: int = FORM_RATIO) -> DataFrame:
    """Per word: word, n, n_near, form, form_n, root; `words` holds distinct words of Latin letters (up to U+00FF) and n.

    Near words differ by one inserted, deleted or replaced letter. The form of a word is its near word of
    largest n, of equal ones the first in code-point order, if that n is at least `ratio` (more than 1) times its own; root
    is where forms lead.
    """
    numbered = scratch_table(numbered_words(words), "words")
    near = scratch_table(near_words(numbered), "near")
    names = numbered.select("id", "word", "n")
    formed = names.join(near, "id").where(-F.col("best.less") >= ratio * F.col("n"))
    forms = scratch_table(formed.select("id", F.col("best.id").alias("to"), (-F.col("best.less")).alias("form_n")), "forms")
    named = lambda c: names.select(F.col("id").alias(c), F.col("word").alias(f"{c}_word"))
    led = forms.join(_followed(forms), "id").join(named("to"), "to").join(named("root"), "root")
    return (
        names.join(near.select("id", "n_near"), "id", "left")
        .join(led.select("id", F.col("to_word").alias("form"), "form_n", F.col("root_word").alias("root")), "id", "left")
        .select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))
    )


def spelling_report(docs: DataFrame) -> DataFrame:
    """Words of whole texts and their forms: word, n, n_near, form, form_n, root.

    A null or empty text has no words. A run of any length is one word. Repeated rows count each. A null id
    counts as the empty string in the rule that deletes letters. Other columns are ignored; an empty table, or one without
    words that are long and frequent enough, gives no rows. Only A-Z have a lower case here.
    """
    ready(docs.sparkSession)
    return spelling_variants(scratch_table(counted_words(docs), "counted"))
