"""Document quality from learned subword embeddings.

A document is the average of the vectors of its words and of the character n-grams of its words, all
hashed into one table; a softmax over two outputs scores it. Table and outputs are trained with plain
stochastic gradient descent in numpy on a bounded sample of labelled documents. For scoring, a word's
part in the average reduces to one number per table row, so a known word costs one lookup.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumirank.llm.common import free_name, held_out, map_batches, ready, with_columns_from

SAMPLE_ROWS = 4_000  # labelled documents the model is fitted on, at most
TABLE_ROWS = 1 << 15
DIMENSION = 10
SHORTEST, LONGEST = 2, 4  # characters of an n-gram
EPOCHS = 12
RATE = 1.0
CACHE_WORDS = 200_000
REPEATED_WEIGHT = 4  # table entries a repeated word counts for
LONGEST_WORD = 200  # characters of a piece; longer runs are cut into pieces, none is left out
KEEP_SCORE = 0.7

_BLANKS = str.maketrans("\t\n\x0b\f\r", "     ")


_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(64 - TABLE_ROWS.bit_length() + 1)


def pieces(text: str | None) -> list[str]:
    """Words of a text; a run longer than LONGEST_WORD is cut."""
    words = [w for w in text.translate(_BLANKS).split(" ") if w] if text else []
    if any(len(w) > LONGEST_WORD for w in words):
        words = [w[i : i + LONGEST_WORD] for w in words for i in range(0, len(w), LONGEST_WORD)]
    return words


def repeats(words: list[str]) -> int:
    """Pairs of neighbours that are the same word: the one word bigram that means the same for all words."""
    return sum(map(operator.eq, words, words[1:]))


def features(words: Sequence[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Table rows of words: first of the words themselves, then of their n-grams, order by order.

    Each entry has the rows of all words, one word after the other, and how many each word has. The words
    are laid out side by side as code points with their ends marked, so the rows come from a few operations
    on whole arrays.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    text = np.frombuffer(("<" + "><".join(words) + ">").encode("utf-32-le"), np.uint32).astype(np.uint64)
    starts = np.cumsum(sizes) - sizes
    place = (np.arange(len(text)) - np.repeat(starts, sizes)).astype(np.uint64)
    whole = np.add.reduceat(_mixed(text + (place << np.uint64(32))), starts)
    out = [(whole >> _SHIFT, np.ones(len(words), np.int64))]
    hashed = np.zeros(len(text) + 1, np.uint64)
    for n in range(1, LONGEST + 1):
        hashed = (hashed[: len(text) - n + 1] + text[n - 1 :]) * _FACTOR
        if n >= SHORTEST:
            count = np.maximum(sizes - n + 1, 0)
            at = np.repeat(starts - (np.cumsum(count) - count), count) + np.arange(count.sum())
            out.append((_mixed(hashed[at] + np.uint64(n)) >> _SHIFT, count))
    return [(rows.astype(np.int64), count) for rows, count in out]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _FACTOR
    return x ^ (x >> np.uint64(29))


# The last two rows of the table stand for no word.
REPEATED = TABLE_ROWS - 1  # stands for each word that is the one before it once more
END = TABLE_ROWS - 2  # stands once in every document, so empty ones have a vector too


@dataclass
class Model:
    """What scoring needs: one number per table row and the difference of the two biases."""

    pull: np.ndarray
    bias: float

    def score(self, total: float, count: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(total / count + self.bias, -500, 500))))


def train(documents: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 7) -> Model:
    """Stochastic gradient descent over (distinct rows, how often each occurs, label) per document."""
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1, 1, (TABLE_ROWS, DIMENSION)).astype(np.float32) / DIMENSION
    out, bias = np.zeros((2, DIMENSION), np.float32), np.zeros(2, np.float32)
    steps, total = 0, max(1, EPOCHS * len(documents))
    for _ in range(EPOCHS):
        for k in rng.permutation(len(documents)):
            rows, counts, label = documents[k]
            shares = (counts / counts.sum(dtype=np.int64)).astype(np.float32)
            rate = RATE * (1 - steps / total)
            steps += 1
            vectors = table[rows]
            mean = shares @ vectors
            logits = out @ mean + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[label] -= 1
            back = p @ out
            out -= rate * np.outer(p, mean)
            bias -= 0.05 * rate * p
            table[rows] = vectors - rate * np.outer(shares, back)
    return Model((table @ (out[1] - out[0])).astype(np.float64), float(bias[1] - bias[0]))


_EXAMPLE = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("rows", T.BinaryType()),
        T.StructField("counts", T.BinaryType()),
    ]
)


def _examples(batches: Iterator[dict]) -> Iterator[dict]:
    for b in batches:
        made = []
        for text in b["text"]:
            words = pieces(text.as_py())
            found = [np.array([END]), np.full(REPEATED_WEIGHT * repeats(words), REPEATED)]
            if words:
                found += [rows for rows, _ in features(words)]
            rows, counts = np.unique(np.concatenate(found), return_counts=True)
            width = 1 if (most := counts.max()) < 1 << 8 else 2 if most < 1 << 16 else 8
            made.append((rows.astype("<u2").tobytes(), counts.astype(f"<u{width}").tobytes()))
        yield {"doc_id": b["doc_id"], "label": b["label"], "rows": [m[0] for m in made], "counts": [m[1] for m in made]}


def _documents(found: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """What `train` takes, in the order of doc_id, as views of the table: nothing is copied."""
    label = found["label"].to_pylist()
    for i in pc.sort_indices(found["doc_id"]).to_pylist():
        rows = np.frombuffer(found["rows"][i].as_buffer(), "<u2")
        counts = found["counts"][i].as_buffer()
        yield rows, np.frombuffer(counts, f"<u{counts.size // len(rows)}"), label[i]


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most `sample_rows` labelled documents that are not held out, chosen by a hash of the id.

    Null labels and labels other than 0 and 1 are ignored, also labels without a document. Features are
    made on the executors; what comes back is bounded by `sample_rows` times the table, at three bytes an
    entry where none occurs more than 255 times, and is given back to the system afterwards. Without any
    labelled document every score is 0.5.
    """
    ready(docs.sparkSession)
    chosen = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("quality").cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_rows)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    found = map_batches(texts.select("doc_id", "label", "text"), _examples, _EXAMPLE).dropDuplicates(["doc_id"]).toArrow()
    model = train(list(_documents(found)))
    del found
    pa.default_memory_pool().release_unused()
    return model


def score_texts(df: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """Add `score`, 0 to 1: how likely label 1 is, from the whole text.

    A null or empty text gets the score of a document without words. Rows are independent; a column
    named `score` is replaced, others stay; an empty table gives an empty table.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable:
        m: Model = shared.value
        # Sum and number of a word's table entries, as real and imaginary part, so that one sum adds both.
        known: dict[str, complex] = {}
        start, again = complex(m.pull[END], 1), complex(m.pull[REPEATED], 1) * REPEATED_WEIGHT

        def learn(words: list[str]) -> None:
            total, count = np.zeros(len(words)), np.zeros(len(words))
            for rows, sizes in features(words):
                ends = np.cumsum(np.concatenate([[0.0], m.pull[rows]]))
                upto = np.cumsum(sizes)
                total += ends[upto] - ends[upto - sizes]
                count += sizes
            known.update(zip(words, (total + 1j * count).tolist()))

        def scores(texts) -> list:
            found = [pieces(t) for t in texts.to_pylist()]
            if len(known) > CACHE_WORDS:
                known.clear()
            new = [w for w in set().union(*found) if w not in known]
            for at in range(0, len(new), 20_000):
                learn(new[at : at + 20_000])
            look = known.__getitem__
            sums = [sum(map(look, words), start) + again * repeats(words) for words in found]
            return [pa.array([m.score(s.real, s.imag) for s in sums], pa.float64())]

        return scores

    return with_columns_from(df, [text], [T.StructField(score, T.DoubleType())], make)


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: held_out, score and predicted (1 from KEEP_SCORE on)."""
    found = score_texts(docs.select("doc_id", "text"), fit(docs, labels))
    return found.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= KEEP_SCORE, 1).otherwise(0).alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, with their columns, that the classifier does not reject."""
    score = free_name(docs, "_score")
    return score_texts(docs, fit(docs, labels), score=score).where(F.col(score) >= KEEP_SCORE).select(*docs.columns)
