"""Languages of documents as mixtures.

Character n-grams are counted per language over all labelled documents. A document is then taken as a
mixture: every word comes from one of its languages with the likelihood of its n-grams, and expectation
maximisation finds the proportions. Smaller sets of languages, the largest proportions first, are fitted
the same way, and the set with the best penalised likelihood is the document's; its largest
proportion names the prediction.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumirank.llm.common import held_out, map_batches, ready, with_columns_from

BUCKETS = 1 << 14
LENGTH = 3  # characters of an n-gram; a word's ends count as characters
SMOOTHING = 0.1
ROUNDS = 25
SETTLED = 1e-4  # largest change of a proportion at which a document's rounds end
UNDETERMINED = "und"
LOCAL_WORDS = 200_000
CACHE_WORDS = 150_000
LONGEST_WORD = 100
BATCH_WORDS = 200_000

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters in lower case; longer runs are cut into pieces."""
    words = _LETTERS.findall(text.lower()) if text else []
    if any(len(w) > LONGEST_WORD for w in words):
        words = [w[i : i + LONGEST_WORD] for w in words for i in range(0, len(w), LONGEST_WORD)]
    return words


def buckets_of(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams of all words, one word after the other, and how many each word has.

    The words are laid out side by side with their ends marked, as code points, so the n-grams of all of them
    come from a few operations on whole arrays.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    text = np.frombuffer((" " + "  ".join(words) + " ").encode("utf-32-le"), np.uint32).astype(np.uint64)
    hashed = np.zeros(len(text) - LENGTH + 1, np.uint64)
    for i in range(LENGTH):
        hashed = (hashed + text[i : i + len(hashed)]) * _FACTOR
    # Word w, with its two marks, begins at the sum of the lengths before it and 2 for each.
    starts = np.cumsum(sizes + 2) - (sizes + 2)
    at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    return (hashed[at] >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64), sizes


_COUNTS = T.StructType(
    [T.StructField("lang", T.StringType()), T.StructField("bucket", T.IntegerType()), T.StructField("n", T.LongType())]
)


def _count(batches: Iterator[dict]) -> Iterator[dict]:
    words: dict[str, Counter] = {}
    counts: dict[str, np.ndarray] = {}

    def settle() -> None:
        for lang, found in words.items():
            grams, sizes = buckets_of(list(found))
            times = np.repeat(np.fromiter(found.values(), np.int64, len(found)), sizes)
            added = np.bincount(grams, weights=times, minlength=BUCKETS).astype(np.int64)
            counts[lang] = counts.get(lang, 0) + added
        words.clear()

    for b in batches:
        for lang, text in zip(b["lang"].to_pylist(), b["text"].to_pylist()):
            words.setdefault(lang, Counter()).update(words_of(text))
        if sum(map(len, words.values())) > LOCAL_WORDS:
            settle()
    settle()
    for lang, into in counts.items():
        full = np.flatnonzero(into)
        yield {"lang": [lang] * len(full), "bucket": pa.array(full, pa.int32()), "n": pa.array(into[full])}


@dataclass
class Model:
    """Log-likelihood of every n-gram bucket in every language."""

    languages: list[str]
    logs: np.ndarray  # languages x buckets


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Model:
    """Count the n-grams of all documents that have a language and are not held out.

    Each task adds up its own rows before anything is shuffled. The model has one row per language and
    comes to the driver: BUCKETS numbers for each, however large the corpus is.
    """
    ready(docs.sparkSession)
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(F.col(doc_id)))
    counts = (
        map_batches(known.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")), _count, _COUNTS)
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    names = counts["lang"].to_pylist()
    languages = sorted(set(names))
    table = np.full((len(languages), BUCKETS), SMOOTHING)
    at = {name: i for i, name in enumerate(languages)}
    table[[at[n] for n in names], counts["bucket"].to_numpy()] += counts["n"].to_numpy()
    return Model(languages, np.log(table / table.sum(1, keepdims=True)) if languages else table)


def mixture(likelihood: np.ndarray, counts: np.ndarray, starts: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood of each document.

    `likelihood` has a row per (document, distinct word) and a column per language, scaled so that its
    largest is 1; `starts` are the documents' first rows; `allowed` marks each document's languages.
    """
    sizes = np.diff(np.append(starts, len(counts)))
    share = allowed / allowed.sum(1, keepdims=True)
    open_, like, n, first, size, now = np.arange(len(starts)), likelihood, counts, starts, sizes, share.copy()
    for _ in range(ROUNDS):
        joint = like * np.repeat(now, size, axis=0)
        joint *= (n / np.maximum(joint.sum(1), 1e-300))[:, None]
        new = np.add.reduceat(joint, first)
        new /= np.maximum(new.sum(1, keepdims=True), 1e-300)
        going = np.abs(new - now).max(1) >= SETTLED
        now = share[open_] = new
        if not going.any():
            break
        if going.mean() < 0.5:  # go on with the documents that have not settled
            rows = np.repeat(going, size)
            open_, like, n, size, now = open_[going], like[rows], n[rows], size[going], now[going]
            first = np.concatenate([[0], np.cumsum(size)[:-1]])
    fits = np.log(np.maximum((likelihood * np.repeat(share, sizes, axis=0)).sum(1), 1e-300))
    return share, np.add.reduceat(counts * fits, starts)


def choose(likelihood: np.ndarray, counts: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions within all languages, and within the set of best penalised likelihood (0 outside)."""
    n_langs = likelihood.shape[1]
    everything, most = mixture(likelihood, counts, starts, np.ones((len(starts), n_langs)))
    rank = np.argsort(np.argsort(-everything, axis=1, kind="stable"), axis=1)
    penalty = np.log(np.maximum(np.add.reduceat(counts, starts), 2)) / 2
    best = np.full(len(starts), -np.inf)
    chosen = np.zeros_like(everything)
    open_ = np.arange(len(starts))
    bounds = np.append(starts, len(counts))
    for size in range(1, n_langs + 1):
        rows = np.concatenate([np.arange(bounds[d], bounds[d + 1]) for d in open_])
        lengths = bounds[open_ + 1] - bounds[open_]
        at = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        share, fit_ = mixture(likelihood[rows], counts[rows], at, (rank[open_] < size).astype(float))
        value = fit_ - (size - 1) * penalty[open_]
        better = value > best[open_]
        best[open_[better]] = value[better]
        chosen[open_[better]] = share[better]
        # No set fits better than all languages do: where even that would not pay for one more, this set stays.
        open_ = open_[better]
        open_ = open_[most[open_] - size * penalty[open_] > best[open_]]
        if not len(open_):
            break
    return everything, chosen


class Guesser:
    """Predictions for lists of texts."""

    def __init__(self, model: Model):
        self.model = model
        self.logs = np.ascontiguousarray(model.logs.T)
        self.row_of: dict[str, int] = {}
        self.rows = np.zeros((1024, len(model.languages)))

    def _learn(self, words: list[str]) -> None:
        """Give new words their rows: likelihoods of their n-grams, the largest set to 1."""
        start = len(self.row_of)
        self.row_of.update(zip(words, range(start, start + len(words))))
        while len(self.rows) < len(self.row_of):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        for at in range(0, len(words), 20_000):
            grams, sizes = buckets_of(words[at : at + 20_000])
            # N-grams overlap, so each counts as one character of the word.
            logs = np.add.reduceat(self.logs[grams], np.concatenate([[0], np.cumsum(sizes)[:-1]])) / LENGTH
            made = np.exp(np.maximum(logs - logs.max(1, keepdims=True), -60))
            self.rows[start + at : start + at + len(made)] = made

    def guess(self, texts: list[str | None]) -> list[tuple[str, float, str]]:
        """(prediction, its proportion, the set with proportions) of each text."""
        out: list[tuple[str, float, str]] = [(UNDETERMINED, 0.0, "")] * len(texts)
        held: list[tuple[int, Counter]] = []
        size = 0
        for k, text in enumerate(texts):
            words = words_of(text)
            if not self.model.languages or not any(c.isalpha() for w in words for c in w):
                continue
            held.append((k, Counter(words)))
            size += len(held[-1][1])
            if size >= BATCH_WORDS:
                self._settle(held, out)
                held, size = [], 0
        if held:
            self._settle(held, out)
        return out

    def _settle(self, held: list, out: list) -> None:
        known = self.row_of
        self._learn(list(dict.fromkeys(w for _, found in held for w in found if w not in known)))
        starts = np.concatenate([[0], np.cumsum([len(found) for _, found in held])[:-1]])
        total = sum(len(found) for _, found in held)
        rows = np.fromiter((known[w] for _, found in held for w in found), np.int64, total)
        counts = np.fromiter((n for _, found in held for n in found.values()), float, total)
        everything, chosen = choose(self.rows[rows], counts, starts)
        names = self.model.languages
        top = np.argmax(chosen, axis=1)
        for (k, _), row, full, i in zip(held, chosen, everything, top):
            parts = ",".join(f"{names[j]}:{row[j]:.3f}" for j in np.argsort(-row, kind="stable") if row[j] > 0)
            out[k] = (names[i], float(min(1.0, max(0.0, full[i]))), parts)
        if len(self.row_of) > CACHE_WORDS:
            self.row_of.clear()


_FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("languages", T.StringType())]


def predict(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add lang_pred, score (the proportion of lang_pred among all languages) and `languages` (the chosen set).

    Whole texts are read. Texts that are null or have no letter, and all texts of a model without
    languages, get `und` with score 0. Ties go to the language first in code point order. Rows are
    independent; columns with the added names are replaced, others stay; an empty table gives an empty table.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable:
        guesser = Guesser(shared.value)

        def guess(texts) -> list:
            found = guesser.guess(texts.to_pylist())
            return [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.string()))]

        return guess

    return with_columns_from(df, [text], _FIELDS, make)


def language_report(docs: DataFrame) -> DataFrame:
    """Per document: held_out, lang_pred, score, languages."""
    found = predict(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "languages")
