"""Mixing sources to target weights by entropy balancing, in DataFrame operations alone.

Among all document rates that give each source its number of words, take the ones closest to "every
document once" in relative entropy. They have the form exp(lambda * size), cut off at the largest number
of copies, with one multiplier per source. The multipliers solve a convex dual, which Newton's method
with a bracket finds; each iteration is one aggregation over (source, size) classes, for all sources
together. Rates then become whole copies by systematic rounding, size after size, so that the rounding
error of a source stays below one document.

In a source that is thinned out, longer documents get lower rates, in one that is repeated higher ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumirank.llm.common import free_name, with_key
from lumirank.plans.scratch import scratch_table

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
ITERATIONS = 80
TOLERANCE = 1e-10

_BLANKS = " \t\n\x0b\f\r"


def word_count(text: Column) -> Column:
    """Number of runs of anything but the six ASCII blanks; 0 for null."""
    marks = F.regexp_replace(text, r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", "w")
    return F.coalesce(F.length(F.translate(marks, _BLANKS, "")), F.lit(0)).cast("long")


def mixture_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """Words each source should give: (source, source_size) plus `sid` and `target`.

    Weights repeat over the sources in code point order, null last. The targets share out the words of
    all sources by weight; a target above `most` times its source stops there, and what it leaves is
    shared by the others by weight until none is above. That is a water level: sources are filled in the
    order of (most * size / weight), and the level is where the rest fits.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    everything = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    # One row per source: these windows are over as many rows as there are sources.
    ranked = sources.withColumn("sid", F.row_number().over(order))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") - 1) % len(weights) + 1)
    limit = (F.col("source_size") * most).cast("double")
    filled = W.orderBy("ratio", "sid")
    return (
        ranked.withColumn("weight", weight)
        .withColumn("limit", limit)
        .withColumn("ratio", F.col("limit") / F.col("weight"))
        .withColumn("before", F.coalesce(F.sum("limit").over(filled.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(filled.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("level", (F.sum("source_size").over(everything) - F.col("before")) / F.col("open"))
        .withColumn("step", F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "sid", "level")))
        .withColumn("final", F.coalesce(F.min("step").over(everything)["level"], F.col("ratio")))
        .select("source", "source_size", "sid", F.least("limit", F.col("weight") * F.col("final")).alias("target"))
    )


def _rate(multiplier: Column, x: Column, most: int) -> Column:
    return F.least(F.lit(float(most)), F.exp(multiplier * x))


def balance(classes: DataFrame, targets: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """Multipliers of the dual: (sid, lam, mean).

    `classes` has (sid, size, n) with size above 0, `targets` (sid, target, source_size, n_docs). The rate
    of a document is min(most, exp(lam * size / mean)). A source whose target is its limit gets rates
    of `most`, one whose target is 0 rates of 0.
    """
    infinite = F.lit(float("inf"))
    full = F.col("target") >= F.col("source_size") * most * (1 - 1e-12)
    state = targets.where("source_size > 0").select(
        "sid",
        "target",
        (F.col("source_size") / F.col("n_docs")).alias("mean"),
        F.when(full, infinite).when(F.col("target") <= 0, -infinite).otherwise(F.log(F.col("target") / F.col("source_size"))).alias("lam"),
        (-infinite).alias("lo"),
        infinite.alias("hi"),
        F.when(full | (F.col("target") <= 0), 0.0).otherwise(1.0).alias("off"),
    )
    state = scratch_table(state, "dual")
    x = F.col("size") / F.col("mean")
    for _ in range(ITERATIONS):
        if not state.where(F.col("off") > TOLERANCE).limit(1).count():
            break
        rate = _rate(F.col("lam"), x, most)
        sums = (
            classes.join(state.where(F.col("off") > TOLERANCE).select("sid", "lam", "mean"), "sid")
            .groupBy("sid")
            .agg(
                F.sum(F.col("n") * F.col("size") * rate).alias("words"),
                F.sum(F.when(rate < most, F.col("n") * F.col("size") * x * rate).otherwise(0.0)).alias("slope"),
            )
        )
        excess = F.col("words") - F.col("target")
        lo = F.when(excess < 0, F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(excess > 0, F.col("lam")).otherwise(F.col("hi"))
        newton = F.col("lam") - excess / F.col("slope")
        # Outside the bracket, or on a flat place: halve the bracket, or go on in steps that double.
        widened = F.when(excess < 0, F.col("lam") + F.abs("lam") + 1).otherwise(F.col("lam") - F.abs("lam") - 1)
        middle = F.when((lo > -infinite) & (hi < infinite), (lo + hi) / 2).otherwise(widened)
        inside = (F.col("slope") > 0) & (newton > lo) & (newton < hi)
        off = F.abs(excess) / F.greatest(F.col("target"), F.lit(1.0))
        state = scratch_table(
            state.join(sums, "sid", "left").select(
                "sid",
                "target",
                "mean",
                F.when(F.col("words").isNull() | (off <= TOLERANCE), F.col("lam")).when(inside, newton).otherwise(middle).alias("lam"),
                F.coalesce(lo, "lo").alias("lo"),
                F.coalesce(hi, "hi").alias("hi"),
                F.coalesce(off, F.col("off")).alias("off"),
            ),
            "dual",
        )
    # Sums of doubles may differ in their last digits from run to run; the rounded multiplier does not.
    return state.select("sid", F.round("lam", 9).alias("lam"), "mean")


def _correct(cells: DataFrame, most: int) -> DataFrame:
    """Add or take one copy in the cell whose size is nearest to what its source has too little or too much."""
    off = cells.groupBy("sid").agg((F.sum(F.col("copies") * F.col("size")) - F.max("target")).alias("off"))
    joined = cells.join(off, "sid")
    usable = F.when(F.col("off") > 0, F.col("copies") > 0).otherwise(F.col("copies") < F.col("n") * most)
    gap = F.abs(F.col("size") - F.abs("off"))
    better = usable & (gap < F.abs("off"))
    pick = (
        joined.where(better)
        .groupBy("sid")
        .agg(F.min(F.struct(gap.alias("gap"), "size", "salt", F.when(F.col("off") > 0, -1).otherwise(1).alias("change"))).alias("p"))
        .select("sid", "p.size", "p.salt", "p.change")
    )
    return cells.join(pick, ["sid", "size", "salt"], "left").select(
        "sid", "size", "salt", "n", "target", (F.col("copies") + F.coalesce("change", F.lit(0))).alias("copies")
    )


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    most: int = MOST_COPIES,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """How often the mix takes each document: one row per row of `docs`.

    Columns: doc_id, size (words), source, source_size, target (words of its source), rate, copies and taken
    (copies * size). Copies are 0 to `most`. A null or blank text has size 0 and is taken without words;
    a null source is a source of its own, last in order; documents of one size and source are told apart
    by a hash of doc_id, so runs agree, and rows repeated with one doc_id are treated as separate
    documents. Columns other than the three named are ignored. An empty table gives no rows.
    """
    sized = scratch_table(
        docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size")),
        "sized",
    )
    by_size = sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    sources = by_size.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum(F.when(F.col("size") > 0, F.col("n")).otherwise(0)).alias("n_docs")
    )
    sources = scratch_table(
        mixture_targets(sources.select("source", "source_size"), weights, most).alias("t")
        .join(sources.select(F.col("source").alias("name"), "n_docs"), F.col("source").eqNullSafe(F.col("name")))
        .drop("name"),
        "sources",
    )
    named = sources.select(F.col("source").alias("name"), "sid")
    classes = scratch_table(by_size.join(named, F.col("source").eqNullSafe(F.col("name"))).select("sid", "source", "size", "n"), "classes")
    dual = balance(classes.where("size > 0"), sources, most)

    # A class is cut into about as many cells as a cell has rows, so no cell and no list of cells is long.
    spread = classes.select(F.col("source").alias("name"), F.col("size").alias("of"), "sid", F.ceil(F.sqrt("n")).cast("long").alias("salts"))
    dealt = (
        sized.join(spread, F.col("source").eqNullSafe(F.col("name")) & (F.col("size") == F.col("of")))
        .withColumn("hash", F.xxhash64("doc_id"))
        .select("doc_id", "source", "sid", "size", "hash", F.pmod(F.col("hash"), F.col("salts")).alias("salt"))
    )
    cells = dealt.groupBy("sid", "size", "salt").agg(F.count(F.lit(1)).alias("n"))
    rate = F.when(F.col("size") > 0, _rate(F.col("lam"), F.col("size") / F.col("mean"), most)).otherwise(1.0)
    along = W.partitionBy("sid").orderBy("size", "salt").rowsBetween(W.unboundedPreceding, 0)
    upto = F.floor(F.sum(F.col("n") * F.col("rate")).over(along) + 0.5)
    rounded = (
        cells.join(dual, "sid", "left")
        .join(sources.select("sid", "target"), "sid")
        .withColumn("rate", rate)
        .withColumn("upto", upto)
        .withColumn("copies", F.col("upto") - F.coalesce(F.lag("upto").over(W.partitionBy("sid").orderBy("size", "salt")), F.lit(0)))
    )
    cells = scratch_table(rounded.select("sid", "size", "salt", "n", "target", "copies"), "cells")
    for _ in range(2):
        cells = scratch_table(_correct(cells, most), "cells")

    each = F.floor(F.col("copies") / F.col("n"))
    nth = F.row_number().over(W.partitionBy("sid", "size", "salt").orderBy("hash", "doc_id"))
    taken = (
        dealt.join(cells.drop("target"), ["sid", "size", "salt"])
        .withColumn("copies", (each + F.when(nth <= F.col("copies") - each * F.col("n"), 1).otherwise(0)).cast("int"))
        .join(sources.select("sid", "source_size", "target"), "sid")
        .join(dual, "sid", "left")
    )
    return taken.select(
        "doc_id",
        "size",
        "source",
        "source_size",
        "target",
        rate.alias("rate"),
        "copies",
        (F.col("copies") * F.col("size")).cast("long").alias("taken"),
    )


def repeat_to_mix(docs: DataFrame) -> DataFrame:
    """The documents of the mix with all columns, each as many times as the mix takes it."""
    rows, key = with_key(docs)
    mixed = mix_sources(rows, doc_id=key).where("copies > 0").select(F.col("doc_id").alias(key), "copies")
    copies, turn = free_name(rows, "_copies"), free_name(rows, "_turn")
    return (
        rows.join(mixed.withColumnRenamed("copies", copies), key)
        .withColumn(turn, F.explode(F.array_repeat(F.lit(0), F.col(copies))))
        .select(*docs.columns)
    )
