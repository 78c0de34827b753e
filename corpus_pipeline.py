"""A corpus made ready for training: stages over `documents`, each written and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumirank.llm.bpe import round_trip
from lumirank.llm.common import read_table, ready
from lumirank.llm.exact_dedup import drop_copies
from lumirank.llm.jaccard import keep_one
from lumirank.llm.mixing import repeat_to_mix
from lumirank.llm.quality import keep_good
from lumirank.plans.scratch import scratch_table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the folder's labels, does not reject."""
    ready(spark)
    return keep_good(docs, read_table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the largest id."""
    ready(spark)
    return drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked shingle sets: the one with the smallest id."""
    ready(spark)
    return keep_one(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix of sources takes it."""
    ready(spark)
    return repeat_to_mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the text decoded from them."""
    ready(spark)
    done = round_trip(docs.select("doc_id", "source", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return done.select(
        "doc_id",
        "source",
        (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        "token_ids",
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("good_documents", good_documents),
    ("without_copies", without_copies),
    ("without_near_copies", without_near_copies),
    ("mixed_sources", mixed_sources),
    ("encoded", encoded),
]

#: The stages train a model, balance sources by iteration and merge byte pairs, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, in order, over the documents of a folder."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch_table(stage(spark, docs, sf_dir), name)
    return docs
