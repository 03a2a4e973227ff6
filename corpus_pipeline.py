"""From raw documents to packed training sequences: five stages, each on all that the one before kept.

A stage takes any table with the columns of `documents`; others are dropped,
whatever their names. Nulls in any column, empty and very long texts, repeated
rows and empty tables are defined in each stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.common import read, shared_dir, tokenizer_path
from loomline.llm.packing import pack
from loomline.llm.quality import quality
from loomline.llm.simhash import keep_one
from loomline.llm.substring import dedup_substrings
from loomline.llm.toxicity import THRESHOLD, fit, tag
from loomline.operators.lineage import remove

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
OTHERS = ("doc_id", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold.

    A null or empty text has the lowest score and stays; a very long one is
    scored whole by its likeliest toxic word. Rows that repeat are each scored.
    Without labels of both kinds, or any documents, nothing goes.
    """
    return tag(docs, fit(docs, read(spark, sf_dir, "labels")), OTHERS, carry_text=True).where(F.col("score") < THRESHOLD).select(COLUMNS)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null and empty texts have fewer than 20 words and go. A null lang is a
    language of its own name; rows that repeat are each judged, and count each
    in their language's reference.
    """
    return quality(docs, OTHERS, carry_text=True).where("kept").select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near copies.

    Null, empty and blank texts are copies of each other. Rows without an id
    come last in their group; rows that share one are told apart by their
    texts; of rows that agree in both one stays.
    """
    return keep_one(docs).select(COLUMNS)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that start earlier as well; n_chars is that of what is left.

    A null text becomes an empty one, a null id counts as the smallest; of rows
    that share an id those with equal texts get equal results, and a text that
    repeats is emptied from its first window to its last but in its first row.
    """
    out = dedup_substrings(docs, carry=("lang", "source"))
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.char_length("kept_text").cast("long").alias("n_chars"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in training sequences.

    A null or empty text is one piece, the end token; documents without an id
    come first; rows that repeat are each packed; a very long text is cut at
    sentences' ends where it can be.
    """
    return pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_low_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("substring dedup", drop_repeated_passages),
    ("packing", pack_sequences),
]

#: SQL has neither the model nor the hashes and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each one's rows are written, read again by the next, and removed after it."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for place, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{place}")
        docs = spark.read.parquet(f"{folder}/{place}")
        if place:
            remove(spark, f"{folder}/{place - 1}")
    return docs
