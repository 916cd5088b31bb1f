"""A corpus pipeline of five stages: language ID, n-gram Jaccard join, substring dedup, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
one's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import bpe, language_id, mixing, ngram_jaccard, substring_dedup
from spindrift.llm.common import written
from spindrift.llm.queries import RANKS


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns profiles from the labelled texts and leaves out texts without letters or like no learned language."""
    profiles = language_id.learn_profiles(docs.select("doc_id", "text", "lang").where(~language_id.held_out()))
    found = language_id.identify(docs, profiles)
    return found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= language_id.LEAST_SCORE)).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of smallest doc_id stays: five words, similarity 0.8."""
    return ngram_jaccard.one_of_each(docs, width=5, percent=80)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out passages of 35 words and more that stand anywhere else, too; texts with nothing left go."""
    found = substring_dedup.remove_repeats(docs, length=35).where("n_words = 0 or n_removed < n_words")
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast(docs.schema["n_chars"].dataType)}
    return found.select(*(new.get(c, F.col(c)).alias(c) for c in docs.columns))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes whole texts and blocks of them so that the sources have their target weights."""
    return mixing.mixed_texts(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text of the mix, and digests of the ids and of what they decode to."""
    return bpe.encode_texts(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, keep=["doc_id", "lang", "source"])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", known_language),
    ("ngram_jaccard", one_of_each_group),
    ("substring_dedup", without_repeats),
    ("mixing", mixed),
    ("bpe", encoded),
]

#: Rank-order profiles, seeded blocks and BPE merges are beyond SQL.  The tests hold the rows of the first three stages
#: against brute-force versions and BPE against the library; of the mix they hold each text's words against the plan.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
