"""From raw documents to shards: five stages, each a table that the next one reads.

Every stage but the last returns the columns of documents. Language ID drops
texts without a letter and those far from every learned profile; SimHash keeps
one document of each class of near copies (five-word shingles, similarity 0.8 or
more, verified); decontamination drops documents that hold a benchmark item;
mixing repeats or leaves documents to bring sources to their target words;
sharding places what is left.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import decontam, langid, mixing, sharding, simhash
from spanloom.llm.common import durable, held_out

#: Similarity to the nearest profile under which a text is in no learned language.
MIN_SCORE = 0.25


def _other(name: str, docs: DataFrame) -> str:
    """name, with as many underscores as set it apart from the columns of docs."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def _any_names(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """stage, for columns of any name: those that hold more than letters, digits and '_' go under plain names meanwhile."""

    @wraps(stage)
    def named(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        plain: list[str] = []
        for c in docs.columns:
            plain.append(c if re.fullmatch(r"\w+", c) else _other(f"column_{len(plain)}", docs))
        return stage(spark, docs.toDF(*plain), sf_dir).toDF(*docs.columns)

    return named


@_any_names
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs whose text is near the profile of a language learned from docs that are not held out.

    Null and blank texts and those without a letter go, as does a text far from every profile, however long it is; ties go to
    the first language by name; equal rows stay or go together; without a labelled row every row goes; an empty table gives
    an empty table; columns of any name keep their values.
    """
    profiles = langid.learn_profiles(docs.filter(~held_out(F.col("doc_id"))))
    pred, score = _other("_lang_pred", docs), _other("_score", docs)
    found = langid.identify(docs, profiles, out=(pred, score))
    return found.filter((F.col(pred) != langid.UNDETERMINED) & (F.col(score) >= MIN_SCORE)).select(*docs.columns)


@_any_names
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of docs for each class of near copies (five-word shingles, similarity 0.8 or more): that of the smallest id.

    Null and blank texts are one class; a null id comes last; of equal rows one stays; an empty table gives an empty table;
    whole texts are compared; columns of any name keep their values.
    """
    return simhash.keep_one(docs, shingle_words=5, similarity=0.8)


@_any_names
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs that hold no item of the benchmark at a weighted similarity of 0.8 or more.

    Null and blank texts hold none and stay, null and blank items are in none; equal rows stay or go together; an empty table
    gives an empty table, an empty benchmark all rows; whole texts are searched; other columns play no part.
    """
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_any_names
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs, each 0, 1 or 2 times, so that the sources' words come near their targets.

    A row without words is left out; null sources are one source; equal rows are separate documents; an empty table gives an
    empty table; columns of any name keep their values.
    """
    mixed = mixing.mix(docs, keep=docs.columns).filter("copies > 0")
    taken = mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return taken.select(*[F.col(f"in_{c}").alias(c) for c in docs.columns])


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of docs, in 8 shards of equal numbers of rows.

    A null text counts as empty; equal rows and null ids are separate rows; an empty table gives an empty table; other columns
    play no part.
    """
    return sharding.assign(docs, shards=8)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("shard", shard),
]

#: Fingerprints, profiles and draws are beyond SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        docs = docs if name == STAGES[-1][0] else durable(docs)
    return docs
