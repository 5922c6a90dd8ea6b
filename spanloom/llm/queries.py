"""The registered queries: each applies its operator to whole tables and derives the contract's columns."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, html, langid, mixing, phrases, quality, search, sharding, simhash, substrings, tokens, toxicity, urls
from .common import held_out, shared_dir


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = held_out(F.col("doc_id"))
    profiles = langid.learn_profiles(docs.filter(~held))
    found = langid.identify(docs.select("doc_id", "text"), profiles)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html.extract(pages, html.learn(pages))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_read(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(_read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_read(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "labels")
    model = toxicity.learn(docs, labels.filter(~held_out(F.col("doc_id"))))
    found = toxicity.score(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_offending", "worst_sentence")


def op9_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_read(spark, sf_dir, "documents"), shards=8)


def op11_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    tokens.write(_read(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return tokens.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), k=50)


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_read(spark, sf_dir, "documents"), threshold=100, longest=5, top=2000)


QUERIES = {
    "op1_langid": op1_langid,
    "op2_urls": op2_urls,
    "op3_simhash": op3_simhash,
    "op4_html": op4_html,
    "op5_mixing": op5_mixing,
    "op6_substrings": op6_substrings,
    "op7_quality": op7_quality,
    "op8_toxicity": op8_toxicity,
    "op9_decontam": op9_decontam,
    "op10_sharding": op10_sharding,
    "op11_tokens": op11_tokens,
    "op12_search": op12_search,
    "op13_phrases": op13_phrases,
}
