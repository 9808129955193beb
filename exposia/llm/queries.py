"""Queries of the numbered operators over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from exposia.llm import bloom_lm, language, oracles, transducer
from exposia.llm.fingerprints import fingerprints
from exposia.llm.importance import importance_sample
from exposia.llm.jaccard_join import jaccard_join
from exposia.llm.lexical import search
from exposia.llm.mixing import mix_sources
from exposia.llm.near_vectors import near_vectors
from exposia.llm.suffix_dedup import remove_repeats
from exposia.llm.token_files import VOCABULARY, read_documents, write_tokens
from exposia.llm.token_machine import count_tokens
from exposia.llm.warc import read_captures, write_archives

TOKENIZERS = "/opt/tokenizers"
BATCH_BYTES = 4 << 20  # of rows sent to a Python worker at once, at most about so many
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def prepare_workers(spark: SparkSession) -> None:
    """Let Python workers import this package where it lies on their disk but not on their path, and
    send them whole texts in batches bounded by bytes as well as by rows."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    size = spark.conf.get(_BATCH_SETTING, None)
    if size is None or not size.isdigit() or int(size) > BATCH_BYTES:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(_table(spark, sf_dir, "documents"))


def _remainder(divisor: int) -> Column:
    """crc32 of the doc_id as text, modulo a divisor."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % divisor


def op2_language_id(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = _remainder(4) == 2
    model = language.fit(docs, f"{tokenizers}/{language.VOCABULARY}", ~held_out)
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("row.doc_id", "lang_pred", "score").select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_sentencepiece(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    path = f"{tokenizers}/{transducer.VOCABULARY}"
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return transducer.round_trip(docs, path).select("row.doc_id", "n_ids", "ids_crc32", "text_sha256")


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(_table(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    return read_documents(write_tokens(_table(spark, sf_dir, "documents"), f"{tokenizers}/{VOCABULARY}"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return read_captures(write_archives(pages), pages)


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = _remainder(7) == 2
    found = bloom_lm.score(docs, ~held_out)
    columns = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    return found.select("row.doc_id", *columns).select("doc_id", held_out.alias("held_out"), *columns)


def op9_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op11_importance_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = (_table(spark, sf_dir, name) for name in ("documents", "benchmark"))
    found = importance_sample(docs, target, keep=["doc_id"])
    return found.select("row.doc_id", "n_features", "weight", "score", "rank")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = count_tokens(docs, vocabulary or public_tokenizers.path(VOCABULARY), keep=["doc_id"])
    return found.select("row.doc_id", "n_bytes", "n_tokens", "over_limit")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_jaccard_join, op2_language_id, op3_suffix_dedup, op4_sentencepiece, op5_document_fingerprints, op6_token_files, op7_warc,
    op8_language_model, op9_near_vectors, op10_mix_sources, op11_importance_sample, op12_lexical_search,
    op13_token_counts,
)}
ORACLES: dict[str, str] = {
    "op1_jaccard_join": oracles.JACCARD,
    "op3_suffix_dedup": oracles.REPEATS,
    "op7_warc": oracles.CAPTURES,
    "op11_importance_sample": oracles.IMPORTANCE,
    "op12_lexical_search": oracles.SEARCH,
}
