"""A corpus pipeline: from documents to token ids in five stages.

Each stage is a function ``(spark, docs, sf_dir) -> DataFrame``; its result is written and read again
as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from exposia.llm import language, mixing, queries, transducer
from exposia.llm.jaccard_join import jaccard_groups
from exposia.llm.suffix_dedup import remove_repeats
from exposia.sources.staging import materialize

ORACLE_SQL = None  # no stage but the counting part of the mix can be said in SQL


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language of the model; texts without a letter, empty or null go."""
    queries.prepare_workers(spark)
    model = language.fit(docs, f"{queries.TOKENIZERS}/{language.VOCABULARY}", F.lit(True))
    found = language.identify(docs, model)
    return found.filter(F.col("lang_pred") != language.UNKNOWN).select("row.*")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each group of near copies; rows that repeat another go too.

    Rows without doc_id come after all others, rows with one doc_id are ordered by a hash of their text.
    """
    queries.prepare_workers(spark)
    found = materialize(jaccard_groups(docs), "joined")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "mark")
    least = found.filter("label is not null").groupBy("label").agg(F.min(order).alias("least"))
    alone = found.filter("label is null").select("doc_id", "mark")
    kept = least.select("least.doc_id", "least.mark").union(alone).toDF("_id", "_mark")
    if not found.groupBy("doc_id", "mark").count().filter("count > 1").isEmpty():
        docs = docs.dropDuplicates(["doc_id", "text"])
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_mark"))
    return docs.join(kept, same, "left_semi")


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without bytes that an earlier 100-byte string covers; ``n_chars`` is counted again."""
    queries.prepare_workers(spark)
    left = remove_repeats(docs).select("row.*", F.col("kept_text").alias("text"))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.take(docs, mixing.mix_sources(docs))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the text that they give back."""
    queries.prepare_workers(spark)
    found = transducer.round_trip(docs, f"{queries.TOKENIZERS}/{transducer.VOCABULARY}")
    return found.select("row.*", "ids", "n_ids", "text")


STAGES = [
    ("language_id", identified),
    ("jaccard_join", without_near_copies),
    ("suffix_dedup", without_repeats),
    ("mix_sources", mixed),
    ("sentencepiece", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
