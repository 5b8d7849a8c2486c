"""Training corpus pipeline over the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.llm.decontamination import remove_contamination
from trialspark.llm.language_id import calibrate, fit_language_models, rejected, score_languages
from trialspark.llm.packing import pack_texts
from trialspark.llm.passages import remove_repeats
from trialspark.llm.simhash import drop_near_duplicates
from trialspark.session import small_batches

HELD, HELD_LEAST = 10, 1000  # one in so many labelled texts is held back from a language model, if there are so many of the language


def with_length(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fit no learned language go; a missing ``lang`` is filled with the predicted one."""
    small_batches(spark)
    at = docs.columns.index("lang")
    # limits come from labelled rows that the models have not seen, where a language has enough of them
    counted = docs.where("lang IS NOT NULL AND text IS NOT NULL").groupBy("lang").count().where(F.col("count") >= HELD_LEAST).collect()
    held = F.coalesce(F.col("lang").isin([r.lang for r in counted]) & (F.pmod(F.xxhash64("doc_id", "text"), F.lit(HELD)) == 0), F.lit(False))
    models = fit_language_models(docs.where(~held), text="text")
    few = F.col("lang").isNotNull() & ~F.col("lang").isin([r.lang for r in counted])
    limits = calibrate(score_languages(docs.where(held | F.coalesce(few, F.lit(False))), models, text="text"), label=f"c{at}")
    kept = score_languages(docs, models, text="text").where(~rejected(limits))
    own = [F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)]
    own[at] = F.coalesce(F.col(f"c{at}"), "language").alias("lang")
    return kept.select(*own)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the least id, stays of every group of texts of similarity 0.8 or more."""
    return drop_near_duplicates(docs, key="doc_id", text="text", shingle=1, distinct=True, distance=5, similarity=0.8)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more stay in the first document that has them; a document of nothing else goes."""
    return with_length(remove_repeats(docs, key="doc_id", text="text"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages go from the texts; a text of nothing else goes whole."""
    return with_length(remove_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), text="text"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a training sequence of 512, 2048 or 8192 tokens."""
    return pack_texts(docs, key="doc_id", text="text")


STAGES = [
    ("language_id", identify_language),
    ("simhash", drop_copies),
    ("passages", drop_repeated_passages),
    ("decontaminate", decontaminate),
    ("packing", pack),
]
ORACLE_SQL = None  # language models, min-hash windows and packing have no SQL form; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
