"""Registered queries of the numbered operators: each maps the given tables to an operator's interface and back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.llm.conversations import repair_conversations, transcript_digests, with_missing
from trialspark.llm.decontamination import find_contamination
from trialspark.llm.hard_negatives import mine_hard_negatives
from trialspark.llm.knn_join import top_k_join
from trialspark.llm.language_id import fit_language_models, identify_language
from trialspark.llm.licenses import find_licenses
from trialspark.llm.main_text import extract_main_text
from trialspark.llm.packing import pack_texts
from trialspark.llm.passages import repeated_passages
from trialspark.llm.sharding import shard_texts
from trialspark.llm.simhash import near_duplicates
from trialspark.llm.toxicity import fit_toxicity, score_toxicity
from trialspark.llm.warc import derive_records
from trialspark.operators.ordered import join_on
from trialspark.session import small_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def eligibilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as eligibility texts: one criteria text per study."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("nct_id"), F.col("text").alias("criteria"))


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_licenses(eligibilities(spark, sf_dir))
    base = F.filter("places", lambda p: p["base"])
    names = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
    starts = F.transform(base, lambda p: p["start"].cast("long"))
    return found.select(
        F.col("nct_id").alias("doc_id"), "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), names(base).alias("base_labels"), names(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["score"])), F.lit(0.0)).alias("score"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as captured responses: a stable record id, one capture date, and the head that a plain server sends."""
    pages = table(spark, sf_dir, "pages")
    seed = F.sha1(F.concat_ws("#", F.col("page_id").cast("string"), "url"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.coalesce(F.octet_length("html"), F.lit(0)).cast("string"))
    responses = pages.select(
        "page_id", F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.substring(seed, 1, 32), "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5"), F.lit(">")).alias("record_id"),
        F.col("url").alias("target_uri"), F.lit("2026-01-01T00:00:00Z").alias("date"), head.alias("http_header"), F.col("html").alias("payload"))
    return derive_records(responses, key="page_id")


def op3_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_passages(eligibilities(spark, sf_dir))
    words = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select(F.col("nct_id").alias("doc_id"), F.col("first_nct_id").alias("first_doc_id"), "spans", words.alias("n_words"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(eligibilities(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    names = F.array_join(F.array_sort(F.transform("item_ids", lambda i: i.cast("string"))), ",")
    return found.select(F.col("nct_id").alias("doc_id"), "n_words", hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
                        F.sha2(names, 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(eligibilities(spark, sf_dir))
    return found.select(F.col("nct_id").alias("doc_id"), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
                        F.col("component").alias("component_id"))


def bucket(key: str, n: int):
    """The remainder of the CRC-32 of a key written as text."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(n))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("nct_id"), F.col("text").alias("criteria"), "lang")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("nct_id"), "toxic")
    model = fit_toxicity(docs, labels.where(bucket("nct_id", 5) != 0))
    found = score_toxicity(docs, model)
    return found.select(F.col("nct_id").alias("doc_id"), (bucket("nct_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k_join(vectors, vectors.where("vec_id % 20 = 0"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("nct_id"), F.col("text").alias("criteria"), "lang")
    models = fit_language_models(docs.where(bucket("nct_id", 4) != 2))
    found = identify_language(docs, models)
    return found.select(F.col("nct_id").alias("doc_id"), (bucket("nct_id", 4) == 2).alias("held_out"), F.col("language").alias("lang_pred"),
                        "score", "cross_entropy")


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_texts(eligibilities(spark, sf_dir)).withColumnRenamed("nct_id", "doc_id")


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with planted faults; the remainder of a hash of conversation and turn picks the fault of a row."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.pmod(F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn")).cast("binary")), F.lit(20))
    rows = turns.select("conv_id", "turn", plain("role").alias("role"), plain("text").alias("text"), fault.alias("fault")).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    repair = repair_conversations(damaged(turns))
    found = join_on(repair.report, transcript_digests(repair.transcript), ["conv_id"], "left")
    found = with_missing(found, turns.select("conv_id").distinct())
    count = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return found.select("conv_id", *map(count, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as the features of studies; every seventh label is wrong, so that hard cases exist."""
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    studies = vectors.select(F.col("vec_id").alias("nct_id"), F.col("embedding").alias("features"), label.alias("label_binary"))
    return mine_hard_negatives(studies, studies.where("nct_id % 100 = 0"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("nct_id"), F.col("text").alias("criteria"), F.col("source").alias("gender"))
    found = shard_texts(docs)
    return found.select(F.col("nct_id").alias("doc_id"), (F.col("n_bytes") + 1).alias("size"), F.col("checksum").alias("text_crc32"),
                        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_licenses": op1_licenses,
    "op2_warc": op2_warc,
    "op3_passages": op3_passages,
    "op4_decontaminate": op4_decontaminate,
    "op5_simhash": op5_simhash,
    "op6_toxicity": op6_toxicity,
    "op7_top_k": op7_top_k,
    "op8_language": op8_language,
    "op9_main_text": op9_main_text,
    "op10_packing": op10_packing,
    "op11_conversations": op11_conversations,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_sharding": op13_sharding,
}
