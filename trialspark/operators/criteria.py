"""Criteria-text jobs: cached enrichment by an injected function, and its structured results."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from trialspark.functions import columns as X, constants as C
from trialspark.session import small_batches
from trialspark.sources.registry import path_exists

ANALYSIS_SCHEMA = (
    "risk_factors array<string>, severity_scores array<string>, "
    "simplification_suggestions array<string>, estimated_population_impact array<string>"
)
COMPARISON_SCHEMA = (
    "differences array<struct<criterion:string, protocol_a:string, protocol_b:string, more_restrictive:string>>, "
    "enrollment_impact array<string>, overall_assessment string, recommendations array<string>"
)


_PREFIX = 2  # hexadecimal digits of the key that name its bucket of the cache: 256 buckets


def _cached(spark, cache_path: str, keyed: DataFrame) -> DataFrame | None:
    """The cache's answers to the keys of ``keyed``, one row a key: only the buckets that they fall into are read."""
    if not path_exists(spark, cache_path):
        return None
    bucket = F.substring("cache_key", 1, _PREFIX)
    buckets = [r[0] for r in keyed.select(bucket).distinct().collect()]  # 256 at most
    found = spark.read.schema("cache_key string, result string, ok boolean, bucket string").parquet(cache_path)
    mine = found.where(F.col("bucket").isin(buckets)).join(keyed.select("cache_key").distinct(), "cache_key", "left_semi")
    return mine.groupBy("cache_key").agg(F.max(F.struct("ok", "result")).alias("a")).select("cache_key", "a.*")


def _store(answers: DataFrame, cache_path: str, mode: str) -> None:
    """One file for each bucket, with a Bloom filter of its keys."""
    rows = answers.select("cache_key", "result", "ok", F.substring("cache_key", 1, _PREFIX).alias("bucket"))
    rows.repartition("bucket").sortWithinPartitions("bucket", "cache_key").write.option(
        "parquet.bloom.filter.enabled#cache_key", "true").mode(mode).partitionBy("bucket").parquet(cache_path)


def compact_cache(spark, cache_path: str, into: str) -> None:
    """Write the cache anew to ``into``: the best answer of every key, one file a bucket, instead of one a run."""
    best = spark.read.schema("cache_key string, result string, ok boolean, bucket string").parquet(cache_path).groupBy("cache_key").agg(
        F.max(F.struct("ok", "result")).alias("a"))
    _store(best.where("a.ok").select("cache_key", "a.*"), into, "errorifexists")


def enrich(
    df: DataFrame, parts: Sequence[str], analyze: Callable[..., dict], cache_path: str,
    fallback: dict | None = None, out: str = "result",
) -> DataFrame:
    """Add ``out``: JSON text of ``analyze(*parts)``, calling it once per distinct new input.

    Inputs are keyed by content hash. Keys found in the cache are reused; only distinct misses are analyzed, in Arrow
    batches on the executors, and appended to the cache. A failing call yields ``fallback`` for its rows and is tried again
    on the next run. The cache is parquet in buckets of the key, of which a run reads those of its inputs. The analysis runs
    while the plan is built, since its answers are kept.
    """
    spark = df.sparkSession
    keyed = df.withColumn("cache_key", X.cache_key(*parts))
    known, todo = _cached(spark, cache_path, keyed), keyed
    if known is not None:
        todo = keyed.join(known.where("ok").select("cache_key"), "cache_key", "left_anti")
    todo = todo.groupBy("cache_key").agg(*[F.first(p).alias(p) for p in parts])
    names = list(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, *values = (batch.column(c) for c in ("cache_key", *names))
            results = []
            for i in range(batch.num_rows):  # one row's texts at a time beside the batch
                try:
                    results.append(json.dumps(analyze(*(v[i].as_py() for v in values)), sort_keys=True))
                except Exception:  # noqa: BLE001 - one bad input must not fail the job
                    results.append(None)
            text = pa.array(results, pa.string())
            yield pa.RecordBatch.from_arrays([key, text, text.is_valid()], ["cache_key", "result", "ok"])

    small_batches(spark)
    _store(todo.mapInArrow(run, "cache_key string, result string, ok boolean"), cache_path, "append")
    answers = _cached(spark, cache_path, keyed).select("cache_key", F.col("result").alias(out))
    default = F.lit(None if fallback is None else json.dumps(fallback, sort_keys=True))
    return keyed.join(answers, "cache_key", "left").withColumn(out, F.coalesce(out, default))


def parse_analysis(df: DataFrame, result: str = "result") -> DataFrame:
    return df.withColumn("analysis", F.from_json(result, ANALYSIS_SCHEMA))


def _at(values: Column, i: Column, default: str) -> Column:
    return F.coalesce(F.get(values, i), F.lit(default))


def risk_factor_rows(df: DataFrame, id_col: str, result: str = "result") -> DataFrame:
    """One row per risk factor; shorter parallel lists are padded with defaults."""
    d = parse_analysis(df, result)
    rows = F.transform("analysis.risk_factors", lambda factor, i: F.struct(
        (i + 1).cast("long").alias("factor_no"),
        F.coalesce(factor, F.lit("")).alias("risk_factor"),
        _at(F.col("analysis.severity_scores"), i, "medium").alias("severity"),
        _at(F.col("analysis.simplification_suggestions"), i, "—").alias("suggestion"),
        _at(F.col("analysis.estimated_population_impact"), i, "").alias("population_impact")))
    return d.select(id_col, F.inline(rows))


def severity_counts(df: DataFrame, result: str = "result") -> DataFrame:
    """Counts of the scored severities in fixed order, zeros included."""
    scores = parse_analysis(df, result).select(F.explode("analysis.severity_scores").alias("severity"))
    one = scores.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in C.SEVERITIES])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(i + 1).cast("long").alias("position"), F.lit(s).alias("severity"), F.col(s).alias("n"))
        for i, s in enumerate(C.SEVERITIES)])))


def comparison_rows(df: DataFrame, id_col: str, result: str = "result") -> DataFrame:
    """One row per protocol difference with a readable impact label."""
    d = df.withColumn("cmp", F.from_json(result, COMPARISON_SCHEMA))
    labels = X.literal_map(C.IMPACT_LABELS)
    text = lambda diff, f: F.coalesce(diff[f], F.lit("")).alias(f)
    rows = F.transform("cmp.differences", lambda diff, i: F.struct(
        (i + 1).cast("long").alias("difference_no"),
        *[text(diff, f) for f in ("criterion", "protocol_a", "protocol_b", "more_restrictive")],
        _at(F.col("cmp.enrollment_impact"), i, "neutral").alias("impact")))
    flat = d.select(id_col, F.inline(rows))
    return flat.withColumn("impact_label", F.coalesce(labels[F.col("impact")], F.col("impact")))


def validate_analysis(df: DataFrame, id_col: str, result: str = "result") -> DataFrame:
    """Structural checks of an analysis result, one boolean per rule."""
    d = parse_analysis(df, result)
    size = lambda f: F.coalesce(F.size(F.col(f"analysis.{f}")), F.lit(-1))
    n = size("risk_factors")
    same = (n == size("severity_scores")) & (n == size("simplification_suggestions")) & (
        n == size("estimated_population_impact"))
    allowed = F.array(*[F.lit(s) for s in C.SEVERITIES])
    known = F.size(F.array_except(F.coalesce("analysis.severity_scores", F.array().cast("array<string>")), allowed)) == 0
    return d.select(id_col, F.greatest(n, F.lit(0)).cast("long").alias("n_factors"),
                    same.alias("lengths_match"), known.alias("severities_known"))


def validate_comparison(df: DataFrame, id_col: str, result: str = "result") -> DataFrame:
    d = df.withColumn("cmp", F.from_json(result, COMPARISON_SCHEMA))
    size = lambda f: F.coalesce(F.size(F.col(f"cmp.{f}")), F.lit(-1))
    return d.select(id_col, (size("differences") == size("enrollment_impact")).alias("impacts_match"))
