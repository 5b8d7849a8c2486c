import json

from conftest import frame

from trialspark.operators import criteria as K


def test_cache_reuse_and_fallback(spark, tmp_path):
    def count_words(text):
        if "fail" in text:
            raise ValueError(text)
        return {"words": len(text.split())}

    cache = str(tmp_path / "cache")
    d = frame(spark, "id int, text string", [(1, "a b c"), (2, "a b c"), (3, "fail here"), (4, "x")])
    first = {r["id"]: r["result"] for r in K.enrich(d, ["text"], count_words, cache, {"words": -1}).collect()}
    assert [json.loads(first[i])["words"] for i in (1, 2, 3, 4)] == [3, 3, -1, 1]
    assert spark.read.parquet(cache).count() == 3  # distinct inputs only
    more = d.unionByName(frame(spark, "id int, text string", [(5, "new text")]))
    second = {r["id"]: r["result"] for r in K.enrich(more, ["text"], count_words, cache).collect()}
    assert second[5] == '{"words": 2}' and second[3] is None
    assert spark.read.parquet(cache).where("ok").count() == 3  # hits were not analyzed again


def test_a_run_reads_only_the_buckets_of_its_inputs(spark, tmp_path):
    cache = str(tmp_path / "cache")
    many = spark.range(20_000).selectExpr("CAST(id AS STRING) AS text")
    K.enrich(many, ["text"], lambda t: {"n": len(t)}, cache)
    few = frame(spark, "text string", [(str(7000 + i),) for i in range(9)] + [("new one",)])
    keyed = few.withColumn("cache_key", K.X.cache_key("text"))
    buckets = {r[0] for r in keyed.selectExpr("substring(cache_key, 1, 2)").collect()}
    read = K._cached(spark, cache, keyed)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and len(buckets) <= 10
    assert {r.cache_key for r in read.collect()} == {r.cache_key for r in keyed.where("text <> 'new one'").collect()}
    got = {r.text: r.result for r in K.enrich(few, ["text"], lambda t: {"n": len(t)}, cache).collect()}
    assert got["new one"] == '{"n": 7}' and got["7003"] == '{"n": 4}'
    assert spark.read.parquet(cache).where("cache_key IS NOT NULL").count() == 20_001
    K.compact_cache(spark, cache, str(tmp_path / "compacted"))
    assert spark.read.parquet(str(tmp_path / "compacted")).count() == 20_001
    again = {r.text: r.result for r in K.enrich(few, ["text"], lambda t: {"n": -1}, str(tmp_path / "compacted")).collect()}
    assert again == got


RESULT = {"risk_factors": ["age", "renal", "prior"], "severity_scores": ["high", "odd"],
          "simplification_suggestions": ["widen"], "estimated_population_impact": []}


def test_risk_rows_are_padded(spark):
    d = frame(spark, "id int, result string", [(1, json.dumps(RESULT)), (2, json.dumps({"risk_factors": []})), (3, "not json")])
    rows = [tuple(r) for r in K.risk_factor_rows(d, "id").collect()]
    assert rows == [(1, 1, "age", "high", "widen", ""), (1, 2, "renal", "odd", "—", ""), (1, 3, "prior", "medium", "—", "")]
    assert [tuple(r) for r in K.severity_counts(d).collect()] == [(1, "high", 1), (2, "medium", 0), (3, "low", 0)]


def test_validation(spark):
    good = {**RESULT, "severity_scores": ["high", "low", "medium"], "simplification_suggestions": ["a"] * 3, "estimated_population_impact": ["b"] * 3}
    d = frame(spark, "id int, result string", [(1, json.dumps(RESULT)), (2, json.dumps(good))])
    assert [tuple(r) for r in K.validate_analysis(d, "id").orderBy("id").collect()] == [(1, 3, False, False), (2, 3, True, True)]


def test_comparison_rows(spark):
    result = {"differences": [{"criterion": "age", "protocol_a": "18+", "protocol_b": "21+", "more_restrictive": "B"}, {"criterion": "bmi"}],
              "enrollment_impact": ["favorable_A"]}
    d = frame(spark, "id int, result string", [(1, json.dumps(result))])
    rows = [tuple(r) for r in K.comparison_rows(d, "id").collect()]
    assert rows == [(1, 1, "age", "18+", "21+", "B", "favorable_A", "Favors A"), (1, 2, "bmi", "", "", "", "neutral", "Neutral")]
    assert K.validate_comparison(d, "id").first()["impacts_match"] is False


def test_analysis_gets_small_batches_and_odd_values(spark, tmp_path):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "10000")
    try:
        d = frame(spark, "text string, n int", [("a", 1), (None, None), ("", 2)])
        got = K.enrich(d, ["text", "n"], lambda t, n: {"t": t, "n": n}, str(tmp_path / "cache")).collect()
        assert spark.conf.get(key) == "1000"
        assert {json.loads(r["result"])["n"] for r in got if r["text"]} == {1} and len(got) == 3
        assert [json.loads(r["result"]) for r in got if r["text"] is None] == [{"t": None, "n": None}]
    finally:
        spark.conf.set(key, before)
