import random

import numpy as np
import pytest
from conftest import frame
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from trialspark.operators import evaluation as V, explore as E, survival as U


@pytest.fixture(scope="module")
def scored(spark):
    r = random.Random(4)
    rows = []
    for i in range(600):
        y = int(r.random() < 0.7)
        rows.append((i, y, round(min(max(r.gauss(0.4 + 0.25 * y, 0.2), 0.0), 1.0), 2)))
    return frame(spark, "nct_id long, label int, score double", rows).cache()


def test_auc_equals_evaluator(spark, scored):
    got = V.roc_auc(scored).first()["roc_auc"]
    want = BinaryClassificationEvaluator(rawPredictionCol="score", numBins=0).evaluate(scored.withColumn("label", F.col("label").cast("double")))
    assert got == pytest.approx(want, abs=1e-9)


def test_auc_of_equal_scores_is_half(spark, scored):
    assert V.roc_auc(scored.withColumn("score", F.lit(0.3))).first()["roc_auc"] == 0.5
    assert V.roc_auc(scored.where("label = 1")).first()["roc_auc"] is None


def test_curve_and_sweep_agree(spark, scored):
    curve = {r["threshold"]: r for r in V.classification_curve(scored).collect()}
    for row in V.threshold_sweep(scored, sorted(curve)[::15]).collect():
        at = curve[row["threshold"]]
        assert (row["tp"], row["fp"], row["fn"], row["tn"]) == (at["tp"], at["fp"], at["fn"], at["tn"])
        assert row["f1_neg"] == pytest.approx(at["f1_neg"])
    best = V.best_threshold(V.classification_curve(scored)).first()
    assert best["f1_neg"] == pytest.approx(max(r["f1_neg"] for r in curve.values()))
    assert 0.7 < V.average_precision(scored).first()["average_precision"] <= 1
    # empty denominators give 0
    assert V.confusion_at(scored, 2.0).first()["precision_pos"] == 0.0


def test_split_and_folds_are_stratified(spark, scored):
    d = V.stratified_split(scored, "label")
    for r in d.groupBy("label").agg(F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect():
        assert r["t"] == round(r["n"] * 0.2)
    sizes = [r["count"] for r in V.stratified_folds(scored, "label").groupBy("label", "fold").count().collect()]
    assert len(sizes) == 10
    again = V.stratified_split(scored.repartition(5), "label")
    ids = lambda x: {r["nct_id"] for r in x.where("is_test").collect()}
    assert ids(d) == ids(again) and ids(V.stratified_split(scored, "label", seed=7)) != ids(d)


def test_regression_diagnostics(spark):
    d = frame(spark, "a double, p double", [(10.0, 8.0), (20.0, 21.0), (30.0, 27.0), (None, 1.0)])
    r = V.regression_diagnostics(d, "a", "p").first()
    assert (r["n"], r["mae"], r["bias"]) == (3, 2.0, pytest.approx(4 / 3))
    assert r["rmse"] == pytest.approx((14 / 3) ** 0.5) and r["r2"] == pytest.approx(1 - 14 / 200)
    h = {x["bin"]: x["n"] for x in V.histogram(d, "a", 0.0, 20.0, 4).collect()}
    assert h == {2: 1, 3: 2}


def test_product_limit(spark):
    d = frame(spark, "g string, t double, e boolean", [("a", 1.0, True), ("a", 2.0, True), ("a", 2.0, False), ("a", 4.0, True),
                                                       ("b", 1.0, False), ("b", 3.0, False), ("tiny", 1.0, True)])
    rows = {(r["g"], r["days"]): r["survival"] for r in U.kaplan_meier(d, "t", F.col("e"), ["g"], min_rows=2).collect()}
    assert rows == {("a", 1.0): pytest.approx(0.75), ("a", 2.0): pytest.approx(0.5), ("a", 4.0): 0.0, ("b", 1.0): 1.0, ("b", 3.0): 1.0}


def test_similar_trials_and_scenario_limit(spark):
    m = frame(spark, "nct_id string, phase_numeric double, n_facilities long, n_countries long, enrollment double, "
                     "enrollment_duration_days double, enrollment_met_target double",
              [(f"n{i}", 2.0, i, 1, 100.0, 10.0, 1.0) for i in range(20)] + [("zero", 2.0, 3, 1, 100.0, 0.0, 1.0)])
    s = E.scenario_frame(spark, [{"scenario": "s", "phase_numeric": 2.0, "n_facilities": 3, "n_countries": 1, "enrollment": 100.0}])
    got = [r["nct_id"] for r in E.similar_trials(m, s, 3).orderBy("position").collect()]
    assert got[0] == "n3" and set(got[1:]) == {"n2", "n4"}
    assert s.first()["geographic_concentration"] == 1.0


def test_describe_equals_numpy(spark, scored):
    r = V.describe(scored, "score").first()
    x = np.array([v["score"] for v in scored.select("score").collect()])
    assert [r["q1"], r["median"], r["q3"]] == pytest.approx(list(np.percentile(x, [25, 50, 75])))
    assert r["mean"] == pytest.approx(x.mean()) and r["std"] == pytest.approx(x.std(ddof=1))


def test_efron_sums_equal_the_loop():
    for d in (1, 2, 24, 25, 60, 1000, 100_000):
        for ratio in (1.0, 1.5, 40.0, 1e6):
            t = 0.7 * d
            s = np.arange(d) / d
            w = t * ratio - s * t
            want = [np.log(w).sum(), (1 / w).sum(), (s / w).sum(), (1 / w**2).sum(), (s / w**2).sum(), (s * s / w**2).sum()]
            got = [float(x[0]) for x in U.efron_sums(np.array([t * ratio]), np.array([t]), np.array([d]))]
            # the sums meet risk, tied and their products, whose size sets what counts as equal
            size = [max(1.0, abs(want[0])), want[1], max(want[2], d / t), want[3], max(want[4], d / (t * t * ratio)), max(want[5], d / (t * t))]
            assert all(abs(g - x) <= 1e-8 * z for g, x, z in zip(got, want, size)), (d, ratio)


def test_durations_survive_repeated_values_and_fractions(spark):
    from datetime import date

    from trialspark.operators import study_features as S

    studies = frame(spark, "nct_id string, start_date date, completion_date date", [("a", date(2020, 1, 1), date(2020, 3, 1)), ("b", date(2020, 1, 1), None)])
    supplied = frame(spark, "nct_id string, actual_duration double", [("a", 50.5), ("a", 60.25), ("b", None), ("b", None)])
    got = S.study_durations(studies, supplied).collect()
    assert len(got) == 2 and {r["nct_id"]: r["enrollment_duration_days"] for r in got}["b"] is None
    d = frame(spark, "t double, e boolean, g string", [(3.2, True, "x"), (3.9, False, "x"), (7.5, True, "x")])
    assert [(r["days"], r["at_risk"]) for r in U.kaplan_meier(d, "t", F.col("e"), ["g"], min_rows=2).orderBy("days").collect()] == [(3.0, 3), (7.0, 1)]


def test_labeled_and_unlabeled_studies_in_one_table(spark):
    from trialspark.ml.prep import with_unlabeled

    a, b = frame(spark, "nct_id string, y int", [("a", 1)]), frame(spark, "nct_id string, z int", [("b", 2), ("c", None)])
    assert sorted(map(tuple, with_unlabeled(a, b).select("nct_id", "is_labeled", "y", "z").collect())) == [("a", True, 1, None), ("b", False, None, 2), ("c", False, None, None)]


def test_pair_sample_is_stable_and_of_the_asked_size(spark):
    d = spark.range(5000).selectExpr("CAST(id AS STRING) AS nct_id", "id AS x")
    one, two = ({r.nct_id for r in E.pair_sample(x, ["x"], 0.1).collect()} for x in (d, d.repartition(7)))
    assert one == two and 400 < len(one) < 600
