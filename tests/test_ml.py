import random

import numpy as np
import pytest
from conftest import frame
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from trialspark.functions import constants as C
from trialspark.ml import explain as X, prep
from trialspark.ml.train import Forecaster
from trialspark.operators import survival as U

SMALL = {"maxIter": 4, "maxDepth": 3, "stepSize": 0.3, "minInstancesPerNode": 2}
SCHEMA = ("nct_id string, overall_status string, phase_numeric double, n_facilities long, n_countries long, n_eligibility_criteria double, "
          "geographic_concentration double, condition_prevalence_proxy long, sponsor_historical_performance double, "
          "competing_trials_count long, enrollment double, enrollment_type_is_actual int, sponsor_type string, "
          "intervention_model string, masking string, is_multicountry boolean, enrollment_met_target double, enrollment_duration_days double")


@pytest.fixture(scope="module")
def modeling(spark):
    """300 rows, 50 of them unlabeled; sponsor history drives completion."""
    r = random.Random(11)
    rows = []
    for i in range(300):
        history = r.random()
        y = None if i < 50 else float(r.random() < 0.35 + 0.6 * history)
        status = {None: "Recruiting", 1.0: "Completed", 0.0: "Terminated"}[y]
        rows.append((f"N{i}", status, r.choice([1.0, 2.0, 3.0]), r.randint(1, 40), r.randint(1, 8), None if i % 9 == 0 else float(r.randint(3, 30)),
                     r.random(), r.randint(1, 500), history, r.randint(0, 60), float(r.randint(10, 2000)), i % 2,
                     r.choice(["industry", "academic", None]), r.choice(["Parallel", "Single"]), r.choice(["None", "Double"]),
                     bool(i % 3), y, float(r.randint(30, 900)) if i % 10 else None))
    return frame(spark, SCHEMA, rows).cache()


@pytest.fixture(scope="module")
def model(modeling):
    return Forecaster(SMALL, SMALL).fit(modeling)


def test_needs_fit_target_and_enough_rows(spark, modeling):
    f = Forecaster(SMALL, SMALL)
    for call in (lambda: f.predict(modeling), lambda: f.save("/tmp/never"), lambda: f.feature_importances(spark)):
        with pytest.raises(RuntimeError):
            call()
    with pytest.raises(ValueError):
        f.fit(modeling.drop(C.CLASS_TARGET))
    with pytest.raises(ValueError):
        f.fit(modeling.limit(60))


def test_predictions_have_the_contract(modeling, model):
    rows = model.predict(modeling).collect()
    assert len(rows) == 300 and {r["nct_id"] for r in rows} == {f"N{i}" for i in range(300)}
    for r in rows:
        assert 0 <= r["p_completed"] <= 1 and 0 <= r["pred_duration_days"] <= model.duration_cap
        assert r["pred_label"] == int(r["p_completed"] >= 0.93)


def test_unseen_categories_and_absent_columns_score(modeling, model):
    odd = modeling.limit(5).withColumn("sponsor_type", F.lit("brand new")).drop("masking")
    assert model.predict(odd).count() == 5
    with pytest.warns(UserWarning):
        prep.check_columns(odd)


def test_holdout_beats_chance(modeling, model):
    r = model.evaluate(modeling).first()
    assert r["n_test"] == 50 and 0 < r["n_pos"] < 50 and r["roc_auc"] > 0.5 and 0 <= r["f1"] <= 1


def test_weight_sweep_and_cross_validation(modeling):
    from trialspark.operators.evaluation import fold_summary

    f = Forecaster({**SMALL, "maxIter": 2}, SMALL)
    assert sorted(r["positive_weight"] for r in f.weight_sweep(modeling, (1, 5)).collect()) == [1.0, 5.0]
    folds = f.cross_validate(modeling, folds=2)
    assert sum(r["n_test"] for r in folds.collect()) == 250
    r = fold_summary(folds, ["roc_auc"]).first()
    assert 0 <= r["roc_auc_mean"] <= 1 and r["roc_auc_std"] >= 0


def test_importances(spark, modeling, model):
    rows = model.feature_importances(spark).collect()
    assert len(rows) == len(model.names) and sum(r["clf_importance"] for r in rows) == pytest.approx(1)
    share = {r["feature"]: r["clf_importance"] for r in rows}
    assert share["sponsor_historical_performance"] > 1 / len(rows)
    nodes = X.node_importance(spark, model.classifier.stages[-1], model.names).collect()
    assert {r["metric"] for r in nodes} == {"gain", "weight", "cover", "total_gain"}
    assert all(0 <= r["score_norm"] <= 1 for r in nodes)
    assert X.importance_divergence(model.feature_importances(spark)).count() == min(20, len(model.names))


def test_save_and_load_predict_the_same(spark, modeling, model, tmp_path):
    model.save(str(tmp_path / "m"))
    again = Forecaster.load(spark, str(tmp_path / "m"))
    assert again.predict(modeling).exceptAll(model.predict(modeling)).count() == 0
    with pytest.raises(FileNotFoundError):
        Forecaster.load(spark, str(tmp_path / "none"))


def test_contributions_add_up(spark, modeling, model):
    rows = prep.feature_frame(modeling, ["nct_id"])
    explained = X.explain(spark, model.classifier, rows, "nct_id", model.names)
    scored = model.classifier.transform(rows).select("nct_id", vector_to_array("rawPrediction")[1].alias("margin"))
    d = explained.join(scored, "nct_id").toPandas()
    np.testing.assert_allclose(d["raw"] * 1.0, d["margin"], atol=1e-9)
    np.testing.assert_allclose(d["base"] + np.stack(d["contributions"]).sum(axis=1), d["raw"], atol=1e-9)
    assert X.mean_contributions(explained, model.names, 3).first()["feature"] == "sponsor_historical_performance"
    assert X.row_waterfall(explained, model.names, "nct_id", 4).count() == 1200


def numpy_cox(x, t, e, penalty):
    """Direct Efron Newton over the rows."""
    z = (x - x.mean(0)) / np.where(x.std(0, ddof=1) > 1e-12, x.std(0, ddof=1), 1.0)
    b, n = np.zeros(z.shape[1]), len(t)
    for _ in range(30):
        g, h = np.zeros_like(b), np.zeros((len(b), len(b)))
        r = np.exp(z @ b)
        for day in np.unique(t[e]):
            risk, dead = t >= day, (t == day) & e
            for k in range(dead.sum()):
                w = r * risk - r * dead * k / dead.sum()
                m = (w[:, None] * z).sum(0) / w.sum()
                g -= m
                h += (w[:, None, None] * z[:, :, None] * z[:, None, :]).sum(0) / w.sum() - np.outer(m, m)
            g += z[dead].sum(0)
        step = np.linalg.solve(h / n + penalty * np.eye(len(b)), g / n - penalty * b)
        b = b + step
        if np.abs(step).max() < 1e-9:
            break
    return b


def test_cox_equals_direct_newton(spark, modeling, tmp_path):
    model = U.fit_cox(modeling)
    rows = modeling.where("enrollment_duration_days >= 1")
    x = rows.select(*U.cox_covariates(rows, model.medians, model.categories).values()).toPandas().to_numpy(float)
    t = rows.select("enrollment_duration_days").toPandas().to_numpy(float)[:, 0]
    e = rows.select((F.col("overall_status") == "Completed").alias("e")).toPandas()["e"].to_numpy(bool)
    np.testing.assert_allclose(model.beta, numpy_cox(x, t, e, 0.1), atol=1e-6)
    s = model.predict_survival(modeling).select("S_t90", "S_t365", "S_t1095").toPandas()
    assert ((s >= 0) & (s <= 1)).all().all() and (s["S_t90"] >= s["S_t365"]).all() and (s["S_t365"] >= s["S_t1095"]).all()
    m = model.predict_median(modeling).select("pred_median_duration_days").toPandas().iloc[:, 0]
    assert (m > 0).all() and np.isfinite(m).any()
    assert model.hazard_ratios(spark).where("hazard_ratio < ci_low OR hazard_ratio > ci_high").count() == 0
    model.save(spark, str(tmp_path / "cox"))
    again = U.CoxModel.load(spark, str(tmp_path / "cox"))
    assert again.beta == model.beta and again.cumulative_hazard == model.cumulative_hazard


def test_cox_says_when_it_has_not_converged(modeling):
    with pytest.raises(RuntimeError, match="converged"):
        U.fit_cox(modeling, max_iter=1, tolerance=1e-14)
