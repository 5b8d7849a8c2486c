"""Rollup, nearest studies, hypothetical studies, folds and explanations against plain Python."""

import math
import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from conftest import frame
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F
from test_ml import SMALL, modeling, model  # noqa: F401

from trialspark.functions import constants as C
from trialspark.ml import prep
from trialspark.ml.explain import PackedTrees
from trialspark.ml.train import DEFAULTS, Forecaster, weighted
from trialspark.operators import evaluation as V, explore as E, sites as T, survival as U
from trialspark.operators.ordered import count_at_most

PAST = "nct_id string, phase_numeric double, n_facilities long, n_countries long, enrollment double, enrollment_duration_days double, enrollment_met_target double"


def test_rollup_counts_a_study_once_in_every_group(spark):
    schema = "nct_id string, facility_name string, city string, country string, condition string, completed_flag int, enrollment_ratio double, duration_days double"
    rows = [("a", "S", "X", "J", "c", 1, 1.0, 10.0), ("a", "S", "X", "J", "c", 1, 1.0, 10.0), ("a", "T", None, "J", "c", 1, 1.0, 10.0), ("b", "S", "X", "J", None, 0, None, None),
            ("c", None, "X", "K", "c", 0, 0.5, 30.0), ("d", None, None, "K", "d", 1, 0.5, None)]
    got = {(r.result_type, r.country, r.condition, r.facility_name, r.city): r for r in T.site_rollup(frame(spark, schema, rows)).collect()}
    total = got["grand_total", None, None, None, None]
    assert (total.n_trials, total.n_unique_sites, total.n_completed, total.global_rank, total.rank_in_condition) == (4, 4, 4, 1, None)
    assert total.avg_enrollment_ratio == pytest.approx(4.0 / 5, abs=5e-4) and total.completion_rate_pct == 100.0
    c = got["condition_performance", None, "c", None, None]
    assert (c.n_trials, c.n_unique_sites, c.n_completed, c.avg_duration_days) == (2, 3, 3, 15.0)
    j = got["country_performance", "J", "c", None, None]
    assert (j.n_trials, j.n_unique_sites, j.rank_in_condition) == (1, 2, 1)
    assert got["site_performance", "J", None, "S", "X"].n_trials == 1 and got["site_performance", "J", "c", "S", "X"].n_completed == 2
    assert got["site_total", "J", None, "S", "X"].n_trials == 2 and got["site_total", "K", None, "", ""].n_trials == 1
    assert len(got) == 5 + 4 + 3 + 4 + 2 + 1
    assert T.site_rollup(frame(spark, schema, [])).where("result_type <> 'grand_total'").count() == 0


def test_nearest_studies_equal_brute_force_and_few_are_examined(spark):
    rng = random.Random(3)
    value = lambda: (rng.choice([1.0, 2.0, 3.0]), rng.randint(0, 60), rng.randint(1, 12), float(round(rng.lognormvariate(5, 1.2))))
    past = [(f"n{i:05d}", *value(), 10.0, 1.0) for i in range(3000)] + [(f"same{i:04d}", 2.0, 5, 1, 100.0, 10.0, 1.0) for i in range(1500)]
    past += [("lacks", 2.0, None, 1, 100.0, 10.0, 1.0), ("no days", 2.0, 5, 1, 100.0, None, 1.0), ("no phase", None, 5, 1, 100.0, 10.0, 1.0)]
    asked = [(f"s{i}", *value()) for i in range(2000)] + [("at the crowd", 2.0, 5, 1, 100.0), ("empty phase", 9.0, 5, 1, 100.0), ("lacks", 2.0, 5, 1, None)]
    p, s = frame(spark, PAST, past), frame(spark, "scenario string, phase_numeric double, n_facilities long, n_countries long, enrollment double", asked)
    got = {}
    for r in E.similar_trials(p, s).orderBy("scenario", "position").collect():
        got.setdefault(r.scenario, []).append((r.distance, r.nct_id))
    usable = [r for r in past if None not in r[:6]]
    arrays = {ph: [r for r in usable if r[1] == ph] for ph in (1.0, 2.0, 3.0, 9.0)}
    for name, ph, nf, nc, e in asked:
        if e is None or ph == 9.0:
            assert name not in got
            continue
        d = [(round(abs(r[3] - nc) * 0.3 + abs(r[2] - nf) * 0.01 + abs(r[4] - e) / max(e, 1.0), 9), r[0]) for r in arrays[ph]]
        want = sorted(d)[:10]
        assert [n for _, n in got[name]] == [n for _, n in want] and [x for x, _ in got[name]] == pytest.approx([x for x, _ in want], abs=2e-9)
    cells = p.where("n_facilities IS NOT NULL AND enrollment_duration_days > 0").withColumn("_cell", E._cell())
    classes = s.where("enrollment IS NOT NULL").select("scenario", "phase_numeric", *[F.col(c).alias(f"_{c}") for c in E._DISTANCE]).withColumn("_class", E._cell("_"))
    needed = E.nearest_buckets(cells, classes, 10)
    examined = needed.join(cells, ["phase_numeric", "_cell"]).join(classes, ["phase_numeric", "_class"]).count()
    everything = cells.join(classes, "phase_numeric").count()
    assert examined < everything / 5, (examined, everything)


def test_survival_between_the_days_of_the_baseline(spark, modeling):  # noqa: F811
    base = frame(spark, "day double, cumulative_hazard double", [(3.0, 0.1), (7.0, 0.4), (8.0, 1.0)])
    rows = frame(spark, "id string, risk double, own array<double>", [("a", 1.0, [0.0, 2.9, 3.0, 6.99, 7.5, 8.0, 1e9, None]), ("b", 2.0, [7.0]), ("c", None, [9.0])])
    got = {(r.id, r.t): r.survival for r in U.survival_at(rows, base, F.col("own")).collect()}
    hazard = {0.0: 0, 2.9: 0, 3.0: 0.1, 6.99: 0.1, 7.5: 0.4, 8.0: 1.0, 1e9: 1.0}
    assert all(got["a", t] == pytest.approx(math.exp(-h)) for t, h in hazard.items())
    assert got["a", None] is None and got["b", 7.0] == pytest.approx(math.exp(-0.8)) and got["c", 9.0] is None
    cox = U.fit_cox(modeling)
    wide = {r.nct_id: r for r in cox.predict_survival(modeling).collect()}
    for r in cox.predict_curve(modeling).collect():
        assert r.survival == pytest.approx(wide[r.nct_id][f"S_t{int(r.t)}"], rel=1e-12)
    risk = np.array([r.r for r in modeling.select(F.exp(cox._linear_predictor(modeling)).alias("r")).collect()])
    want = np.array([*cox.days, np.inf])[np.searchsorted(cox.cumulative_hazard, np.log(2) / risk)]
    assert np.array_equal([r[0] for r in cox.predict_median(modeling).select("pred_median_duration_days").collect()], want)


def test_binary_search_equals_bisection(spark):
    rows = [([], 1.0), ([1.0], 1.0), ([1.0, 1.0, 2.0], 1.0), (sorted(random.Random(1).random() for _ in range(1000)), 0.3), ([1.0, 2.0], None)]
    got = frame(spark, "a array<double>, b double", rows).select("a", "b", count_at_most(F.col("a"), F.col("b")).alias("le"),
                                                               count_at_most(F.col("a"), F.col("b"), strict=True).alias("lt")).collect()
    for r in got:
        if r.b is not None:
            assert (r.le, r.lt) == (sum(x <= r.b for x in r.a), sum(x < r.b for x in r.a))


def test_forecast_of_hypothetical_studies(spark, modeling, model):  # noqa: F811
    s = E.scenario_frame(spark, [{"scenario": "one", "phase_numeric": 2.0, "n_facilities": 5, "n_countries": 2, "enrollment": 200.0, "sponsor_type": "industry"},
                                 {"scenario": "bare"}])
    got = model.forecast(s, U.fit_cox(modeling), (30, 365)).collect()
    assert sorted((r.scenario, r.t) for r in got) == [("bare", 30.0), ("bare", 365.0), ("one", 30.0), ("one", 365.0)]
    for r in got:
        assert 0 <= r.survival <= 1 and r.pred_label == int(r.p_completed >= C.DECISION_THRESHOLD) and r.pred_months == pytest.approx(r.pred_duration_days / 30.4, rel=0.01)
        assert r.risk_band == ("Low Risk" if r.pred_label else "Moderate Risk" if r.p_completed >= 0.5 else "High Risk")


def test_folds_fitted_side_by_side_equal_fits_of_their_own(spark, modeling):  # noqa: F811
    f = Forecaster({**SMALL, "maxIter": 2}, SMALL)
    got = {r.fold: r for r in f.cross_validate(modeling, folds=3).collect()}
    rows = V.stratified_folds(prep.labeled_rows(modeling), C.CLASS_TARGET, "nct_id", 3, 42).cache()
    for k in range(3):
        train, test = rows.where(F.col("fold") != k), rows.where(F.col("fold") == k)
        fit = f._fit_one(weighted(prep.feature_frame(train, [C.CLASS_TARGET]), f.positive_weight), GBTClassifier(
            labelCol="label", weightCol="weight", **{**DEFAULTS, **f.classifier_params, "subsamplingRate": 1.0, "featureSubsetStrategy": "all"}))
        scored = fit.transform(prep.feature_frame(test, [C.CLASS_TARGET])).select(F.col(C.CLASS_TARGET).cast("int").alias("label"), vector_to_array("probability")[1].alias("score"))
        assert got[k].n_test == test.count() and abs(got[k].roc_auc - V.roc_auc(scored).first()["roc_auc"]) < 0.25  # trees draw their rows by partition
    full = Forecaster({**SMALL, "maxIter": 2, "subsamplingRate": 1.0, "featureSubsetStrategy": "all"}, SMALL)
    a, b = ({r.fold: r.roc_auc for r in full.cross_validate(modeling, folds=3).collect()} for _ in range(2))
    assert a == b


def grown(rng, depth, width, tree=0):
    rows, stack, n = [], [(0, 0, 1000.0)], 1
    while stack:
        node, level, cover = stack.pop()
        if level == depth or level and rng.random() < 0.1:
            rows.append((tree, node, rng.gauss(0, 1), cover, -1, -1, -1, [], -1))
            continue
        part, categorical = rng.uniform(0.1, 0.9), rng.random() < 0.2
        rows.append((tree, node, 0.0, cover, n, n + 1, rng.randrange(width), [0.0, 2.0] if categorical else [rng.gauss(0, 1)], 3 if categorical else -1))
        stack += [(n, level + 1, cover * part), (n + 1, level + 1, cover * (1 - part))]
        n += 2
    return rows


def expected(nodes, x, known, node=0):
    _, _, value, cover, left, right, feature, cut, categories = nodes[node]
    if left < 0:
        return value
    if feature in known:
        goes_left = x[feature] in cut if categories >= 0 else x[feature] <= cut[0]
        return expected(nodes, x, known, left if goes_left else right)
    share = nodes[left][3] / cover
    return share * expected(nodes, x, known, left) + (1 - share) * expected(nodes, x, known, right)


@pytest.mark.parametrize(("depth", "width", "table"), [(4, 5, 8), (7, 5, 8), (4, 5, 2)])
def test_contributions_equal_shapley_values_by_definition(depth, width, table, monkeypatch):
    monkeypatch.setattr(PackedTrees, "TABLE", table)
    rng = random.Random(depth + table)
    trees = [grown(rng, depth, width, t) for t in range(3)]
    names = ["tree", "node", "prediction", "cover", "left", "right", "feature", "cut", "categories"]
    weights = [1.0, 0.5, 2.0]
    packed = PackedTrees(pa.table({n: list(c) for n, c in zip(names, zip(*[r for t in trees for r in t], strict=True), strict=True)}), weights, width)
    x = np.array([[rng.choice([0.0, 1.0, 2.0, rng.gauss(0, 1)]) for _ in range(width)] for _ in range(6)])
    got = packed.contributions(x)
    for row, phi in zip(x, got, strict=True):
        want = np.zeros(width)
        for t, w in zip(trees, weights, strict=True):
            nodes = {r[1]: r for r in t}
            value = {s: w * expected(nodes, row, set(s)) for k in range(width + 1) for s in combinations(range(width), k)}
            for i in range(width):
                for s in (s for s in value if i not in s):
                    size = math.factorial(len(s)) * math.factorial(width - len(s) - 1) / math.factorial(width)
                    want[i] += size * (value[tuple(sorted((*s, i)))] - value[s])
        np.testing.assert_allclose(phi, want, atol=1e-9)
        assert packed.base == pytest.approx(sum(w * expected({r[1]: r for r in t}, row, set()) for t, w in zip(trees, weights, strict=True)))
