import pytest
from check_oracles import compare, duck

from oracle_queries import build
from trialspark.plans.registered import REGISTERED

from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"
SQL = build()
ROWS_ONLY = {"train_classifier", "train_regressor", "score", "feature_importance", "tree_node_importance",
             "importance_divergence", "explain_scores", "cox_coefficients", "survival_probabilities", "scenario_forecast", "cross_validation", "weight_sweep",
             "kpi_summary_sketched"}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_sql_has_a_query_and_the_rest_is_known():
    assert set(SQL) <= set(REGISTERED) <= set(queries()) and set(SQL) <= set(oracle_sql())
    assert set(REGISTERED) - set(SQL) == ROWS_ONLY


def test_entry(spark):
    assert entry(spark).count() > 0


def test_sketched_kpis_are_near_the_exact_ones(spark):
    for sf in (SF, "/root/testdata/sf0.01"):
        exact, near = (REGISTERED[n](spark, sf).first() for n in ("kpi_summary", "kpi_summary_sketched"))
        assert near["n_trials"] == exact["n_trials"]
        assert all(abs(near[c] - exact[c]) <= 0.02 * exact[c] for c in ("n_conditions", "n_countries"))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    n, ok, note = compare(spark, con, SF, name, SQL[name])
    assert ok, note
