from datetime import date

import pytest
from conftest import STUDIES, frame, study_rows
from pyspark.sql import functions as F

from trialspark.operators import study_features as S
from trialspark.plans.modeling import build_modeling_table, enrollment_extract
from trialspark.sources.registry import TrialTables


def test_clean_studies(spark, tables):
    d = S.clean_studies(tables.studies)
    rows = d.collect()
    assert {r["study_type"] for r in rows} == {"Interventional"}
    assert not {r["overall_status"] for r in rows} & {"WITHDRAWN", "UNKNOWN STATUS"}
    assert {r["phase"] for r in rows} == {"Phase 4", "N/A", "Phase 2", "Phase 1", "Phase 2/Phase 3"}
    assert all(r["phase_numeric"] == 0.0 for r in rows if r["phase"] == "N/A")
    assert {r["has_dmc"] for r in rows} == {True, False}


def test_scope_filters(spark):
    base = study_rows()[0]
    rows = [base, ("old", *base[1:7], date(2000, 1, 1), *base[8:]), ("small", *base[1:4], 5.0, *base[5:]),
            ("nullstatus", base[1], None, *base[3:]), ("nostart", *base[1:7], None, *base[8:])]
    t = TrialTables.of({"studies": frame(spark, STUDIES, rows)})
    assert {r["nct_id"] for r in S.clean_studies(t.studies).collect()} == {base[0], "nullstatus"}


def test_footprint_and_hhi(spark):
    d = frame(spark, "nct_id string, name string, city string, country string, status string", [
        *[("five", "s", "c", f"C{i}", None) for i in range(5)], ("one", "s", "c", "X", "Active"), ("one", "t", "c", "X", None),
        ("none", "s", "c", None, None), ("gone", "s", "c", "X", "Withdrawn")])
    rows = {r["nct_id"]: (r["n_facilities"], r["geographic_concentration"]) for r in S.site_footprint(d).collect()}
    assert rows == {"five": (5, pytest.approx(0.2)), "one": (2, 1.0), "none": (1, None)}
    assert {r["nct_id"]: r["n_facilities"] for r in S.facility_counts(d, distinct=True).collect()}["one"] == 2


def test_first_listed_value_skips_null(spark):
    d = frame(spark, "id long, nct_id string, name string", [(3, "a", "Z"), (1, "a", None), (2, "a", "Y"), (9, "b", None)])
    assert [tuple(r) for r in S.primary_value(d, "name", "condition").collect()] == [("a", "Y")]


def test_modeling_table(spark, tables):
    m = build_modeling_table(tables).cache()
    rows = {r["nct_id"]: r for r in m.collect()}
    assert len(rows) == m.count() and m.count() > 30
    for r in rows.values():
        assert 0 < r["geographic_concentration"] <= 1 and r["n_facilities"] >= 1 and r["competing_trials_count"] >= 0
        assert 0 <= r["sponsor_historical_performance"] <= 1 and r["n_eligibility_criteria"] == 3.0
        assert r["is_multicountry"] == (r["n_countries"] > 1)
        assert r["enrollment_met_target"] == {"Completed": 1.0, "Terminated": 0.0}.get(r["overall_status"])
    assert rows["NCT0000"]["sponsor_name"] == "A Second Lead"  # one row although two leads are listed
    assert rows["NCT0000"]["condition_prevalence_proxy"] == 30
    assert any(r["terminated_for_enrollment"] for r in rows.values())


def test_defaults_without_child_tables(spark, tables):
    m = build_modeling_table(TrialTables.of({"studies": tables.studies}))
    r = m.where("nct_id = 'NCT0000'").first()
    assert (r["n_countries"], r["is_multicountry"], r["n_facilities"], r["geographic_concentration"]) == (1, False, 1, 1.0)
    assert (r["condition"], r["intervention_type"], r["sponsor_name"], r["sponsor_type"]) == ("Unknown", "Unknown", "Unknown", "academic")
    assert r["sponsor_historical_performance"] == 0.5 and r["competing_trials_count"] == 0
    assert r["n_eligibility_criteria"] is None


def test_short_durations_are_dropped(spark):
    base = list(study_rows()[0])
    rows = []
    for name, end in (("short", date(2012, 1, 4)), ("ok", date(2012, 1, 8)), ("open", None)):
        rows.append((name, *base[1:7], date(2012, 1, 1), end, *base[9:]))
    m = build_modeling_table(TrialTables.of({"studies": frame(spark, STUDIES, rows)}))
    assert {r["nct_id"] for r in m.collect()} == {"ok", "open"}


def test_criteria_row_count_stands_in_without_any_text(spark):
    d = frame(spark, "nct_id string, criteria string, gender string, healthy_volunteers string",
              [("a", None, "ALL", "f"), ("a", None, "ALL", "f"), ("b", None, "ALL", "f")])
    assert {r["nct_id"]: r["n_eligibility_criteria"] for r in S.criteria_features(d).collect()} == {"a": 2, "b": 1}


def test_sponsor_counts_scale_to_one(spark, tables):
    d = S.scaled_sponsor_performance(S.sponsor_completed_counts(tables.sponsors, S.clean_studies(tables.studies)))
    assert d.agg(F.max("sponsor_historical_performance")).first()[0] == 1.0


def test_enrollment_extract_one_row_per_study(spark, tables):
    t = TrialTables.of({**tables.present(), "calculated_values": frame(
        spark, "nct_id string, actual_duration double, number_of_facilities long, minimum_age_num double, maximum_age_num double",
        [(f"NCT{i:04d}", 100.0, 3, 18.0, 65.0) for i in range(60)])})
    rows = enrollment_extract(t).collect()
    assert len(rows) == len({r["nct_id"] for r in rows}) > 30
    assert all(r["phase_numeric"] is None for r in rows if r["phase"] == "N/A")
    assert all(r["age_window_years"] == 47.0 and r["sponsor_rank"] >= 1 for r in rows)


def test_first_conditions_are_stored_once_for_the_modeling_table(spark, tables):
    staged = []

    def stage(df):
        staged.append(df.columns)
        return df.localCheckpoint()

    build_modeling_table(tables, stage=stage)
    assert ["nct_id", "condition"] in staged


def test_country_counts_keep_no_hash_table_of_rows_for_a_distinct_count(spark):
    rows = [(1, "A", None), (1, "A", None), (1, "B", None), (1, None, None), (2, None, None), (3, "C", True), (4, "C", False)]
    counts = S.country_counts(frame(spark, "nct_id long, name string, removed boolean", rows))
    assert {r.nct_id: r.n_countries for r in counts.collect()} == {1: 2, 2: 0, 4: 1}
    assert "distinct name" not in counts._jdf.queryExecution().optimizedPlan().toString().lower()
