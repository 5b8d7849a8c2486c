from datetime import date

import pytest
from conftest import STUDIES, frame

from trialspark.operators import landscape as L
from trialspark.sources.registry import TrialTables

AS_OF = "2020-01-01"


def small(spark, statuses, facilities=None):
    rows = [(f"N{i}", "Interventional", s, "Phase 2", 100.0, None, None, date(2015, 1, 1), date(2016, 1, 1), None, None)
            for i, s in enumerate(statuses)]
    ids = [r[0] for r in rows]
    t = {
        "studies": frame(spark, STUDIES, rows),
        "conditions": frame(spark, "id long, nct_id string, name string, downcase_name string", [(i, n, "Asthma", "asthma") for i, n in enumerate(ids)]),
        "countries": frame(spark, "nct_id string, name string, removed string", [(n, "Japan", "f") for n in ids]),
        "sponsors": frame(spark, "nct_id string, name string, agency_class string, lead_or_collaborator string", [(n, "S", "Industry", "lead") for n in ids]),
    }
    if facilities is not None:
        t["facilities"] = frame(spark, "nct_id string, name string, city string, country string", facilities)
    return TrialTables.of(t)


def test_landscape_is_all_zero_without_match(spark, tables):
    r = L.landscape(tables, "no such condition", AS_OF).first()
    assert r["total_trials"] == 0 and r["total_competing_enrollment"] == 0 and r["competition_intensity"] == 0.0
    assert r["phase_breakdown"] == {} and r["top_countries"] == [] and r["temporal_density"]["last_6m"] == 0


def test_landscape_counts_and_nested_parts(spark, tables):
    r = L.landscape(tables, "BREAST", AS_OF).first()
    one = L.landscape_summary(tables, "breast", AS_OF).first()
    assert r["total_trials"] == one["total_trials"] > 0
    assert r["active_trials"] <= r["total_trials"] and sum(r["phase_breakdown"].values()) == r["active_trials"]
    counts = [c["count"] for c in r["top_countries"]]
    assert counts == sorted(counts, reverse=True)
    per = {x["condition"]: x for x in L.landscape_by_condition(tables, AS_OF).collect()}
    assert per["breast cancer"]["total_trials"] == one["total_trials"]


def test_query_text_is_literal(spark, tables):
    assert L.condition_studies(tables, "(50%_").count() == 50
    assert L.condition_studies(tables, "5_%").count() == 0


def test_intensity_methods(spark, tables):
    r = L.landscape_summary(tables, "pain", AS_OF, "damped").first()
    assert 0 <= r["competition_intensity"]
    with pytest.raises(ValueError):
        L.landscape_summary(tables, "pain", AS_OF, "other")


def test_countries_stand_in_for_facilities(spark):
    t = small(spark, ["RECRUITING"] * 3, facilities=[("other", "x", "y", "Peru")])
    assert [tuple(r) for r in L.top_countries(t, "asthma").collect()] == [("Japan", 3)]
    t = small(spark, ["RECRUITING"] * 3, facilities=[("N0", "x", "y", "Korea, Republic of"), ("N0", "z", "y", None)])
    assert [tuple(r)[:2] for r in L.site_density(t, "asthma").collect()] == [("South Korea", 1)]


def test_saturation(spark):
    few = small(spark, ["COMPLETED"] * 2 + ["Active, not recruiting"])
    assert L.recruitment_saturation(few, "asthma", "japan", AS_OF).first()["saturation"] == 0.5
    many = small(spark, ["COMPLETED"] * 4 + ["RECRUITING"] * 2)
    years = (date(2020, 1, 1) - date(2015, 1, 1)).days / 365.25
    assert L.recruitment_saturation(many, "asthma", "JAP", AS_OF).first()["saturation"] == pytest.approx(200 / (400 / years), abs=1e-4)
    assert L.recruitment_saturation(many, "asthma", "peru", AS_OF).first()["saturation"] == 0.0
    pair = L.saturation_by_pair(many, AS_OF).first()
    assert pair["saturation"] == pytest.approx(200 / (400 / years), abs=1e-4)
    wide = L.saturation_matrix(many, ["asth", "none"], ["japan", "peru"], AS_OF).collect()
    assert len(wide) == 1 and wide[0]["peru"] == 0.0


def test_market_share_counts_a_study_per_lead(spark, tables):
    base = L.market_base(tables, "a", "2010-01-01", "2030-01-01", AS_OF)
    rows = L.sponsor_market(tables, base, None).collect()
    assert sum(r["n_trials"] for r in rows) == base.count() + 1  # one study lists two leads
    assert sum(r["market_share_pct"] for r in rows) == pytest.approx(100, abs=0.1)


def test_landscape_detail(spark, tables):
    base = L.market_base(tables, "asthma", "2010-01-01", "2030-01-01", AS_OF)
    rows = L.landscape_detail(tables, base).collect()
    assert {r["total_competing_trials"] for r in rows} == {len(rows)}
    newest = max(r["start_date"] for r in rows)
    assert all((r["recency_rank"] == 1) == (r["start_date"] == newest) for r in rows)
    assert all(r["countries"] == sorted(r["countries"]) for r in rows)


def test_timeline_limits_before_dropping_phases(spark, tables):
    rows = L.timeline(tables, "pain", 10, AS_OF).collect()
    assert len(rows) < 10 and all(r["end_date"] > r["start_date"] for r in rows)
    recent = L.timeline(tables, "pain", 5, AS_OF, "recency").collect()
    assert len(recent) == 5
    with pytest.raises(ValueError):
        L.timeline(tables, "pain", 5, AS_OF, "other").collect()


def test_years_accumulate_and_rollup(spark, tables):
    base = L.market_base(tables, "pain", "2010-01-01", "2030-01-01", AS_OF)
    years = L.yearly_density(base).orderBy("start_year").collect()
    assert years[-1]["cumulative_trials"] == base.count()
    assert {r["result_type"] for r in L.market_rollup(tables, base).collect()} == {
        "sponsor_summary", "temporal_density", "phase_distribution"}
