from datetime import date

from conftest import frame
from pyspark.sql import functions as F

from trialspark.functions import columns as X, filters as P


def values(df, expr):
    return [r[0] for r in df.select(expr).collect()]


def test_phase_repair_and_ordinal(spark):
    d = frame(spark, "p string", [("PHASE 4",), ("early_phase1",), ("Phase 1 / Phase 2",), (" Phase 2/3 ",), ("weird",), (None,)])
    assert values(d, X.phase_canonical("p")) == ["Phase 4", "Phase 1", "Phase 1/Phase 2", "Phase 2/Phase 3", "N/A", "N/A"]
    assert values(d, X.phase_ordinal(X.phase_canonical("p"))) == [4.0, 1.0, 1.5, 2.5, 0.0, 0.0]
    assert values(d, X.phase_ordinal(X.phase_canonical("p"), None))[-2:] == [None, None]


def test_status_forms(spark):
    d = frame(spark, "s string", [("Active, not recruiting",), ("NOT_YET_RECRUITING",), (None,)])
    assert values(d, X.status_key("s")) == ["ACTIVE_NOT_RECRUITING", "NOT_YET_RECRUITING", None]
    assert values(d, X.status_display("s")) == ["Active, Not Recruiting", "Not Yet Recruiting", None]


def test_sponsor_type_follows_agency_class(spark):
    d = frame(spark, "a string", [("Industry",), ("NIH",), (" u.s. fed",), ("Other",), (None,)])
    assert values(d, X.sponsor_type("a")) == ["industry", "government", "government", "academic", "academic"]


def test_numbers_dates_and_flags(spark):
    d = frame(spark, "v string", [("12.5",), ("x",), ("2020-02-30",), ("2020-02-03",), ("t",), ("False",), ("NaN",)])
    assert values(d, X.parse_number("v")) == [12.5, None, None, None, None, None, None]
    assert values(d, X.parse_date("v"))[2:4] == [None, date(2020, 2, 3)]
    assert values(d, X.flag("v"))[4:] == [True, False, None]


def test_duration_prefers_supplied_days_and_keeps_null(spark):
    d = frame(spark, "d double, s date, e date", [
        (100.0, date(2020, 1, 1), date(2020, 1, 3)), (None, date(2020, 1, 1), date(2020, 1, 31)),
        (None, date(2020, 1, 5), date(2020, 1, 1)), (-4.0, None, None), (None, date(2020, 1, 1), None)])
    assert values(d, X.study_duration("d", "s", "e")) == [100.0, 30.0, 0.0, 0.0, None]


def test_labels_and_failure_reason(spark):
    d = frame(spark, "s string, w string", [
        ("Completed", None), ("TERMINATED", "Slow Accrual"), ("Terminated", "Sponsor"), ("Recruiting", "accrual"), (None, None)])
    assert values(d, X.completion_label("s")) == [1.0, 0.0, 0.0, None, None]
    assert values(d, X.recruitment_failure("s", "w")) == [False, True, False, False, False]


def test_criteria_lines(spark):
    d = frame(spark, "c string", [("a\r\n\r\nb\n  \nc\rd",), ("",), (None,), ("  one",), ("\n\n",)])
    assert values(d, X.criteria_line_count("c")) == [4, 0, 0, 1, 0]
    assert values(d, X.criteria_parts_sql("c")) == [5, None, None, 1, 3]


def test_ratio_speed_and_bands(spark):
    d = frame(spark, "a double, t double", [(90.0, 100.0), (500.0, 100.0), (5.0, 0.0), (None, 10.0)])
    assert values(d, X.enrollment_ratio("a", "t")) == [0.9, 2.0, None, None]
    d = frame(spark, "d double", [(100.0,), (730.0,), (None,)])
    assert values(d, X.speed_bonus("d")) == [1.0, 0.5, 1.0]
    d = frame(spark, "p double", [(0.95,), (0.6,), (0.1,), (None,)])
    assert values(d, X.risk_band("p")) == ["Low Risk", "Moderate Risk", "High Risk", None]


def test_display_text_and_keys(spark):
    d = frame(spark, "n long, r double, d double", [(1234, 0.456, 730.5), (None, None, None)])
    assert values(d, X.thousands_text("n")) == ["1,234", "N/A"]
    assert values(d, X.percent_text("r")) == ["46%", "N/A"]
    assert values(d, X.years_text("d")) == ["2.0", "N/A"]
    d = frame(spark, "a string, b string, c string", [("x", None, "y")])
    assert values(d, X.site_key("a", "b", "c")) == ["x||y"]
    assert values(d, F.length(X.cache_key("a", "c"))) == [16]


def test_stable_round_absorbs_summation_noise(spark):
    d = frame(spark, "v double", [(0.1 + 0.2 + 0.05,), (0.35,), (2.5,)])
    assert values(d, X.stable_round("v", 1)) == [0.4, 0.4, 2.5]


def test_filters_respect_null_rules(spark):
    d = frame(spark, "s string", [("Withdrawn",), ("withdrawn ",), ("Active",), (None,)])
    assert d.where(P.not_withdrawn("s")).count() == 2
    assert d.where(P.not_withdrawn("s", keep_null=False)).count() == 1
    d = frame(spark, "c string", [("Pain (50%_x)",), ("pain 50",), (None,)])
    assert d.where(P.text_contains("c", "(50%_")).count() == 1
    d = frame(spark, "n string", [("Research Site",), ("Clinic",), (None,)])
    assert d.where(P.named_site("n")).count() == 2


def test_filter_state_empty_means_all(spark):
    d = frame(spark, "condition string, phase string, sponsor_type string, start_date date, enrollment double",
              [("A", "Phase 1", "industry", date(2020, 1, 1), 10.0), ("B", "Phase 2", "academic", date(2021, 1, 1), 90.0)])
    assert P.FilterState().apply(d).count() == 2
    assert P.FilterState(phases=("Phase 2",), min_enrollment=50).apply(d).count() == 1
    assert P.FilterState(condition_query="a", start_from=date(2020, 6, 1)).apply(d).count() == 0
