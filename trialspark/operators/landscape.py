"""Competitive landscape of a condition: funnels, density, saturation and market structure.

A condition query selects studies through a semi-join; identifiers are never collected. Every
function takes ``as_of``, the date that "now" stands for (the current date when None).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from trialspark.functions import columns as X, constants as C, filters as P
from trialspark.operators.intervals import count_overlaps
from trialspark.operators.ordered import join_on, with_rank
from trialspark.operators.study_features import lead_rows
from trialspark.session import checkpointed
from trialspark.sources.registry import TrialTables


def condition_studies(tables: TrialTables, condition: str | None) -> DataFrame:
    """Interventional studies with a matching condition (all of them for None)."""
    studies = tables.studies.where(P.interventional())
    if condition is None:
        return studies
    matched = tables.conditions.where(P.text_contains("downcase_name", condition)).select("nct_id")
    return studies.join(matched, "nct_id", "left_semi")


def _active(c="overall_status") -> Column:
    return P.status_in(C.ACTIVE_STATUSES, c)


def _status_is(value: str) -> Column:
    return F.coalesce(X.status_key("overall_status") == value, F.lit(False))


def intensity(active: Column, total: Column, method: str = "ceiling", ceiling: float = 200.0) -> Column:
    """``ceiling``: min(active / 200, 1); ``damped``: active / (total + 1) * log1p(total)."""
    if method == "ceiling":
        return X.stable_round(F.least(active / ceiling, F.lit(1.0)), 3)
    if method == "damped":
        return X.stable_round(active / (total + 1) * F.log1p(total.cast("double")), 3)
    raise ValueError(f"unknown intensity method: {method}")


def funnel_columns(as_of: Column) -> list[Column]:
    """Status funnel, recent starts and enrollment pressure, as one pass of conditional counts."""
    recent = lambda n: F.count_if(P.started_within_months("start_date", as_of, n))
    return [
        F.count(F.lit(1)).alias("total_trials"),
        F.count_if(_active()).alias("active_trials"),
        F.count_if(P.status_in(C.RECRUITING_STATUSES)).alias("recruiting_trials"),
        F.count_if(_status_is("COMPLETED")).alias("completed_trials"),
        F.count_if(_status_is("TERMINATED")).alias("terminated_trials"),
        F.coalesce(F.sum(F.when(_active(), F.col("enrollment"))), F.lit(0)).cast("long")
        .alias("total_competing_enrollment"),
        recent(6).alias("last_6m"), recent(12).alias("last_12m"), recent(24).alias("last_24m"),
    ]


def landscape_summary(tables: TrialTables, condition: str, as_of=None, method: str = "ceiling") -> DataFrame:
    """Scalar landscape metrics; all zero when nothing matches."""
    one = condition_studies(tables, condition).agg(*funnel_columns(X.as_of_date(as_of)))
    return one.select(
        F.lit(condition).alias("condition"), "*",
        intensity(F.col("active_trials"), F.col("total_trials"), method).alias("competition_intensity"))


def landscape(tables: TrialTables, condition: str, as_of=None, n: int = 10) -> DataFrame:
    """``landscape_summary`` with nested breakdowns: one row.

    The nested values hold one entry per phase, or the ``n`` largest countries and sponsors.
    """
    def listed(df: DataFrame, name: str, count: str):
        entry = F.struct((-F.col(count)).alias("neg"), F.col(name).alias("name"))
        return df.agg(F.sort_array(F.collect_list(entry))).scalar()

    phases = phase_breakdown(tables, condition).agg(
        F.map_from_entries(F.collect_list(F.struct("phase", "n_trials")))).scalar()
    one = landscape_summary(tables, condition, as_of).withColumns({
        "temporal_density": F.create_map(*[x for k in ("last_6m", "last_12m", "last_24m")
                                           for x in (F.lit(k), F.col(k))]),
        "phase_breakdown": phases,
        "top_countries": listed(top_countries(tables, condition, n), "country", "site_count"),
        "top_sponsors": listed(top_sponsors(tables, condition, n), "sponsor_name", "n_trials"),
    }).drop("last_6m", "last_12m", "last_24m")
    by_count = lambda c: F.transform(c, lambda x: F.struct(
        x["name"].alias("name"), (-x["neg"]).alias("count")))
    return one.withColumns({c: by_count(c) for c in ("top_countries", "top_sponsors")})


def landscape_by_condition(tables: TrialTables, as_of=None) -> DataFrame:
    """The summary for every condition name at once."""
    pairs = tables.conditions.where(F.col("downcase_name").isNotNull()).select(
        "nct_id", F.col("downcase_name").alias("condition")).distinct()
    studies = tables.studies.where(P.interventional())
    rows = pairs.join(studies.select("nct_id", "overall_status", "enrollment", "start_date"), "nct_id")
    return rows.groupBy("condition").agg(*funnel_columns(X.as_of_date(as_of))).withColumn(
        "competition_intensity", intensity(F.col("active_trials"), F.col("total_trials")))


def phase_breakdown(tables: TrialTables, condition: str) -> DataFrame:
    active = condition_studies(tables, condition).where(_active())
    phase = F.coalesce("phase", F.lit(C.PHASE_UNKNOWN)).alias("phase")
    return active.groupBy(phase).agg(F.count(F.lit(1)).alias("n_trials"))


def temporal_density(tables: TrialTables, condition: str, as_of=None, months: Sequence[int] = (6, 12, 24)) -> DataFrame:
    now = X.as_of_date(as_of)
    return condition_studies(tables, condition).agg(*[
        F.count_if(P.started_within_months("start_date", now, m)).alias(f"last_{m}m") for m in months])


def _site_counts(tables: TrialTables, trials: DataFrame) -> DataFrame:
    """(country, site_count) from facilities, or from countries when no facility row matches."""
    ids = trials.select("nct_id")
    frames = []
    has_sites = None
    if tables.facilities is not None:
        sites = tables.facilities.join(ids, "nct_id", "left_semi")
        has_sites = sites.select(F.lit(True)).limit(1).scalar()
        frames.append(sites.where(F.col("country").isNotNull()).select("country"))
    if tables.countries is not None:
        listed = tables.countries.join(ids, "nct_id", "left_semi").where(F.col("name").isNotNull())
        if has_sites is not None:
            listed = listed.where(has_sites.isNull())
        frames.append(listed.select(F.col("name").alias("country")))
    rows = frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])
    return rows.groupBy("country").agg(F.count(F.lit(1)).alias("site_count"))


def top_countries(tables: TrialTables, condition: str, n: int = 10) -> DataFrame:
    counts = _site_counts(tables, condition_studies(tables, condition))
    return counts.orderBy(F.col("site_count").desc(), "country").limit(n)


def top_sponsors(tables: TrialTables, condition: str, n: int = 10) -> DataFrame:
    """Lead sponsors of active studies by number of rows."""
    active = condition_studies(tables, condition).where(_active()).select("nct_id")
    rows = lead_rows(tables.sponsors).join(active, "nct_id", "left_semi").where(F.col("name").isNotNull())
    counts = rows.groupBy(F.col("name").alias("sponsor_name")).agg(F.count(F.lit(1)).alias("n_trials"))
    return counts.orderBy(F.col("n_trials").desc(), "sponsor_name").limit(n)


def site_density(tables: TrialTables, condition: str) -> DataFrame:
    """Sites per country with map-ready names and log-scaled counts."""
    counts = _site_counts(tables, condition_studies(tables, condition))
    named = counts.select(X.country_canonical("country").alias("country_name"), "site_count")
    return named.where(P.not_blank("country_name")).withColumn("log_sites", X.log_scaled("site_count"))


def timeline(
    tables: TrialTables, condition: str, max_trials: int = 40, as_of=None, order: str = "enrollment"
) -> DataFrame:
    """Bars of a timeline: largest (``order='enrollment'``) or latest (``'recency'``) studies.

    Studies without end run to ``as_of`` (enrollment order) or are left out (recency order). The
    largest are taken before undefined phases are dropped, so fewer than ``max_trials`` may remain.
    """
    d = condition_studies(tables, condition).withColumn("phase", X.phase_canonical("phase"))
    if order == "enrollment":
        d = d.withColumn("end_date", F.coalesce("completion_date", X.as_of_date(as_of)))
        first = F.col("enrollment").desc_nulls_last()
    elif order == "recency":
        d = d.withColumn("end_date", F.col("completion_date"))
        first = F.col("start_date").desc_nulls_last()
    else:
        raise ValueError(f"unknown timeline order: {order}")
    d = d.where(P.valid_interval(F.col("start_date"), F.col("end_date")))
    d = d.orderBy(first, "nct_id").limit(max_trials)
    if order == "enrollment":
        d = d.where(F.col("phase").isin(*C.TIMELINE_PHASES))
    return d.select(
        "nct_id", X.short_label("brief_title", "nct_id").alias("label"), "phase",
        F.coalesce("overall_status", F.lit("Unknown")).alias("status"),
        "start_date", "end_date", "enrollment",
        X.thousands_text(F.col("enrollment").cast("long")).alias("enrollment_text"),
    ).orderBy("start_date", "nct_id")


# ---- recruitment saturation ---------------------------------------------------

def _saturation(as_of: Column) -> tuple[list[Column], Column]:
    done = _status_is("COMPLETED")
    aggs = [
        F.count_if(_active()).alias("active_trials"),
        F.count_if(done).alias("completed_trials"),
        F.coalesce(F.sum(F.when(_active(), F.col("enrollment"))), F.lit(0.0)).alias("active_enrollment"),
        F.avg(F.when(done, F.col("enrollment"))).alias("_mean"),
        F.min(F.when(done, F.col("start_date"))).alias("_earliest"),
    ]
    years = F.greatest(F.coalesce(F.datediff(as_of, "_earliest") / 365.25, F.lit(1.0)), F.lit(1.0))
    capacity = F.coalesce(F.col("_mean"), F.lit(0.0)) * F.col("completed_trials") / years
    by_count = F.least(F.col("active_trials") / F.greatest(F.col("completed_trials"), F.lit(1)), F.lit(1.0))
    score = F.when((F.col("completed_trials") < 3) | (F.col("active_enrollment") == 0), by_count).otherwise(
        F.col("active_enrollment") / F.greatest(capacity, F.lit(1.0)))
    return aggs, X.stable_round(score, 4)


def recruitment_saturation(
    tables: TrialTables, condition: str, country: str, as_of=None, pattern: bool = False
) -> DataFrame:
    """Active demand over yearly historical capacity in one country; 0 when nothing matches."""
    found = P.text_matches("name", country) if pattern else P.text_contains("name", country)
    here = tables.countries.where(found).select("nct_id")
    rows = condition_studies(tables, condition).join(here, "nct_id", "left_semi")
    aggs, score = _saturation(X.as_of_date(as_of))
    return rows.agg(*aggs).select(
        F.lit(condition).alias("condition"), F.lit(country).alias("country"),
        "active_trials", "completed_trials", "active_enrollment", score.alias("saturation"))


def _matched(name: str, queries: Sequence[str]) -> Column:
    """The queries a name contains, one row each; rows without any are dropped."""
    wanted = F.array(*[F.lit(q) for q in queries])
    return F.explode(F.filter(wanted, lambda q: F.contains(F.lower(F.col(name)), F.lower(q))))


def saturation_by_pair(
    tables: TrialTables, as_of=None, conditions: Sequence[str] | None = None,
    countries: Sequence[str] | None = None,
) -> DataFrame:
    """Saturation of every (condition, country) in one pass, long form.

    With lists given, a name counts for every query it contains; otherwise exact names are grouped.
    """
    label = lambda queries, name: F.col(name) if queries is None else _matched(name, queries)
    cond = tables.conditions.select("nct_id", label(conditions, "downcase_name").alias("condition"))
    place = tables.countries.select("nct_id", label(countries, "name").alias("country"))
    cond = cond.where(F.col("condition").isNotNull()).distinct()
    place = place.where(F.col("country").isNotNull()).distinct()
    studies = tables.studies.where(P.interventional()).select("nct_id", "overall_status", "enrollment", "start_date")
    rows = studies.join(cond, "nct_id").join(place, "nct_id")
    aggs, score = _saturation(X.as_of_date(as_of))
    return rows.groupBy("condition", "country").agg(*aggs).select(
        "condition", "country", "active_trials", "completed_trials", score.alias("saturation"))


def saturation_matrix(
    tables: TrialTables, conditions: Sequence[str], countries: Sequence[str], as_of=None
) -> DataFrame:
    """One row per condition query, one column per country query; 0 where no study matches."""
    long = saturation_by_pair(tables, as_of, conditions, countries)
    wide = long.groupBy("condition").pivot("country", list(countries)).agg(F.max("saturation"))
    return wide.fillna(0.0, subset=list(countries))


# ---- market of a condition and date window --------------------------------------

def market_base(tables: TrialTables, condition: str, window_start, window_end, as_of=None) -> DataFrame:
    """Competing or completed studies of the condition that meet the window."""
    low, high = (F.lit(str(x)).cast("date") for x in (window_start, window_end))
    end = F.coalesce("completion_date", "primary_completion_date", F.add_months(X.as_of_date(as_of), 60))
    rows = condition_studies(tables, condition).where(P.status_in(C.MARKET_STATUSES))
    rows = rows.where(P.overlaps_window(F.col("start_date"), end, low, high))
    return rows.select(
        "nct_id", "brief_title", "overall_status", "phase", F.col("enrollment").alias("target_enrollment"),
        "start_date", "completion_date", "primary_completion_date",
        F.year("start_date").alias("start_year"), end.alias("effective_end"))


def _leads(tables: TrialTables) -> DataFrame:
    return lead_rows(tables.sponsors).select("nct_id", F.col("name").alias("sponsor_name"), "agency_class")


def sponsor_market(tables: TrialTables, base: DataFrame, n: int | None = 20) -> DataFrame:
    """Distinct trials, demand and market share per lead sponsor."""
    rows = base.join(_leads(tables), "nct_id", "left")
    grouped = rows.groupBy("sponsor_name", "agency_class").agg(
        F.count_distinct("nct_id").alias("n_trials"), F.sum("target_enrollment").alias("total_target_enrollment"))
    all_trials = grouped.agg(F.sum("n_trials")).scalar()
    out = grouped.withColumn("market_share_pct", X.stable_round(F.col("n_trials") / all_trials * 100, 2))
    if n is None:
        return out
    return out.orderBy(
        F.col("n_trials").desc(), F.col("sponsor_name").asc_nulls_last(), F.col("agency_class").asc_nulls_last()
    ).limit(n)


def yearly_density(base: DataFrame) -> DataFrame:
    """Starts and demand per year with a running total."""
    running = Window.orderBy("start_year").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per_year = base.groupBy("start_year").agg(
        F.count(F.lit(1)).alias("new_trials_started"), F.sum("target_enrollment").alias("new_enrollment_targets"))
    return per_year.withColumn("cumulative_trials", F.sum("new_trials_started").over(running))


def phase_distribution(base: DataFrame) -> DataFrame:
    per_phase = base.groupBy("phase").agg(
        F.count(F.lit(1)).alias("n_trials"), F.sum("target_enrollment").alias("total_enrollment"),
        X.stable_round(F.avg("target_enrollment"), 0).alias("avg_enrollment_per_trial"))
    return with_rank(per_phase, [("n_trials", True)], "phase_rank")


def trial_countries(countries: DataFrame) -> DataFrame:
    """Sorted distinct countries of every study and their number."""
    kept = countries.where(P.not_removed(keep_null=False) & F.col("name").isNotNull())
    names = F.sort_array(F.collect_set("name"))
    return kept.groupBy("nct_id").agg(names.alias("countries")).withColumn(
        "n_countries", F.size("countries").cast("long"))


def landscape_detail(tables: TrialTables, base: DataFrame, concurrent: bool = True) -> DataFrame:
    """One row per competing study and lead sponsor, with market totals and ranks.

    Totals come from a scalar subquery and ranks from counts per start date, so no window spans the
    whole market.
    """
    base = checkpointed(base)  # the matched studies only; read by every part below
    rows = base
    if concurrent:
        rows = count_overlaps(base, end="effective_end", open_end=None, out="concurrent_competitors")
    rows = rows.join(_leads(tables), "nct_id", "left").join(trial_countries(tables.countries), "nct_id", "left")
    totals = base.join(_leads(tables), "nct_id", "left").agg(
        F.sum("target_enrollment").alias("total_market_enrollment_target"),
        F.count(F.lit(1)).alias("total_competing_trials"))
    rows = join_on(rows, totals, [])
    share = F.col("target_enrollment") / F.nullif(F.col("total_market_enrollment_target"), F.lit(0.0)) * 100
    rows = rows.withColumn("this_trial_enrollment_share_pct", X.stable_round(share, 2))
    return with_rank(rows, [("start_date", True)], "recency_rank").drop("effective_end")


def market_rollup(tables: TrialTables, base: DataFrame) -> DataFrame:
    """Sponsor, year and phase results in one long table tagged by ``result_type``."""
    text = lambda c: F.col(c).cast("string").alias("dimension")
    sponsors = sponsor_market(tables, base).select(
        F.lit("sponsor_summary").alias("result_type"), text("sponsor_name"), "n_trials",
        F.col("total_target_enrollment").alias("enrollment"))
    years = yearly_density(base).select(
        F.lit("temporal_density").alias("result_type"), text("start_year"),
        F.col("new_trials_started").alias("n_trials"), F.col("new_enrollment_targets").alias("enrollment"))
    phases = phase_distribution(base).select(
        F.lit("phase_distribution").alias("result_type"), text("phase"), "n_trials",
        F.col("total_enrollment").alias("enrollment"))
    return sponsors.unionByName(years).unionByName(phases)
