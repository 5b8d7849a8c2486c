"""The one-row-per-study modeling table and the SQL-style enrollment extract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from trialspark.functions import columns as X, constants as C, filters as P
from trialspark.operators import study_features as S
from trialspark.operators.intervals import count_overlaps
from trialspark.operators.ordered import exact_percentiles
from trialspark.sources.registry import TrialTables


def _typed_null(kind: str):
    return F.lit(None).cast(kind)


def _with_frequency(df: DataFrame, frequency: DataFrame) -> DataFrame:
    """``df`` plus ``condition_prevalence_proxy`` of its ``condition``."""
    df = df.withColumn("condition_lower", F.lower("condition"))
    return df.join(frequency, "condition_lower", "left").drop("condition_lower")


def primary_conditions(tables: TrialTables, first: DataFrame | None = None) -> DataFrame:
    """(nct_id, condition, condition_prevalence_proxy); ``first`` has the studies' conditions if they are known."""
    first = S.primary_value(tables.conditions, "name", "condition") if first is None else first
    return _with_frequency(first, S.condition_frequency(tables.conditions))


def competing_trials(cleaned: DataFrame, conditions: DataFrame, open_end="2035-12-31", inverted: bool | None = None,
                     first: DataFrame | None = None) -> DataFrame:
    """(nct_id, competing_trials_count): other studies of the same condition, overlapping in time.

    ``inverted`` as in ``count_overlaps``: None looks at the intervals at once, True leaves the plan lazy. ``first`` has the
    studies' conditions if they are known, unless ``cleaned`` has them itself.
    """
    d = cleaned
    if "condition" not in cleaned.columns:
        first = S.primary_value(conditions, "name", "condition") if first is None else first
        d = cleaned.select("nct_id", "start_date", "completion_date").join(first, "nct_id", "left")
    d = d.select(
        "nct_id", "start_date", "completion_date",
        F.coalesce(F.lower("condition"), F.lit("")).alias("condition_lower"))
    counted = count_overlaps(d, by=["condition_lower"], open_end=open_end, out="competing_trials_count", inverted=inverted)
    # One row per study as far as the optimizer knows: it can drop this join where the count is unused.
    return counted.groupBy("nct_id").agg(F.max("competing_trials_count").alias("competing_trials_count"))


def build_modeling_table(
    tables: TrialTables, min_start_year: int = 2008, min_enrollment: float = 10,
    open_end="2035-12-31", ratio_cap: float = 2.0, stage: Callable[[DataFrame], DataFrame] | None = None,
    reduced: DataFrame | None = None,
) -> DataFrame:
    """Cleaned studies with every feature and target; one lazy plan, no action.

    The cleaned studies are read four more times, by overlaps, sponsor counts and the median. ``stage`` (such as
    ``session.stored``) writes them and the studies' first conditions once, and lets all of those read the narrow tables. Every child table is reduced to one row per study (narrow joins on condition and sponsor come
    first), so all joins of the wide row are on ``nct_id`` and share its partitioning. A source that can reduce its child
    tables itself gives ``reduced``, the studies with the columns ``S.REDUCED``; those child tables are not joined then.
    """
    df = S.clean_studies(tables.studies if reduced is None else reduced, min_start_year, min_enrollment)
    if stage is not None:
        df = stage(df)
    cleaned = df
    df = df.withColumns({
        "study_type": X.normalized("study_type"),
        "enrollment_type_is_actual": X.enrollment_is_actual("enrollment_type"),
        "overall_status": X.status_display("overall_status"),
        "enrollment_ratio": X.enrollment_ratio("actual_enrollment", "enrollment", ratio_cap),
        C.CLASS_TARGET: X.completion_label("overall_status"),
        "terminated_for_enrollment": X.recruitment_failure("overall_status", "why_stopped"),
    })

    if reduced is None:
        df = _join_reductions(df, tables)
    n_countries = F.coalesce("n_countries", F.lit(1)).cast("long")
    df = df.withColumns({
        "n_countries": n_countries,
        "is_multicountry": n_countries > 1,
        "n_facilities": F.coalesce("n_facilities", "registry_sites", F.lit(1)).cast("long"),
        "geographic_concentration": F.coalesce("geographic_concentration", F.lit(1.0)),
    })

    if tables.conditions is not None:
        first = None
        if reduced is None:
            first = S.primary_value(tables.conditions, "name", "condition")
            first = first if stage is None else stage(first)
            df = df.join(primary_conditions(tables, first), "nct_id", "left")
        else:
            frequency = S.condition_frequency(tables.conditions)  # stored, its size is known: few conditions move no wide row
            df = _with_frequency(df, frequency if stage is None else stage(frequency))
        df = df.join(competing_trials(cleaned, tables.conditions, open_end, True if stage is None else None, first), "nct_id", "left")
        df = df.withColumn("competing_trials_count", F.coalesce("competing_trials_count", F.lit(0)).cast("long"))
    else:
        df = df.withColumns({"condition": F.lit("Unknown"), "condition_prevalence_proxy": _typed_null("long"),
                             "competing_trials_count": F.lit(0).cast("long")})

    if tables.sponsors is not None:
        one_lead = reduced is not None and (cleaned.agg(F.max("n_leads")).first()[0] or 0) <= 1
        history = S.scaled_sponsor_performance(S.first_lead_counts(cleaned) if one_lead else S.sponsor_completed_counts(tables.sponsors, cleaned))
        if reduced is None:
            leads = S.lead_sponsor(tables.sponsors).join(history, "sponsor_name", "left")
        else:  # narrow rows here too
            leads = cleaned.select("nct_id", "sponsor_name").join(history, "sponsor_name").groupBy("nct_id").agg(
                *[F.max(c).alias(c) for c in history.columns if c != "sponsor_name"])
        df = df.join(leads, "nct_id", "left").withColumns({
            "sponsor_historical_performance": F.coalesce("sponsor_historical_performance", F.lit(0.0)),
        })
    else:
        df = df.withColumns({
            "sponsor_name": F.lit("Unknown"), "sponsor_type": F.lit(C.SPONSOR_TYPE_DEFAULT),
            "sponsor_agency_class": _typed_null("string"), "sponsor_completed_trials": _typed_null("long"),
            "sponsor_historical_performance": F.lit(0.5)})

    duration = X.study_duration("registry_days", "start_date", "completion_date")
    df = df.withColumn(C.DURATION_TARGET, duration).drop("registry_days", "registry_sites", "n_leads")
    df = df.where(P.plausible_duration(C.DURATION_TARGET))

    if tables.eligibilities is not None:
        criteria = S.criteria_features(tables.eligibilities)
        if reduced is None:
            durations = S.study_durations(cleaned, tables.calculated_values)
        else:
            durations = cleaned.select("nct_id", duration.alias(C.DURATION_TARGET))
        kept = cleaned.join(durations.where(P.plausible_duration(C.DURATION_TARGET)), "nct_id", "left_semi")
        known = criteria.join(kept.select("nct_id"), "nct_id", "left_semi")
        median = exact_percentiles(known, "n_eligibility_criteria", {"m": 0.5}).scalar()
        df = df.join(criteria, "nct_id", "left").withColumn(
            "n_eligibility_criteria", F.coalesce(F.col("n_eligibility_criteria").cast("double"), median))
    else:
        df = df.withColumn("n_eligibility_criteria", _typed_null("double"))
    if tables.designs is not None and reduced is None:
        df = df.join(S.design_features(tables.designs), "nct_id", "left")
    return df


def _join_reductions(df: DataFrame, tables: TrialTables) -> DataFrame:
    """``df`` plus what calculated values, countries, facilities and interventions say of a study."""
    if tables.calculated_values is not None:
        df = df.join(tables.calculated_values.groupBy("nct_id").agg(
            F.max("actual_duration").alias("registry_days"), F.max("number_of_facilities").alias("registry_sites")), "nct_id", "left")
    else:
        df = df.withColumns({"registry_days": _typed_null("double"), "registry_sites": _typed_null("long")})
    if tables.countries is not None:
        df = df.join(S.country_counts(tables.countries), "nct_id", "left")
    else:
        df = df.withColumn("n_countries", _typed_null("long"))
    if tables.facilities is not None:
        df = df.join(S.site_footprint(tables.facilities), "nct_id", "left")
    else:
        df = df.withColumns({"n_facilities": _typed_null("long"), "geographic_concentration": _typed_null("double")})
    if tables.interventions is None:
        return df.withColumn("intervention_type", F.lit("Unknown"))
    return df.join(S.primary_value(tables.interventions, "intervention_type", "intervention_type"), "nct_id", "left")


def enrollment_extract(
    tables: TrialTables, min_start_year: int = 2008, order: bool = False, stage: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """One row per study with targets, characteristics and labels, by the SQL rules.

    Statuses drop NULL, unknown phases have no ordinal, the condition frequency counts studies, and
    actual and target enrollment are separate columns. ``stage`` (such as ``session.stored``) writes what the
    sponsor history reads several times.
    """
    t = tables
    base = t.studies.where(
        P.interventional() & P.started_from_year(min_start_year)
        & P.not_excluded_status(keep_null=False) & (F.col("enrollment") > 0))
    cv = t.calculated_values.groupBy("nct_id").agg(*[F.max(c).alias(c) for c in (
        "actual_duration", "number_of_facilities", "minimum_age_num", "maximum_age_num")])
    first = S.primary_value(t.conditions, "downcase_name", "condition")
    frequency = S.condition_frequency(t.conditions, "studies").withColumnRenamed("condition_lower", "condition")
    condition = first.join(frequency, "condition", "left")
    history = S.sponsor_ratio_history(t.sponsors, t.studies, stage)
    sponsor = S.lead_sponsor(t.sponsors).join(history, "sponsor_name", "left")
    joined = (
        base.join(cv, "nct_id", "left").join(condition, "nct_id", "left")
        .join(S.primary_value(t.interventions, "intervention_type", "intervention_type"), "nct_id", "left")
        .join(sponsor, "nct_id", "left")
        .join(S.country_counts(t.countries, keep_null_removed=False), "nct_id", "left")
        .join(S.criteria_parts(t.eligibilities), "nct_id", "left")
        .join(S.design_features(t.designs), "nct_id", "left")
    )
    phase = X.phase_canonical("phase")
    ratio = X.enrollment_ratio("actual_enrollment", "enrollment", cap=None)
    n_countries = F.coalesce("n_countries", F.lit(1)).cast("long")
    out = joined.select(
        "nct_id", X.normalized("study_type").alias("study_type"),
        X.status_display("overall_status").alias("overall_status"), phase.alias("phase"),
        X.phase_ordinal(phase, unknown=None).alias("phase_numeric"),
        "intervention_model", "primary_purpose", "masking", "allocation", "intervention_type",
        "condition", "condition_prevalence_proxy",
        F.col("enrollment").alias("target_enrollment"),
        F.col("actual_duration").alias("enrollment_duration_days"),
        F.col("number_of_facilities").alias("n_facilities"),
        n_countries.alias("n_countries"), (n_countries > 1).alias("is_multicountry"),
        "minimum_age_num", "maximum_age_num",
        (F.col("maximum_age_num") - F.col("minimum_age_num")).alias("age_window_years"),
        "n_criteria_lines", "gender", "healthy_volunteers",
        "sponsor_name", "sponsor_type", "sponsor_agency_class",
        F.coalesce("sponsor_median_enrollment_ratio", F.lit(1.0)).alias("sponsor_historical_performance"),
        F.coalesce("sponsor_rank_by_volume", F.lit(9999)).cast("long").alias("sponsor_rank"),
        "has_dmc", "is_fda_regulated_drug", "is_fda_regulated_device",
        "start_date", "completion_date", "primary_completion_date",
        F.year("start_date").alias("start_year"), F.month("start_date").alias("start_month"),
        X.met_target(ratio, "actual_duration", "enrollment").alias("enrollment_met_target"),
        ratio.alias("enrollment_ratio"),
    )
    return out.orderBy(F.col("start_date").desc(), "nct_id") if order else out
