"""Per-study features, each pre-aggregated to one row per study before any join.

First-row picks are ``min(struct(...))`` aggregates: they combine on the map side, so one study with
a huge number of child rows is reduced before the shuffle, and the pick does not depend on file order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trialspark.functions import columns as X, constants as C, filters as P

# What a source may know of a study without its child tables: the modeling table then joins none of them.
REDUCED = (
    "registry_days", "registry_sites", "n_countries", "n_facilities", "geographic_concentration", "condition", "intervention_type",
    "sponsor_name", "sponsor_type", "sponsor_agency_class", "n_leads", "intervention_model", "primary_purpose", "masking", "allocation",
)
_DESIGN = REDUCED[-4:]


def clean_studies(studies: DataFrame, min_start_year: int = 2008, min_enrollment: float = 10) -> DataFrame:
    """Interventional studies in scope, with canonical phase, ordinal phase and boolean flags."""
    kept = studies.where(
        P.started_from_year(min_start_year)
        & F.col("enrollment").isNotNull() & (F.col("enrollment") >= min_enrollment)
        & P.interventional() & P.not_excluded_status()
    )
    flags = ("has_dmc", "is_fda_regulated_drug", "is_fda_regulated_device")
    kept = kept.withColumns({"phase": X.phase_canonical("phase"), **{c: X.flag(c) for c in flags}})
    return kept.withColumn("phase_numeric", X.phase_ordinal("phase"))


def country_counts(countries: DataFrame, keep_null_removed: bool = True) -> DataFrame:
    """Distinct countries per study, a small set of each: a distinct count keeps its rows in three more hash tables."""
    return countries.where(P.not_removed(keep_null=keep_null_removed)).groupBy("nct_id").agg(
        F.size(F.collect_set("name")).cast("long").alias("n_countries"))


def facility_counts(facilities: DataFrame, distinct: bool = False) -> DataFrame:
    """Non-withdrawn facility rows per study, or distinct sites."""
    kept = facilities.where(P.not_withdrawn())
    if distinct:
        kept = kept.select("nct_id", X.site_key("name", "city", "country").alias("site")).distinct()
    return kept.groupBy("nct_id").agg(F.count(F.lit(1)).alias("n_facilities"))


def site_footprint(facilities: DataFrame) -> DataFrame:
    """Facility count and geographic concentration in one pass.

    Concentration is the sum of squared country shares, sum(n^2) / sum(n)^2 over known countries.
    """
    n = F.when(F.col("country").isNotNull(), F.col("n"))
    return (
        facilities.where(P.not_withdrawn()).groupBy("nct_id", "country").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("nct_id").agg(
            F.sum("n").alias("n_facilities"), concentration(n).alias("geographic_concentration"),
        )
    )


def concentration(n: Column) -> Column:
    """Sum of squared shares of the counts ``n``."""
    return F.sum(n * n) / F.pow(F.sum(n), F.lit(2))


def geographic_hhi(facilities: DataFrame) -> DataFrame:
    return site_footprint(facilities).select("nct_id", "geographic_concentration").where(
        "geographic_concentration IS NOT NULL")


def primary_value(df: DataFrame, value: str, out: str) -> DataFrame:
    """First-listed non-NULL ``value`` per study, by ``id``."""
    first = F.min(F.struct("id", value))
    return df.where(F.col(value).isNotNull()).groupBy("nct_id").agg(first.alias("f")).select(
        "nct_id", F.col(f"f.{value}").alias(out))


def condition_frequency(conditions: DataFrame, count: str = "rows") -> DataFrame:
    """(condition_lower, n): rows, or distinct studies, per lower-cased condition name."""
    named = conditions.where(F.col("name").isNotNull()).withColumn("condition_lower", F.lower("name"))
    n = F.count(F.lit(1)) if count == "rows" else F.count_distinct("nct_id")
    return named.groupBy("condition_lower").agg(n.alias("condition_prevalence_proxy"))


def lead_rows(sponsors: DataFrame) -> DataFrame:
    return sponsors.where(F.col("lead_or_collaborator") == "lead")


def lead_sponsor(sponsors: DataFrame) -> DataFrame:
    """One lead sponsor per study (alphabetically first when several are listed)."""
    pick = F.min(F.struct("name", "agency_class"))
    return lead_rows(sponsors).groupBy("nct_id").agg(pick.alias("s")).select("nct_id", *_sponsor_columns())


def _sponsor_columns() -> list[Column]:
    return [F.col("s.name").alias("sponsor_name"), X.sponsor_type("s.agency_class").alias("sponsor_type"),
            F.col("s.agency_class").alias("sponsor_agency_class")]


def lead_and_design(rows: DataFrame, found: Column | None = None) -> DataFrame:
    """``lead_sponsor`` and ``design_features`` of rows that have the columns of both tables, in one grouping.

    Where each study has one row, ``found`` tells whether it has a sponsor and a design at all: the columns are added then,
    and nothing is grouped.
    """
    lead = F.when(F.col("lead_or_collaborator") == "lead", F.struct("name", "agency_class"))
    design = F.struct(*_DESIGN)
    known = F.when(lead.isNotNull(), F.col("name"))
    if found is None:
        both = rows.groupBy("nct_id").agg(F.min(lead).alias("s"), F.count(known).alias("n_leads"), F.min(design).alias("d"))
    else:
        own = [c for c in rows.columns if c not in (*_DESIGN, "name", "agency_class", "lead_or_collaborator")]
        both = rows.select(*own, F.when(found, lead).alias("s"), F.when(found, known.isNotNull().cast("long")).alias("n_leads"), F.when(found, design).alias("d"))
    # without a lead there is no type either
    sponsor = [F.when(F.col("s").isNotNull(), c).alias(n) for c, n in zip(_sponsor_columns(), ("sponsor_name", "sponsor_type", "sponsor_agency_class"))]
    return both.select(*[c for c in both.columns if c not in ("s", "n_leads", "d")], *sponsor, "n_leads", "d.*")


def sponsor_completed_counts(sponsors: DataFrame, studies: DataFrame) -> DataFrame:
    """(sponsor_name, sponsor_completed_trials) over completed studies of ``studies``."""
    done = studies.where(X.status_key("overall_status") == "COMPLETED").select("nct_id")
    return (
        lead_rows(sponsors).join(done, "nct_id", "left_semi").where(F.col("name").isNotNull())
        .groupBy(F.col("name").alias("sponsor_name"))
        .agg(F.count(F.lit(1)).alias("sponsor_completed_trials"))
    )


def first_lead_counts(cleaned: DataFrame) -> DataFrame:
    """``sponsor_completed_counts`` where studies carry their first lead and no study has another."""
    return cleaned.where((X.status_key("overall_status") == "COMPLETED") & F.col("sponsor_name").isNotNull()).groupBy("sponsor_name").agg(
        F.count(F.lit(1)).alias("sponsor_completed_trials"))


def scaled_sponsor_performance(completed: DataFrame) -> DataFrame:
    """Counts divided by the largest count (at least 1)."""
    top = completed.agg(F.greatest(F.max("sponsor_completed_trials"), F.lit(1))).scalar()
    return completed.withColumn("sponsor_historical_performance", F.col("sponsor_completed_trials") / top)


def sponsor_ratio_history(sponsors: DataFrame, studies: DataFrame, stage=None) -> DataFrame:
    """Per lead sponsor: median actual/target ratio and number of completed studies, with volume rank.

    Counts, percentiles and ranks read the (sponsor, ratio) rows several times; ``stage`` writes them once.
    """
    from trialspark.operators.ordered import exact_percentiles, join_on, with_rank

    done = studies.where((X.status_key("overall_status") == "COMPLETED") & (F.col("enrollment") > 0)).select(
        "nct_id", X.enrollment_ratio("actual_enrollment", "enrollment", cap=None).alias("ratio"))
    rows = lead_rows(sponsors).select("nct_id", F.col("name").alias("sponsor_name")).join(done, "nct_id")
    if stage is not None:
        rows = stage(rows.select("sponsor_name", "ratio"))
    counts = rows.groupBy("sponsor_name").agg(F.count(F.lit(1)).alias("sponsor_historical_trial_count"))
    medians = exact_percentiles(rows, "ratio", {"sponsor_median_enrollment_ratio": 0.5}, ["sponsor_name"])
    both = join_on(counts, medians, ["sponsor_name"], "left")
    return with_rank(both, [("sponsor_historical_trial_count", True)], "sponsor_rank_by_volume")


def criteria_features(eligibilities: DataFrame) -> DataFrame:
    """Criteria complexity, gender and volunteers, one row per study.

    Line counts replace the text before the shuffle. When no study has any text at all, the number of
    criteria rows stands in.
    """
    has_text = eligibilities.where(F.col("criteria").isNotNull()).select(F.lit(True)).limit(1).scalar()
    first = F.min(F.struct("lines", "gender", "healthy_volunteers"))
    return (
        eligibilities.withColumn("lines", X.criteria_line_count("criteria"))
        .groupBy("nct_id").agg(first.alias("f"), F.count(F.lit(1)).alias("n_rows"))
        .select(
            "nct_id",
            F.when(has_text.isNotNull(), F.col("f.lines")).otherwise(F.col("n_rows")).alias("n_eligibility_criteria"),
            F.col("f.gender").alias("gender"), F.col("f.healthy_volunteers").alias("healthy_volunteers"),
        )
    )


def criteria_parts(eligibilities: DataFrame) -> DataFrame:
    """Newline-separated parts per study, as the SQL extract counts them."""
    first = F.min(F.struct("n_criteria_lines", "gender", "healthy_volunteers"))
    return (
        eligibilities.withColumn("n_criteria_lines", X.criteria_parts_sql("criteria"))
        .groupBy("nct_id").agg(first.alias("f")).select("nct_id", "f.*")
    )


def design_features(designs: DataFrame) -> DataFrame:
    return designs.groupBy("nct_id").agg(F.min(F.struct(*_DESIGN)).alias("d")).select("nct_id", "d.*")


def study_durations(studies: DataFrame, calculated_values: DataFrame | None) -> DataFrame:
    """(nct_id, enrollment_duration_days): supplied days first, date difference otherwise."""
    d = studies.select("nct_id", "start_date", "completion_date")
    supplied = None
    if calculated_values is not None:
        longest = calculated_values.groupBy("nct_id").agg(F.max("actual_duration").alias("actual_duration"))
        d = d.join(longest, "nct_id", "left")
        supplied = "actual_duration"
    span = X.study_duration(supplied, "start_date", "completion_date")
    return d.select("nct_id", span.alias(C.DURATION_TARGET))
