"""Site and country performance, ranking, allocation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from trialspark.functions import columns as X, constants as C, filters as P
from trialspark.operators.landscape import condition_studies
from trialspark.operators.ordered import exact_percentiles, join_on, with_rank, with_ranks
from trialspark.operators.study_features import primary_value
from trialspark.session import checkpointed
from trialspark.sources.registry import TrialTables

SITE = ("name", "city", "country")


def site_score(rate: Column, ratio: Column, n_trials: Column, method: str = "pipeline") -> Column:
    """Composite site score on 0-100, in the two published forms."""
    if method == "pipeline":
        score = 0.4 * X.capped(rate, 100.0) + 0.4 * X.capped(ratio, 1.0) * 100 + 0.2 * X.capped(n_trials, 20) / 20 * 100
    elif method == "sql":
        score = 0.4 * X.capped(rate, 100.0) + 0.4 * X.capped(ratio * 50, 50.0) + 0.2 * X.capped(n_trials / 10, 10.0) * 10
    else:
        raise ValueError(f"unknown score method: {method}")
    return X.stable_round(score, 1)


def site_performance(facilities: DataFrame, modeling: DataFrame, country: str | None = None) -> DataFrame:
    """Per (site, condition): volume, target rate, ratios, duration and score.

    Rows are first reduced to one per (site, study), so no distinct count is needed and one site with
    very many rows is combined on the map side.
    """
    rows = facilities.where(P.not_withdrawn())
    if country:
        rows = rows.where(P.same_text("country", country))
    per_study = rows.groupBy(*SITE, "nct_id").agg(F.count(F.lit(1)).alias("w"))
    studies = modeling.select(
        "nct_id", "condition", "enrollment_ratio", C.CLASS_TARGET, C.DURATION_TARGET, "enrollment")
    d = per_study.join(studies, "nct_id", "left")
    key = [*SITE, "condition"]
    mean = lambda c: F.sum(F.col(c) * F.col("w")) / F.sum(F.when(F.col(c).isNotNull(), F.col("w")))
    agg = d.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_trials"),
        F.coalesce(F.sum(F.col(C.CLASS_TARGET) * F.col("w")), F.lit(0.0)).alias("n_met_target"),
        mean("enrollment_ratio").alias("avg_enrollment_ratio"),
        mean(C.DURATION_TARGET).alias("avg_duration_days"),
        mean("enrollment").alias("avg_target_enrollment"))
    medians = exact_percentiles(d, "enrollment_ratio", {"median_enrollment_ratio": 0.5}, key, weight="w")
    agg = join_on(agg, medians, key, "left")
    rate = X.stable_round(F.col("n_met_target") / F.greatest(F.col("n_trials"), F.lit(1)) * 100, 1)
    agg = agg.withColumn("completion_rate_pct", rate)
    return agg.withColumn("performance_score", site_score(
        F.col("completion_rate_pct"), F.col("avg_enrollment_ratio"), F.col("n_trials")))


def _outcome_columns() -> list[Column]:
    key = X.status_key("overall_status")
    return [F.coalesce(key == "COMPLETED", F.lit(False)).alias("completed"),
            F.coalesce(key == "TERMINATED", F.lit(False)).alias("terminated")]


def _completion_rate() -> Column:
    decided = F.nullif(F.col("n_completed") + F.col("n_terminated"), F.lit(0))
    return X.stable_round(F.col("n_completed") / decided, 4)


def top_sites(tables: TrialTables, condition: str | None, n: int | None = 20, basis: str = "studies") -> DataFrame:
    """Named sites by volume, then completion rate.

    ``basis='studies'`` counts outcomes once per (site, study); ``'rows'`` once per facility row.
    """
    studies = condition_studies(tables, condition).select("nct_id", "enrollment", *_outcome_columns())
    per_study = tables.facilities.where(P.named_site()).groupBy(*SITE, "nct_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("latitude").alias("lat"), F.count("latitude").alias("n_lat"),
        F.sum("longitude").alias("lon"), F.count("longitude").alias("n_lon"))
    w = F.col("rows") if basis == "rows" else F.lit(1)
    d = per_study.join(studies, "nct_id")
    agg = d.groupBy(*SITE).agg(
        F.count(F.lit(1)).alias("n_trials"),
        F.sum(F.when(F.col("completed"), w).otherwise(0)).alias("n_completed"),
        F.sum(F.when(F.col("terminated"), w).otherwise(0)).alias("n_terminated"),
        X.stable_round(F.sum(F.col("enrollment") * w) / F.sum(F.when(F.col("enrollment").isNotNull(), w)), 1)
        .alias("avg_enrollment"),
        X.stable_round(F.sum("lat") / F.nullif(F.sum("n_lat"), F.lit(0)), 5).alias("latitude"),
        X.stable_round(F.sum("lon") / F.nullif(F.sum("n_lon"), F.lit(0)), 5).alias("longitude"))
    out = agg.withColumn("completion_rate", _completion_rate())
    if n is None:
        return out
    return out.orderBy(
        F.col("n_trials").desc(), F.col("completion_rate").desc_nulls_last(),
        *[F.col(c).asc_nulls_last() for c in SITE]).limit(n)


# Fixed weights of the documented five-metric site score.
COMPOSITE_WEIGHTS = {
    "completion_rate": 0.35, "avg_enrollment": 0.25, "n_trials": 0.20, "late_phase_share": 0.10, "n_conditions": 0.10,
}


def site_metrics(tables: TrialTables, condition: str | None = None) -> DataFrame:
    """``top_sites`` metrics of every named site, its Phase 2/3 share and its number of conditions."""
    late = X.phase_canonical("phase").isin("Phase 2", "Phase 2/Phase 3", "Phase 3").cast("double")
    studies = condition_studies(tables, condition).select("nct_id", late.alias("late"))
    first = primary_value(tables.conditions, "downcase_name", "condition")
    visits = tables.facilities.where(P.named_site()).select(*SITE, "nct_id").distinct()
    extra = visits.join(studies, "nct_id").join(first, "nct_id", "left").groupBy(*SITE).agg(
        X.stable_round(F.avg("late"), 6).alias("late_phase_share"), F.count_distinct("condition").alias("n_conditions"))
    return join_on(top_sites(tables, condition, None), extra, list(SITE))


def site_zscores(
    sites: DataFrame, weights: dict[str, float] | None = None, out: str = "performance_score"
) -> DataFrame:
    """Weighted sum of z-scores across all sites; means and deviations come from one scalar row."""
    weights = weights or COMPOSITE_WEIGHTS
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    stats = sites.agg(*[f(value(c)).alias(f"_{k}_{c}") for c in weights
                        for k, f in (("m", F.avg), ("d", F.stddev_pop))])
    d = join_on(sites, stats, [])
    score = sum(
        (w * F.when(F.col(f"_d_{c}") > 1e-12, (value(c) - F.col(f"_m_{c}")) / F.col(f"_d_{c}")).otherwise(0.0)
         for c, w in weights.items()), F.lit(0.0))
    return d.withColumn(out, X.stable_round(score, 4)).drop(*stats.columns)


def country_performance(tables: TrialTables, condition: str | None = None) -> DataFrame:
    """Outcomes, pace and score per country over studies with a site there."""
    studies = condition_studies(tables, condition).select(
        "nct_id", "enrollment", "start_date", X.day_span("start_date", "completion_date").alias("days"),
        *_outcome_columns())
    here = tables.facilities.where(F.col("country").isNotNull()).select("nct_id", "country").distinct()
    d = here.join(studies, "nct_id")
    agg = d.groupBy("country").agg(
        F.count(F.lit(1)).alias("n_trials"),
        F.count_if("completed").alias("n_completed"), F.count_if("terminated").alias("n_terminated"),
        X.stable_round(F.avg("enrollment"), 1).alias("avg_enrollment"),
        X.stable_round(F.avg(F.when(F.col("completed"), F.col("days"))), 1).alias("avg_duration_days"),
        F.count("start_date").alias("_dated"),
        F.datediff(F.max("start_date"), F.min("start_date")).alias("_span"))
    agg = agg.withColumn("completion_rate", _completion_rate())
    years = F.greatest(F.col("_span") / 365.25, F.lit(1.0))
    score = F.coalesce(F.col("completion_rate") * F.log1p(F.col("n_completed").cast("double")), F.lit(0.0))
    return agg.withColumns({
        "trials_per_year": F.when(F.col("_dated") >= 2, X.stable_round(F.col("n_trials") / years, 2)),
        "performance_score": X.stable_round(score, 4),
    }).drop("_dated", "_span")


def recommend_sites(
    tables: TrialTables, condition: str, target_enrollment: int, n_countries: int,
    min_completed: int = 3, repair_residual: bool = False,
) -> DataFrame:
    """Countries by speed-adjusted score with a proportional share of the target enrollment.

    The windows below run over the ``n_countries`` chosen rows only. ``repair_residual`` hands
    rounding differences to the largest remainders so that allocations add up to the target.
    """
    perf = country_performance(tables, condition).where(F.col("n_completed") >= min_completed)
    adjusted = F.coalesce(F.col("performance_score") * X.speed_bonus("avg_duration_days"), F.lit(0.0))
    top = perf.withColumn("adj_score", X.stable_round(adjusted, 10))
    top = top.orderBy(F.col("adj_score").desc(), "country").limit(n_countries)
    everyone = Window.partitionBy()
    total = F.sum("adj_score").over(everyone)
    top = top.withColumn("weight", F.when(total == 0, 1 / F.count(F.lit(1)).over(everyone)).otherwise(
        F.col("adj_score") / total))
    exact = F.col("weight") * target_enrollment
    if repair_residual:
        top = top.withColumns({"_base": F.floor(exact), "_rest": exact - F.floor(exact)})
        short = F.lit(target_enrollment) - F.sum("_base").over(everyone)
        order = F.row_number().over(Window.orderBy(F.col("_rest").desc(), "country"))
        top = top.withColumn("_more", (order <= short).cast("long"))
        top = top.withColumn("allocated_enrollment", F.col("_base") + F.col("_more"))
    else:
        top = top.withColumn("allocated_enrollment", X.stable_round(exact, 0).cast("long"))
    per_site = F.coalesce(X.floored(F.col("avg_enrollment"), 10.0), F.lit(10.0))
    needed = F.greatest(F.ceil(F.col("allocated_enrollment") / per_site), F.lit(1))
    return top.select(
        F.row_number().over(Window.orderBy(F.col("adj_score").desc(), "country")).cast("long").alias("rank"),
        "country", "performance_score", "completion_rate", "n_completed", "avg_duration_days",
        "allocated_enrollment", needed.cast("long").alias("recommended_sites"),
        X.rationale_text("n_completed", "completion_rate", "avg_duration_days").alias("rationale"))


def country_zscores(perf: DataFrame, metrics: Sequence[str], top: int = 25, wide: bool = False) -> DataFrame:
    """z-scores of the ``top`` countries by the first metric; missing values count as 0."""
    best = perf.where(F.col("country").isNotNull()).orderBy(
        F.col(metrics[0]).desc_nulls_last(), "country").limit(top)
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    w = Window.partitionBy()  # at most ``top`` rows
    z = {c: F.when(F.stddev_pop(value(c)).over(w) > 1e-12,
                   (value(c) - F.avg(value(c)).over(w)) / F.stddev_pop(value(c)).over(w)).otherwise(0.0)
         for c in metrics}
    scored = best.select("country", *[X.stable_round(e, 4).alias(c) for c, e in z.items()])
    return scored if wide else scored.unpivot("country", list(metrics), "metric", "z_score")


# ---- SQL-style site tables -------------------------------------------------------

def facility_studies(tables: TrialTables, start_from: int = 2005, ratio_cap: float = 2.0) -> DataFrame:
    """Facility rows of interventional studies with enrollment, one row per participation."""
    studies = tables.studies.where(
        P.interventional() & P.started_from_year(start_from) & (F.col("enrollment") > 0))
    if tables.calculated_values is not None:
        cv = tables.calculated_values.groupBy("nct_id").agg(F.max("actual_duration").alias("duration_days"))
        studies = studies.join(cv, "nct_id", "left")
    else:
        studies = studies.withColumn("duration_days", F.lit(None).cast("double"))
    studies = studies.select(
        "nct_id", F.col("enrollment").alias("target_enrollment"), "duration_days", "start_date", "overall_status",
        F.when(F.col("phase").isNotNull(), X.phase_canonical("phase")).alias("phase"),
        X.enrollment_ratio("actual_enrollment", "enrollment", ratio_cap).alias("enrollment_ratio"),
        F.coalesce(X.status_key("overall_status") == "COMPLETED", F.lit(False)).cast("int").alias("completed_flag"))
    sites = tables.facilities.where(P.not_withdrawn(keep_null=False) & F.col("country").isNotNull())
    sites = sites.select("nct_id", F.col("name").alias("facility_name"), "city", "state", "country",
                         F.col("status").alias("facility_status"))
    condition = primary_value(tables.conditions, "downcase_name", "condition")
    return sites.join(studies, "nct_id").join(condition, "nct_id", "left")


def site_performance_by_condition(rows: DataFrame, as_of=None) -> DataFrame:
    """Per (site, condition) metrics with both ranks and the SQL-form score."""
    key = ["facility_name", "city", "country", "condition"]
    per_study = rows.groupBy(*key, "nct_id").agg(
        F.count(F.lit(1)).alias("w"), *[F.first(c).alias(c) for c in (
            "completed_flag", "enrollment_ratio", "duration_days", "target_enrollment", "phase", "start_date")])
    mean = lambda c: F.sum(F.col(c) * F.col("w")) / F.sum(F.when(F.col(c).isNotNull(), F.col("w")))
    recent = F.add_months(X.as_of_date(as_of), -60)
    agg = per_study.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_trials"),
        F.sum(F.col("completed_flag") * F.col("w")).cast("long").alias("n_completed"),
        X.stable_round(mean("enrollment_ratio"), 3).alias("avg_enrollment_ratio"),
        X.stable_round(mean("duration_days"), 0).alias("avg_duration_days"),
        X.stable_round(mean("target_enrollment"), 0).alias("avg_target_enrollment"),
        F.nullif(F.array_join(F.array_sort(F.collect_set("phase")), ", "), F.lit("")).alias("phases_participated"),
        F.min("start_date").alias("first_trial_date"), F.max("start_date").alias("most_recent_trial_date"),
        F.max((F.col("start_date") >= recent).cast("int")).alias("is_recently_active"))
    medians = exact_percentiles(per_study, "enrollment_ratio", {"_median": 0.5}, key, weight="w")
    agg = join_on(agg, medians, key, "left")
    agg = agg.withColumns({
        "median_enrollment_ratio": X.stable_round("_median", 3),
        "completion_rate_pct": X.stable_round(F.col("n_completed") / F.col("n_trials") * 100, 1),
    }).drop("_median")
    agg = agg.withColumn("performance_score", site_score(
        F.col("completion_rate_pct"), F.col("avg_enrollment_ratio"), F.col("n_trials"), "sql"))
    order = [("n_trials", True), ("completion_rate_pct", True)]
    agg = checkpointed(agg)  # small next to the rows, and read by the ranks and by the result
    return with_ranks(agg, order, {"rank_in_condition": ["condition"], "global_rank": []})


def country_performance_ranked(rows: DataFrame) -> DataFrame:
    """Per (country, condition) metrics, efficiency and ranks."""
    ratio, days = F.avg("enrollment_ratio"), F.avg("duration_days")
    agg = rows.groupBy("country", "condition").agg(
        F.count_distinct("nct_id").alias("n_trials"),
        F.count_distinct(F.concat(F.coalesce("facility_name", F.lit("")), F.lit("|"), F.coalesce("city", F.lit(""))))
        .alias("n_unique_sites"),
        X.stable_round(ratio, 10).alias("_ratio"),
        X.stable_round(ratio, 3).alias("avg_enrollment_ratio"),
        X.stable_round(days, 0).alias("avg_duration_days"),
        F.sum("completed_flag").alias("_completed"),
        X.stable_round(ratio / F.nullif(days / 365.0, F.lit(0.0)), 4).alias("enrollment_efficiency"))
    agg = agg.withColumn("trial_completion_rate_pct", X.stable_round(F.col("_completed") / F.col("n_trials") * 100, 1))
    within = Window.partitionBy("condition").orderBy(F.col("_ratio").desc_nulls_last())  # one row per country
    agg = agg.withColumn("rank_in_condition", F.rank().over(within).cast("long"))
    return with_rank(agg, [("n_trials", True)], "global_volume_rank").drop("_ratio", "_completed")


ROLLUP = {  # the columns that name a group on every level; columns below it are NULL
    "site_performance": ("country", "condition", "facility_name", "city"), "country_performance": ("country", "condition"),
    "condition_performance": ("condition",), "site_total": ("country", "facility_name", "city"), "country_total": ("country",), "grand_total": (),
}


def site_rollup(rows: DataFrame) -> DataFrame:
    """Site, country and condition results in one long table tagged by ``result_type``, from one pass over the rows.

    ``GROUPING SETS`` reduce the participations to one row per level, group and study, so that a study counts once in
    every group whatever its sites; a second set of rows without the study stands for the distinct sites of a group. Both steps
    combine on the map side: no key is hotter than one study or one site of a level. Every level ranks its groups
    overall by volume and completion rate, and within the condition where it has one. Missing facility names and cities count as one name.
    """
    dims = ["country", "condition", "facility_name", "city"]
    d = rows.select("nct_id", "country", "condition", F.coalesce("facility_name", F.lit("")).alias("facility_name"), F.coalesce("city", F.lit("")).alias("city"),
                    "completed_flag", "enrollment_ratio", "duration_days")
    by_study = [[*level, "nct_id"] for level in ROLLUP.values()]
    sites = [["country", "condition", "facility_name", "city"], ["country", "facility_name", "city"]]
    keys = [*dims, "nct_id"]
    d = d.groupingSets([[F.col(c) for c in s] for s in by_study + sites], *keys).agg(
        F.grouping_id(*keys).alias("_set"), F.count(F.lit(1)).alias("w"),
        *[F.max(c).alias(c) for c in ("completed_flag", "enrollment_ratio", "duration_days")])
    code = lambda s: sum(1 << (len(keys) - 1 - i) for i, c in enumerate(keys) if c not in s)
    level = F.create_map(*[x for name, by in ROLLUP.items() for x in (F.lit(code([*by, "nct_id"])), F.array(F.lit(name)))],
                         *[x for s, names in zip(sites, (["site_performance", "country_performance", "condition_performance"], ["site_total", "country_total", "grand_total"]))
                           for x in (F.lit(code(s)), F.array(*map(F.lit, names)))])
    d = d.withColumn("is_site", F.col("_set").bitwiseAND(1) == 1).withColumn("result_type", F.explode(level[F.col("_set").cast("int")]))
    shown = lambda c: F.when(F.col("result_type").isin([n for n, by in ROLLUP.items() if c in by]), F.col(c))
    study, w = ~F.col("is_site"), F.col("w")
    mean = lambda c: F.sum(F.when(study, F.col(c) * w)) / F.sum(F.when(study & F.col(c).isNotNull(), w))
    agg = d.groupBy("result_type", *[shown(c).alias(c) for c in dims]).agg(
        F.count_if(study).alias("n_trials"), F.count_if("is_site").alias("n_unique_sites"),
        F.sum(F.when(study, F.col("completed_flag") * w)).cast("long").alias("n_completed"),
        X.stable_round(mean("enrollment_ratio"), 3).alias("avg_enrollment_ratio"), X.stable_round(mean("duration_days"), 0).alias("avg_duration_days"))
    agg = agg.withColumn("completion_rate_pct", X.stable_round(F.col("n_completed") / F.col("n_trials") * 100, 1))
    order = [("n_trials", True), ("completion_rate_pct", True)]
    ranked = with_ranks(checkpointed(agg), order, {"rank_in_condition": ["result_type", "condition"], "global_rank": ["result_type"]})
    in_condition = F.col("result_type").isin([n for n, by in ROLLUP.items() if "condition" in by])
    return ranked.withColumn("rank_in_condition", F.when(in_condition, F.col("rank_in_condition")))
