"""The named queries of the library over the bound tables, with fixed example parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from trialspark.functions import columns as X, constants as C, filters as P
from trialspark.operators import (
    criteria as K, evaluation as V, explore as E, intervals as I, landscape as L, network as N,
    sites as T, study_features as S, survival as U,
)
from trialspark.operators.ordered import exact_percentiles, join_on
from trialspark.plans.modeling import build_modeling_table, competing_trials, enrollment_extract
from trialspark.session import shared_folder, stored
from trialspark.sources.bindings import reduced_studies, registry, table
from trialspark.sources.schemas import conform

YEAR, AS_OF = 1996, "2001-08-01"
CONDITION, COUNTRY = "gear", "NATION_3"
WINDOW = ("1997-01-01", "1999-12-31")
SATURATION_CONDITIONS = ["gear", "bolt", "red w"]
SATURATION_COUNTRIES = ["NATION_3", "NATION_7", "NATION_1"]
MODELS = ["Parallel Assignment", "Single Group Assignment", "Crossover Assignment"]
THRESHOLDS = [0.1, 0.25, 0.5, 0.7, 0.93]
SCENARIOS = [
    {"scenario": "small", "phase_numeric": 1.0, "n_facilities": 3, "n_countries": 2, "enrollment": 120.0},
    {"scenario": "large", "phase_numeric": 3.0, "n_facilities": 6, "n_countries": 4, "enrollment": 800.0},
]
MODEL_COLUMNS = [
    "nct_id", "overall_status", "phase", "phase_numeric", "enrollment", "start_date", "completion_date", "has_dmc",
    "enrollment_type_is_actual", "enrollment_met_target", "terminated_for_enrollment", "n_countries", "is_multicountry",
    "n_facilities", "condition", "condition_prevalence_proxy", "competing_trials_count", "intervention_type",
    "sponsor_name", "sponsor_type", "enrollment_duration_days", "n_eligibility_criteria", "gender",
    "intervention_model", "masking",
]
Query = Callable[[SparkSession, str], DataFrame]
REGISTERED: dict[str, Query] = {}


def _rounded(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    return df.withColumns({c: X.stable_round(c, digits) for c in cols})


def _query(fn: Query) -> Query:
    REGISTERED[fn.__name__] = fn
    return fn


def _from_tables(**queries) -> None:
    for name, fn in queries.items():
        REGISTERED[name] = lambda spark, sf, fn=fn: fn(registry(spark, sf))


def _from_modeling(**queries) -> None:
    for name, fn in queries.items():
        REGISTERED[name] = lambda spark, sf, fn=fn: fn(modeling(spark, sf))


def _from_base(base: str, **queries) -> None:
    for name, fn in queries.items():
        REGISTERED[name] = lambda spark, sf, fn=fn: fn(table(spark, sf, base))


def modeling(spark: SparkSession, sf: str) -> DataFrame:
    return build_modeling_table(registry(spark, sf), YEAR, stage=stored, reduced=reduced_studies(spark, sf, stored))


def _market(t) -> DataFrame:
    return L.market_base(t, CONDITION, *WINDOW, AS_OF)


def _facility_rows(t) -> DataFrame:
    return T.facility_studies(t, YEAR)


# ---- features --------------------------------------------------------------------

def _cleaned(t) -> DataFrame:
    return S.clean_studies(t.studies, YEAR)


def _phase_ordinal(t) -> DataFrame:
    d = t.studies.select(F.col("phase").alias("raw_phase"), X.phase_canonical("phase").alias("phase"))
    return d.withColumn("phase_numeric", X.phase_ordinal("phase", unknown=None)).groupBy(*d.columns, "phase_numeric").agg(
        F.count(F.lit(1)).alias("n"))


def _labels(t) -> DataFrame:
    return _cleaned(t).groupBy(
        X.completion_label("overall_status").alias("enrollment_met_target"),
        X.recruitment_failure("overall_status", "why_stopped").alias("terminated_for_enrollment"),
    ).agg(F.count(F.lit(1)).alias("n"))


def _frequency(t) -> DataFrame:
    rows = S.condition_frequency(t.conditions).withColumnRenamed("condition_prevalence_proxy", "n_rows")
    studies = S.condition_frequency(t.conditions, "studies").withColumnRenamed("condition_prevalence_proxy", "n_studies")
    return rows.join(studies, "condition_lower")


_from_tables(
    clean_studies=lambda t: _cleaned(t).select(
        "nct_id", "overall_status", "phase", "phase_numeric", "enrollment", "start_date", "has_dmc",
        "is_fda_regulated_drug", "is_fda_regulated_device"),
    phase_ordinal=_phase_ordinal,
    status_funnel=lambda t: L.condition_studies(t, None).agg(*L.funnel_columns(X.as_of_date(AS_OF))),
    labels_and_stop_reason=_labels,
    country_counts=lambda t: S.country_counts(t.countries),
    facility_counts=lambda t: S.facility_counts(t.facilities),
    facility_counts_distinct=lambda t: S.facility_counts(t.facilities, distinct=True),
    geographic_hhi=lambda t: _rounded(S.geographic_hhi(t.facilities), 6, "geographic_concentration"),
    primary_condition=lambda t: S.primary_value(t.conditions, "name", "condition"),
    condition_frequency=_frequency,
    sponsor_history=lambda t: _rounded(
        S.sponsor_ratio_history(t.sponsors, t.studies, stored), 6, "sponsor_median_enrollment_ratio"),
    sponsor_performance_scaled=lambda t: _rounded(S.scaled_sponsor_performance(
        S.sponsor_completed_counts(t.sponsors, _cleaned(t))), 6, "sponsor_historical_performance"),
    lead_sponsor=lambda t: S.lead_sponsor(t.sponsors),
    criteria_line_count=lambda t: S.criteria_features(t.eligibilities),
    eligibility_complexity_sql=lambda t: S.criteria_parts(t.eligibilities),
    study_duration=lambda t: S.study_durations(_cleaned(t), t.calculated_values),
    competing_trials_count=lambda t: competing_trials(
        stored(_cleaned(t).select("nct_id", "start_date", "completion_date")), t.conditions, first=stored(S.primary_value(t.conditions, "name", "condition"))),
    concurrent_trials=lambda t: I.count_overlaps(
        _market(t).select("nct_id", "start_date", "effective_end"), end="effective_end", open_end=None,
        out="concurrent_trial_count").select("nct_id", "concurrent_trial_count"),
    enrollment_extract=lambda t: _rounded(
        enrollment_extract(replace(t, studies=stored(t.studies)), YEAR, stage=stored), 6, "sponsor_historical_performance", "enrollment_ratio").drop("study_type"),
)
_from_modeling(
    competitors_in_window=lambda m: I.competitors_in_window(
        m, condition=CONDITION, window_start=WINDOW[0], window_end=WINDOW[1]),
    filter_state=lambda m: P.FilterState(
        condition_query="bolt", phases=("Phase 1", "Phase 3"), sponsor_types=("industry", "academic"),
        start_from="1996-06-01", start_to="2000-12-31", min_enrollment=50, max_enrollment=900,
    ).apply(m).select("nct_id", "condition", "phase", "sponsor_type", "start_date", "enrollment"),
)



@_query
def modeling_table(spark: SparkSession, sf: str) -> DataFrame:
    ratios = ("enrollment_ratio", "geographic_concentration", "sponsor_historical_performance")
    m = modeling(spark, sf)
    return _rounded(m.select(*MODEL_COLUMNS, *ratios), 6, *ratios)


# ---- landscape --------------------------------------------------------------------

_from_tables(
    landscape_summary=lambda t: L.landscape_summary(t, CONDITION, AS_OF),
    landscape_by_condition=lambda t: L.landscape_by_condition(t, AS_OF),
    intensity_damped=lambda t: L.landscape_summary(t, CONDITION, AS_OF, "damped").select(
        "condition", "competition_intensity"),
    phase_breakdown=lambda t: L.phase_breakdown(t, CONDITION),
    temporal_density=lambda t: L.temporal_density(t, CONDITION, AS_OF),
    top_countries=lambda t: L.top_countries(t, CONDITION),
    top_sponsors=lambda t: L.top_sponsors(t, CONDITION),
    site_density=lambda t: _rounded(L.site_density(t, CONDITION), 6, "log_sites"),
    trial_timeline=lambda t: L.timeline(t, CONDITION, 40, AS_OF),
    trial_timeline_recent=lambda t: L.timeline(t, CONDITION, 40, AS_OF, "recency"),
    recruitment_saturation=lambda t: L.recruitment_saturation(t, CONDITION, COUNTRY, AS_OF),
    saturation_by_pair=lambda t: L.saturation_by_pair(t, AS_OF),
    saturation_matrix=lambda t: L.saturation_matrix(t, SATURATION_CONDITIONS, SATURATION_COUNTRIES, AS_OF),
    sponsor_market=lambda t: L.sponsor_market(t, _market(t)),
    yearly_density=lambda t: L.yearly_density(_market(t)),
    phase_distribution=lambda t: L.phase_distribution(_market(t)),
    trial_countries=lambda t: L.trial_countries(t.countries).withColumn(
        "countries", F.array_join("countries", ", ")),
    market_rollup=lambda t: L.market_rollup(t, _market(t)),
    landscape_detail=lambda t: L.landscape_detail(t, _market(t)).withColumn(
        "countries", F.array_join("countries", ", ")),
)

# ---- sites ------------------------------------------------------------------------

_Z_METRICS = ["n_trials", "completion_rate", "avg_enrollment"]
_from_tables(
    site_performance_by_condition=lambda t: T.site_performance_by_condition(_facility_rows(t), AS_OF),
    country_performance_ranked=lambda t: T.country_performance_ranked(_facility_rows(t)),
    site_rollup=lambda t: T.site_rollup(_facility_rows(t)),
    country_performance=lambda t: T.country_performance(t),
    country_performance_condition=lambda t: T.country_performance(t, CONDITION),
    top_sites=lambda t: T.top_sites(t, CONDITION),
    site_rank=lambda t: T.site_zscores(T.site_metrics(t, CONDITION)).select(
        *T.SITE, "n_trials", "completion_rate", "late_phase_share", "n_conditions", "performance_score"),
    site_network_nodes=lambda t: N.network_nodes(t, CONDITION),
    site_network_edges=lambda t: N.network_edges(t, CONDITION),
    site_pairs=lambda t: N.shared_trial_edges(_facility_rows(t)),
    site_pairs_by_month=lambda t: N.shared_trial_edges(
        t.facilities.join(t.studies.select("nct_id", F.date_format("start_date", "yyyy-MM").alias("month")), "nct_id"),
        trial="month", site=("name",), within=()),
    site_pairs_by_country=lambda t: N.shared_trial_edges(_facility_rows(t), within=("country",)),
    site_recommendation=lambda t: T.recommend_sites(t, CONDITION, 1000, 6),
    country_zscores_wide=lambda t: T.country_zscores(T.country_performance(t), _Z_METRICS, wide=True),
    country_zscores=lambda t: T.country_zscores(T.country_performance(t), _Z_METRICS),
    kpi_summary=E.kpi_summary,
    kpi_summary_sketched=lambda t: E.kpi_from_sketches(stored(E.kpi_sketches(
        t, studies=F.year("start_date"), conditions=F.col("id") % 16, countries=F.crc32(F.col("nct_id").cast("string").cast("binary")) % 16))),
    site_recommendation_repaired=lambda t: T.recommend_sites(t, CONDITION, 1001, 6, repair_residual=True),
    top_sites_by_rows=lambda t: T.top_sites(t, CONDITION, basis="rows"),
    dataset_summary=E.dataset_summary,
    explore_sites_by_country=lambda t: E.sites_by_country(t.facilities),
    explore_site_density_map=lambda t: E.sites_by_country(t.facilities, None),
)


@_query
def site_performance_country(spark: SparkSession, sf: str) -> DataFrame:
    d = T.site_performance(registry(spark, sf).facilities, modeling(spark, sf), COUNTRY.lower())
    return _rounded(d, 6, "avg_enrollment_ratio", "median_enrollment_ratio", "avg_duration_days", "avg_target_enrollment")


@_query
def landscape_nested(spark: SparkSession, sf: str) -> DataFrame:
    """The nested breakdowns of the one-row landscape, one row for each of their entries."""
    one = L.landscape(registry(spark, sf), CONDITION, AS_OF)
    lists = [one.select(F.lit(c).alias("part"), F.explode(c).alias("e")).select("part", "e.name", F.col("e.count").alias("n")) for c in ("top_countries", "top_sponsors")]
    maps = [one.select(F.lit(c).alias("part"), F.explode(c).alias("name", "n")) for c in ("phase_breakdown", "temporal_density")]
    return lists[0].unionByName(lists[1]).unionByName(maps[0]).unionByName(maps[1])


@_query
def site_performance(spark: SparkSession, sf: str) -> DataFrame:
    d = T.site_performance(registry(spark, sf).facilities, modeling(spark, sf))
    return _rounded(d, 6, "avg_enrollment_ratio", "median_enrollment_ratio", "avg_duration_days", "avg_target_enrollment")


# ---- benchmarks and exploration ------------------------------------------------------

def _scored(m: DataFrame) -> DataFrame:
    return m.select("nct_id", "phase", F.col(C.DURATION_TARGET).alias("pred_duration_days"),
                    X.stable_round("sponsor_historical_performance", 6).alias("p_completed"))


_from_modeling(
    phase_benchmark=E.phase_benchmark,
    similar_trials=lambda m: E.similar_trials(m, E.scenario_frame(m.sparkSession, SCENARIOS)),
    duration_ranking=lambda m: E.duration_ranking(_scored(m)),
    duration_summary=lambda m: _rounded(E.duration_summary(m, C.DURATION_TARGET), 4, "median", "q1", "q3"),
    explore_starts_per_year=E.starts_per_year,
    explore_status_share=lambda m: E.share_by(m, "overall_status"),
    explore_phase_counts=lambda m: E.counts_by(m, "phase"),
    explore_enrollment_by_phase=lambda m: E.quantiles_by_phase(m, "enrollment"),
    explore_duration_by_phase=lambda m: E.quantiles_by_phase(m, C.DURATION_TARGET),
    explore_phase_model=lambda m: E.phase_model_pivot(m, MODELS),
    explore_top_conditions=lambda m: E.top_by(m, "condition", 20),
    explore_top_conditions_enrollment=lambda m: E.top_by(m, "condition", 15, "enrollment"),
    explore_sponsor_type_share=lambda m: E.share_by(m, "sponsor_type"),
    explore_success_by_sponsor_type=lambda m: E.success_rate(m, "sponsor_type"),
    explore_success_by_multicountry=lambda m: E.success_rate(m, "is_multicountry"),
    explore_success_by_intervention=lambda m: E.success_rate(m, "intervention_type"),
    explore_intervention_counts=lambda m: E.counts_by(m, "intervention_type"),
    explore_success_by_phase=lambda m: E.success_rate(m, "phase", interval=True),
    explore_success_by_year=E.success_by_year,
    explore_ratio_histogram=E.ratio_histogram,
    labeled_and_unlabeled=lambda m: _with_unlabeled(m),
    explore_enrollment_duration_corr=lambda m: E.correlation(m, "enrollment", C.DURATION_TARGET),
    explore_sites_ratio_corr=lambda m: E.correlation(m, "n_facilities", "enrollment_ratio"),
    label_coverage=lambda m: V.label_coverage(m, C.CLASS_TARGET, ["phase"]),
    duration_cap=lambda m: duration_cap(m),
)


def _with_unlabeled(m: DataFrame) -> DataFrame:
    from trialspark.ml.prep import labeled_rows, with_unlabeled

    both = with_unlabeled(labeled_rows(m).select("nct_id", "phase", C.CLASS_TARGET), m.where(F.col(C.CLASS_TARGET).isNull()).select("nct_id", "phase"))
    return both.groupBy("is_labeled", "phase").agg(F.count(F.lit(1)).alias("n"), F.count(C.CLASS_TARGET).alias("n_with_target"))


def duration_cap(m: DataFrame) -> DataFrame:
    from trialspark.ml.prep import regression_rows

    rows = regression_rows(m)
    cap = exact_percentiles(rows, C.DURATION_TARGET, {"p99": 0.99})
    return rows.agg(F.count(F.lit(1)).alias("n")).withColumn("p99", X.stable_round(cap.scalar(), 6))


# ---- evaluation ------------------------------------------------------------------------

def _scores(lines: DataFrame) -> DataFrame:
    return lines.select((F.col("l_returnflag") == "R").cast("int").alias("label"), (F.col("l_quantity") / 50).alias("score"))


def _predictions(lines: DataFrame) -> DataFrame:
    return lines.select(F.col("l_extendedprice").alias("actual"), (F.col("l_quantity") * 2000).alias("predicted"))


_SWEEP = ["precision_pos", "recall_pos", "f1_pos", "precision_neg", "recall_neg", "f1_neg", "f1_macro", "accuracy"]
_from_base(
    "lineitem",
    confusion_at_threshold=lambda d: _rounded(V.confusion_at(_scores(d), 0.5), 6, *_SWEEP),
    threshold_sweep=lambda d: _rounded(V.threshold_sweep(_scores(d), THRESHOLDS), 6, *_SWEEP),
    pr_curve=lambda d: _rounded(V.classification_curve(_scores(d)), 6, "recall", "false_positive_rate", "precision")
    .drop("pos", "f1_pos", "f1_neg"),
    best_threshold=lambda d: _rounded(V.best_threshold(V.classification_curve(_scores(d))), 6, "f1_neg"),
    average_precision=lambda d: _rounded(V.average_precision(_scores(d)), 6, "average_precision"),
    roc_auc_rank=lambda d: _rounded(V.roc_auc(_scores(d)), 6, "roc_auc"),
    regression_diagnostics=lambda d: _rounded(_rounded(
        V.regression_diagnostics(_predictions(d), "actual", "predicted"), 4, "mae", "rmse", "bias"), 6, "r2"),
    residual_histogram=lambda d: V.histogram(
        _predictions(d).select((F.col("actual") - F.col("predicted")).alias("r")), "r", -60000.0, 60000.0, 60),
    risk_band=lambda d: _scores(d).groupBy(X.risk_band("score").alias("risk_band")).agg(F.count(F.lit(1)).alias("n")),
)


def _labeled(m: DataFrame) -> DataFrame:
    return m.where(F.col(C.CLASS_TARGET).isNotNull()).select("nct_id", F.col(C.CLASS_TARGET).alias("label"))


_from_modeling(
    stratified_split=lambda m: V.stratified_split(_labeled(m), "label"),
    stratified_folds=lambda m: V.stratified_folds(_labeled(m), "label"),
    kaplan_meier=lambda m: _rounded(U.phase_survival_curves(m), 6, "survival").drop("years"),
)

# ---- criteria texts ------------------------------------------------------------------


def _analysis(documents: DataFrame) -> DataFrame:
    """Analysis results derived from each document's own lines, with one severity left out."""
    lines = F.filter(F.split("text", "\r\n|\r|\n"), lambda x: x.rlike(r"\S"))
    d = documents.select("doc_id", lines.alias("lines"))
    severity = F.transform("lines", lambda x: F.when(F.length(x) > 80, "high").when(F.length(x) > 40, "medium").otherwise("low"))
    scored = F.slice(severity, F.lit(1), F.greatest(F.size("lines") - 1, F.lit(0)))
    return d.select("doc_id", F.to_json(F.struct(
        F.col("lines").alias("risk_factors"), scored.alias("severity_scores"),
        F.transform("lines", lambda x: F.concat(F.lit("Relax: "), x)).alias("simplification_suggestions"),
        F.array().cast("array<string>").alias("estimated_population_impact"))).alias("result"))


def _comparison(orders: DataFrame) -> DataFrame:
    price = F.col("o_totalprice")
    impact = F.when(price > 300000, "favorable_A").when(price > 100000, "favorable_B").when(price > 50000, "unclear")
    diff = F.struct(
        F.col("o_orderpriority").alias("criterion"), F.col("o_orderstatus").alias("protocol_a"),
        F.col("o_custkey").cast("string").alias("protocol_b"))
    impacts = F.when(impact.isNotNull(), F.array(impact)).otherwise(F.array().cast("array<string>"))
    return orders.select("o_orderkey", F.to_json(F.struct(
        F.array(diff).alias("differences"), impacts.alias("enrollment_impact"))).alias("result"))


_from_base(
    "documents",
    risk_factor_rows=lambda d: K.risk_factor_rows(_analysis(d), "doc_id"),
    severity_counts=lambda d: K.severity_counts(_analysis(d)),
    criteria_validation=lambda d: K.validate_analysis(_analysis(d), "doc_id"),
)
_from_base("orders", comparison_rows=lambda d: K.comparison_rows(_comparison(d), "o_orderkey"),
           comparison_validation=lambda d: K.validate_comparison(_comparison(d), "o_orderkey"))


@_query
def criteria_enrichment(spark: SparkSession, sf: str) -> DataFrame:
    def line_facts(text: str) -> dict:
        lines = [line for line in (text or "").splitlines() if line.strip()]
        return {"n_lines": len(lines), "longest": max((len(x) for x in lines), default=0)}

    cache = f"{shared_folder(spark)}/criteria-cache-{uuid.uuid4().hex}"
    texts = table(spark, sf, "documents").select("doc_id", "text")
    K.enrich(texts, ["text"], line_facts, cache)
    return K.enrich(texts, ["text"], line_facts, cache).drop("text")  # the second run finds every answer in the cache


# ---- models ------------------------------------------------------------------------
# Every model trains with the default parameters, on all labeled studies of the tables.


def _stored_modeling(spark: SparkSession, sf: str) -> DataFrame:
    """The modeling table written once for a query, since training reads it many times."""
    return stored(modeling(spark, sf))


def _forecaster(m: DataFrame):
    from trialspark.ml.train import Forecaster

    return Forecaster().fit(m)


@_query
def train_classifier(spark: SparkSession, sf: str) -> DataFrame:
    from trialspark.ml.train import Forecaster

    return Forecaster().evaluate(_stored_modeling(spark, sf))


@_query
def train_regressor(spark: SparkSession, sf: str) -> DataFrame:
    m = _stored_modeling(spark, sf)
    scored = _forecaster(m).predict(m, ("nct_id", C.DURATION_TARGET))
    return V.regression_diagnostics(scored, C.DURATION_TARGET, "pred_duration_days")


@_query
def score(spark: SparkSession, sf: str) -> DataFrame:
    m = _stored_modeling(spark, sf)
    return _forecaster(m).predict(m)


@_query
def feature_importance(spark: SparkSession, sf: str) -> DataFrame:
    return _forecaster(_stored_modeling(spark, sf)).feature_importances(spark)


@_query
def tree_node_importance(spark: SparkSession, sf: str) -> DataFrame:
    from trialspark.ml.explain import node_importance

    f = _forecaster(_stored_modeling(spark, sf))
    return node_importance(spark, f.classifier.stages[-1], f.names)


@_query
def importance_divergence(spark: SparkSession, sf: str) -> DataFrame:
    from trialspark.ml.explain import importance_divergence as divergence

    return divergence(_forecaster(_stored_modeling(spark, sf)).feature_importances(spark))


@_query
def explain_scores(spark: SparkSession, sf: str) -> DataFrame:
    from trialspark.ml import explain, prep

    m = _stored_modeling(spark, sf)
    f = _forecaster(m)
    frame = prep.feature_frame(m, ["nct_id"])
    return explain.mean_contributions(explain.explain(spark, f.classifier, frame, "nct_id", f.names), f.names)


@_query
def typed_studies(spark: SparkSession, sf: str) -> DataFrame:
    """Dates and numbers that arrive as text, some of it unreadable."""
    key = F.col("o_orderkey")
    raw = table(spark, sf, "orders").select(
        key.alias("nct_id"), F.when(key % 7 == 0, "soon").otherwise(F.date_format(F.col("o_orderdate").cast("date"), "yyyy-MM-dd")).alias("start_date"),
        F.when(key % 5 == 0, "n/a").when(key % 5 == 1, " 12 ").otherwise(F.floor("o_totalprice").cast("string")).alias("enrollment"),
        F.when(key % 3 == 0, "").otherwise("2001-02-30").alias("completion_date"))
    return conform(raw, "studies").select("nct_id", "start_date", "completion_date", "enrollment")


@_query
def feature_frame(spark: SparkSession, sf: str) -> DataFrame:
    from trialspark.ml import prep

    d = prep.feature_frame(modeling(spark, sf), ["nct_id"])
    return _rounded(d, 6, *[f"f_{c}" for c in prep.NUMERIC])


@_query
def filled_features(spark: SparkSession, sf: str) -> DataFrame:
    """Every feature of the models before it enters the vector: filled numbers, and categories as flags in alphabetical order."""
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    from trialspark.ml import prep

    frame = prep.feature_frame(_stored_modeling(spark, sf), ["nct_id"])
    ready = Pipeline(stages=prep.preparation_stages(frame)).fit(frame).transform(frame)
    flags = [F.array_join(F.transform(vector_to_array(f"x_{c}"), lambda v: v.cast("int").cast("string")), "").alias(f"x_{c}") for c in prep.CATEGORICAL]
    return _rounded(ready.select("nct_id", *[f"x_{c}" for c in prep.NUMERIC], *flags), 6, *[f"x_{c}" for c in prep.NUMERIC])


@_query
def cox_design_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Rows, total and largest value of every covariate; the first category of a column has none."""
    d, names, _, _ = U._cox_frame(_stored_modeling(spark, sf), 1)
    cells = d.select(F.posexplode("x").alias("i", "value")).groupBy("i").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max("value").alias("largest"))
    return _rounded(cells.select(F.get(F.array(*map(F.lit, names)), F.col("i")).alias("covariate"), "n", "total", "largest"), 4, "total", "largest")


@_query
def cox_score_at_zero(spark: SparkSession, sf: str) -> DataFrame:
    completed = X.status_key("overall_status") == "COMPLETED"
    found = U.score_at_zero(modeling(spark, sf), C.DURATION_TARGET, completed, ["phase_numeric", "n_facilities", "n_countries"])
    return _rounded(found, 4, "gradient", "information")


@_query
def cox_coefficients(spark: SparkSession, sf: str) -> DataFrame:
    return U.fit_cox(_stored_modeling(spark, sf)).hazard_ratios(spark)


@_query
def survival_probabilities(spark: SparkSession, sf: str) -> DataFrame:
    m = _stored_modeling(spark, sf)
    model = U.fit_cox(m)
    d = model.predict_median(model.predict_survival(m))
    return d.select("nct_id", *[f"S_t{t}" for t in C.SURVIVAL_TIME_POINTS], "pred_median_duration_days")


@_query
def survival_curve(spark: SparkSession, sf: str) -> DataFrame:
    """Survival of every study at three points of its own, from the hazard of all studies and given coefficients."""
    m = _stored_modeling(spark, sf)
    hazard = stored(U.nelson_aalen(m.where(P.known_positive(C.DURATION_TARGET)), C.DURATION_TARGET, X.status_key("overall_status") == "COMPLETED"))
    risk = F.exp(0.2 * (F.col("phase_numeric") - 2) - 0.05 * (F.col("n_facilities") - 3))
    points = F.array(F.lit(0.5), F.lit(60.0), F.col("n_facilities") * 400.0)
    curve = U.survival_at(m.select("nct_id", "n_facilities", risk.alias("risk")), hazard, points)
    return _rounded(curve.select("nct_id", "t", "survival"), 6, "survival")


@_query
def scenario_forecast(spark: SparkSession, sf: str) -> DataFrame:
    """A hypothetical study like the average one of every phase and type of sponsor: scores and survival curve."""
    m = _stored_modeling(spark, sf)
    scenarios = m.where("phase_numeric IS NOT NULL").groupBy("phase_numeric", "sponsor_type").agg(
        *[F.round(F.avg(c)).alias(c) for c in ("n_facilities", "n_countries", "n_eligibility_criteria", "enrollment")],
        F.lit(MODELS[0]).alias("intervention_model"), F.lit("Double").alias("masking"))
    scenarios = scenarios.withColumn("scenario", F.concat_ws("/", F.col("phase_numeric").cast("string"), "sponsor_type"))
    return _forecaster(m).forecast(E.complete_scenarios(scenarios), U.fit_cox(m))


@_query
def cross_validation(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics of every stratified fold, with their mean and deviation."""
    from trialspark.ml.train import Forecaster

    folds = Forecaster().cross_validate(_stored_modeling(spark, sf))
    return join_on(folds, V.fold_summary(folds, ["roc_auc", "f1"]), [])


@_query
def weight_sweep(spark: SparkSession, sf: str) -> DataFrame:
    from trialspark.ml.train import Forecaster

    return Forecaster().weight_sweep(_stored_modeling(spark, sf))


# The rules behind the model reports, over values that the tables give, so that SQL can follow them.

@_query
def importance_normalisation(spark: SparkSession, sf: str) -> DataFrame:
    from trialspark.ml.explain import normalized_long

    wide = table(spark, sf, "part").groupBy(F.col("p_brand").alias("feature")).agg(
        F.sum(F.floor("p_retailprice")).cast("double").alias("gain"), F.count(F.lit(1)).cast("double").alias("weight"), F.lit(0.0).alias("cover"))
    return _rounded(normalized_long(wide, "feature", ["gain", "weight", "cover"]), 6, "score_norm")


@_query
def importance_agreement(spark: SparkSession, sf: str) -> DataFrame:
    from trialspark.ml.explain import importance_divergence as divergence

    own = table(spark, sf, "part").groupBy(F.col("p_brand").alias("feature")).agg(
        F.sum(F.floor("p_retailprice")).cast("double").alias("clf_importance"), F.sum("p_size").cast("double").alias("reg_importance"))
    own = own.withColumn("mean_importance", (F.col("clf_importance") + F.col("reg_importance")) / 2)
    return _rounded(divergence(own, top=15, limit=0.05), 6, "clf_norm", "reg_norm", "delta", "agreement")


@_query
def contribution_waterfall(spark: SparkSession, sf: str) -> DataFrame:
    from trialspark.ml.explain import row_waterfall

    values = F.array(F.col("p_size") - 25.0, F.floor("p_retailprice") - 1200.0, F.col("p_partkey") % 7 - 3.0, F.lit(0.5))
    return row_waterfall(table(spark, sf, "part").select("p_partkey", values.alias("contributions")), ["size", "price", "key", "rest"], "p_partkey", top=3)
