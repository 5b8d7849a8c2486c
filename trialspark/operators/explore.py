"""Exploratory aggregates, benchmarks and dataset summaries over the modeling table and the registry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from trialspark.functions import columns as X, constants as C, filters as P
from trialspark.operators.evaluation import describe, histogram
from trialspark.operators.ordered import exact_percentiles
from trialspark.session import checkpointed
from trialspark.sources.registry import TrialTables


def counts_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_trials"))


def share_by(df: DataFrame, key: str) -> DataFrame:
    """Rows per value and percent of all rows."""
    total = df.agg(F.count(F.lit(1))).scalar()
    return counts_by(df, key).withColumn("share_pct", X.stable_round(F.col("n_trials") / total * 100, 2))


def starts_per_year(df: DataFrame) -> DataFrame:
    return counts_by(df.where(F.col("start_date").isNotNull()).withColumn("start_year", F.year("start_date")), "start_year")


def quantiles_by_phase(df: DataFrame, value: str) -> DataFrame:
    out = describe(df.where(F.col("phase").isNotNull()), value, ["phase"])
    return out.select("phase", "n", "min", *[X.stable_round(c, 4).alias(c) for c in ("mean", "q1", "median", "q3")], "max")


def phase_model_pivot(df: DataFrame, models: Sequence[str]) -> DataFrame:
    """Phase by intervention model, one column per listed model."""
    wide = df.groupBy("phase").pivot("intervention_model", list(models)).agg(F.count(F.lit(1)))
    return wide.fillna(0, subset=list(models))


def top_by(df: DataFrame, key: str, n: int, total_of: str | None = None) -> DataFrame:
    """The ``n`` values with most rows, or with the largest total of a column."""
    known = df.where(F.col(key).isNotNull()).groupBy(key)
    if total_of is None:
        agg, order = known.agg(F.count(F.lit(1)).alias("n_trials")), "n_trials"
    else:
        agg, order = known.agg(F.sum(total_of).alias(f"total_{total_of}")), f"total_{total_of}"
    return agg.orderBy(F.col(order).desc_nulls_last(), key).limit(n)


def success_rate(df: DataFrame, key: str, interval: bool = False) -> DataFrame:
    """Labeled studies and positive rate per value, optionally with a 95 % normal interval."""
    label = F.col(C.CLASS_TARGET)
    p = F.avg(label)
    out = df.where(label.isNotNull()).groupBy(key).agg(
        F.count(F.lit(1)).alias("n_labeled"), X.stable_round(p, 4).alias("success_rate"), p.alias("_p"))
    if interval:
        half = 1.96 * F.sqrt(F.col("_p") * (1 - F.col("_p")) / F.col("n_labeled"))
        out = out.withColumns({"ci_low": X.stable_round(F.col("_p") - half, 4),
                               "ci_high": X.stable_round(F.col("_p") + half, 4)})
    return out.drop("_p")


def success_by_year(df: DataFrame) -> DataFrame:
    d = df.where(F.col("start_date").isNotNull()).withColumn("start_year", F.year("start_date"))
    return d.groupBy("start_year").agg(
        F.count(F.lit(1)).alias("n_trials"), F.count(C.CLASS_TARGET).alias("n_labeled"),
        X.stable_round(F.avg(C.CLASS_TARGET), 4).alias("success_rate"))


def ratio_histogram(df: DataFrame, bins: int = 40, high: float = 2.0) -> DataFrame:
    """Enrollment-ratio bins; ``met`` marks bins from the 90 % threshold on."""
    h = histogram(df, "enrollment_ratio", 0.0, high, bins)
    return h.withColumn("met", F.col("bin_start") >= 0.9 - 1e-9)


def sites_by_country(facilities: DataFrame, n: int | None = 20) -> DataFrame:
    counts = facilities.where(P.not_withdrawn() & F.col("country").isNotNull()).groupBy("country").agg(
        F.count(F.lit(1)).alias("site_count"))
    return counts if n is None else counts.orderBy(F.col("site_count").desc(), "country").limit(n)


def correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return d.agg(F.count(F.lit(1)).alias("n"), X.stable_round(F.corr(x, y), 6).alias("corr"))


def pair_sample(df: DataFrame, columns: Sequence[str], fraction: float, seed: int = 42) -> DataFrame:
    """Rows for a scatter plot, chosen by a hash of the identifier, so every run shows the same ones."""
    limit = int(fraction * 1_000_000)
    chosen = F.pmod(F.xxhash64(F.col("nct_id").cast("string"), F.lit(seed)), F.lit(1_000_000)) < limit
    return df.where(chosen).select("nct_id", *columns)


# ---- summaries -----------------------------------------------------------------

def kpi_summary(tables: TrialTables, approximate: bool = False) -> DataFrame:
    """Distinct studies, conditions and countries; each table is scanned for one column."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    scalar = lambda df, c: df.agg(distinct(c)).scalar()
    return tables.studies.agg(F.count(F.lit(1)).alias("n_trials")).withColumns({
        "n_conditions": scalar(tables.conditions, "downcase_name"),
        "n_countries": scalar(tables.countries, "name")})


def kpi_sketches(tables: TrialTables, **batches: str | Column) -> DataFrame:
    """(metric, batch, rows, sketch): a mergeable sketch of the distinct values of every batch of every counted table.

    ``batches`` names, for a table, what a batch is, such as the file a load brought or the day of it. Sketches have a fixed size,
    so a summary of any number of loads reads them instead of the tables; new loads only add rows.
    """
    counted = {"n_trials": ("studies", "nct_id"), "n_conditions": ("conditions", "downcase_name"), "n_countries": ("countries", "name")}
    out = None
    for metric, (table, column) in counted.items():
        df = getattr(tables, table)
        batch = batches.get(table, F.lit(""))
        one = df.groupBy((F.col(batch) if isinstance(batch, str) else batch).cast("string").alias("batch")).agg(
            F.count(F.lit(1)).alias("rows"), F.hll_sketch_agg(F.col(column).cast("string"), 14).alias("sketch"))
        one = one.select(F.lit(metric).alias("metric"), "batch", "rows", "sketch")
        out = one if out is None else out.unionByName(one)
    return out


def kpi_from_sketches(sketches: DataFrame) -> DataFrame:
    """The KPIs of all batches together: studies exactly, distinct values within two per cent or so."""
    one = lambda c: F.when(F.col("metric") == c, F.col("sketch"))
    return sketches.agg(
        F.coalesce(F.sum(F.when(F.col("metric") == "n_trials", F.col("rows"))), F.lit(0)).alias("n_trials"),
        *[F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(one(c))), F.lit(0)).alias(c) for c in ("n_conditions", "n_countries")])


def dataset_summary(tables: TrialTables) -> DataFrame:
    """Long table (metric, key, value) of row counts, phases, statuses and distinct values."""
    def one(df: DataFrame, metric: str, value) -> DataFrame:
        return df.agg(value.alias("value")).select(F.lit(metric).alias("metric"), F.lit("").alias("key"), "value")

    def per_value(df: DataFrame, metric: str, key: str) -> DataFrame:
        kept = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("value"))
        return kept.select(F.lit(metric).alias("metric"), F.col(key).alias("key"), "value")

    rows = F.count(F.lit(1))
    parts = [one(tables.studies, "total_studies", rows), per_value(tables.studies, "phase", "phase"),
             per_value(tables.studies, "status", "overall_status")]
    if tables.conditions is not None:
        parts.append(one(tables.conditions, "unique_conditions", F.count_distinct("name")))
    if tables.facilities is not None:
        parts += [one(tables.facilities, "facility_records", rows),
                  one(tables.facilities, "unique_countries", F.count_distinct("country"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def phase_benchmark(modeling: DataFrame) -> DataFrame:
    """Box statistics of known positive durations per phase, and the median in months."""
    out = describe(modeling.where(P.known_positive(C.DURATION_TARGET)), C.DURATION_TARGET, ["phase_numeric"])
    return out.select(
        "phase_numeric", "n", "min", "max",
        *[X.stable_round(c, 4).alias(c) for c in ("mean", "q1", "median", "q3")],
        X.stable_round(X.months("median"), 4).alias("median_months"))


_SCENARIO_SCHEMA = (
    "scenario string, phase_numeric double, n_facilities long, n_countries long, "
    "n_eligibility_criteria double, enrollment double, sponsor_type string, intervention_model string, masking string"
)


def complete_scenarios(scenarios: DataFrame) -> DataFrame:
    """Hypothetical studies completed with the fixed defaults of the forecast form; NULL where a given column is absent."""
    names, kinds = zip(*(part.split() for part in _SCENARIO_SCHEMA.split(", ")), strict=True)
    d = scenarios.select(*[(F.col(n) if n in scenarios.columns else F.lit(None)).cast(k).alias(n) for n, k in zip(names, kinds, strict=True)])
    return d.withColumns({
        "geographic_concentration": F.round(1.0 / F.greatest(F.col("n_countries"), F.lit(1)), 4),
        "condition_prevalence_proxy": F.lit(50.0),
        "sponsor_historical_performance": F.lit(0.75),
        "competing_trials_count": F.lit(10).cast("long"),
        "enrollment_type_is_actual": F.lit(0),
        "is_multicountry": F.col("n_countries") > 1,
    })


def scenario_frame(spark, scenarios: Sequence[dict]) -> DataFrame:
    """Scenarios given as dictionaries, completed."""
    names = [part.split()[0] for part in _SCENARIO_SCHEMA.split(", ")]
    return complete_scenarios(spark.createDataFrame([tuple(s.get(n) for n in names) for s in scenarios], _SCENARIO_SCHEMA))


_DISTANCE = {"n_countries": 0.3, "n_facilities": 0.01, "enrollment": 1.0}  # the last gap counts relative to the scenario's own enrollment
_CELLS = {"n_countries": 4, "n_facilities": 4, "enrollment": 8}  # of a bucket per factor of two


def _cell(prefix: str = "") -> Column:
    """The bucket of a study's values: powers of two cut into steps, so that buckets are few whatever the number of studies."""
    steps = [F.floor(F.log2(1 + F.greatest(F.col(prefix + c).cast("double"), F.lit(0.0))) * n).cast("string") for c, n in _CELLS.items()]
    return F.concat_ws("/", *steps)


def nearest_buckets(past: DataFrame, scenarios: DataFrame, k: int) -> DataFrame:
    """(phase_numeric, _class, _cell): the buckets of studies that can hold one of the ``k`` nearest of a class of scenarios.

    ``past`` and ``scenarios`` carry their buckets. From the least and greatest values of both follow bounds of every
    distance between them. Buckets in the order of their upper bounds are sure to offer ``k`` studies within some distance; a
    bucket whose lower bound is beyond that is left out. Only bucket tables meet here.
    """
    def ranges(df, cell, prefix, n):
        return df.groupBy("phase_numeric", cell).agg(F.count(F.lit(1)).alias(n), *[
            f(F.col(prefix + c).cast("double")).alias(f"{n}_{k}_{c}") for c in _DISTANCE for k, f in (("low", F.min), ("high", F.max))])

    pairs = ranges(scenarios, "_class", "_", "s").join(ranges(past, "_cell", "", "p"), "phase_numeric")
    col = lambda side, end, c: F.col(f"{side}_{end}_{c}")
    scale = lambda c, end: F.greatest(col("s", end, c), F.lit(1.0)) if c == "enrollment" else F.lit(1.0)
    low, high = F.lit(0.0), F.lit(0.0)
    for c, w in _DISTANCE.items():
        least = F.greatest(F.lit(0.0), col("p", "low", c) - col("s", "high", c), col("s", "low", c) - col("p", "high", c))
        most = F.greatest(col("p", "high", c) - col("s", "low", c), col("s", "high", c) - col("p", "low", c))
        low, high = low + least * w / scale(c, "high"), high + most * w / scale(c, "low")
    own = Window.partitionBy("phase_numeric", "_class")
    pairs = pairs.select("phase_numeric", "_class", "_cell", "p", low.alias("low"), high.alias("high"))
    pairs = pairs.withColumn("offered", F.sum("p").over(own.orderBy("high").rowsBetween(Window.unboundedPreceding, 0)))
    pairs = pairs.withColumn("enough", F.min(F.when(F.col("offered") >= k, F.col("high"))).over(own))
    return pairs.where("enough IS NULL OR low <= enough + 1e-8").select("phase_numeric", "_class", "_cell")  # distances are rounded


def similar_trials(modeling: DataFrame, scenarios: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` nearest historical studies of the same phase per scenario; ties go to the smaller id.

    A scenario meets only the buckets that can hold one of its nearest. Of studies that are equal in all compared values
    ``k`` are enough, so a bucket with very many of them stays small; each task keeps its best ``k`` per scenario before the shuffle. Scenarios and
    studies that lack one of the values are not compared.
    """
    has = lambda prefix: F.forall(F.array(*[F.col(prefix + c).isNotNull() for c in _DISTANCE]), lambda x: x)
    s = scenarios.select("scenario", "phase_numeric", *[F.col(c).alias(f"_{c}") for c in _DISTANCE])
    s = s.where(has("_")).withColumn("_class", _cell("_"))
    past = modeling.where(P.known_positive(C.DURATION_TARGET) & has("")).select(
        "nct_id", "phase_numeric", "n_facilities", "n_countries", "enrollment", C.DURATION_TARGET, C.CLASS_TARGET)
    equal = Window.partitionBy("phase_numeric", *_DISTANCE).orderBy("nct_id")
    past = past.withColumn("_equal", F.row_number().over(equal)).where(F.col("_equal") <= k).drop("_equal")
    past = checkpointed(past.withColumn("_cell", _cell()))
    d = past.join(nearest_buckets(past, s, k), ["phase_numeric", "_cell"]).join(s, ["phase_numeric", "_class"])
    gap = lambda c: F.abs(F.col(c) - F.col(f"_{c}"))
    distance = gap("n_countries") * 0.3 + gap("n_facilities") * 0.01 + gap("enrollment") / F.greatest(
        F.col("_enrollment"), F.lit(1.0))
    d = d.withColumn("distance", X.stable_round(distance, 9)).drop("_n_countries", "_n_facilities", "_enrollment", "_class", "_cell")
    w = Window.partitionBy("scenario").orderBy("distance", "nct_id")
    return d.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)


def duration_ranking(scored: DataFrame, max_rows: int = 50, threshold: float = C.DECISION_THRESHOLD) -> DataFrame:
    """Longest predicted durations with their risk band."""
    known = scored.where(F.col("pred_duration_days").isNotNull())
    top = known.orderBy(F.col("pred_duration_days").desc(), "nct_id").limit(max_rows)
    return top.withColumn("risk_band", X.risk_band("p_completed", threshold))


def duration_summary(scored: DataFrame, value: str = "pred_median_duration_days") -> DataFrame:
    """Median and interquartile range of predicted durations."""
    return exact_percentiles(scored, value, {"median": 0.5, "q1": 0.25, "q3": 0.75})


def value_counts(df: DataFrame, key: str) -> DataFrame:
    """Non-NULL values by frequency."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
