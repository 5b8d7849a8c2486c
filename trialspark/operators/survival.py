"""Survival analysis: product-limit curves and a Cox proportional-hazards model fitted by Spark."""

from __future__ import annotations

import bisect
import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.storagelevel import StorageLevel

from trialspark.functions import columns as X, constants as C, filters as P
from trialspark.operators.ordered import count_at_most
from trialspark.sources.registry import path_exists


def kaplan_meier(
    df: DataFrame, duration: str, event: Column, by: Sequence[str], min_rows: int = 20
) -> DataFrame:
    """S(t) = product over t_i <= t of (1 - d_i / n_i), per group with at least ``min_rows`` rows.

    Durations are cut to whole days, so a group has one row per distinct day after the first aggregation
    and the windows stay small whatever the number of studies.
    """
    by = list(by)
    rows = df.where(F.col(duration).isNotNull()).groupBy(*by, F.floor(F.col(duration)).cast("double").alias("days")).agg(
        F.count(F.lit(1)).alias("n_here"), F.sum(F.coalesce(event.cast("int"), F.lit(0))).alias("events"))
    group = Window.partitionBy(*by)
    later = group.orderBy("days").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    upto = group.orderBy("days").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"at_risk": F.sum("n_here").over(later), "_size": F.sum("n_here").over(group)})
    all_ended = F.col("events") == F.col("at_risk")
    step = F.when(all_ended, F.lit(0.0)).otherwise(F.log(1 - F.col("events") / F.col("at_risk")))
    ended = F.max(all_ended.cast("int")).over(upto) == 1
    survival = F.when(ended, F.lit(0.0)).otherwise(F.exp(F.sum(step).over(upto)))
    return rows.where(F.col("_size") >= min_rows).withColumn("survival", survival).drop("_size", "n_here")


def phase_survival_curves(modeling: DataFrame, phases: Sequence[str] = C.SINGLE_PHASES, min_rows: int = 20) -> DataFrame:
    """Share of studies still running after ``years``, per phase."""
    d = modeling.where(P.known_positive(C.DURATION_TARGET) & F.col("phase").isin(*phases))
    curve = kaplan_meier(d, C.DURATION_TARGET, X.status_key("overall_status") == "COMPLETED", ["phase"], min_rows)
    return curve.withColumn("years", F.col("days") / 365.25)


def nelson_aalen(df: DataFrame, duration: str, event: Column) -> DataFrame:
    """(day, cumulative_hazard): sum over days up to here of events / rows at risk. Windows run over distinct days only."""
    days = df.where(F.col(duration).isNotNull()).groupBy(F.floor(F.col(duration)).cast("double").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(event.cast("int"), F.lit(0))).alias("events"))
    at_risk = F.sum("n").over(Window.orderBy("day").rowsBetween(Window.currentRow, Window.unboundedFollowing))
    days = days.withColumn("step", F.col("events") / at_risk)
    return days.select("day", F.sum("step").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("cumulative_hazard"))


def survival_at(rows: DataFrame, baseline: DataFrame, time_points: Sequence[float] | Column, risk: str = "risk") -> DataFrame:
    """Rows times time points ``t``, with the baseline hazard of the last day not after ``t`` and exp(-hazard * risk).

    The as-of join is an equi-join: baseline days are whole, so each is spread over the days up to the next one, and a
    point after the last day takes the last. The spread table has one row a day, decades are ten thousand. Before the first
    day the hazard is 0; a NULL point or risk has no survival.
    """
    points = time_points if isinstance(time_points, Column) else F.array(*[F.lit(float(t)) for t in time_points])
    after = F.lead("day").over(Window.orderBy("day"))
    last = baseline.agg(F.max("day")).scalar().cast("long")
    spread = baseline.withColumn("_next", F.coalesce(after - 1, F.col("day"))).select(
        F.explode(F.sequence(F.col("day").cast("long"), F.col("_next").cast("long"))).alias("_day"), "cumulative_hazard")
    d = rows.withColumn("t", F.explode(points)).withColumn("_day", F.least(F.floor("t"), last))
    d = d.join(spread, "_day", "left").drop("_day").withColumn("cumulative_hazard", F.when(F.col("t").isNotNull(), F.coalesce("cumulative_hazard", F.lit(0.0))))
    return d.withColumn("survival", F.exp(-F.col("cumulative_hazard") * F.col(risk)))


# ---- Cox proportional hazards -------------------------------------------------------

MOST_CATEGORIES = 200  # of one column; each but the first is a covariate

@dataclass
class CoxModel:
    """Coefficients on standardised covariates, their scale, and the baseline hazard by day."""

    names: list[str]
    beta: list[float]
    covariance: list[list[float]]
    means: list[float]
    scales: list[float]
    days: list[float]
    cumulative_hazard: list[float]
    medians: dict[str, float]
    categories: dict[str, list[str]]

    def hazard_ratios(self, spark: SparkSession, top: int = 20) -> DataFrame:
        """exp(coef) with 95 % bounds and p-value on the original scale, largest effects first."""
        rows = []
        for i, name in enumerate(self.names):
            coef, se = self.beta[i] / self.scales[i], math.sqrt(max(self.covariance[i][i], 0.0)) / self.scales[i]
            z = coef / se if se > 0 else 0.0
            bound = lambda v: math.exp(min(max(v, -700.0), 700.0))
            rows.append((name, coef, se, bound(coef), bound(coef - 1.96 * se), bound(coef + 1.96 * se), z,
                         math.erfc(abs(z) / math.sqrt(2))))
        d = spark.createDataFrame(
            rows, "covariate string, coef double, se double, hazard_ratio double, ci_low double, ci_high double, z double, p double")
        return d.orderBy(F.abs(F.col("coef")).desc(), "covariate").limit(top).orderBy(F.col("hazard_ratio").desc(), "covariate")

    def _linear_predictor(self, df: DataFrame) -> Column:
        x = cox_covariates(df, self.medians, self.categories)
        terms = [(x[n] - m) / s * b for n, m, s, b in zip(self.names, self.means, self.scales, self.beta)]
        return sum(terms[1:], terms[0])

    def predict_survival(self, df: DataFrame, time_points: Sequence[int] = C.SURVIVAL_TIME_POINTS) -> DataFrame:
        """S_t<days> columns: probability of still running at each time point."""
        risk = F.exp(self._linear_predictor(df))
        out = {}
        for t in time_points:
            k = bisect.bisect_right(self.days, t)
            h = self.cumulative_hazard[k - 1] if k else 0.0
            out[f"S_t{t}"] = F.exp(-F.lit(h) * risk)
        return df.withColumns(out)

    def baseline(self, spark: SparkSession) -> DataFrame:
        """(day, cumulative_hazard): one row per distinct duration day, thousands whatever the number of studies."""
        return spark.createDataFrame(list(zip(self.days, self.cumulative_hazard, strict=True)), "day double, cumulative_hazard double")

    def predict_curve(self, df: DataFrame, time_points: Sequence[float] | Column = C.SURVIVAL_TIME_POINTS) -> DataFrame:
        """One row per study and time point: ``t`` and ``survival``. The points may be an array column of the studies' own."""
        rows = df.withColumn("risk", F.exp(self._linear_predictor(df)))
        return survival_at(rows, self.baseline(df.sparkSession), time_points).drop("risk", "cumulative_hazard")

    def predict_median(self, df: DataFrame, out: str = "pred_median_duration_days") -> DataFrame:
        """First day with S <= 0.5; infinity when the curve never gets there."""
        one = df.sparkSession.createDataFrame([(self.days, self.cumulative_hazard)], "days array<double>, hazard array<double>")
        needed = F.lit(math.log(2.0)) / F.exp(self._linear_predictor(df))
        df = df.withColumns({"__days": one.select("days").scalar(), "__hazard": one.select("hazard").scalar()})
        first = F.get("__days", count_at_most(F.col("__hazard"), needed, strict=True))
        return df.withColumn(out, F.coalesce(first, F.lit(float("inf")))).drop("__days", "__hazard")

    def save(self, spark: SparkSession, path: str) -> None:
        """Coefficient, baseline and setting tables as parquet."""
        meta = json.dumps({k: getattr(self, k) for k in (
            "names", "beta", "covariance", "means", "scales", "medians", "categories")})
        spark.createDataFrame([(meta,)], "meta string").write.mode("overwrite").parquet(f"{path}/meta")
        spark.createDataFrame(list(zip(self.days, self.cumulative_hazard)), "day double, cumulative_hazard double"
                              ).write.mode("overwrite").parquet(f"{path}/baseline")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "CoxModel":
        if not path_exists(spark, f"{path}/meta"):
            raise FileNotFoundError(f"no saved model at {path}")
        meta = json.loads(spark.read.parquet(f"{path}/meta").first()["meta"])
        base = spark.read.parquet(f"{path}/baseline").orderBy("day").collect()
        return cls(days=[r["day"] for r in base], cumulative_hazard=[r["cumulative_hazard"] for r in base], **meta)


def cox_covariates(df: DataFrame, medians: dict[str, float], categories: dict[str, list[str]]) -> dict[str, Column]:
    """Named covariate columns: filled numbers, flags, and one 0/1 column per category but the first."""
    out: dict[str, Column] = {}
    for c in C.NUMERIC_FEATURES:
        value = X.parse_number(c) if c in df.columns else F.lit(None).cast("double")
        value = X.log_scaled(value) if c in C.LOG_FEATURES else value
        out[c] = F.coalesce(value, F.lit(medians.get(f"f_{c}", 0.0)))
    for c in C.BOOLEAN_FEATURES:
        out[c] = F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0)
    for c, values in categories.items():
        text = F.coalesce(F.col(c).cast("string"), F.lit("Unknown")) if c in df.columns else F.lit("Unknown")
        for v in values[1:]:
            out[f"{c}_{v}"] = (text == v).cast("double")
    return out


def fit_cox(
    modeling: DataFrame, penalizer: float = 0.1, min_days: float = 1, max_iter: int = 25, tolerance: float = 1e-7,
) -> CoxModel:
    """Penalised Cox model of completion: Efron ties, mean log partial likelihood - penalizer/2 * |beta|^2.

    A Newton step is two Spark jobs. The first reduces the studies to one row of 2 + 3p sums per distinct duration
    day; only these rows, thousands whatever the number of studies, reach the driver. The driver turns them into one
    weight per day, and the second job sums the weighted p x p products of all rows. Steps that do not raise the
    likelihood are halved. Raises ``RuntimeError`` if ``max_iter`` steps do not converge.
    """
    d, names, medians, categories = _cox_frame(modeling, min_days)
    d = d.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _newton(d, names, medians, categories, penalizer, max_iter, tolerance)
    finally:
        d.unpersist()


def _cox_frame(modeling: DataFrame, min_days: float) -> tuple[DataFrame, list[str], dict, dict]:
    """(day, event, x) of the studies with a duration, the names of the covariates, medians and categories."""
    from trialspark.ml.prep import exact_medians, feature_frame

    rows = modeling.where(F.col(C.DURATION_TARGET).isNotNull() & (F.col(C.DURATION_TARGET) >= min_days))
    frame = feature_frame(rows)
    medians = exact_medians(frame, [f"f_{c}" for c in C.NUMERIC_FEATURES])
    categories = {}
    for c in C.CATEGORICAL_FEATURES:
        found = [r[0] for r in frame.select(f"f_{c}").distinct().limit(MOST_CATEGORIES + 1).collect()]
        if len(found) > MOST_CATEGORIES:
            raise ValueError(f"{c} has more than {MOST_CATEGORIES} values: group them first")
        categories[c] = sorted(found)
    covariates = cox_covariates(rows, medians, categories)
    d = rows.select(
        F.floor(F.col(C.DURATION_TARGET)).cast("double").alias("day"),
        F.coalesce(X.status_key("overall_status") == "COMPLETED", F.lit(False)).alias("event"),
        F.array(*covariates.values()).alias("x"))
    return d, list(covariates), medians, categories


def score_at_zero(rows: DataFrame, duration: str, event: Column, covariates: Sequence[str]) -> DataFrame:
    """Per covariate: events, rows at risk on the first day, and gradient and information of the log partial
    likelihood (Efron ties, raw scale) at coefficients of zero. Rows with a NULL among them are left out."""
    d = rows.select(F.floor(F.col(duration)).cast("double").alias("day"), F.coalesce(event, F.lit(False)).alias("event"),
                    F.array(*[F.col(c).cast("double") for c in covariates]).alias("x"))
    d = d.where(F.col("day").isNotNull() & ~F.exists("x", F.isnull))
    p = len(covariates)
    zero, one = np.zeros(p), np.ones(p)
    sums = _day_sums(d, zero, zero, one)
    _, gradient, weights = _first_order(sums, p, zero)
    information = _information(d, sums, weights, zero, zero, one)
    return rows.sparkSession.createDataFrame(
        [(c, int(sums[:, 1].sum()), int(round(sums[:, 2].sum())), float(gradient[i]), float(information[i, i])) for i, c in enumerate(covariates)],
        "covariate string, events long, at_risk long, gradient double, information double")


def _newton(d, names, medians, categories, penalizer, max_iter, tolerance) -> CoxModel:
    p = len(names)
    stats = d.agg(F.count(F.lit(1)).alias("n"), *[
        f(F.col("x")[i]).alias(f"{k}{i}") for i in range(p) for k, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    if stats["n"] < 2:
        raise ValueError("too few studies with a duration")
    means = np.array([stats[f"m{i}"] for i in range(p)], dtype=float)
    scales = np.array([stats[f"s{i}"] or 0.0 for i in range(p)], dtype=float)
    scales[~(scales > 1e-12)] = 1.0
    n, beta = stats["n"], np.zeros(p)

    def at(beta):
        sums = _day_sums(d, beta, means, scales)
        value, gradient, weights = _first_order(sums, p, beta)
        return sums, value / n - penalizer / 2 * beta @ beta, gradient / n - penalizer * beta, weights

    sums, value, gradient, weights = at(beta)
    information = _information(d, sums, weights, beta, means, scales)
    for _ in range(max_iter):
        step = np.linalg.solve(information / n + penalizer * np.eye(p), gradient)
        while True:
            sums, new, gradient, weights = at(beta + step)
            if new >= value - 1e-10 * (1 + abs(value)) or np.max(np.abs(step)) < tolerance:
                break
            step = step / 2
        beta, value = beta + step, new
        information = _information(d, sums, weights, beta, means, scales)
        if np.max(np.abs(step)) < tolerance:
            break
    else:
        raise RuntimeError(f"the Cox model has not converged in {max_iter} steps (last step {np.max(np.abs(step)):.2g})")
    covariance = np.linalg.inv(information + n * penalizer * np.eye(p))
    at_risk = np.cumsum(sums[::-1, 2])[::-1]
    hazard = np.cumsum(sums[:, 1] / at_risk)
    return CoxModel(names, beta.tolist(), covariance.tolist(), means.tolist(), scales.tolist(),
                    sums[:, 0].tolist(), hazard.tolist(), medians, categories)


def _day_sums(d: DataFrame, beta: np.ndarray, means: np.ndarray, scales: np.ndarray) -> np.ndarray:
    """Per day, in order: day, events, then sums of risk and risk * z over all rows and over events, and z over events."""

    def by_day(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                z = (np.stack(batch["x"].to_numpy()) - means) / scales
                r = np.exp(z @ beta)[:, None]
                e = batch["event"].to_numpy(dtype=float)[:, None]
                order = np.argsort(batch["day"].to_numpy(), kind="stable")
                days, first = np.unique(batch["day"].to_numpy()[order], return_index=True)
                sums = np.hstack([e, r, r * z, e * r, e * r * z, e * z])[order]
                yield pd.DataFrame({"day": days, "sums": list(np.add.reduceat(sums, first, axis=0))})

    p = len(beta)
    parts = d.mapInPandas(by_day, "day double, sums array<double>")
    merged = parts.groupBy("day").agg(F.array(*[F.sum(F.col("sums")[i]) for i in range(3 + 3 * p)]).alias("sums")).toPandas()
    merged = merged.sort_values("day")
    if not len(merged):
        raise ValueError("no rows with a duration")
    return np.column_stack([merged["day"].to_numpy(), np.stack(merged["sums"].to_numpy())])


def _first_order(sums: np.ndarray, p: int, beta: np.ndarray) -> tuple[float, np.ndarray, dict]:
    """Log partial likelihood and its gradient with Efron's tie correction, and what the information needs of every day."""
    events = sums[:, 1]
    risk = np.cumsum(sums[::-1, 2:3 + p], axis=0)[::-1]
    tied, x_events = sums[:, 3 + p:4 + 2 * p], sums[:, 4 + 2 * p:]
    on = np.flatnonzero(events)
    log_w, a0, a1, b0, b1, b2 = np.zeros((6, len(sums)))
    log_w[on], a0[on], a1[on], b0[on], b1[on], b2[on] = efron_sums(risk[on, 0], tied[on, 0], events[on])
    r1, t1 = risk[:, 1:], tied[:, 1:]
    value = float(x_events.sum(0) @ beta - log_w.sum())
    gradient = x_events.sum(0) - r1.T @ a0 + t1.T @ a1
    cross = (r1 * b1[:, None]).T @ t1
    means = (r1 * b0[:, None]).T @ r1 - cross - cross.T + (t1 * b2[:, None]).T @ t1
    return value, gradient, {"all": np.cumsum(a0), "events": a1, "means": means}


def _information(d: DataFrame, sums: np.ndarray, weights: dict, beta, means, scales) -> np.ndarray:
    """The p x p information: one sum of risk * weight(day) * z z' over all rows, less the products of the risk means."""
    days, of_all, of_events = sums[:, 0], weights["all"], weights["events"]

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(beta), len(beta)))
        for batch in batches:
            if len(batch):
                z = (np.stack(batch["x"].to_numpy()) - means) / scales
                at = np.searchsorted(days, batch["day"].to_numpy())
                w = np.exp(z @ beta) * (of_all[at] - batch["event"].to_numpy(dtype=float) * of_events[at])
                total += (z * w[:, None]).T @ z
        yield pd.DataFrame({"row": range(len(beta)), "sums": list(total)})

    p = len(beta)
    parts = d.mapInPandas(products, "row int, sums array<double>")
    rows = parts.groupBy("row").agg(F.array(*[F.sum(F.col("sums")[i]) for i in range(p)]).alias("sums")).collect()
    total = np.zeros((p, p))
    for r in rows:
        total[r["row"]] = r["sums"]
    return total - weights["means"]


def efron_sums(risk: np.ndarray, tied: np.ndarray, events: np.ndarray, direct: int = 24) -> tuple[np.ndarray, ...]:
    """Sums over k < d of log w, 1/w, s/w, 1/w^2, s/w^2 and s^2/w^2 with s = k/d and w = risk - s * tied, for every day.

    With u = d * risk / tied they are sums over k of 1/(u - k) and its square: the last ``direct`` terms are added one by
    one, the others are differences of digamma and trigamma by their asymptotic series. The cost per day is constant.
    """
    d, ratio = events.astype(float), tied / events
    u = risk / ratio
    rest = np.maximum(d - direct, 0.0)  # k < rest by series
    k = np.arange(direct)[None, :] + rest[:, None]
    w = np.where(k < d[:, None], risk[:, None] - k * ratio[:, None], 1.0)
    s1 = np.where(k < d[:, None], ratio[:, None] / w, 0.0).sum(1)
    s2 = np.where(k < d[:, None], (ratio[:, None] / w) ** 2, 0.0).sum(1)
    log_w = np.where(k < d[:, None], np.log(w), 0.0).sum(1)
    many = np.flatnonzero(rest)
    if len(many):
        hi, lo = u[many] + 1, u[many] - rest[many] + 1
        s1[many] += _series(hi, lo, (-1 / 2, -1 / 12, 1 / 120, -1 / 252), (1, 2, 4, 6)) - np.log1p((lo - hi) / hi)
        s2[many] += -_series(hi, lo, (1, 1 / 2, 1 / 6, -1 / 30, 1 / 42), (1, 2, 3, 5, 7))
        stirling = lambda x: 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
        # log gamma(hi) - log gamma(lo), its leading terms written as differences
        log_u = (lo - 0.5) * np.log1p((hi - lo) / lo) + (hi - lo) * np.log(hi) - (hi - lo) + stirling(hi) - stirling(lo)
        log_w[many] += log_u + rest[many] * np.log(ratio[many])
    few = rest == 0  # exact where no term is left to the series
    s = np.where(k < d[:, None], k / d[:, None], 0.0)
    inverse = np.where(k < d[:, None], 1 / w, 0.0)
    t = ratio
    a0, b0 = s1 / t, s2 / t**2
    a1 = np.where(few, (s * inverse).sum(1), (u * s1 - d) / (d * t))
    b1 = np.where(few, (s * inverse**2).sum(1), (u * s2 - s1) / (d * t**2))
    b2 = np.where(few, (s**2 * inverse**2).sum(1), (u**2 * s2 - 2 * u * s1 + d) / (d * t) ** 2)
    return log_w, a0, a1, b0, b1, b2


def _series(hi: np.ndarray, lo: np.ndarray, factors: Sequence[float], powers: Sequence[int]) -> np.ndarray:
    """Sum of factor * (hi ** -power - lo ** -power)."""
    return sum(f * (hi**-float(n) - lo**-float(n)) for f, n in zip(factors, powers))
