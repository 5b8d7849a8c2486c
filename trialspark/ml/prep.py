"""Feature frame and preprocessing stages of the forecast models."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, functions as F

from trialspark.functions import columns as X, constants as C, filters as P
from trialspark.operators.ordered import exact_percentiles
from trialspark.session import checkpointed

NUMERIC = [*C.NUMERIC_FEATURES, *C.BOOLEAN_FEATURES]
CATEGORICAL = list(C.CATEGORICAL_FEATURES)


def labeled_rows(modeling: DataFrame) -> DataFrame:
    return modeling.where(F.col(C.CLASS_TARGET).isNotNull())


def with_unlabeled(labeled: DataFrame, unlabeled: DataFrame) -> DataFrame:
    """Labeled studies and others in one table, told apart by ``is_labeled``; columns that one side lacks are NULL there."""
    mark = lambda df, is_: df.withColumn("is_labeled", F.lit(is_))
    return mark(labeled, True).unionByName(mark(unlabeled, False), allowMissingColumns=True)


def regression_rows(modeling: DataFrame) -> DataFrame:
    """Labeled studies with a positive duration."""
    return labeled_rows(modeling).where(P.known_positive(C.DURATION_TARGET))


def check_columns(modeling: DataFrame) -> None:
    """Warn about absent features; fail without the class target."""
    absent = [c for c in (*NUMERIC, *CATEGORICAL) if c not in modeling.columns]
    if absent:
        warnings.warn(f"absent feature columns, filled with defaults: {absent}", stacklevel=2)
    if C.CLASS_TARGET not in modeling.columns:
        raise ValueError(f"target column {C.CLASS_TARGET!r} is absent: build the modeling table first")


def feature_frame(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Typed feature columns: numbers (log-scaled where skewed), 0/1 flags and categories."""
    def number(c: str):
        if c not in df.columns:
            return F.lit(None).cast("double")
        value = X.parse_number(c)
        return X.log_scaled(value) if c in C.LOG_FEATURES else value

    def zero_one(c: str):
        return F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0)

    def category(c: str):
        return F.coalesce(F.col(c).cast("string"), F.lit("Unknown")) if c in df.columns else F.lit("Unknown")

    return df.select(
        *[c for c in keep if c in df.columns],
        *[number(c).alias(f"f_{c}") for c in C.NUMERIC_FEATURES],
        *[zero_one(c).alias(f"f_{c}") for c in C.BOOLEAN_FEATURES],
        *[category(c).alias(f"f_{c}") for c in CATEGORICAL])


def exact_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Exact median of every column, 0 for a column without values; one row per column is collected."""
    long = df.select(*columns).unpivot([], list(columns), "feature", "value")
    found = exact_percentiles(long, "value", {"median": 0.5}, ["feature"]).collect()
    medians = {r["feature"]: r["median"] for r in found}
    return {c: float(medians.get(c, 0.0)) for c in columns}


def preparation_stages(frame: DataFrame) -> list:
    """Median fill, one-hot categories (unseen ones all zero) and the feature vector."""
    return [_fill(exact_medians(frame, [f"f_{c}" for c in NUMERIC])), *_encoders(), _assembler()]


def fold_features(frame: DataFrame, parts: Sequence[int]) -> tuple[DataFrame, dict[int, PipelineModel]]:
    """The frame stored with its categories encoded, and for each part what completes the features without knowing it.

    ``frame`` has a ``part`` column. The medians of all rows outside a part are exact, and one job finds those of every part.
    """
    parts = sorted(set(parts))
    columns = [f"f_{c}" for c in NUMERIC]
    encoder = Pipeline(stages=_encoders()).fit(frame)
    encoded = checkpointed(encoder.transform(frame))
    outside = encoded.withColumn("outside", F.explode(F.array(*map(F.lit, parts)))).where("outside <> part")
    long = outside.select("outside", *columns).unpivot("outside", columns, "feature", "value")
    found = exact_percentiles(long, "value", {"median": 0.5}, ["outside", "feature"]).collect()
    medians = {(r["outside"], r["feature"]): r["median"] for r in found}
    return encoded, {p: PipelineModel([_fill({c: float(medians.get((p, c), 0.0)) for c in columns}), _assembler()]) for p in parts}


def _fill(medians: dict[str, float]) -> SQLTransformer:
    fills = ", ".join(f"coalesce({c}, {m!r}D) AS x_{c[2:]}" for c, m in medians.items())
    return SQLTransformer(statement=f"SELECT *, {fills} FROM __THIS__")


def _encoders() -> list:
    indexed = [f"i_{c}" for c in CATEGORICAL]
    return [
        StringIndexer(inputCols=[f"f_{c}" for c in CATEGORICAL], outputCols=indexed,
                      handleInvalid="keep", stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=indexed, outputCols=[f"x_{c}" for c in CATEGORICAL], dropLast=True)]


def _assembler() -> VectorAssembler:
    return VectorAssembler(inputCols=[f"x_{c}" for c in [*NUMERIC, *CATEGORICAL]], outputCol="features")


def feature_names(transformed: DataFrame) -> list[str]:
    """Names of the vector positions, from the column's metadata."""
    attrs = transformed.schema["features"].metadata["ml_attr"]["attrs"]
    flat = sorted((a for group in attrs.values() for a in group), key=lambda a: a["idx"])
    return [a["name"].removeprefix("x_") for a in flat]
