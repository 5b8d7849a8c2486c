"""Row predicates, each a Column, and the composite filter state."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from trialspark.functions import constants as C
from trialspark.functions.columns import col, normalized, status_key


def not_in_keep_null(c: Column, values) -> Column:
    """``NOT IN`` that keeps NULL rows."""
    return ~F.coalesce(c.isin(*values), F.lit(False))


def interventional(c: str | Column = "study_type") -> Column:
    return normalized(c) == "INTERVENTIONAL"


def not_excluded_status(c: str | Column = "overall_status", keep_null: bool = True) -> Column:
    key = F.replace(status_key(c), F.lit("_"), F.lit(" "))
    return not_in_keep_null(key, C.EXCLUDED_STATUSES) if keep_null else ~key.isin(*C.EXCLUDED_STATUSES)


def started_from_year(year: int, c: str | Column = "start_date") -> Column:
    """A range on the raw column, so file statistics can skip row groups."""
    return col(c) >= F.lit(date(year, 1, 1))


def status_in(values, c: str | Column = "overall_status") -> Column:
    return F.coalesce(status_key(c).isin(*values), F.lit(False))


def text_contains(c: str | Column, query: str) -> Column:
    """Case-insensitive literal substring; user text is never read as a pattern."""
    return F.lower(col(c)).contains(query.lower())


def text_matches(c: str | Column, pattern: str) -> Column:
    return col(c).rlike("(?i)" + pattern)


def same_text(c: str | Column, value: str) -> Column:
    return F.lower(col(c)) == value.lower()


def not_withdrawn(c: str | Column = "status", keep_null: bool = True) -> Column:
    return not_in_keep_null(normalized(c), ("WITHDRAWN",)) if keep_null else normalized(c) != "WITHDRAWN"


def not_removed(c: str | Column = "removed", keep_null: bool = True) -> Column:
    gone = F.lower(col(c).cast("string")).isin("t", "true")
    return ~F.coalesce(gone, F.lit(False)) if keep_null else ~gone


def named_site(c: str | Column = "name") -> Column:
    return not_in_keep_null(col(c), C.GENERIC_SITE_NAMES)


def overlaps_window(start: Column, end: Column, low: Column, high: Column) -> Column:
    """Closed intervals intersect."""
    return (start <= high) & (end >= low)


def started_within_months(start: str | Column, as_of: Column, n: int) -> Column:
    return col(start) >= F.add_months(as_of, -n)


def valid_interval(start: Column, end: Column) -> Column:
    return end > start


def plausible_duration(c: str | Column, minimum: int = 7) -> Column:
    return col(c).isNull() | (col(c) >= minimum)


def known_positive(c: str | Column) -> Column:
    return col(c).isNotNull() & (col(c) > 0)


def not_blank(c: str | Column) -> Column:
    return col(c).isNotNull() & (F.trim(col(c)) != "")


@dataclass(frozen=True)
class FilterState:
    """User filter choices over the modeling table; empty choices mean 'all'."""

    condition_query: str = ""
    phases: tuple[str, ...] = ()
    sponsor_types: tuple[str, ...] = ()
    start_from: date | None = None
    start_to: date | None = None
    min_enrollment: float | None = None
    max_enrollment: float | None = None
    columns: dict = field(default_factory=dict)

    def to_column(self) -> Column:
        name = lambda logical: F.col(self.columns.get(logical, logical))
        parts = []
        if self.condition_query.strip():
            parts.append(text_contains(name("condition"), self.condition_query.strip()))
        if self.phases:
            parts.append(name("phase").isin(*self.phases))
        if self.sponsor_types:
            parts.append(name("sponsor_type").isin(*self.sponsor_types))
        if self.start_from is not None:
            parts.append(name("start_date") >= F.lit(self.start_from))
        if self.start_to is not None:
            parts.append(name("start_date") <= F.lit(self.start_to))
        if self.min_enrollment is not None:
            parts.append(name("enrollment") >= self.min_enrollment)
        if self.max_enrollment is not None:
            parts.append(name("enrollment") <= self.max_enrollment)
        predicate = F.lit(True)
        for part in parts:
            predicate = predicate & part
        return predicate

    def apply(self, df: DataFrame) -> DataFrame:
        return df.where(self.to_column())
