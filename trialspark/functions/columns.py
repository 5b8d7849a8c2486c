"""Column builders: cleaning, derived attributes and display text.

Every function maps columns to a column and stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from trialspark.functions import constants as C


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def stable_round(c: str | Column, digits: int) -> Column:
    """HALF_UP rounding that ignores last-bit noise.

    Sums of doubles differ in the last bits with the order partitions arrive in; settling the tenth
    decimal first keeps a value near a rounding boundary on the same side on every run.
    """
    return F.round(F.round(col(c).cast("double"), 10), digits)


def literal_map(mapping: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def as_of_date(as_of) -> Column:
    """A literal date, or the current date when ``as_of`` is None."""
    return F.current_date() if as_of is None else F.lit(str(as_of)).cast("date")


# ---- cleaning ---------------------------------------------------------------

def parse_date(c: str | Column) -> Column:
    """Date value; unparsable text becomes NULL."""
    return F.try_to_timestamp(col(c).cast("string")).cast("date")


def parse_number(c: str | Column) -> Column:
    """Double value; unparsable text and NaN become NULL."""
    number = col(c).try_cast("double")
    return F.when(~F.isnan(number), number)


def normalized(c: str | Column) -> Column:
    return F.upper(F.trim(col(c)))


def status_key(c: str | Column) -> Column:
    """'Active, not recruiting' -> ACTIVE_NOT_RECRUITING."""
    return F.replace(F.replace(normalized(c), F.lit(","), F.lit("")), F.lit(" "), F.lit("_"))


def status_display(c: str | Column) -> Column:
    """NOT_YET_RECRUITING -> 'Not Yet Recruiting'."""
    return F.initcap(F.lower(F.replace(F.trim(col(c)), F.lit("_"), F.lit(" "))))


def phase_canonical(c: str | Column) -> Column:
    return F.coalesce(literal_map(C.PHASE_SPELLINGS)[normalized(c)], F.lit(C.PHASE_UNKNOWN))


def phase_ordinal(canonical: str | Column, unknown: float | None = 0.0) -> Column:
    value = literal_map(C.PHASE_ORDINAL)[col(canonical)]
    return value if unknown is None else F.coalesce(value, F.lit(unknown))


def flag(c: str | Column) -> Column:
    """'t'/'f' text or boolean -> boolean; anything else NULL."""
    text = F.lower(F.trim(col(c).cast("string")))
    return F.when(text.isin("t", "true"), True).when(text.isin("f", "false"), False)


def null_tokens(c: str | Column) -> Column:
    """Registry text with the declared missing-value tokens turned into NULL."""
    return F.when(~F.trim(col(c)).isin(*C.NULL_TOKENS), col(c))


# ---- derived attributes -----------------------------------------------------

def enrollment_is_actual(c: str | Column) -> Column:
    return F.coalesce((normalized(c) == "ACTUAL").cast("int"), F.lit(0))


def sponsor_type(agency_class: str | Column, extra: dict[str, str] | None = None) -> Column:
    mapping = C.SPONSOR_TYPES | (extra or {})
    return F.coalesce(literal_map(mapping)[normalized(agency_class)], F.lit(C.SPONSOR_TYPE_DEFAULT))


def day_span(start: str | Column, end: str | Column) -> Column:
    return F.datediff(col(end), col(start))


def floored(c: Column, low: float = 0) -> Column:
    """max(c, low), NULL staying NULL (``greatest`` would skip it)."""
    return F.when(c.isNotNull(), F.greatest(c, F.lit(low)))


def capped(c: Column, high: float) -> Column:
    return F.when(c.isNotNull(), F.least(c, F.lit(high)))


def study_duration(supplied: str | Column | None, start: str | Column, end: str | Column) -> Column:
    """Supplied duration when known, else the date difference; never negative."""
    by_dates = floored(day_span(start, end).cast("double"))
    if supplied is None:
        return by_dates
    return F.coalesce(floored(parse_number(supplied), 0.0), by_dates)


def completion_label(status: str | Column) -> Column:
    key = status_key(status)
    return F.when(key == "COMPLETED", 1.0).when(key == "TERMINATED", 0.0)


def recruitment_failure(status: str | Column, why_stopped: str | Column) -> Column:
    reason = F.lower(F.coalesce(col(why_stopped), F.lit("")))
    return F.coalesce(status_key(status) == "TERMINATED", F.lit(False)) & reason.rlike(
        "|".join(C.RECRUITMENT_FAILURE_KEYWORDS)
    )


# A non-blank line: its first visible character and the rest up to the next line break.
NON_BLANK_LINE = r"(?U)[^\s\x1c-\x1f][^\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]*"


def criteria_line_count(criteria: str | Column) -> Column:
    """Non-blank lines of a criteria text; NULL text counts 0 lines."""
    return F.regexp_count(F.coalesce(col(criteria), F.lit("")), F.lit(NON_BLANK_LINE)).cast("long")


def criteria_parts_sql(criteria: str | Column) -> Column:
    """Newline-separated parts, blanks included; NULL for missing or empty text."""
    text = F.nullif(col(criteria), F.lit(""))
    return F.when(text.isNotNull(), F.size(F.split(text, "\n"))).cast("long")


def enrollment_ratio(actual: str | Column, target: str | Column, cap: float | None = 2.0) -> Column:
    ratio = col(actual).cast("double") / F.nullif(col(target).cast("double"), F.lit(0.0))
    return ratio if cap is None else capped(ratio, cap)


def met_target(ratio: Column, duration: str | Column, target: str | Column, share: float = 0.9) -> Column:
    """1/0 by ratio for studies with a positive duration and target, else NULL."""
    return F.when((col(duration) > 0) & (col(target) > 0), (ratio >= share).cast("int"))


def country_canonical(c: str | Column) -> Column:
    return F.coalesce(literal_map(C.COUNTRY_ALIASES)[col(c)], col(c))


def site_key(name: str | Column, city: str | Column, country: str | Column) -> Column:
    return F.concat_ws("|", *[F.coalesce(col(c), F.lit("")) for c in (name, city, country)])


def speed_bonus(avg_days: str | Column) -> Column:
    """365/max(days, 365); unknown speed is neutral."""
    return F.coalesce(F.lit(365.0) / floored(col(avg_days), 365.0), F.lit(1.0))


def log_scaled(c: str | Column) -> Column:
    return F.log1p(floored(col(c).cast("double"), 0.0))


def risk_band(probability: str | Column, threshold: float = C.DECISION_THRESHOLD) -> Column:
    p = col(probability)
    return (
        F.when(p.isNull(), None).when(p >= threshold, "Low Risk").when(p >= 0.5, "Moderate Risk").otherwise("High Risk")
    )


def short_label(title: str | Column, fallback: str | Column, width: int = 60) -> Column:
    return F.substring(F.coalesce(col(title), col(fallback).cast("string")), 1, width)


# ---- display text -----------------------------------------------------------

def thousands_text(c: str | Column, missing: str = "N/A") -> Column:
    return F.coalesce(F.format_number(col(c), 0), F.lit(missing))


def percent_text(share: str | Column, missing: str = "N/A") -> Column:
    return F.coalesce(F.concat(F.format_number(col(share) * 100, 0), F.lit("%")), F.lit(missing))


def years_text(days: str | Column, missing: str = "N/A") -> Column:
    return F.coalesce(F.format_number(col(days) / 365.25, 1), F.lit(missing))


def months(days: str | Column) -> Column:
    return col(days) / 30.4


def rationale_text(n_completed: str | Column, rate: str | Column, avg_days: str | Column) -> Column:
    return F.concat(
        col(n_completed).cast("string"), F.lit(" completed trials; completion rate "), percent_text(rate),
        F.lit("; avg duration "), years_text(avg_days), F.lit(" yrs"),
    )


def cache_key(*parts: str | Column) -> Column:
    """First 16 hex digits of SHA-256 over the parts joined by newline."""
    return F.substring(F.sha2(F.concat_ws("\n", *[col(p) for p in parts]), 256), 1, 16)
