"""Declared table schemas and the step that makes any input fit them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

_TYPES = {
    "string": T.StringType(), "double": T.DoubleType(), "long": T.LongType(), "date": T.DateType(),
}


def _schema(**columns: str) -> T.StructType:
    return T.StructType([T.StructField(n, _TYPES[t], True) for n, t in columns.items()])


SCHEMAS: dict[str, T.StructType] = {
    "studies": _schema(
        nct_id="string", study_type="string", overall_status="string", phase="string",
        enrollment="double", enrollment_type="string", actual_enrollment="double",
        brief_title="string", start_date="date", completion_date="date",
        primary_completion_date="date", has_dmc="string", is_fda_regulated_drug="string",
        is_fda_regulated_device="string", why_stopped="string",
    ),
    "calculated_values": _schema(
        nct_id="string", actual_duration="double", number_of_facilities="long",
        minimum_age_num="double", maximum_age_num="double",
    ),
    "eligibilities": _schema(
        nct_id="string", criteria="string", gender="string", minimum_age="string",
        maximum_age="string", healthy_volunteers="string",
    ),
    "designs": _schema(
        nct_id="string", intervention_model="string", primary_purpose="string",
        masking="string", allocation="string",
    ),
    "facilities": _schema(
        nct_id="string", name="string", city="string", state="string", country="string",
        status="string", latitude="double", longitude="double",
    ),
    "countries": _schema(nct_id="string", name="string", removed="string"),
    "sponsors": _schema(
        nct_id="string", name="string", agency_class="string", lead_or_collaborator="string",
    ),
    "conditions": _schema(id="long", nct_id="string", name="string", downcase_name="string"),
    "interventions": _schema(id="long", nct_id="string", intervention_type="string", name="string"),
    "outcome_counts": _schema(nct_id="string", outcome_type="string", count="long"),
}


def conform(df: DataFrame, table: str, key_type: T.DataType | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Exactly the declared columns, and those of ``keep`` as they are: absent ones as typed NULL, the rest cast with bad values NULL.

    The identifier keeps its own type unless ``key_type`` is given: it may be text or a number.
    """
    present = dict(zip((c.lower() for c in df.columns), df.columns))
    columns = []
    for f in SCHEMAS[table].fields:
        wanted = f.dataType
        if f.name == "nct_id":
            wanted = key_type or df.schema[present["nct_id"]].dataType
        if f.name not in present:
            columns.append(F.lit(None).cast(wanted).alias(f.name))
            continue
        c, have = F.col(f"`{present[f.name]}`"), df.schema[present[f.name]].dataType
        if have == wanted:
            columns.append(c.alias(f.name))
        elif isinstance(wanted, T.DateType):
            as_date = c.cast("date") if isinstance(have, (T.TimestampType, T.TimestampNTZType)) else (
                F.try_to_timestamp(c.cast("string")).cast("date")
            )
            columns.append(as_date.alias(f.name))
        else:
            columns.append(c.try_cast(wanted).alias(f.name))
    return df.select(*columns, *keep)
