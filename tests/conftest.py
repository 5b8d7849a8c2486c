import sys
from datetime import date, timedelta
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from trialspark.session import local_session

    session = local_session(8, "tests", memory="6g")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    yield session
    session.stop()


def frame(spark, schema, rows):
    return spark.createDataFrame(rows, schema)


STUDIES = (
    "nct_id string, study_type string, overall_status string, phase string, enrollment double, "
    "enrollment_type string, actual_enrollment double, start_date date, completion_date date, has_dmc string, why_stopped string"
)


def study_rows():
    """50 interventional and 10 observational studies over five statuses."""
    statuses = ["COMPLETED"] * 30 + ["TERMINATED"] * 10 + ["RECRUITING"] * 10 + ["WITHDRAWN"] * 5 + ["UNKNOWN STATUS"] * 5
    phases = ["PHASE 4", "N/A", "Phase 2", "PHASE1", "PHASE 2/3"]
    rows = []
    for i, status in enumerate(statuses):
        start = date(2012, 1, 1) + timedelta(days=40 * i)
        end = start + timedelta(days=200 + 5 * i) if status in ("COMPLETED", "TERMINATED") else None
        rows.append((
            f"NCT{i:04d}", "Observational" if i % 6 == 5 else "Interventional", status, phases[i % 5],
            float(50 + 7 * i), "ACTUAL" if i % 2 else "ESTIMATED", float(40 + 7 * i), start, end,
            "t" if i % 3 == 0 else "f", "Low accrual" if status == "TERMINATED" and i % 2 else None))
    return rows


@pytest.fixture(scope="session")
def tables(spark):
    from trialspark.sources.registry import TrialTables

    rows = study_rows()
    ids = [r[0] for r in rows]
    places = ["United States", "Germany", "Japan"]
    facilities = [(n, f"Site {k % 4}", "Town", places[(i + k) % 3], "Withdrawn" if k == 3 else None, 1.0 * k, 2.0 * k)
                  for i, n in enumerate(ids) for k in range(1 + i % 5)]
    return TrialTables.of({
        "studies": frame(spark, STUDIES, rows),
        "facilities": frame(spark, "nct_id string, name string, city string, country string, status string, latitude double, longitude double", facilities),
        "countries": frame(spark, "nct_id string, name string, removed string",
                           [(n, places[(i + k) % 3], "t" if k == 2 else "f") for i, n in enumerate(ids) for k in range(3)]),
        "sponsors": frame(spark, "nct_id string, name string, agency_class string, lead_or_collaborator string",
                          [(n, f"Sponsor {i % 4}", ["INDUSTRY", "NIH", "Other", "U.S. Fed"][i % 4], "lead") for i, n in enumerate(ids)]
                          + [(ids[0], "A Second Lead", "Other", "lead"), (ids[1], "Helper", "Other", "collaborator")]),
        "conditions": frame(spark, "id long, nct_id string, name string, downcase_name string",
                            [(2 * i + k, n, c, c.lower()) for i, n in enumerate(ids) for k, c in enumerate(
                                (["Breast Cancer", "Asthma"][i % 2], "Pain (50%_x)"))]),
        "interventions": frame(spark, "id long, nct_id string, intervention_type string",
                               [(i, n, ["Drug", "Device"][i % 2]) for i, n in enumerate(ids)]),
        "eligibilities": frame(spark, "nct_id string, criteria string, gender string, healthy_volunteers string",
                               [(n, "Inclusion:\r\n\r\n  - age\n \n  - consent", "ALL", "f") for n in ids[:-3]]),
        "designs": frame(spark, "nct_id string, intervention_model string, masking string",
                         [(n, "Parallel", ["None", "Double"][i % 2]) for i, n in enumerate(ids)]),
    })
