"""Independent SQL for the registered queries, over the base tables only.

``BIND`` derives the registry from the base tables; ``DERIVED`` holds shared steps. Every query is one
statement starting with these common table expressions (unused ones cost nothing).
"""

from __future__ import annotations

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


def R(x: str, k: int) -> str:
    return f"CAST(ROUND(CAST({x} AS DECIMAL(38,10)), {k}) AS DOUBLE)"


def KEY(c: str) -> str:
    return f"replace(replace(upper(trim({c})), ',', ''), ' ', '_')"


def PHASE(c: str) -> str:
    return (f"CASE upper(trim({c})) WHEN 'PHASE1' THEN 'Phase 1' WHEN 'PHASE 1/2' THEN 'Phase 1/Phase 2' "
            f"WHEN 'PHASE2' THEN 'Phase 2' WHEN 'PHASE 3' THEN 'Phase 3' ELSE 'N/A' END")


def ORD(c: str) -> str:
    return (f"CASE {c} WHEN 'Phase 1' THEN 1.0::DOUBLE WHEN 'Phase 1/Phase 2' THEN 1.5::DOUBLE "
            f"WHEN 'Phase 2' THEN 2.0::DOUBLE WHEN 'Phase 3' THEN 3.0::DOUBLE END")


def DISPLAY(c: str) -> str:
    return (f"CASE {KEY(c)} WHEN 'COMPLETED' THEN 'Completed' WHEN 'TERMINATED' THEN 'Terminated' "
            f"WHEN 'RECRUITING' THEN 'Recruiting' WHEN 'ACTIVE_NOT_RECRUITING' THEN 'Active, Not Recruiting' "
            f"WHEN 'NOT_YET_RECRUITING' THEN 'Not Yet Recruiting' "
            f"WHEN 'ENROLLING_BY_INVITATION' THEN 'Enrolling By Invitation' WHEN 'WITHDRAWN' THEN 'Withdrawn' END")


ACTIVE = "('RECRUITING','ACTIVE_NOT_RECRUITING','NOT_YET_RECRUITING','ENROLLING_BY_INVITATION')"
INTERVENTIONAL = "upper(trim(study_type)) = 'INTERVENTIONAL'"
LINES = r"len(list_filter(string_split_regex(text, '\r\n|\r|\n'), lambda x: regexp_matches(x, '\S')))"

BIND = """
b_ship AS (SELECT l_orderkey, max(CAST(l_shipdate AS DATE)) AS last_ship, min(CAST(l_shipdate AS DATE)) AS first_ship,
    CAST(floor(sum(floor(l_extendedprice)) / 500) AS DOUBLE) AS actual, max(l_tax) AS tax, max(l_discount) AS disc,
    count(*) AS n, count(DISTINCT l_suppkey) AS n_supp, min(l_quantity) AS min_q, max(l_quantity) AS max_q
  FROM lineitem GROUP BY l_orderkey),
studies AS (SELECT o.o_orderkey AS nct_id,
  CASE WHEN o_totalprice < 9000 THEN 'Observational' WHEN o_totalprice < 250000 THEN 'Interventional' ELSE ' INTERVENTIONAL ' END AS study_type,
  CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderpriority = '1-URGENT' THEN 'COMPLETED' ELSE 'Completed' END
    WHEN o_orderstatus = 'P' THEN 'Terminated'
    ELSE CASE o_orderpriority WHEN '1-URGENT' THEN 'RECRUITING' WHEN '2-HIGH' THEN 'Active, not recruiting'
      WHEN '3-MEDIUM' THEN 'NOT_YET_RECRUITING' WHEN '4-NOT SPECIFIED' THEN 'Enrolling by invitation' ELSE 'Withdrawn' END END AS overall_status,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'PHASE1' WHEN '2-HIGH' THEN 'Phase 1/2' WHEN '3-MEDIUM' THEN 'PHASE2' WHEN '4-NOT SPECIFIED' THEN 'Phase 3' END AS phase,
  CAST(floor(o_totalprice / 500) AS DOUBLE) AS enrollment,
  CASE o_orderstatus WHEN 'F' THEN 'Actual' WHEN 'P' THEN 'ACTUAL' ELSE 'Anticipated' END AS enrollment_type,
  actual AS actual_enrollment,
  CASE WHEN o_orderpriority <> '5-LOW' THEN concat('Study ', CAST(o_orderkey AS VARCHAR), ' in class ', o_orderpriority) END AS brief_title,
  CAST(o_orderdate AS DATE) AS start_date, last_ship AS completion_date, first_ship AS primary_completion_date,
  CASE WHEN tax > 0.06 THEN 't' WHEN tax IS NOT NULL THEN 'f' END AS has_dmc,
  CASE WHEN o_totalprice > 250000 THEN 't' ELSE 'f' END AS is_fda_regulated_drug,
  CASE WHEN disc > 0.08 THEN 't' ELSE 'f' END AS is_fda_regulated_device,
  CASE WHEN o_orderstatus = 'P' THEN CASE o_orderpriority WHEN '1-URGENT' THEN 'Slow Accrual' WHEN '2-HIGH' THEN 'Low enrollment'
    WHEN '3-MEDIUM' THEN 'Sponsor decision' WHEN '4-NOT SPECIFIED' THEN 'Lack of participants' END END AS why_stopped
  FROM orders o LEFT JOIN b_ship ON o.o_orderkey = b_ship.l_orderkey),
calculated_values AS (SELECT l_orderkey AS nct_id, CASE WHEN n > 1 THEN CAST(last_ship - first_ship AS DOUBLE) END AS actual_duration,
  n_supp AS number_of_facilities, min_q AS minimum_age_num, max_q AS maximum_age_num FROM b_ship),
eligibilities AS (SELECT doc_id AS nct_id, text, CASE lang WHEN 'en' THEN 'ALL' WHEN 'fr' THEN 'FEMALE' ELSE 'MALE' END AS gender,
  CASE source WHEN 'src0' THEN 't' ELSE 'f' END AS healthy_volunteers FROM documents),
b_oc AS (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey),
designs AS (SELECT o_orderkey AS nct_id,
  CASE c_mktsegment WHEN 'MACHINERY' THEN 'Parallel Assignment' WHEN 'BUILDING' THEN 'Single Group Assignment' WHEN 'AUTOMOBILE' THEN 'Crossover Assignment' END AS intervention_model,
  CASE o_orderstatus WHEN 'F' THEN 'Treatment' WHEN 'P' THEN 'Prevention' ELSE 'Diagnostic' END AS primary_purpose,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Double' WHEN '2-HIGH' THEN 'Single' WHEN '3-MEDIUM' THEN 'None (Open Label)' ELSE 'Triple' END AS masking,
  CASE WHEN c_acctbal > 5000 THEN 'Randomized' ELSE 'Non-Randomized' END AS allocation FROM b_oc),
sponsors AS (SELECT o_orderkey AS nct_id, c_name AS name,
  CASE c_mktsegment WHEN 'MACHINERY' THEN 'Industry' WHEN 'BUILDING' THEN 'NIH' WHEN 'AUTOMOBILE' THEN 'U.S. Fed' ELSE 'Other' END AS agency_class,
  CASE WHEN c_acctbal < 0 THEN 'collaborator' ELSE 'lead' END AS lead_or_collaborator FROM b_oc),
b_site AS (SELECT * FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
facilities AS (SELECT l_orderkey AS nct_id, CASE WHEN s_acctbal < 0 THEN 'Research Site' ELSE s_name END AS name,
  concat('CITY_', CAST(CAST(floor(s_acctbal / 2000) AS BIGINT) AS VARCHAR)) AS city, n_name AS country,
  CASE l_returnflag WHEN 'A' THEN 'Withdrawn' WHEN 'R' THEN 'Completed' END AS status,
  CASE WHEN s_acctbal > 1000 THEN s_acctbal / 200 END AS latitude, s_acctbal / -100 AS longitude FROM b_site),
countries AS (SELECT l_orderkey AS nct_id, n_name AS name, CASE WHEN sum(l_quantity) < 5 THEN 't' ELSE 'f' END AS removed
  FROM b_site GROUP BY ALL),
b_part AS (SELECT *, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey AS id FROM lineitem JOIN part ON l_partkey = p_partkey),
conditions AS (SELECT id, l_orderkey AS nct_id, p_name AS name, lower(p_name) AS downcase_name FROM b_part),
interventions AS (SELECT id, l_orderkey AS nct_id, p_type AS intervention_type FROM b_part)"""

DERIVED = f""",
cleaned AS (SELECT * REPLACE ({PHASE('phase')} AS phase, has_dmc = 't' AS has_dmc,
    is_fda_regulated_drug = 't' AS is_fda_regulated_drug, is_fda_regulated_device = 't' AS is_fda_regulated_device)
  FROM studies WHERE {INTERVENTIONAL} AND {KEY('overall_status')} NOT IN ('WITHDRAWN', 'UNKNOWN_STATUS')
    AND start_date >= DATE '{YEAR}-01-01' AND enrollment >= 10),
first_condition AS (SELECT nct_id, name AS condition FROM conditions
  QUALIFY row_number() OVER (PARTITION BY nct_id ORDER BY id, name) = 1),
first_intervention AS (SELECT nct_id, intervention_type FROM interventions
  QUALIFY row_number() OVER (PARTITION BY nct_id ORDER BY id, intervention_type) = 1),
frequency AS (SELECT lower(name) AS condition_lower, count(*) AS n_rows, count(DISTINCT nct_id) AS n_studies FROM conditions GROUP BY 1),
leads AS (SELECT nct_id, name AS sponsor_name, agency_class FROM sponsors WHERE lead_or_collaborator = 'lead'),
sponsor_done AS (SELECT sponsor_name, count(*) AS sponsor_completed_trials FROM leads
  WHERE nct_id IN (SELECT nct_id FROM cleaned WHERE {KEY('overall_status')} = 'COMPLETED') GROUP BY 1),
n_country AS (SELECT nct_id, count(DISTINCT name) AS n_countries FROM countries WHERE removed = 'f' GROUP BY 1),
kept_fac AS (SELECT * FROM facilities WHERE status IS NULL OR status <> 'Withdrawn'),
footprint AS (SELECT nct_id, CAST(sum(n) AS BIGINT) AS n_facilities, sum(n * n) / (sum(n) * sum(n)) AS hhi
  FROM (SELECT nct_id, country, CAST(count(*) AS DOUBLE) AS n FROM kept_fac GROUP BY ALL) GROUP BY 1),
spans AS (SELECT s.nct_id, coalesce(CASE WHEN c.actual_duration IS NOT NULL THEN greatest(c.actual_duration, 0) END, CASE WHEN completion_date IS NOT NULL
    THEN CAST(greatest(completion_date - start_date, 0) AS DOUBLE) END) AS days
  FROM cleaned s LEFT JOIN calculated_values c USING (nct_id)),
timed AS (SELECT nct_id, lower(coalesce(condition, '')) AS g, start_date AS s, coalesce(completion_date, DATE '2035-12-31') AS e
  FROM cleaned LEFT JOIN first_condition USING (nct_id)),
competing AS (SELECT a.nct_id, count(b.nct_id) AS competing_trials_count FROM timed a LEFT JOIN timed b
  ON a.g = b.g AND a.nct_id <> b.nct_id AND a.s <= b.e AND a.e >= b.s GROUP BY 1),
crit AS (SELECT nct_id, {LINES} AS n_lines, gender, healthy_volunteers FROM eligibilities),
kept AS (SELECT * FROM spans WHERE days IS NULL OR days >= 7),
modeling AS (SELECT s.nct_id, {DISPLAY('s.overall_status')} AS overall_status, s.phase, coalesce({ORD('s.phase')}, 0.0) AS phase_numeric,
    s.enrollment, s.start_date, s.completion_date, s.has_dmc,
    CAST(upper(enrollment_type) = 'ACTUAL' AS INTEGER) AS enrollment_type_is_actual,
    CASE WHEN s.actual_enrollment IS NOT NULL THEN least(s.actual_enrollment / nullif(s.enrollment, 0), 2.0) END AS enrollment_ratio,
    CASE {KEY('s.overall_status')} WHEN 'COMPLETED' THEN 1.0::DOUBLE WHEN 'TERMINATED' THEN 0.0::DOUBLE END AS enrollment_met_target,
    {KEY('s.overall_status')} = 'TERMINATED' AND regexp_matches(lower(coalesce(why_stopped, '')), 'enrollment|accrual|recruit|enrol|participant|patient|subject') AS terminated_for_enrollment,
    coalesce(nc.n_countries, 1) AS n_countries, coalesce(nc.n_countries, 1) > 1 AS is_multicountry,
    coalesce(f.n_facilities, c.number_of_facilities, 1) AS n_facilities, coalesce(f.hhi, 1.0) AS geographic_concentration,
    fc.condition, fq.n_rows AS condition_prevalence_proxy, coalesce(cp.competing_trials_count, 0) AS competing_trials_count,
    fi.intervention_type, l.sponsor_name,
    CASE WHEN l.sponsor_name IS NOT NULL THEN CASE WHEN l.agency_class = 'Industry' THEN 'industry' WHEN l.agency_class IN ('NIH', 'U.S. Fed') THEN 'government' ELSE 'academic' END END AS sponsor_type,
    coalesce(sd.sponsor_completed_trials, 0) / (SELECT greatest(max(sponsor_completed_trials), 1) FROM sponsor_done)::DOUBLE AS sponsor_historical_performance,
    k.days AS enrollment_duration_days,
    coalesce(CAST(cr.n_lines AS DOUBLE), (SELECT median(n_lines) FROM crit JOIN kept USING (nct_id))) AS n_eligibility_criteria,
    cr.gender, d.intervention_model, d.masking
  FROM cleaned s JOIN kept k USING (nct_id) LEFT JOIN calculated_values c USING (nct_id) LEFT JOIN n_country nc USING (nct_id)
    LEFT JOIN footprint f USING (nct_id) LEFT JOIN first_condition fc USING (nct_id) LEFT JOIN frequency fq ON lower(fc.condition) = fq.condition_lower
    LEFT JOIN competing cp USING (nct_id) LEFT JOIN first_intervention fi USING (nct_id) LEFT JOIN leads l USING (nct_id)
    LEFT JOIN sponsor_done sd ON l.sponsor_name = sd.sponsor_name LEFT JOIN crit cr USING (nct_id) LEFT JOIN designs d USING (nct_id)),
gear AS (SELECT * FROM studies WHERE {INTERVENTIONAL} AND nct_id IN (SELECT nct_id FROM conditions WHERE contains(downcase_name, '{CONDITION}'))),
market AS (SELECT *, year(start_date) AS start_year, coalesce(completion_date, primary_completion_date, DATE '{AS_OF}' + INTERVAL 60 MONTH)::DATE AS e
  FROM gear WHERE {KEY('overall_status')} IN ('COMPLETED','RECRUITING','ACTIVE_NOT_RECRUITING','NOT_YET_RECRUITING','ENROLLING_BY_INVITATION')
    AND start_date <= DATE '{WINDOW[1]}' AND coalesce(completion_date, primary_completion_date, DATE '{AS_OF}' + INTERVAL 60 MONTH) >= DATE '{WINDOW[0]}'),
market_leads AS (SELECT m.*, sponsor_name, agency_class FROM market m LEFT JOIN leads USING (nct_id)),
sponsor_share AS (SELECT sponsor_name, agency_class, count(DISTINCT nct_id) AS n_trials, sum(enrollment) AS total_target_enrollment,
    {R('count(DISTINCT nct_id) / sum(count(DISTINCT nct_id)) OVER () * 100', 2)} AS market_share_pct FROM market_leads GROUP BY 1, 2),
sponsor_top AS (SELECT * FROM sponsor_share ORDER BY n_trials DESC, sponsor_name NULLS LAST, agency_class NULLS LAST LIMIT 20),
per_year AS (SELECT start_year, count(*) AS new_trials_started, sum(enrollment) AS new_enrollment_targets,
    CAST(sum(count(*)) OVER (ORDER BY start_year) AS BIGINT) AS cumulative_trials FROM market GROUP BY 1),
per_phase AS (SELECT phase, count(*) AS n_trials, sum(enrollment) AS total_enrollment, {R('avg(enrollment)', 0)} AS avg_enrollment_per_trial,
    rank() OVER (ORDER BY count(*) DESC) AS phase_rank FROM market GROUP BY 1),
trial_places AS (SELECT nct_id, string_agg(DISTINCT name, ', ' ORDER BY name) AS countries, count(DISTINCT name) AS n_countries FROM countries WHERE removed = 'f' GROUP BY 1),
fac_study AS (SELECT f.nct_id, f.name AS facility_name, f.city, f.country, condition, enrollment AS target_enrollment, actual_duration AS duration_days,
    least(actual_enrollment / nullif(enrollment, 0), 2.0) AS enrollment_ratio, CAST({KEY('overall_status')} = 'COMPLETED' AS INTEGER) AS completed_flag,
    CASE WHEN s.phase IS NOT NULL THEN {PHASE('s.phase')} END AS phase, start_date
  FROM facilities f JOIN studies s USING (nct_id) LEFT JOIN calculated_values USING (nct_id)
    LEFT JOIN (SELECT nct_id, lower(condition) AS condition FROM first_condition) USING (nct_id)
  WHERE f.status <> 'Withdrawn' AND f.country IS NOT NULL AND {INTERVENTIONAL} AND start_date >= DATE '{YEAR}-01-01' AND enrollment > 0),
scored AS (SELECT CAST(l_returnflag = 'R' AS INTEGER) AS label, l_quantity / 50 AS score FROM lineitem),
score_n AS (SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM scored GROUP BY 1),
curve AS (SELECT score AS threshold, pos, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp,
    CAST(sum(pos) OVER () AS BIGINT) AS p, CAST(sum(neg) OVER () AS BIGINT) AS n FROM score_n WINDOW w AS (ORDER BY score DESC))"""


def funnel(where: str) -> str:
    k = KEY("overall_status")
    recent = ", ".join(
        f"count(*) FILTER (start_date >= DATE '{AS_OF}' - INTERVAL {m} MONTH) AS last_{m}m" for m in (6, 12, 24))
    return (f"count(*) AS total_trials, count(*) FILTER ({k} IN {ACTIVE}) AS active_trials, "
            f"count(*) FILTER ({k} IN ('RECRUITING','ENROLLING_BY_INVITATION')) AS recruiting_trials, "
            f"count(*) FILTER ({k} = 'COMPLETED') AS completed_trials, count(*) FILTER ({k} = 'TERMINATED') AS terminated_trials, "
            f"CAST(coalesce(sum(enrollment) FILTER ({k} IN {ACTIVE}), 0) AS BIGINT) AS total_competing_enrollment, {recent} {where}")


def saturation(group: str) -> str:
    k = KEY("overall_status")
    cols = f"{group}, " if group else ""
    by = f"GROUP BY {group}" if group else ""
    return (
        f"SELECT {cols}active_trials, completed_trials, active_enrollment, {R('''CASE WHEN completed_trials < 3 OR active_enrollment = 0 THEN least(active_trials / greatest(completed_trials, 1), 1.0) ELSE active_enrollment / greatest(mean_e * completed_trials / years, 1.0) END''', 4)} AS saturation "
        f"FROM (SELECT {cols}count(*) FILTER ({k} IN {ACTIVE}) AS active_trials, count(*) FILTER ({k} = 'COMPLETED') AS completed_trials, "
        f"coalesce(sum(enrollment) FILTER ({k} IN {ACTIVE}), 0.0) AS active_enrollment, avg(enrollment) FILTER ({k} = 'COMPLETED') AS mean_e, "
        f"greatest(coalesce((DATE '{AS_OF}' - min(start_date) FILTER ({k} = 'COMPLETED')) / 365.25, 1.0), 1.0) AS years FROM pairs {by})")


def country_perf(trials: str) -> str:
    k = KEY("overall_status")
    return (
        f"perf AS (SELECT country, n_trials, n_completed, n_terminated, avg_enrollment, avg_duration_days, completion_rate, "
        f"CASE WHEN n_trials >= 2 THEN {R('n_trials / greatest(span / 365.25, 1.0)', 2)} END AS trials_per_year, "
        f"{R('coalesce(completion_rate * ln(1 + n_completed), 0)', 4)} AS performance_score FROM ("
        f"SELECT *, {R('n_completed / nullif(n_completed + n_terminated, 0)', 4)} AS completion_rate FROM ("
        f"SELECT country, count(*) AS n_trials, count(*) FILTER ({k} = 'COMPLETED') AS n_completed, count(*) FILTER ({k} = 'TERMINATED') AS n_terminated, "
        f"{R('avg(enrollment)', 1)} AS avg_enrollment, {R(f'''avg(completion_date - start_date) FILTER ({k} = 'COMPLETED')''', 1)} AS avg_duration_days, "
        f"max(start_date) - min(start_date) AS span FROM (SELECT DISTINCT nct_id, country FROM facilities) JOIN {trials} USING (nct_id) GROUP BY 1)))")


def confusion(rows: str) -> str:
    f1p, f1n = "coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0)", "coalesce(2.0 * tn / nullif(2 * tn + fn + fp, 0), 0)"
    z = lambda a, b: R(f"coalesce(1.0::DOUBLE * ({a}) / nullif({b}, 0), 0)", 6)
    return (f"SELECT threshold, tp, fp, fn, tn, {z('tp', 'tp + fp')} AS precision_pos, {z('tp', 'tp + fn')} AS recall_pos, {R(f1p, 6)} AS f1_pos, "
            f"{z('tn', 'tn + fn')} AS precision_neg, {z('tn', 'tn + fp')} AS recall_neg, {R(f1n, 6)} AS f1_neg, "
            f"{R(f'({f1p} + {f1n}) / 2', 6)} AS f1_macro, {z('tp + tn', 'tp + tn + fp + fn')} AS accuracy FROM ({rows})")


def at_thresholds(values) -> str:
    listed = ", ".join(f"({t}::DOUBLE)" for t in values)
    return (f"SELECT threshold, count(*) FILTER (label = 1 AND score >= threshold) AS tp, count(*) FILTER (label = 0 AND score >= threshold) AS fp, "
            f"count(*) FILTER (label = 1 AND score < threshold) AS fn, count(*) FILTER (label = 0 AND score < threshold) AS tn "
            f"FROM scored, (VALUES {listed}) t(threshold) GROUP BY 1")


def describe_sql(value: str, group: str, rows: str, extra: str = "") -> str:
    return (f"SELECT {group}, count(*) AS n, min({value}) AS min, {R(f'avg({value})', 4)} AS mean, {R(f'quantile_cont({value}, 0.25)', 4)} AS q1, "
            f"{R(f'median({value})', 4)} AS median, {R(f'quantile_cont({value}, 0.75)', 4)} AS q3, max({value}) AS max{extra} "
            f"FROM {rows} WHERE {value} IS NOT NULL GROUP BY 1")


def success(key: str) -> str:
    return (f"SELECT {key}, count(*) AS n_labeled, {R('avg(enrollment_met_target)', 4)} AS success_rate FROM modeling "
            f"WHERE enrollment_met_target IS NOT NULL GROUP BY 1")


def order_hash(rows: str, label: str, id_col: str) -> str:
    return (f"SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY md5(concat(CAST({id_col} AS VARCHAR), '|42')), {id_col}) - 1 AS pos, "
            f"count(*) OVER (PARTITION BY {label}) AS size FROM {rows}")


NAMED = ("name NOT IN ('Research Site')")
SITE_KEY = "concat(coalesce(name, ''), '|', coalesce(city, ''), '|', coalesce(country, ''))"
NODES = (f"site_rows AS (SELECT nct_id, name, city, country, {SITE_KEY} AS site_key FROM facilities WHERE {NAMED} AND nct_id IN (SELECT nct_id FROM gear)), "
         f"nodes AS (SELECT site_key, min(name) AS name, min(city) AS city, min(country) AS country, count(DISTINCT nct_id) AS n_trials "
         f"FROM site_rows GROUP BY 1 HAVING count(DISTINCT nct_id) >= 2 ORDER BY n_trials DESC, site_key LIMIT 30)")

FACTORS = r"""doc_lines AS (SELECT doc_id, list_filter(string_split_regex(text, '\r\n|\r|\n'), lambda x: regexp_matches(x, '\S')) AS lines FROM documents),
factors AS (SELECT doc_id, i AS factor_no, lines[i] AS risk_factor,
    CASE WHEN i < len(lines) THEN CASE WHEN length(lines[i]) > 80 THEN 'high' WHEN length(lines[i]) > 40 THEN 'medium' ELSE 'low' END END AS scored,
    concat('Relax: ', lines[i]) AS suggestion FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM doc_lines))"""

MODEL_COLUMNS = (
    "nct_id, overall_status, phase, phase_numeric, enrollment, start_date, completion_date, has_dmc, enrollment_type_is_actual, "
    "enrollment_met_target, terminated_for_enrollment, n_countries, is_multicountry, n_facilities, condition, "
    "condition_prevalence_proxy, competing_trials_count, intervention_type, sponsor_name, sponsor_type, enrollment_duration_days, "
    "n_eligibility_criteria, gender, intervention_model, masking")


def build() -> dict[str, str]:
    q: dict[str, str] = {}

    def add(name: str, body: str, ctes: str = "") -> None:
        q[name] = f"WITH {BIND}{DERIVED}{', ' + ctes if ctes else ''} {body}"

    k = KEY("overall_status")
    add("clean_studies", f"SELECT nct_id, overall_status, phase, coalesce({ORD('phase')}, 0.0) AS phase_numeric, enrollment, start_date, has_dmc, is_fda_regulated_drug, is_fda_regulated_device FROM cleaned")
    add("phase_ordinal", f"SELECT phase AS raw_phase, {PHASE('phase')} AS phase, {ORD(PHASE('phase'))} AS phase_numeric, count(*) AS n FROM studies GROUP BY ALL")
    add("status_funnel", f"SELECT {funnel('')} FROM studies WHERE {INTERVENTIONAL}")
    add("labels_and_stop_reason", f"""SELECT CASE {k} WHEN 'COMPLETED' THEN 1.0::DOUBLE WHEN 'TERMINATED' THEN 0.0::DOUBLE END AS enrollment_met_target,
        {k} = 'TERMINATED' AND regexp_matches(lower(coalesce(why_stopped, '')), 'enrollment|accrual|recruit|enrol|participant|patient|subject') AS terminated_for_enrollment, count(*) AS n FROM cleaned GROUP BY 1, 2""")
    add("country_counts", "SELECT * FROM n_country")
    add("facility_counts", "SELECT nct_id, count(*) AS n_facilities FROM kept_fac GROUP BY 1")
    add("facility_counts_distinct", "SELECT nct_id, count(DISTINCT concat(name, '|', city, '|', country)) AS n_facilities FROM kept_fac GROUP BY 1")
    add("geographic_hhi", f"SELECT nct_id, {R('hhi', 6)} AS geographic_concentration FROM footprint")
    add("primary_condition", "SELECT * FROM first_condition")
    add("condition_frequency", "SELECT condition_lower, n_rows, n_studies FROM frequency")
    add("sponsor_history", f"""SELECT sponsor_name, {R('median(ratio)', 6)} AS sponsor_median_enrollment_ratio, count(*) AS sponsor_historical_trial_count,
        rank() OVER (ORDER BY count(*) DESC) AS sponsor_rank_by_volume FROM (SELECT sponsor_name, actual_enrollment / enrollment AS ratio FROM leads JOIN studies USING (nct_id)
        WHERE {k} = 'COMPLETED' AND enrollment > 0) GROUP BY 1""")
    add("sponsor_performance_scaled", f"SELECT sponsor_name, sponsor_completed_trials, {R('sponsor_completed_trials / (SELECT max(sponsor_completed_trials) FROM sponsor_done)', 6)} AS sponsor_historical_performance FROM sponsor_done")
    add("lead_sponsor", "SELECT nct_id, sponsor_name, CASE WHEN agency_class = 'Industry' THEN 'industry' WHEN agency_class IN ('NIH', 'U.S. Fed') THEN 'government' ELSE 'academic' END AS sponsor_type, agency_class AS sponsor_agency_class FROM leads")
    add("criteria_line_count", "SELECT nct_id, n_lines AS n_eligibility_criteria, gender, healthy_volunteers FROM crit")
    add("eligibility_complexity_sql", r"SELECT nct_id, CASE WHEN text <> '' THEN len(string_split(text, chr(10))) END AS n_criteria_lines, gender, healthy_volunteers FROM eligibilities")
    add("study_duration", "SELECT nct_id, days AS enrollment_duration_days FROM spans")
    add("competing_trials_count", "SELECT * FROM competing")
    add("concurrent_trials", "SELECT a.nct_id, count(b.nct_id) AS concurrent_trial_count FROM market a LEFT JOIN market b ON a.nct_id <> b.nct_id AND a.start_date <= b.e AND a.e >= b.start_date GROUP BY 1")
    add("competitors_in_window", f"SELECT nct_id, condition, overall_status, phase, enrollment, start_date, completion_date, sponsor_name, sponsor_type, n_countries, n_facilities FROM modeling WHERE contains(lower(coalesce(condition, '')), '{CONDITION}') AND start_date <= DATE '{WINDOW[1]}' AND coalesce(completion_date, DATE '2030-12-31') >= DATE '{WINDOW[0]}'")
    add("modeling_table", f"SELECT {MODEL_COLUMNS}, {R('enrollment_ratio', 6)} AS enrollment_ratio, {R('geographic_concentration', 6)} AS geographic_concentration, {R('sponsor_historical_performance', 6)} AS sponsor_historical_performance FROM modeling")
    add("filter_state", "SELECT nct_id, condition, phase, sponsor_type, start_date, enrollment FROM modeling WHERE contains(lower(condition), 'bolt') AND phase IN ('Phase 1', 'Phase 3') AND sponsor_type IN ('industry', 'academic') AND start_date BETWEEN DATE '1996-06-01' AND DATE '2000-12-31' AND enrollment BETWEEN 50 AND 900")
    add("enrollment_extract", f"""SELECT s.nct_id, {DISPLAY('s.overall_status')} AS overall_status, {PHASE('s.phase')} AS phase, {ORD(PHASE('s.phase'))} AS phase_numeric,
        intervention_model, primary_purpose, masking, allocation, intervention_type, lower(fc.condition) AS condition, n_studies AS condition_prevalence_proxy, s.enrollment AS target_enrollment,
        actual_duration AS enrollment_duration_days, number_of_facilities AS n_facilities, coalesce(n_countries, 1) AS n_countries, coalesce(n_countries, 1) > 1 AS is_multicountry,
        minimum_age_num, maximum_age_num, maximum_age_num - minimum_age_num AS age_window_years, CASE WHEN text <> '' THEN len(string_split(text, chr(10))) END AS n_criteria_lines, gender, healthy_volunteers,
        l.sponsor_name, CASE WHEN l.sponsor_name IS NOT NULL THEN CASE WHEN l.agency_class = 'Industry' THEN 'industry' WHEN l.agency_class IN ('NIH', 'U.S. Fed') THEN 'government' ELSE 'academic' END END AS sponsor_type,
        l.agency_class AS sponsor_agency_class, {R('coalesce(med, 1.0)', 6)} AS sponsor_historical_performance, coalesce(rnk, 9999) AS sponsor_rank,
        s.has_dmc, s.is_fda_regulated_drug, s.is_fda_regulated_device, s.start_date, s.completion_date, s.primary_completion_date, CAST(year(s.start_date) AS INTEGER) AS start_year, CAST(month(s.start_date) AS INTEGER) AS start_month,
        CASE WHEN actual_duration > 0 AND s.enrollment > 0 THEN CAST(s.actual_enrollment / s.enrollment >= 0.9 AS INTEGER) END AS enrollment_met_target, {R('s.actual_enrollment / nullif(s.enrollment, 0)', 6)} AS enrollment_ratio
        FROM studies s LEFT JOIN calculated_values USING (nct_id) LEFT JOIN first_condition fc USING (nct_id) LEFT JOIN frequency ON lower(fc.condition) = condition_lower
        LEFT JOIN first_intervention USING (nct_id) LEFT JOIN leads l USING (nct_id) LEFT JOIN hist ON hist.sponsor_name = l.sponsor_name LEFT JOIN n_country USING (nct_id)
        LEFT JOIN eligibilities USING (nct_id) LEFT JOIN designs USING (nct_id)
        WHERE {INTERVENTIONAL} AND s.start_date >= DATE '{YEAR}-01-01' AND {KEY('s.overall_status')} NOT IN ('WITHDRAWN', 'UNKNOWN_STATUS') AND s.enrollment > 0""",
        f"hist AS (SELECT sponsor_name, median(actual_enrollment / enrollment) AS med, rank() OVER (ORDER BY count(*) DESC) AS rnk FROM leads JOIN studies USING (nct_id) WHERE {k} = 'COMPLETED' AND enrollment > 0 GROUP BY 1)")

    add("landscape_summary", f"SELECT '{CONDITION}' AS condition, *, {R('least(active_trials / 200.0, 1.0)', 3)} AS competition_intensity FROM (SELECT {funnel('')} FROM gear)")
    add("landscape_by_condition", f"SELECT *, {R('least(active_trials / 200.0, 1.0)', 3)} AS competition_intensity FROM (SELECT condition, {funnel('')} FROM (SELECT DISTINCT nct_id, downcase_name AS condition FROM conditions) JOIN studies USING (nct_id) WHERE {INTERVENTIONAL} GROUP BY 1)")
    add("intensity_damped", f"SELECT '{CONDITION}' AS condition, {R('active / (total + 1) * ln(1 + total)', 3)} AS competition_intensity FROM (SELECT count(*) AS total, count(*) FILTER ({k} IN {ACTIVE}) AS active FROM gear)")
    add("phase_breakdown", f"SELECT coalesce(phase, 'N/A') AS phase, count(*) AS n_trials FROM gear WHERE {k} IN {ACTIVE} GROUP BY 1")
    add("temporal_density", "SELECT " + ", ".join(f"count(*) FILTER (start_date >= DATE '{AS_OF}' - INTERVAL {m} MONTH) AS last_{m}m" for m in (6, 12, 24)) + " FROM gear")
    add("top_countries", "SELECT country, count(*) AS site_count FROM facilities WHERE nct_id IN (SELECT nct_id FROM gear) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
    add("top_sponsors", f"SELECT sponsor_name, count(*) AS n_trials FROM leads WHERE nct_id IN (SELECT nct_id FROM gear WHERE {k} IN {ACTIVE}) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
    add("site_density", f"SELECT country AS country_name, count(*) AS site_count, {R('ln(1 + count(*))', 6)} AS log_sites FROM facilities WHERE nct_id IN (SELECT nct_id FROM gear) GROUP BY 1")
    bar = "nct_id, substr(coalesce(brief_title, CAST(nct_id AS VARCHAR)), 1, 60) AS label, p AS phase, overall_status AS status, start_date, end_date, enrollment, format('{:,}', CAST(enrollment AS BIGINT)) AS enrollment_text"
    add("trial_timeline", f"SELECT {bar} FROM (SELECT *, {PHASE('phase')} AS p, coalesce(completion_date, DATE '{AS_OF}') AS end_date FROM gear WHERE coalesce(completion_date, DATE '{AS_OF}') > start_date ORDER BY enrollment DESC, nct_id LIMIT 40) WHERE p <> 'N/A'")
    add("trial_timeline_recent", f"SELECT {bar} FROM (SELECT *, {PHASE('phase')} AS p, completion_date AS end_date FROM gear WHERE completion_date > start_date ORDER BY start_date DESC, nct_id LIMIT 40)")
    pairs = f"pairs AS (SELECT * FROM gear WHERE nct_id IN (SELECT nct_id FROM countries WHERE contains(lower(name), lower('{COUNTRY}'))))"
    add("recruitment_saturation", f"SELECT '{CONDITION}' AS condition, '{COUNTRY}' AS country, active_trials, completed_trials, active_enrollment, saturation FROM ({saturation('')})", pairs)
    all_pairs = f"pairs AS (SELECT s.*, c.condition, p.country FROM studies s JOIN (SELECT DISTINCT nct_id, downcase_name AS condition FROM conditions) c USING (nct_id) JOIN (SELECT DISTINCT nct_id, name AS country FROM countries) p USING (nct_id) WHERE {INTERVENTIONAL})"
    add("saturation_by_pair", f"SELECT condition, country, active_trials, completed_trials, saturation FROM ({saturation('condition, country')})", all_pairs)
    lists = lambda xs: ", ".join(f"('{x}')" for x in xs)
    m_pairs = (f"pairs AS (SELECT DISTINCT s.*, cq.q AS condition, nq.q AS country FROM studies s JOIN conditions c USING (nct_id) JOIN (VALUES {lists(SATURATION_CONDITIONS)}) cq(q) ON contains(c.downcase_name, lower(cq.q)) "
               f"JOIN countries p ON p.nct_id = s.nct_id JOIN (VALUES {lists(SATURATION_COUNTRIES)}) nq(q) ON contains(lower(p.name), lower(nq.q)) WHERE {INTERVENTIONAL})")
    add("saturation_matrix", "SELECT condition, " + ", ".join(f"coalesce(max(saturation) FILTER (country = '{c}'), 0.0) AS \"{c}\"" for c in SATURATION_COUNTRIES) + f" FROM ({saturation('condition, country')}) GROUP BY 1", m_pairs)

    add("sponsor_market", "SELECT * FROM sponsor_top")
    add("yearly_density", "SELECT CAST(start_year AS INTEGER) AS start_year, new_trials_started, new_enrollment_targets, cumulative_trials FROM per_year")
    add("phase_distribution", "SELECT * FROM per_phase")
    add("trial_countries", "SELECT * FROM trial_places")
    add("market_rollup", "SELECT 'sponsor_summary' AS result_type, sponsor_name AS dimension, n_trials, total_target_enrollment AS enrollment FROM sponsor_top UNION ALL SELECT 'temporal_density', CAST(start_year AS VARCHAR), new_trials_started, new_enrollment_targets FROM per_year UNION ALL SELECT 'phase_distribution', phase, n_trials, total_enrollment FROM per_phase")
    add("landscape_detail", f"""SELECT m.nct_id, brief_title, overall_status, phase, enrollment AS target_enrollment, start_date, completion_date, primary_completion_date, CAST(start_year AS INTEGER) AS start_year, sponsor_name, agency_class,
        n_countries, countries, concurrent_competitors, sum(enrollment) OVER () AS total_market_enrollment_target, count(*) OVER () AS total_competing_trials,
        {R('enrollment / nullif(sum(enrollment) OVER (), 0) * 100', 2)} AS this_trial_enrollment_share_pct, rank() OVER (ORDER BY start_date DESC) AS recency_rank
        FROM market_leads m LEFT JOIN trial_places USING (nct_id) JOIN conc USING (nct_id)""",
        "conc AS (SELECT a.nct_id, count(b.nct_id) AS concurrent_competitors FROM market a LEFT JOIN market b ON a.nct_id <> b.nct_id AND a.start_date <= b.e AND a.e >= b.start_date GROUP BY 1)")

    add("site_performance", f"""SELECT *, {R('0.4 * least(completion_rate_pct, 100) + 0.4 * (CASE WHEN ratio IS NOT NULL THEN least(ratio, 1) END) * 100 + 0.2 * least(n_trials, 20) / 20.0 * 100', 1)} AS performance_score FROM (
        SELECT name, city, country, condition, count(DISTINCT f.nct_id) AS n_trials, coalesce(sum(enrollment_met_target), 0.0) AS n_met_target, {R('avg(enrollment_ratio)', 6)} AS avg_enrollment_ratio,
        {R('median(enrollment_ratio)', 6)} AS median_enrollment_ratio, {R('avg(enrollment_duration_days)', 6)} AS avg_duration_days, {R('avg(enrollment)', 6)} AS avg_target_enrollment,
        {R('coalesce(sum(enrollment_met_target), 0.0) / count(DISTINCT f.nct_id) * 100', 1)} AS completion_rate_pct, avg(enrollment_ratio) AS ratio
        FROM kept_fac f LEFT JOIN modeling m ON f.nct_id = m.nct_id GROUP BY 1, 2, 3, 4)""".replace("SELECT *,", "SELECT * EXCLUDE (ratio),", 1))
    add("site_performance_by_condition", f"""SELECT *, {R('0.4 * least(completion_rate_pct, 100) + 0.4 * least(avg_enrollment_ratio * 50, 50) + 0.2 * least(n_trials / 10.0, 10) * 10', 1)} AS performance_score,
        rank() OVER (PARTITION BY condition ORDER BY n_trials DESC, completion_rate_pct DESC) AS rank_in_condition, rank() OVER (ORDER BY n_trials DESC, completion_rate_pct DESC) AS global_rank FROM (
        SELECT facility_name, city, country, condition, count(DISTINCT nct_id) AS n_trials, CAST(sum(completed_flag) AS BIGINT) AS n_completed, {R('sum(completed_flag) / count(DISTINCT nct_id) * 100', 1)} AS completion_rate_pct,
        {R('avg(enrollment_ratio)', 3)} AS avg_enrollment_ratio, {R('median(enrollment_ratio)', 3)} AS median_enrollment_ratio, {R('avg(duration_days)', 0)} AS avg_duration_days, {R('avg(target_enrollment)', 0)} AS avg_target_enrollment,
        string_agg(DISTINCT phase, ', ' ORDER BY phase) AS phases_participated, min(start_date) AS first_trial_date, max(start_date) AS most_recent_trial_date,
        max(CAST(start_date >= DATE '{AS_OF}' - INTERVAL 60 MONTH AS INTEGER)) AS is_recently_active FROM fac_study GROUP BY 1, 2, 3, 4)""")
    add("country_performance_ranked", f"""SELECT country, condition, n_trials, n_unique_sites, {R('r', 3)} AS avg_enrollment_ratio, {R('d', 0)} AS avg_duration_days, {R('r / nullif(d / 365.0, 0)', 4)} AS enrollment_efficiency,
        {R('done / n_trials * 100', 1)} AS trial_completion_rate_pct, rank() OVER (PARTITION BY condition ORDER BY round(r, 10) DESC NULLS LAST) AS rank_in_condition, rank() OVER (ORDER BY n_trials DESC) AS global_volume_rank FROM (
        SELECT country, condition, count(DISTINCT nct_id) AS n_trials, count(DISTINCT concat(facility_name, '|', city)) AS n_unique_sites, avg(enrollment_ratio) AS r, avg(duration_days) AS d, sum(completed_flag) AS done FROM fac_study GROUP BY 1, 2)""")
    levels = {"site_performance": ("country", "condition", "facility_name", "city"), "country_performance": ("country", "condition"), "condition_performance": ("condition",),
              "site_total": ("country", "facility_name", "city"), "country_total": ("country",), "grand_total": ()}
    names = lambda by: ", ".join(c if c in by else f"CAST(NULL AS VARCHAR) AS {c}" for c in levels["site_performance"])
    site = lambda by: "country, condition, facility_name, city" if "condition" in by else "country, facility_name, city"
    add("site_rollup", "SELECT *, rank() OVER (PARTITION BY result_type ORDER BY n_trials DESC, completion_rate_pct DESC) AS global_rank, CASE WHEN result_type NOT IN ('site_total', 'country_total', 'grand_total') THEN rank() OVER (PARTITION BY result_type, condition ORDER BY n_trials DESC, completion_rate_pct DESC) END AS rank_in_condition FROM ("
        + " UNION ALL ".join(f"""SELECT '{level}' AS result_type, {names(by)}, count(DISTINCT nct_id) AS n_trials, count(DISTINCT ({site(by)})) AS n_unique_sites, CAST(sum(completed_flag) AS BIGINT) AS n_completed,
        {R('avg(enrollment_ratio)', 3)} AS avg_enrollment_ratio, {R('avg(duration_days)', 0)} AS avg_duration_days, {R('sum(completed_flag) / count(DISTINCT nct_id) * 100', 1)} AS completion_rate_pct
        FROM fac_study {'GROUP BY ' + ', '.join(by) if by else ''}""" for level, by in levels.items()) + ")")
    add("country_performance", "SELECT * FROM perf", country_perf(f"(SELECT * FROM studies WHERE {INTERVENTIONAL})"))
    add("country_performance_condition", "SELECT * FROM perf", country_perf("gear"))
    sites_agg = f"""SELECT name, city, country, count(*) AS n_trials, count(*) FILTER (st = 'COMPLETED') AS n_completed, count(*) FILTER (st = 'TERMINATED') AS n_terminated,
        {R('avg(enrollment)', 1)} AS avg_enrollment, {R('sum(lat) / nullif(sum(n_lat), 0)', 5)} AS latitude, {R('sum(lon) / nullif(sum(n_lon), 0)', 5)} AS longitude,
        {R("count(*) FILTER (st = 'COMPLETED') / nullif(count(*) FILTER (st IN ('COMPLETED', 'TERMINATED')), 0)", 4)} AS completion_rate
        FROM (SELECT name, city, country, f.nct_id, any_value(g.enrollment) AS enrollment, any_value({KEY('g.overall_status')}) AS st, sum(latitude) AS lat, count(latitude) AS n_lat, sum(longitude) AS lon, count(longitude) AS n_lon
        FROM facilities f JOIN gear g ON f.nct_id = g.nct_id WHERE {NAMED} GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3"""
    add("top_sites", f"{sites_agg} ORDER BY n_trials DESC, completion_rate DESC NULLS LAST, name NULLS LAST, city NULLS LAST, country NULLS LAST LIMIT 20")
    add("top_sites_by_rows", f"""SELECT name, city, country, count(DISTINCT f.nct_id) AS n_trials, count(*) FILTER ({KEY('g.overall_status')} = 'COMPLETED') AS n_completed, count(*) FILTER ({KEY('g.overall_status')} = 'TERMINATED') AS n_terminated,
        {R('avg(g.enrollment)', 1)} AS avg_enrollment, {R('avg(latitude)', 5)} AS latitude, {R('avg(longitude)', 5)} AS longitude,
        {R(f"count(*) FILTER ({KEY('g.overall_status')} = 'COMPLETED') / nullif(count(*) FILTER ({KEY('g.overall_status')} IN ('COMPLETED', 'TERMINATED')), 0)", 4)} AS completion_rate
        FROM facilities f JOIN gear g ON f.nct_id = g.nct_id WHERE {NAMED} GROUP BY 1, 2, 3 ORDER BY n_trials DESC, completion_rate DESC NULLS LAST, name NULLS LAST, city NULLS LAST, country NULLS LAST LIMIT 20""")
    zs = " + ".join(f"{w} * ((coalesce({c}, 0) - avg(coalesce({c}, 0)) OVER ()) / stddev_pop(coalesce({c}, 0)) OVER ())" for c, w in (
        ("completion_rate", 0.35), ("avg_enrollment", 0.25), ("n_trials", 0.20), ("late_phase_share", 0.10), ("n_conditions", 0.10)))
    late = f"""SELECT name, city, country, {R(f"avg(CASE WHEN {PHASE('g.phase')} IN ('Phase 2', 'Phase 3') THEN 1.0 ELSE 0.0 END)", 6)} AS late_phase_share, count(DISTINCT lower(condition)) AS n_conditions
        FROM (SELECT DISTINCT name, city, country, nct_id FROM facilities WHERE {NAMED}) v JOIN gear g ON v.nct_id = g.nct_id LEFT JOIN first_condition fc ON fc.nct_id = g.nct_id GROUP BY 1, 2, 3"""
    add("site_rank", f"SELECT name, city, country, n_trials, completion_rate, late_phase_share, n_conditions, {R(zs, 4)} AS performance_score FROM ({sites_agg}) JOIN ({late}) USING (name, city, country)")
    add("site_network_nodes", "SELECT * FROM nodes", NODES)
    add("site_network_edges", "SELECT a.site_key AS site_a, b.site_key AS site_b, count(DISTINCT a.nct_id) AS shared_trials FROM site_rows a JOIN site_rows b ON a.nct_id = b.nct_id AND a.site_key < b.site_key WHERE a.site_key IN (SELECT site_key FROM nodes) AND b.site_key IN (SELECT site_key FROM nodes) GROUP BY 1, 2", NODES)
    add("site_pairs", """SELECT a.condition, a.country, a.facility_name AS facility_name_a, a.city AS city_a, b.facility_name AS facility_name_b, b.city AS city_b, count(DISTINCT a.nct_id) AS shared_trials
        FROM fac_study a JOIN fac_study b ON a.nct_id = b.nct_id AND a.country = b.country AND (a.facility_name, a.city) < (b.facility_name, b.city) GROUP BY 1, 2, 3, 4, 5, 6 HAVING count(DISTINCT a.nct_id) >= 2""")
    add("site_pairs_by_country", """SELECT a.country, a.facility_name AS facility_name_a, a.city AS city_a, b.facility_name AS facility_name_b, b.city AS city_b, count(DISTINCT a.nct_id) AS shared_trials
        FROM fac_study a JOIN fac_study b ON a.nct_id = b.nct_id AND a.country = b.country AND (a.facility_name, a.city) < (b.facility_name, b.city) GROUP BY 1, 2, 3, 4, 5 HAVING count(DISTINCT a.nct_id) >= 2""")
    add("site_pairs_by_month", """SELECT a.name AS name_a, b.name AS name_b, count(*) AS shared_trials FROM sm a JOIN sm b ON a.month = b.month AND a.name < b.name GROUP BY 1, 2 HAVING count(*) >= 2""",
        "sm AS (SELECT DISTINCT strftime(start_date, '%Y-%m') AS month, name FROM facilities JOIN studies USING (nct_id) WHERE name IS NOT NULL AND start_date IS NOT NULL)")
    adj = R("performance_score * coalesce(365.0 / greatest(avg_duration_days, 365.0), 1.0)", 10)
    add("site_recommendation", f"""SELECT rank, country, performance_score, completion_rate, n_completed, avg_duration_days, alloc AS allocated_enrollment, greatest(CAST(ceil(alloc / greatest(avg_enrollment, 10.0)) AS BIGINT), 1) AS recommended_sites,
        concat(CAST(n_completed AS VARCHAR), ' completed trials; completion rate ', CAST(CAST(round(completion_rate * 100) AS BIGINT) AS VARCHAR), '%; avg duration ', format('{{:.1f}}', avg_duration_days / 365.25), ' yrs') AS rationale
        FROM (SELECT *, row_number() OVER (ORDER BY adj DESC, country) AS rank, CAST(round(adj / sum(adj) OVER () * 1000) AS BIGINT) AS alloc FROM (SELECT *, {adj} AS adj FROM perf WHERE n_completed >= 3 ORDER BY adj DESC, country LIMIT 6))""", country_perf("gear"))
    add("site_recommendation_repaired", f"""SELECT rank, country, performance_score, completion_rate, n_completed, avg_duration_days, alloc AS allocated_enrollment, greatest(CAST(ceil(alloc / greatest(avg_enrollment, 10.0)) AS BIGINT), 1) AS recommended_sites,
        concat(CAST(n_completed AS VARCHAR), ' completed trials; completion rate ', CAST(CAST(round(completion_rate * 100) AS BIGINT) AS VARCHAR), '%; avg duration ', format('{{:.1f}}', avg_duration_days / 365.25), ' yrs') AS rationale
        FROM (SELECT *, CAST(floor(x) + CAST(row_number() OVER (ORDER BY x - floor(x) DESC, country) <= 1001 - sum(floor(x)) OVER () AS INTEGER) AS BIGINT) AS alloc FROM (
        SELECT *, row_number() OVER (ORDER BY adj DESC, country) AS rank, adj / sum(adj) OVER () * 1001 AS x FROM (SELECT *, {adj} AS adj FROM perf WHERE n_completed >= 3 ORDER BY adj DESC, country LIMIT 6)))""", country_perf("gear"))
    z = lambda c: R(f"coalesce((coalesce({c}, 0) - avg(coalesce({c}, 0)) OVER ()) / nullif(stddev_pop(coalesce({c}, 0)) OVER (), 0), 0)", 4)
    add("country_zscores_wide", "SELECT country, z1 AS n_trials, z2 AS completion_rate, z3 AS avg_enrollment FROM z",
        country_perf(f"(SELECT * FROM studies WHERE {INTERVENTIONAL})") + f", z AS (SELECT country, {z('n_trials')} AS z1, {z('completion_rate')} AS z2, {z('avg_enrollment')} AS z3 FROM (SELECT * FROM perf ORDER BY n_trials DESC, country LIMIT 25))")
    add("country_zscores", "SELECT country, 'n_trials' AS metric, z1 AS z_score FROM z UNION ALL SELECT country, 'completion_rate', z2 FROM z UNION ALL SELECT country, 'avg_enrollment', z3 FROM z",
        country_perf(f"(SELECT * FROM studies WHERE {INTERVENTIONAL})") + f", z AS (SELECT country, {z('n_trials')} AS z1, {z('completion_rate')} AS z2, {z('avg_enrollment')} AS z3 FROM (SELECT * FROM perf ORDER BY n_trials DESC, country LIMIT 25))")

    add("kpi_summary", "SELECT (SELECT count(*) FROM studies) AS n_trials, (SELECT count(DISTINCT downcase_name) FROM conditions) AS n_conditions, (SELECT count(DISTINCT name) FROM countries) AS n_countries")
    add("dataset_summary", "SELECT 'total_studies' AS metric, '' AS key, count(*) AS value FROM studies UNION ALL SELECT 'phase', phase, count(*) FROM studies WHERE phase IS NOT NULL GROUP BY 2 UNION ALL SELECT 'status', overall_status, count(*) FROM studies GROUP BY 2 UNION ALL SELECT 'unique_conditions', '', count(DISTINCT name) FROM conditions UNION ALL SELECT 'facility_records', '', count(*) FROM facilities UNION ALL SELECT 'unique_countries', '', count(DISTINCT country) FROM facilities")
    d = "enrollment_duration_days"
    add("phase_benchmark", describe_sql(d, "phase_numeric", f"(SELECT * FROM modeling WHERE {d} > 0)", ", " + R(f"median({d}) / 30.4", 4) + " AS median_months"))
    scen = ", ".join(f"('{s['scenario']}', {s['phase_numeric']}::DOUBLE, {s['n_facilities']}, {s['n_countries']}, {s['enrollment']}::DOUBLE)" for s in SCENARIOS)
    add("similar_trials", f"""SELECT phase_numeric, nct_id, n_facilities, n_countries, enrollment, {d}, enrollment_met_target, scenario, distance, position FROM (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY distance, nct_id) AS position FROM (
        SELECT m.phase_numeric, m.nct_id, m.n_facilities, m.n_countries, m.enrollment, {d}, enrollment_met_target, scenario, {R('abs(m.n_countries - s.nc) * 0.3::DOUBLE + abs(m.n_facilities - s.nf) * 0.01::DOUBLE + abs(m.enrollment - s.e) / greatest(s.e, 1.0)', 9)} AS distance
        FROM modeling m JOIN (VALUES {scen}) s(scenario, ph, nf, nc, e) ON m.phase_numeric = s.ph WHERE {d} > 0)) WHERE position <= 10""")
    add("duration_ranking", f"SELECT nct_id, phase, {d} AS pred_duration_days, {R('sponsor_historical_performance', 6)} AS p_completed, CASE WHEN sponsor_historical_performance >= 0.93 THEN 'Low Risk' WHEN sponsor_historical_performance >= 0.5 THEN 'Moderate Risk' ELSE 'High Risk' END AS risk_band FROM modeling WHERE {d} IS NOT NULL ORDER BY {d} DESC, nct_id LIMIT 50")
    add("duration_summary", f"SELECT {R(f'median({d})', 4)} AS median, {R(f'quantile_cont({d}, 0.25)', 4)} AS q1, {R(f'quantile_cont({d}, 0.75)', 4)} AS q3 FROM modeling")
    add("risk_band", "SELECT CASE WHEN score >= 0.93 THEN 'Low Risk' WHEN score >= 0.5 THEN 'Moderate Risk' ELSE 'High Risk' END AS risk_band, count(*) AS n FROM scored GROUP BY 1")

    add("explore_starts_per_year", "SELECT CAST(year(start_date) AS INTEGER) AS start_year, count(*) AS n_trials FROM modeling GROUP BY 1")
    add("explore_status_share", f"SELECT overall_status, count(*) AS n_trials, {R('count(*) / sum(count(*)) OVER () * 100', 2)} AS share_pct FROM modeling GROUP BY 1")
    add("explore_phase_counts", "SELECT phase, count(*) AS n_trials FROM modeling GROUP BY 1")
    add("explore_enrollment_by_phase", describe_sql("enrollment", "phase", "modeling"))
    add("explore_duration_by_phase", describe_sql(d, "phase", "modeling"))
    add("explore_phase_model", "SELECT phase, " + ", ".join(f"count(*) FILTER (intervention_model = '{m}') AS \"{m}\"" for m in MODELS) + " FROM modeling GROUP BY 1")
    add("explore_top_conditions", "SELECT condition, count(*) AS n_trials FROM modeling WHERE condition IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
    add("explore_top_conditions_enrollment", "SELECT condition, sum(enrollment) AS total_enrollment FROM modeling WHERE condition IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
    add("explore_sponsor_type_share", f"SELECT sponsor_type, count(*) AS n_trials, {R('count(*) / sum(count(*)) OVER () * 100', 2)} AS share_pct FROM modeling GROUP BY 1")
    add("explore_success_by_sponsor_type", success("sponsor_type"))
    add("explore_success_by_multicountry", success("is_multicountry"))
    add("explore_success_by_intervention", success("intervention_type"))
    add("explore_intervention_counts", "SELECT intervention_type, count(*) AS n_trials FROM modeling GROUP BY 1")
    ci = "1.96 * sqrt(p * (1 - p) / n_labeled)"
    add("explore_success_by_phase", f"SELECT phase, n_labeled, {R('p', 4)} AS success_rate, {R(f'p - {ci}', 4)} AS ci_low, {R(f'p + {ci}', 4)} AS ci_high FROM (SELECT phase, count(*) AS n_labeled, avg(enrollment_met_target) AS p FROM modeling WHERE enrollment_met_target IS NOT NULL GROUP BY 1)")
    add("explore_success_by_year", f"SELECT CAST(year(start_date) AS INTEGER) AS start_year, count(*) AS n_trials, count(enrollment_met_target) AS n_labeled, {R('avg(enrollment_met_target)', 4)} AS success_rate FROM modeling GROUP BY 1")
    add("explore_ratio_histogram", "SELECT bin, CAST(0.0 + bin * (2.0::DOUBLE / 40) AS DOUBLE) AS bin_start, n, bin * (2.0::DOUBLE / 40) >= 0.9 - 1e-9 AS met FROM (SELECT CAST(greatest(least(floor(enrollment_ratio / (2.0::DOUBLE / 40)), 39), 0) AS BIGINT) AS bin, count(*) AS n FROM modeling WHERE enrollment_ratio IS NOT NULL GROUP BY 1)")
    add("explore_sites_by_country", "SELECT country, count(*) AS site_count FROM kept_fac GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
    add("explore_site_density_map", "SELECT country, count(*) AS site_count FROM kept_fac GROUP BY 1")
    add("explore_enrollment_duration_corr", f"SELECT count(*) AS n, {R(f'corr(enrollment, {d})', 6)} AS corr FROM modeling WHERE enrollment IS NOT NULL AND {d} IS NOT NULL")
    add("explore_sites_ratio_corr", f"SELECT count(*) AS n, {R('corr(n_facilities, enrollment_ratio)', 6)} AS corr FROM modeling WHERE enrollment_ratio IS NOT NULL")

    add("confusion_at_threshold", confusion(at_thresholds([0.5])))
    add("threshold_sweep", confusion(at_thresholds(THRESHOLDS)))
    z6 = lambda a, b: R(f"coalesce(1.0::DOUBLE * ({a}) / nullif({b}, 0), 0)", 6)
    add("pr_curve", f"SELECT threshold, tp, fp, p - tp AS fn, n - fp AS tn, {z6('tp', 'p')} AS recall, {z6('fp', 'n')} AS false_positive_rate, {z6('tp', 'tp + fp')} AS precision FROM curve")
    add("best_threshold", f"SELECT threshold, {R('f1', 6)} AS f1_neg FROM (SELECT threshold, coalesce(2.0 * (n - fp) / nullif(2 * (n - fp) + (p - tp) + fp, 0), 0) AS f1 FROM curve) ORDER BY f1 DESC, threshold LIMIT 1")
    add("average_precision", f"SELECT {R('sum(1.0::DOUBLE * pos / p * tp / (tp + fp))', 6)} AS average_precision FROM curve")
    add("roc_auc_rank", f"SELECT {R('(sum(r) FILTER (label = 1) - np * (np + 1) / 2.0) / (np * nn)', 6)} AS roc_auc, np AS n_pos, nn AS n_neg FROM (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r, count(*) FILTER (label = 1) OVER () AS np, count(*) FILTER (label = 0) OVER () AS nn FROM scored) GROUP BY np, nn")
    res = "lineitem"
    add("regression_diagnostics", f"SELECT count(*) AS n, {R('avg(abs(r))', 4)} AS mae, {R('sqrt(avg(r * r))', 4)} AS rmse, {R('1 - avg(r * r) / var_pop(l_extendedprice)', 6)} AS r2, {R('avg(r)', 4)} AS bias FROM (SELECT l_extendedprice, l_extendedprice - l_quantity * 2000 AS r FROM {res})")
    add("residual_histogram", f"SELECT bin, CAST(-60000.0 + bin * 2000.0 AS DOUBLE) AS bin_start, n FROM (SELECT CAST(greatest(least(floor((l_extendedprice - l_quantity * 2000 + 60000) / 2000), 59), 0) AS BIGINT) AS bin, count(*) AS n FROM {res} GROUP BY 1)")
    add("kaplan_meier", f"""SELECT phase, days, CAST(events AS BIGINT) AS events, at_risk, {R('CASE WHEN dead THEN 0.0 ELSE exp(ls) END', 6)} AS survival FROM (SELECT *, sum(CASE WHEN events < at_risk THEN ln(1 - events / at_risk) ELSE 0 END) OVER w AS ls, bool_or(events = at_risk) OVER w AS dead FROM (
        SELECT phase, days, events, CAST(sum(n) OVER (PARTITION BY phase ORDER BY days DESC) AS BIGINT) AS at_risk FROM (SELECT phase, {d} AS days, count(*) AS n, sum(CAST(overall_status = 'Completed' AS INTEGER)) AS events FROM modeling WHERE {d} > 0 AND phase IN ('Phase 1', 'Phase 2', 'Phase 3', 'Phase 4') GROUP BY 1, 2)) WINDOW w AS (PARTITION BY phase ORDER BY days))
        WHERE phase IN (SELECT phase FROM modeling WHERE {d} > 0 GROUP BY 1 HAVING count(*) >= 20)""")
    add("survival_curve", f"""SELECT nct_id, t, {R('exp(-coalesce(hazard, 0) * risk)', 6)} AS survival FROM (
        SELECT nct_id, exp(0.2::DOUBLE * (phase_numeric - 2) - 0.05::DOUBLE * (n_facilities - 3)) AS risk, unnest([0.5::DOUBLE, 60.0::DOUBLE, n_facilities * 400.0::DOUBLE]) AS t FROM modeling)
        LEFT JOIN (SELECT t, max(hazard) AS hazard FROM hazard_at GROUP BY 1) USING (t)""",
        f"""per_day AS (SELECT floor({d}) AS day, count(*) AS n, sum(CAST(overall_status = 'Completed' AS INTEGER)) AS e FROM modeling WHERE {d} > 0 GROUP BY 1),
        steps AS (SELECT day, e / sum(n) OVER (ORDER BY day DESC) AS step FROM per_day),
        hazard AS (SELECT day, sum(step) OVER (ORDER BY day) AS hazard FROM steps),
        hazard_at AS (SELECT t, hazard FROM (SELECT DISTINCT unnest([0.5::DOUBLE, 60.0::DOUBLE, n_facilities * 400.0::DOUBLE]) AS t FROM modeling) JOIN hazard ON day <= t)""")
    parts = " UNION ALL ".join(f"SELECT '{c}' AS covariate, floor({d}) AS day, CAST(overall_status = 'Completed' AS INTEGER) AS e, CAST({c} AS DOUBLE) AS x FROM modeling WHERE {d} IS NOT NULL AND phase_numeric IS NOT NULL" for c in ("phase_numeric", "n_facilities", "n_countries"))
    add("cox_score_at_zero", f"""SELECT covariate, CAST(events AS BIGINT) AS events, CAST(at_risk AS BIGINT) AS at_risk, {R('es - sm', 4)} AS gradient, {R('sv', 4)} AS information FROM
        (SELECT covariate, sum(k) AS events, sum(n) AS at_risk, sum(es) AS es FROM per_day GROUP BY 1) JOIN
        (SELECT covariate, sum(m) AS sm, sum(mm - m * m) AS sv FROM (SELECT covariate, (rs - f * es) / (rn - f * k) AS m, (rss - f * ess) / (rn - f * k) AS mm FROM
            (SELECT *, j / k AS f FROM (SELECT *, unnest(range(CAST(k AS BIGINT))) AS j FROM risk WHERE k > 0))) GROUP BY 1) USING (covariate)""",
        f"""per_day AS (SELECT covariate, day, count(*) AS n, sum(e) AS k, sum(x) AS s, sum(x * x) AS ss, sum(e * x) AS es, sum(e * x * x) AS ess FROM ({parts}) GROUP BY 1, 2),
        risk AS (SELECT *, sum(n) OVER w AS rn, sum(s) OVER w AS rs, sum(ss) OVER w AS rss FROM per_day WINDOW w AS (PARTITION BY covariate ORDER BY day DESC))""")
    add("typed_studies", """SELECT nct_id, TRY_CAST(s AS DATE) AS start_date, TRY_CAST(c AS DATE) AS completion_date, TRY_CAST(trim(e) AS DOUBLE) AS enrollment FROM (
        SELECT o_orderkey AS nct_id, CASE WHEN o_orderkey % 7 = 0 THEN 'soon' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS s, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '2001-02-30' END AS c,
        CASE o_orderkey % 5 WHEN 0 THEN 'n/a' WHEN 1 THEN ' 12 ' ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) END AS e FROM orders)""")
    numeric = ["phase_numeric", "n_facilities", "n_countries", "n_eligibility_criteria", "geographic_concentration", "condition_prevalence_proxy", "sponsor_historical_performance",
               "competing_trials_count", "enrollment", "enrollment_type_is_actual"]
    value = lambda c: f"ln(1 + greatest(CAST({c} AS DOUBLE), 0))" if c in ("n_facilities", "competing_trials_count", "enrollment") else f"CAST({c} AS DOUBLE)"
    flag, category = "CAST(coalesce(CAST(is_multicountry AS INTEGER), 0) AS DOUBLE)", lambda c: f"coalesce({c}, 'Unknown')"
    categories = ["sponsor_type", "intervention_model", "masking"]
    add("feature_frame", f"SELECT nct_id, {', '.join(f'{R(value(c), 6)} AS f_{c}' for c in numeric)}, {flag} AS f_is_multicountry, {', '.join(f'{category(c)} AS f_{c}' for c in categories)} FROM modeling")
    add("filled_features", f"""SELECT nct_id, {', '.join(R(f'coalesce({value(c)}, (SELECT median({value(c)}) FROM modeling), 0)', 6) + f' AS x_{c}' for c in numeric)}, {flag} AS x_is_multicountry,
        {', '.join(f"(SELECT string_agg(CASE WHEN v = {category('m.' + c)} THEN '1' ELSE '0' END, '' ORDER BY v) FROM (SELECT DISTINCT {category(c)} AS v FROM modeling)) AS x_{c}" for c in categories)} FROM modeling m""")
    timed = f"(SELECT * FROM modeling WHERE {d} >= 1)"
    cells = [f"SELECT '{c}' AS covariate, count(*) AS n, sum(x) AS total, max(x) AS largest FROM (SELECT coalesce({value(c)}, median({value(c)}) OVER (), 0) AS x FROM {timed})" for c in numeric]
    cells.append(f"SELECT 'is_multicountry', count(*), sum({flag}), max({flag}) FROM {timed}")
    cells += [f"""SELECT '{c}_' || v, (SELECT count(*) FROM {timed}), count(*) FILTER (c = v), max(CAST(c = v AS DOUBLE)) FROM (SELECT v FROM (SELECT DISTINCT {category(c)} AS v FROM {timed}) QUALIFY row_number() OVER (ORDER BY v) > 1)
        CROSS JOIN (SELECT {category(c)} AS c FROM {timed}) GROUP BY v""" for c in categories]
    add("cox_design_matrix", f"SELECT covariate, n, {R('total', 4)} AS total, {R('largest', 4)} AS largest FROM ({' UNION ALL '.join(cells)})")
    labeled = "(SELECT nct_id, enrollment_met_target AS label FROM modeling WHERE enrollment_met_target IS NOT NULL)"
    add("stratified_split", f"SELECT nct_id, label, pos < round(size * 0.2) AS is_test FROM ({order_hash(labeled, 'label', 'nct_id')})")
    add("stratified_folds", f"SELECT nct_id, label, CAST(pos % 5 AS INTEGER) AS fold FROM ({order_hash(labeled, 'label', 'nct_id')})")
    add("label_coverage", f"SELECT phase, count(*) AS n_rows, count(enrollment_met_target) AS n_labeled, {R('count(enrollment_met_target) / count(*)', 4)} AS labeled_share, {R('avg(enrollment_met_target)', 4)} AS positive_rate FROM modeling GROUP BY 1")
    add("labeled_and_unlabeled", "SELECT enrollment_met_target IS NOT NULL AS is_labeled, phase, count(*) AS n, count(enrollment_met_target) AS n_with_target FROM modeling GROUP BY 1, 2")
    add("duration_cap", f"SELECT {R(f'quantile_cont({d}, 0.99)', 6)} AS p99, count(*) AS n FROM modeling WHERE {d} > 0 AND enrollment_met_target IS NOT NULL")

    add("risk_factor_rows", "SELECT doc_id, factor_no, risk_factor, coalesce(scored, 'medium') AS severity, suggestion, '' AS population_impact FROM factors", FACTORS)
    add("severity_counts", "SELECT position, severity, (SELECT count(*) FROM factors f WHERE f.scored = s.severity) AS n FROM (VALUES (1::BIGINT, 'high'), (2::BIGINT, 'medium'), (3::BIGINT, 'low')) s(position, severity)", FACTORS)
    add("criteria_validation", "SELECT doc_id, len(lines) AS n_factors, len(lines) = 0 AS lengths_match, TRUE AS severities_known FROM doc_lines", FACTORS)
    add("criteria_enrichment", "SELECT doc_id, substr(sha256(text), 1, 16) AS cache_key, format('{{\"longest\": {}, \"n_lines\": {}}}', coalesce(list_max([length(x) FOR x IN lines]), 0), len(lines)) AS result FROM doc_lines JOIN documents USING (doc_id)", FACTORS)
    imp = "CASE WHEN o_totalprice > 300000 THEN 'favorable_A' WHEN o_totalprice > 100000 THEN 'favorable_B' WHEN o_totalprice > 50000 THEN 'unclear' END"
    add("comparison_rows", f"SELECT o_orderkey, 1::BIGINT AS difference_no, o_orderpriority AS criterion, o_orderstatus AS protocol_a, CAST(o_custkey AS VARCHAR) AS protocol_b, '' AS more_restrictive, coalesce({imp}, 'neutral') AS impact, CASE coalesce({imp}, 'neutral') WHEN 'favorable_A' THEN 'Favors A' WHEN 'favorable_B' THEN 'Favors B' WHEN 'neutral' THEN 'Neutral' ELSE {imp} END AS impact_label FROM orders")
    add("comparison_validation", f"SELECT o_orderkey, ({imp}) IS NOT NULL AS impacts_match FROM orders")
    add("landscape_nested", f"""SELECT 'phase_breakdown' AS part, coalesce(phase, 'N/A') AS name, count(*) AS n FROM gear WHERE {k} IN {ACTIVE} GROUP BY 2
        UNION ALL SELECT 'temporal_density', 'last_' || m || 'm', count(*) FILTER (start_date >= DATE '{AS_OF}' - to_months(m)) FROM gear, (VALUES (6), (12), (24)) t(m) GROUP BY m
        UNION ALL SELECT * FROM (SELECT 'top_countries', country, count(*) FROM facilities WHERE nct_id IN (SELECT nct_id FROM gear) GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10)
        UNION ALL SELECT * FROM (SELECT 'top_sponsors', sponsor_name, count(*) FROM leads WHERE nct_id IN (SELECT nct_id FROM gear WHERE {k} IN {ACTIVE}) GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10)""")
    add("importance_normalisation", f"""SELECT feature, metric, score, {R('CASE WHEN max(score) OVER (PARTITION BY metric) > 0 THEN score / max(score) OVER (PARTITION BY metric) ELSE 0.0 END', 6)} AS score_norm FROM brands UNPIVOT (score FOR metric IN (gain, weight, cover))""",
        "brands AS (SELECT p_brand AS feature, sum(floor(p_retailprice))::DOUBLE AS gain, count(*)::DOUBLE AS weight, 0.0::DOUBLE AS cover FROM part GROUP BY 1)")
    add("importance_agreement", f"""SELECT feature, clf_importance, reg_importance, mean_importance, {R('c', 6)} AS clf_norm, {R('r', 6)} AS reg_norm, {R('delta', 6)} AS delta, {R('1 - delta / greatest(max(delta) OVER (), 1e-9)', 6)} AS agreement, delta > 0.05 AS diverges
        FROM (SELECT *, abs(c - r) AS delta FROM (SELECT *, clf_importance / max(clf_importance) OVER () AS c, reg_importance / max(reg_importance) OVER () AS r, (clf_importance + reg_importance) / 2 AS mean_importance FROM brands) ORDER BY mean_importance DESC, feature LIMIT 15)""",
        "brands AS (SELECT p_brand AS feature, sum(floor(p_retailprice))::DOUBLE AS clf_importance, sum(p_size)::DOUBLE AS reg_importance FROM part GROUP BY 1)")
    add("contribution_waterfall", """SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY value, feature) - 1 AS INTEGER) AS position, value, feature FROM
        (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY abs(value) DESC, feature, value) AS place FROM (SELECT p_partkey, unnest(['size', 'price', 'key', 'rest']) AS feature, unnest([p_size - 25.0::DOUBLE, floor(p_retailprice) - 1200.0::DOUBLE, p_partkey % 7 - 3.0::DOUBLE, 0.5::DOUBLE]) AS value FROM part)) WHERE place <= 3""")
    q["site_performance_country"] = f"SELECT * FROM ({q['site_performance']}) WHERE lower(country) = '{COUNTRY.lower()}'"
    return q
