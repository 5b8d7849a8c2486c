"""Fixed values of the registry domain.

Everything here is a lookup value that results depend on; logic lives elsewhere.
"""

# Registry tables, in load order. Only ``studies`` is mandatory.
TABLES = (
    "studies", "calculated_values", "eligibilities", "designs", "facilities",
    "countries", "sponsors", "conditions", "interventions", "outcome_counts",
)

# Upper-cased raw phase spelling -> canonical phase.
PHASE_SPELLINGS = {
    "PHASE1": "Phase 1",
    "PHASE 1": "Phase 1",
    "EARLY_PHASE1": "Phase 1",
    "EARLY PHASE 1": "Phase 1",
    "PHASE2": "Phase 2",
    "PHASE 2": "Phase 2",
    "PHASE3": "Phase 3",
    "PHASE 3": "Phase 3",
    "PHASE4": "Phase 4",
    "PHASE 4": "Phase 4",
    "PHASE1/PHASE2": "Phase 1/Phase 2",
    "PHASE 1/PHASE 2": "Phase 1/Phase 2",
    "PHASE 1 / PHASE 2": "Phase 1/Phase 2",
    "PHASE 1/2": "Phase 1/Phase 2",
    "PHASE2/PHASE3": "Phase 2/Phase 3",
    "PHASE 2/PHASE 3": "Phase 2/Phase 3",
    "PHASE 2 / PHASE 3": "Phase 2/Phase 3",
    "PHASE 2/3": "Phase 2/Phase 3",
}
PHASE_UNKNOWN = "N/A"

PHASE_ORDINAL = {
    "Phase 1": 1.0,
    "Phase 1/Phase 2": 1.5,
    "Phase 2": 2.0,
    "Phase 2/Phase 3": 2.5,
    "Phase 3": 3.0,
    "Phase 4": 4.0,
}

# Phases that may appear on a timeline; single phases that get a survival curve.
TIMELINE_PHASES = (
    "Phase 1", "Phase 2", "Phase 3", "Phase 4",
    "Phase 1/Phase 2", "Phase 2/Phase 3", "Early Phase 1",
)
SINGLE_PHASES = ("Phase 1", "Phase 2", "Phase 3", "Phase 4")

EXCLUDED_STATUSES = ("WITHDRAWN", "UNKNOWN STATUS")
ACTIVE_STATUSES = (
    "RECRUITING", "ACTIVE_NOT_RECRUITING", "NOT_YET_RECRUITING", "ENROLLING_BY_INVITATION",
)
RECRUITING_STATUSES = ("RECRUITING", "ENROLLING_BY_INVITATION")
MARKET_STATUSES = ACTIVE_STATUSES + ("COMPLETED",)

# Upper-cased agency class -> sponsor type; anything else is academic.
SPONSOR_TYPES = {"INDUSTRY": "industry", "NIH": "government", "U.S. FED": "government"}
SPONSOR_TYPE_DEFAULT = "academic"

RECRUITMENT_FAILURE_KEYWORDS = (
    "enrollment", "accrual", "recruit", "enrol", "participant", "patient", "subject",
)

COUNTRY_ALIASES = {
    "Turkey (Türkiye)": "Turkey",
    "Korea, Republic of": "South Korea",
    "Iran, Islamic Republic of": "Iran",
    "Russian Federation": "Russia",
    "Czech Republic": "Czechia",
    "Viet Nam": "Vietnam",
    "Syrian Arab Republic": "Syria",
    "Congo, The Democratic Republic of the": "Democratic Republic of the Congo",
    "Tanzania, United Republic of": "Tanzania",
    "Bolivia, Plurinational State of": "Bolivia",
    "Venezuela, Bolivarian Republic of": "Venezuela",
    "Moldova, Republic of": "Moldova",
    "Lao People's Democratic Republic": "Laos",
    "Palestine, State of": "Palestine",
}

# Sponsor placeholders that do not name a physical site.
GENERIC_SITE_NAMES = (
    "Research Site",
    "GSK Investigational Site",
    "Novartis Investigative Site",
    "Pfizer Investigational Site",
    "Novo Nordisk Investigational Site",
    "Investigational Site",
    "AstraZeneca Investigational Site",
    "Eli Lilly and Company",
    "Merck Sharp & Dohme LLC",
    "Sanofi-Aventis Investigational Site",
    "Roche Investigational Site",
    "Johnson & Johnson",
    "Boehringer Ingelheim Investigational Site",
    "Bristol-Myers Squibb",
    "Amgen Investigational Site",
    "Janssen Research & Development, LLC",
)

# Tokens that stand for "missing" in the pipe-delimited registry files.
NULL_TOKENS = ("", "NA", "N/A", "n/a", "NaN", "nan", "NULL", "null", "None")

NUMERIC_FEATURES = (
    "phase_numeric", "n_facilities", "n_countries", "n_eligibility_criteria",
    "geographic_concentration", "condition_prevalence_proxy",
    "sponsor_historical_performance", "competing_trials_count", "enrollment",
    "enrollment_type_is_actual",
)
LOG_FEATURES = ("n_facilities", "competing_trials_count", "enrollment")
BOOLEAN_FEATURES = ("is_multicountry",)
CATEGORICAL_FEATURES = ("sponsor_type", "intervention_model", "masking")

CLASS_TARGET = "enrollment_met_target"
DURATION_TARGET = "enrollment_duration_days"
DECISION_THRESHOLD = 0.93
POSITIVE_WEIGHT = 5.0
SURVIVAL_TIME_POINTS = (90, 180, 365, 730, 1095)

SEVERITIES = ("high", "medium", "low")
IMPACT_LABELS = {
    "favorable_A": "Favors A",
    "favorable_B": "Favors B",
    "neutral": "Neutral",
}
