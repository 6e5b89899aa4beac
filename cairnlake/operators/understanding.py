"""What a request asks for: classes, rewriting, expansion, time windows, cohort filters.

Column builders over the text of a request; null counts as empty.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that tell the class of a request.
CLASSES = {
    "table": r"\b(?:lab|laboratory|result|value|range|reference|vital|blood pressure|bp|heart rate|hba1c|a1c|creatinine|egfr|glucose|ldl|hdl|inr|bun|sodium|potassium|allergen|ige|class|positive|sensiti|test|panel|benefit|coverage|copay|coinsurance|deductible|policy|limit|allowance)\b|\d",
    "chronology": r"\b(?:trend|timeline|chronolog|over time|compare|change|changed|started|stopped|initiated|increased|decreased|latest|recent|current|most recent|newer|later)\b",
    "administrative": r"\b(?:benefit|coverage|copay|co[- ]?insurance|deductible|policy|eligibility|allowance|limit|covered|insurance|claim)\b",
    "summary": r"\bsummar(?:y|ize|ise)|\boverview\b|\breview\b|\bwhat\s+is\s+this\b|\bwhat\s+are\s+these\b|\bcontents?\b",
    "orders": r"\ball\s+orders?\b|\border(?:ed|s)?\b|\bcomplete\s+(?:med|medication|lab|order)|\bmedications?\s+and\s+labs?\b",
    "analytical": r"\b(?:compar|differ|chang|increas|decreas|titrat|uptitrat)\b|\b(?:trend|over time|throughout|during admission|progression|trajectory)\b|\b(?:why|what caused|reason for|explain|how did)\b|\b(?:prioriti[sz](?:e|ed|ing)?|priority|trigger(?:ed|s|ing)?|rationale|drivers?)\b|\b(?:critical|most important|key finding|major concern|significant|urgent)\b|\bwhich (?:med|drug|treatment|intervention)\b|\bmedication.{0,30}(?:start|stop|chang|increas|decreas|added|removed|new)\b|\b(?:risk|readmission|prognosis|deteriorat|worsening)\b|\bwhen (?:was|did|were).{0,20}(?:first|start|initiat|begin)\b|\b(?:what happened|hospital course|what changed|clinical events)\b",
    "policy": r"\b(?:benefit|coverage|copay|co[- ]?insurance|deductible|policy|eligibility|allowance|covered service|claim|premium|out[- ]of[- ]pocket|administrative_benefit)\b",
}
# What is added to a request that asks for it.
REWRITES = [
    (r"advance directive|code status|healthcare proxy|power of attorney|poa|full code|dnr", "advance directive full code DNR do-not-resuscitate DNAR DNI do-not-intubate healthcare proxy power of attorney POA comfort care goals of care POLST MOLST code status resuscitation"),
    (r"weight\s+gain|pounds?\s+gain|gained.{0,30}before admission|presenting\s+weight", "weight gain presenting complaint admission significant weight gain fluid retention edema"),
    (r"home\s+med|medication.{0,20}at home|medications?\s+before admission|taking\s+at\s+home|admission\s+med", "home medications prior medications admission medication reconciliation chronic medications medication history"),
    (r"bnp.{0,30}admission|admission.{0,30}bnp|bnp.{0,10}on admission|natriuretic\s+peptide", "BNP brain natriuretic peptide elevated admission labs baseline cardiac biomarker heart failure fluid overload"),
    (r"weight\s+loss.{0,20}hospital|lost.{0,20}weight.{0,20}hospital|total\s+weight\s+loss|weight\s+was\s+lost|weight\s+lost", "total weight loss discharge decongestion diuresis fluid removal hospitalization net fluid balance"),
    (r"epi.?pen|epinephrine\s+auto|shellfish\s+anaphylaxis", "EpiPen epinephrine anaphylaxis allergy severe hypersensitivity reaction"),
    (r"cha2ds2|stroke\s+risk\s+score", "CHA2DS2-VASc score atrial fibrillation anticoagulation stroke prevention"),
    (r"\bicd\b|implantable.{0,20}defibrillator", "implantable cardioverter defibrillator ICD cardiac device GDMT guideline-directed medical therapy evaluation planned not yet implanted electrophysiology"),
    (r"dietary\s+restrict|fluid\s+restrict|sodium\s+restrict|diet\s+at\s+discharge|discharge\s+diet", "sodium dietary restriction fluid restriction discharge education heart-healthy low-sodium diet fluid intake daily weight monitoring"),
    (r"lisinopril.{0,20}stop|lisinopril.{0,20}discontin|why.{0,20}lisinopril|switch.{0,20}lisinopril", "lisinopril stopped discontinued replaced sacubitril entresto ARNI washout ACE inhibitor ARB transition switch ARNI neprilysin inhibitor"),
]
# Abbreviations and what they stand for.
EXPANSIONS = {
    "hba1c": "hemoglobin a1c glycated hemoglobin", "bnp": "brain natriuretic peptide b-type natriuretic peptide", "bmp": "basic metabolic panel electrolytes sodium potassium", "cmp": "comprehensive metabolic panel liver function renal function",
    "ef": "ejection fraction cardiac function systolic", "echo": "echocardiogram cardiac ultrasound", "chf": "congestive heart failure", "hf": "heart failure", "dm": "diabetes mellitus", "htn": "hypertension blood pressure", "cad": "coronary artery disease",
    "afib": "atrial fibrillation", "ckd": "chronic kidney disease renal insufficiency", "copd": "chronic obstructive pulmonary disease", "dvt": "deep vein thrombosis", "pe": "pulmonary embolism", "mi": "myocardial infarction heart attack",
    "sob": "shortness of breath dyspnea", "cp": "chest pain", "nkda": "no known drug allergies", "dnr": "do not resuscitate code status", "dni": "do not intubate", "cpr": "cardiopulmonary resuscitation", "icu": "intensive care unit critical care",
    "ed": "emergency department emergency room", "iv": "intravenous", "po": "oral by mouth", "prn": "as needed", "wbc": "white blood cell count leukocytes", "rbc": "red blood cell count erythrocytes", "hgb": "hemoglobin", "plt": "platelet count thrombocytes",
    "bun": "blood urea nitrogen", "cr": "creatinine", "bp": "blood pressure", "hr": "heart rate pulse", "rr": "respiratory rate", "spo2": "oxygen saturation pulse oximetry", "o2": "oxygen", "egfr": "estimated glomerular filtration rate renal function",
    "lv": "left ventricle left ventricular", "rv": "right ventricle right ventricular", "pef": "peak expiratory flow", "fev1": "forced expiratory volume", "inr": "international normalized ratio coagulation", "pt": "prothrombin time coagulation",
    "ptt": "partial thromboplastin time coagulation", "alt": "alanine aminotransferase liver enzyme", "ast": "aspartate aminotransferase liver enzyme", "alp": "alkaline phosphatase liver enzyme", "ldl": "low density lipoprotein cholesterol",
    "hdl": "high density lipoprotein cholesterol", "tsh": "thyroid stimulating hormone thyroid function", "a1c": "hemoglobin a1c glycated hemoglobin diabetes",
}
DOMAINS = [r"\bmedication|\bdrug|\brx\b|\bprescri", r"\blab|\btest|\bblood|\bculture|\bpanel", r"\bprocedure|\bsurgery|\bimaging|\bscan|\becho", r"\ball\b|\bcomplete|\bfull\b|\bsummary|\btotal", r"\band\b.{1,50}\band\b"]
LONGEST_REQUEST, MOST_FETCHED = 10_000, 20
FORBIDDEN = (
    "ignore previous instructions", "ignore all previous", "disregard your instructions", "forget your system prompt", "you are now", "act as if you", "new persona", "override your", "bypass your", "reveal your system", "show me your prompt", "print your instructions",
)
DAYS = {"day": 1, "week": 7, "month": 30, "year": 365}
COMPARED = r"\b(?:hba1c|a1c|hemoglobin\s*a1c|glycated\s*hemoglobin)\b\s*(>=|<=|>|<|=|equals|equal)\s*(\d+(?:\.\d+)?)"
WORDED = r"\b(?:hba1c|a1c)\b.*?\b(greater\s*than|at\s*least|less\s*than|at\s*most|equal\s*to|=)\b.*?(\d+(?:\.\d+)?)"
SIGNS = {">": "gt", ">=": "gte", "<": "lt", "<=": "lte", "=": "eq", "equals": "eq", "equal": "eq"}
PHRASES = [(r"\bgreater\s*than\b", "gt"), (r"\bat\s*least\b", "gte"), (r"\bless\s*than\b", "lt"), (r"\bat\s*most\b", "lte"), (r"\bequal\s*to\b", "eq")]


def _low(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit("")))


def is_class(text: Column, name: str) -> Column:
    return _low(text).rlike(CLASSES[name])


def problem(text: Column) -> Column:
    """Why a request is not accepted: ``empty``, ``too_long``, ``forbidden``; else null."""
    bad = sum((F.contains(_low(text), F.lit(x)).cast("int") for x in FORBIDDEN), F.lit(0)) > 0
    return F.when(~_low(text).rlike(r"\S"), "empty").when(F.length(text) > LONGEST_REQUEST, "too_long").when(bad, "forbidden")


def rewritten(text: Column) -> Column:
    """The request with the terms of every intent it shows behind it."""
    return F.concat_ws(" ", F.coalesce(text, F.lit("")), *[F.when(_low(text).rlike(p), F.lit(s)) for p, s in REWRITES])


def expanded(text: Column) -> Column:
    """The request with the meaning of every abbreviation in it behind it."""
    return F.concat_ws(" ", F.coalesce(text, F.lit("")), *[F.when(_low(text).rlike(rf"\b{k}\b"), F.lit(v)) for k, v in EXPANSIONS.items()])


def without_patient(text: Column) -> Column:
    """The request without the patient it names at its head or by record number."""
    t = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"(?i)^\s*for\s+patient\s+[^,]{2,120},\s*", "")
    t = F.regexp_replace(F.regexp_replace(t, r"(?i)\(\s*mrn\s*:\s*[^\)]+\)", ""), r"\s+", " ")
    t = F.regexp_replace(t, "^[ ,]+|[ ,]+$", "")
    return F.when(t != "", t).otherwise(F.coalesce(text, F.lit("")))


def fetch_count(text: Column, usual: int) -> Column:
    """How many candidates to fetch: twice as many for a request of two domains or more, up to ``MOST_FETCHED``."""
    signs = sum((_low(text).rlike(p).cast("int") for p in DOMAINS), F.lit(0))
    return F.when(signs >= 2, F.lit(min(2 * usual, MOST_FETCHED))).otherwise(F.lit(usual))


def within_days(text: Column) -> Column:
    """Days of ``last N days, weeks, months, years``."""
    p = r"\blast\s+(\d+)\s*(day|week|month|year)s?\b"
    n, unit = F.regexp_extract(_low(text), p, 1).try_cast("int"), F.regexp_extract(_low(text), p, 2)
    out = F.lit(None).cast("int")
    for k, v in DAYS.items():
        out = F.when(unit == k, n * v).otherwise(out)
    return out


def cohort_filter(text: Column) -> Column:
    """(diagnoses, operator, value, within_days) of a request for patients by A1C; null where it asks for none."""
    t = _low(text)
    sign, worded = F.regexp_extract(t, COMPARED, 1), F.regexp_extract(t, WORDED, 1)
    op = F.lit(None).cast("string")
    for p, name in reversed(PHRASES):
        op = F.when(t.rlike(p), F.lit(name)).otherwise(op)
    op = F.when(worded == "=", F.lit("eq")).otherwise(op)
    op = F.when(worded != "", op)
    for s, name in SIGNS.items():
        op = F.when(sign == s, F.lit(name)).otherwise(op)
    value = F.when(sign != "", F.regexp_extract(t, COMPARED, 2)).otherwise(F.regexp_extract(t, WORDED, 2)).try_cast("double")
    kind = F.when(t.rlike(r"\btype\s*2\b|\bt2dm\b"), F.array(F.lit("diabetes"), F.lit("type 2 diabetes"))).when(t.rlike(r"\btype\s*1\b|\bt1dm\b"), F.array(F.lit("diabetes"), F.lit("type 1 diabetes"))).otherwise(F.array(F.lit("diabetes")))
    diagnoses = F.when(t.rlike(r"\bdiabet"), kind).otherwise(F.array().cast("array<string>"))
    return F.when(op.isNotNull() & value.isNotNull(), F.struct(diagnoses.alias("diagnoses"), op.alias("operator"), value.alias("value"), within_days(text).alias("within_days")))
