"""Keys and tags taken from the text of a document: people, places, dates, diagnoses, readings.

Every function is a Column builder over one text, so that a scan stays one
narrow stage.  Defined results: null and empty texts give null (lists: empty);
an invalid date is null; ties go to the first rule or the first in the text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Categories of sections in the order they are tried.
SECTION_RULES = [
    ("allergies", r"\ballerg"),
    ("medications", r"\bmedication|\bcurrent\s+med|\bdischarge\s+med|\bmed\s+list|\bpharmac|\bprescri"),
    ("labs", r"\blab\b|\blaboratory|\bblood\s+(?:test|result|panel)|\bcbc|\bcmp|\bbmp|\bculture|\bcoagulat"),
    ("vitals", r"\bvital|\bblood\s+pressure|\bheart\s+rate|\btemperature|\bpulse\s+ox|\bspo2"),
    ("assessment", r"\bassessment|\bimpression|\bproblem\s+list|\bdiagnos"),
    ("procedures", r"\bprocedure|\boperat|\bsurgical|\bintervention|\bimaging|\bradiol|\bct\b|\bmri\b|\becho"),
    ("discharge", r"\bdischarge|\bsummary"),
    ("demographics", r"\bdemographic|\bpatient\s+info|\bidentifi|\bregistration|\badmission\s+info"),
]
# Words that tell the type of a document, within its first 5,000 characters.
TYPE_HEAD = 5000
TYPE_RULES = [
    ("lab_report", [r"\b(?:laboratory|lab)\s+(?:report|results|values|test)", r"\bcomplete\s+blood\s+count\b", r"\bcomprehensive\s+metabolic\s+panel\b", r"\blab\s+(?:order|panel)\b"]),
    ("radiology", [r"\b(?:radiology|imaging)\s+report\b", r"\b(?:x-ray|xray|ct\s+scan|mri|ultrasound|echocardiogram)\s+(?:report|findings)\b", r"\bimpression\s*:\s*\n", r"\bradiolog"]),
    ("discharge_summary", [r"\bdischarge\s+summar", r"\bdischarge\s+(?:instructions|plan|disposition)\b"]),
    ("operative_note", [r"\b(?:operative|surgical|procedure)\s+(?:note|report)\b", r"\bpreoperative\s+diagnosis\b", r"\bpostoperative\s+diagnosis\b"]),
    ("progress_note", [r"\b(?:progress|daily)\s+note", r"\bSOAP\s+note\b", r"\bsubjective\s*:\s*\n", r"\bassessment\s+(?:and|&)\s+plan\b"]),
    ("clinical_note", [r"\bclinical\s+note\b", r"\b(?:history\s+and\s+physical|h\s*&\s*p)\b", r"\bchief\s+complaint\b", r"\bhistory\s+of\s+present\s+illness\b"]),
    ("billing", [r"\b(?:billing|insurance|claim)\s+(?:statement|summary|report)\b", r"\bcpt\s+code\b.*\bcharge\b", r"\btotal\s+charges\b"]),
]
# Labels before names, places and dates.
NAMES = [
    r"(?:patient\s+name|full\s+name|pt\.?\s*name)\s*:\s*(.+?)(?:\n|$)", r"(?:^|\n)\s*(?<!file\s)(?<!drug\s)(?<!brand\s)name\s*:\s*([A-Za-z][A-Za-z .\-,]+?)(?:\n|$)", r"(?:^|\n)\s*patient\s*:\s*([A-Za-z][A-Za-z .\-,]+?)(?:\n|$)",
    r"(?:^|\n)\s*pt\.?\s*:\s*([A-Za-z][A-Za-z .\-,]+?)(?:\n|$)", r"\*\*(?:patient\s+name|name|patient)\*\*\s*:?\s*([A-Za-z][A-Za-z .\-,]+?)(?:\n|$)",
]
FACILITIES = [
    r"(?:hospital|facility|institution|health\s+system|medical\s+center|clinic)\s*:\s*([A-Za-z][A-Za-z0-9 &\-,.']{4,80})", r"(?:discharge\s+from|admitted\s+to|treated\s+at)\s*:?\s*([A-Za-z][A-Za-z0-9 &\-,.']{4,80})",
    r"^([A-Z][A-Za-z0-9 &\-,.']{4,60})\s*\n(?:\d{1,5}|\([0-9]{3}\))",
]
LOCATIONS = [r"(?:location|unit)\s*:\s*([A-Za-z][A-Za-z0-9 /&\-]{2,80})", r"(?:get\s*well\s*location)\s*[:\-]?\s*([A-Za-z][A-Za-z0-9 /&\-]{2,80})"]
_DAY = r"(\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4})"
CLINICAL_DATES = [
    r"(?:collected(?:\s+on)?|collection\s+date|collection\s+time)\s*:?\s*" + _DAY, r"(?:resulted?(?:\s+date)?|result\s+date|reported)\s*:?\s*" + _DAY, r"(?:ordered(?:\s+on)?|order\s+date)\s*:?\s*" + _DAY,
    r"(?:procedure|study|test|event)\s+date\s*:?\s*" + _DAY, "^" + _DAY + r"\s*(?:[:\-—]|$)",
]
HEADS = {"name": 3000, "facility": 4000, "location": 8000, "clinical_date": 2000}
MEDICATION_HINT = r"(?:medication|meds|rx|discharge medication|discharge rx|current medication|home medication)"
DOSED = r"\b([A-Za-z][A-Za-z0-9\-_]{1,30})\s*\d+(?:\.\d+)?\s*(?:mg|mcg|g)\b"
A1C = r"\b(?:hba1c|a1c|hemoglobin\s*a1c|glycated\s*hemoglobin)\b\s*[:=]?\s*(\d+(?:\.\d+)?)"
NEGATIONS = ("no", "not", "denies", "denied", "without", "negative for", "rule out", "r/o")
NEGATION_WINDOW = 100


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def section_category(title: Column) -> Column:
    out = F.lit("other")
    for name, p in reversed(SECTION_RULES):
        out = F.when(_text(title).rlike("(?i)" + p), F.lit(name)).otherwise(out)
    return out


def document_type(text: Column) -> Column:
    """The type with most hits, the earlier one among equals; ``general`` without any."""
    t = F.lower(F.substring(_text(text), 1, TYPE_HEAD))
    hits = [sum((F.size(F.regexp_extract_all(t, F.lit("(?i)" + p), 0)) for p in patterns), F.lit(0)) for _, patterns in TYPE_RULES]
    best = F.array_max(F.array(*[F.struct(h.alias("n"), F.lit(-i).alias("order"), F.lit(name).alias("name")) for i, ((name, _), h) in enumerate(zip(TYPE_RULES, hits))]))
    return F.when(best["n"] > 0, best["name"]).otherwise("general")


def iso_date(raw: Column) -> Column:
    """Month, day and year between slashes, dashes or dots, as ``yyyy-MM-dd``; years below 100 are 20xx."""
    part = lambda i: F.try_element_at(F.split(F.trim(raw), "[./-]"), F.lit(i)).try_cast("int")
    year = F.when(part(3) < 100, part(3) + 2000).otherwise(part(3))
    shape = F.trim(raw).rlike(r"^\d{1,2}[./-]\d{1,2}[./-]\d{1,4}$")
    return F.when(shape, F.try_to_date(F.format_string("%04d-%02d-%02d", year, part(1), part(2)), "yyyy-MM-dd").cast("string"))


def encounter_date(raw: Column) -> Column:
    """As ``iso_date`` for slashes only, with two-digit years of 1969 to 2068."""
    part = lambda i: F.try_element_at(F.split(F.trim(raw), "/"), F.lit(i)).try_cast("int")
    year = F.when(F.trim(raw).rlike(r"/\d{4}$"), part(3)).when(part(3) >= 69, part(3) + 1900).otherwise(part(3) + 2000)
    shape = F.trim(raw).rlike(r"^\d{1,2}/\d{1,2}/(?:\d{2}|\d{4})$")
    return F.when(shape, F.try_to_date(F.format_string("%04d-%02d-%02d", year, part(1), part(2)), "yyyy-MM-dd").cast("string"))


def _first_valid(values: list[Column], valid) -> Column:
    return F.coalesce(*[F.when(valid(v), v) for v in values])


def patient_name(text: Column) -> Column:
    """The first labelled name of two words or more."""
    t = F.substring(_text(text), 1, HEADS["name"])
    found = [F.regexp_replace(_strip(F.regexp_extract(t, "(?i)" + p, 1)), "[,.]+$", "") for p in NAMES]
    words = lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda w: w.rlike(r"^\p{L}.")))
    return _first_valid(found, lambda c: (F.length(c) > 2) & c.rlike(r"^\p{L}") & (words(c) >= 2))


def facility(text: Column) -> Column:
    t = F.substring(_text(text), 1, HEADS["facility"])
    found = [F.regexp_replace(_strip(F.regexp_extract(t, "(?im)" + p, 1)), "[,.]+$", "") for p in FACILITIES]
    return _first_valid(found, lambda c: F.length(c) > 4)


def location(text: Column) -> Column:
    t = F.substring(_text(text), 1, HEADS["location"])
    return _first_valid([_strip(F.regexp_extract(t, "(?i)" + p, 1)) for p in LOCATIONS], lambda c: c != "")


def clinical_date(text: Column) -> Column:
    """The first labelled date that is a date."""
    t = F.substring(_text(text), 1, HEADS["clinical_date"])
    return F.coalesce(*[iso_date(F.regexp_extract(t, "(?im)" + p, 1)) for p in CLINICAL_DATES])


def diagnoses(text: Column) -> Column:
    """Tags of diabetes, the general one before the type."""
    t = F.lower(_text(text))
    has = lambda *words: sum((F.contains(t, F.lit(w)).cast("int") for w in words), F.lit(0)) > 0
    return (
        F.when(has("type 2 diabetes", "t2dm"), F.array(F.lit("diabetes"), F.lit("type 2 diabetes")))
        .when(has("type 1 diabetes", "t1dm"), F.array(F.lit("diabetes"), F.lit("type 1 diabetes")))
        .when(has("diabetes", "hba1c"), F.array(F.lit("diabetes")))
        .otherwise(F.array().cast("array<string>"))
    )


def dosed_medications(text: Column) -> Column:
    """Names before a dose, lower case, each once, where the text speaks of medication at all."""
    names = F.array_distinct(F.transform(F.regexp_extract_all(_text(text), F.lit("(?i)" + DOSED), 1), lambda x: F.lower(x)))
    return F.when(F.lower(_text(text)).rlike(MEDICATION_HINT), names).otherwise(F.array().cast("array<string>"))


def negated(before: Column) -> Column:
    """Whether one of the words that deny stands in the text before a finding."""
    c = F.lower(_text(before))
    return sum((F.contains(c, F.lit(w)).cast("int") for w in NEGATIONS), F.lit(0)) > 0


def pieces_between(text: Column, pattern: str) -> Column:
    """(at, match) of every match: the text is split at them, so that lengths give positions (from 0)."""
    t = _text(text)
    hits = F.regexp_extract_all(t, F.lit(pattern), 0)
    gaps = F.split(t, pattern, -1)
    rows = F.arrays_zip(gaps.alias("g"), hits.alias("h"))
    start = F.struct(F.lit(0).alias("p"), F.array().cast("array<struct<at:int,match:string>>").alias("o"))
    step = lambda s, x: F.struct(
        (s["p"] + F.length(x["g"]) + F.coalesce(F.length(x["h"]), F.lit(0))).cast("int").alias("p"),
        F.when(x["h"].isNull(), s["o"]).otherwise(F.concat(s["o"], F.array(F.struct((s["p"] + F.length(x["g"])).cast("int").alias("at"), x["h"].alias("match"))))).alias("o"),
    )
    return F.when(F.size(hits) > 0, F.aggregate(rows, start, step)["o"]).otherwise(F.array().cast("array<struct<at:int,match:string>>"))


def a1c_reading(text: Column) -> Column:
    """(value, date) of the highest A1C that is not denied, with the nearest date of the text;
    among equal values one with a date."""
    t = _text(text)
    dates = F.filter(F.transform(pieces_between(t, r"\b\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}\b"), lambda d: F.struct(d["at"].alias("at"), iso_date(d["match"]).alias("day"))), lambda d: d["day"].isNotNull())
    sound = F.filter(pieces_between(t, "(?i)" + A1C), lambda m: ~negated(F.substring(t, F.greatest(m["at"] - NEGATION_WINDOW, F.lit(0)) + 1, F.least(m["at"], F.lit(NEGATION_WINDOW)))))
    near = lambda m: F.array_min(F.transform(dates, lambda d: F.struct(F.abs(d["at"] - m["at"]).alias("far"), d["at"].alias("at"), d["day"].alias("day"))))["day"]
    value = lambda m: F.regexp_extract(m["match"], r"(\d+(?:\.\d+)?)$", 1).try_cast("double")
    best = F.array_max(F.transform(sound, lambda m: F.struct(value(m).alias("value"), near(m).isNotNull().alias("dated"), (-m["at"]).alias("first"), near(m).alias("day"))))
    return F.struct(best["value"].alias("value"), best["day"].alias("day"))
