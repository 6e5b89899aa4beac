"""Sections, facts of tables, events, classification and grounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlake.functions.text import citations, first_match, sentences

# Record numbers and dates without a label, as chat texts have them.
MRN = [(r"MRN[:#\s-]*([A-Z]{2,4}-[0-9]{4}-[0-9]{4,})", 1), (r"MRN[:#\s-]*([0-9]{6,})", 1), (r"\b(MRN-[0-9]{4}-[0-9]{4,})\b", 1)]
DATE = [(r"([0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4})", 1), (r"([0-9]{4}-[0-9]{2}-[0-9]{2})", 1)]


def extracted(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """Record number and first date of a text."""
    t = F.substring(F.col(text), 1, 3000)
    return df.select(id_col, first_match(t, MRN, 4).alias("mrn"), first_match(t, DATE).alias("first_date"))


# Record numbers and dates by their labels, the surest first.
RECORD_NUMBERS = [
    (r"\b(?:mrn|medical\s+record\s+(?:number|no\.?|#))\s*(?:is\s*|:\s*|#?\s*)([A-Z0-9][\w\-]+)", 1),
    (r"\b(?:med\.?\s*rec\.?\s*(?:no\.?|number|#)|mr\s*#|mr\s*no\.?)\s*:?\s*([A-Z0-9][\w\-]+)", 1),
    (r"\b(?:record\s+(?:number|no\.?|#))\s*:?\s*([A-Z0-9][\w\-]+)", 1), (r"\bMRN\s*\|?\s+([A-Z0-9][\w\-]{3,})", 1), (r"\b(MRN-\d{4}-\d{4,})\b", 1),
]
_DAY = r"\s*:\s*(\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4})"
ENCOUNTER_DATES = [(p + _DAY, 1) for p in (r"(?:admission|admit)\s+date", r"date\s+of\s+service", r"encounter\s+date", r"visit\s+date", r"(?:^|\n)\s*date")]
HEAD = 3000


def record_keys(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """Labelled record number and encounter date: of the head where it has one, else of the whole text."""

    def found(patterns: list[tuple[str, int]], least: int) -> Column:
        p = [("(?iuU)" + x, g) for x, g in patterns]
        return F.coalesce(first_match(F.substring(F.col(text), 1, HEAD), p, least), first_match(F.col(text), p, least))

    return df.select(id_col, found(RECORD_NUMBERS, 4).alias("mrn"), found(ENCOUNTER_DATES, 1).alias("encounter_date"))


def sections(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """Heading sections of marked-up text: (id, section_no, title, body)."""
    parts = F.split(F.concat(F.lit("\n"), F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\r", "")), r"\n(?=#{1,4} )")
    d = df.select(id_col, F.posexplode(parts).alias("section_no", "_s"))
    title = F.regexp_extract("_s", r"^#{1,4} ([^\n]*)", 1)
    body = F.trim(F.regexp_replace("_s", r"^#{1,4} [^\n]*", ""))
    return d.select(id_col, "section_no", title.alias("title"), F.regexp_replace(body, r"^\n+|\n+$", "").alias("body")).filter("title <> '' OR body <> ''")


def table_facts(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """Rows of pipe tables with three cells: (id, row_no, name, value, reference)."""
    rows = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda s: s.startswith("|") & ~s.rlike(r"^\|[-| :]+\|?$"))
    d = df.select(id_col, F.posexplode(rows).alias("row_no", "_r"))
    cells = F.transform(F.split(F.regexp_replace("_r", r"^\||\|\s*$", ""), r"\|"), lambda x: F.trim(x))
    d = d.select(id_col, "row_no", cells.alias("_c")).filter(F.size("_c") == 3)
    d = d.select(id_col, "row_no", F.col("_c")[0].alias("name"), F.col("_c")[1].alias("value"), F.col("_c")[2].alias("reference"))
    return d.filter(F.col("value").rlike("[0-9]") & (F.col("name") != ""))


EVENTS = [("start", r"(?i)\bstarted ([A-Z][a-z]+)"), ("change", r"(?i)\bdose of ([A-Z][a-z]+) was changed"), ("reaction", r"(?i)\ballergy review: ([A-Z][a-z]+) caused")]


def _event(e: str):
    return lambda m: F.struct(F.lit(e).alias("event"), m.alias("medication"))


def events(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """Medication events: (id, event, medication), each once a text."""
    every = F.concat(*[F.transform(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(p), 1), _event(e)) for e, p in EVENTS])
    return df.select(id_col, F.explode(F.array_distinct(every)).alias("_e")).select(id_col, "_e.event", "_e.medication")


def grounding(df: DataFrame, id_col: str, text: str, sources: Column) -> DataFrame:
    """Citations, coverage, invalid ones, and sentences with a number but no citation."""
    c = citations(F.col(text))
    bare = F.filter(sentences(F.coalesce(F.col(text), F.lit(""))), lambda s: s.rlike(r"[0-9]+\.[0-9]") & ~s.rlike(r"\[S[0-9]+\]"))
    d = df.select(id_col, c.alias("cited"), F.size(bare).alias("uncited"), sources.alias("_n"))
    invalid = F.size(F.filter("cited", lambda x: (x < 1) | (x > F.col("_n"))))
    return d.select(
        id_col, F.size("cited").alias("n_cited"), F.coalesce(F.array_max("cited"), F.lit(0)).alias("max_source"), invalid.alias("invalid"), "uncited",
        F.round(F.size("cited") / F.greatest("_n", F.lit(1)), 3).alias("coverage"), ((invalid == 0) & (F.col("uncited") == 0)).alias("grounded"),
    )


# Numbers that need a source, the first of a sentence counts.
CLAIMS = [
    ("medication/dose value", r"\d+(?:\.\d+)?\s*(?:mg|mcg|µg|mEq|mL|L|g|units?|mmol)\b"),
    ("lab value", r"\d+(?:\.\d+)?\s*(?:mg/dL|mmol/L|pg/mL|ng/mL|IU/L|U/L|mEq/L|g/dL|%)(?!\w)"),
    ("blood pressure", r"\bBP\s+\d{2,3}/\d{2,3}\b|\b\d{2,3}/\d{2,3}\s*mmHg\b"),
    ("heart rate", r"\bHR\s+\d+\b|\bpulse\s+of\s+\d+\b|\bheart\s+rate\s+(?:of\s+|was\s+)?\d+\b"),
    ("oxygen saturation", r"\bSpO2\s+(?:of\s+)?\d+\b|\bO2\s+sat(?:uration)?\s+(?:of\s+)?\d+\b"),
    ("temperature", r"\btemperature\s+(?:of\s+)?\d+(?:\.\d+)?\s*(?:°[CF]|degrees?)\b"),
    ("weight", r"\bweight\s+(?:of\s+)?\d+(?:\.\d+)?\s*(?:kg|lbs?|pounds?)\b"),
    ("HbA1c value", r"\bHbA1c\s+(?:of\s+)?\d+(?:\.\d+)?%?\b|\bA1c\s+(?:of\s+)?\d+(?:\.\d+)?%?\b"),
]
CITED = r"\[S([0-9]+)(?:[,\s][^\]]+)?\]"


def claim(sentence: Column) -> Column:
    """Label of the first of ``CLAIMS`` in a sentence without citation, else null."""
    out = F.lit(None).cast("string")
    for label, p in reversed(CLAIMS):
        out = F.when(sentence.rlike("(?iuU)" + p), F.lit(label)).otherwise(out)
    return F.when(~sentence.rlike(CITED), out)


def claims(df: DataFrame, id_col: str, text: str, sources: Column) -> DataFrame:
    """As ``grounding``, with all claims of ``CLAIMS`` and the labels of those that name no source, in order."""
    t = F.coalesce(F.col(text), F.lit(""))
    cited = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit(CITED), 1), lambda x: x.cast("int"))))
    labels = F.filter(F.transform(sentences(t), claim), lambda x: x.isNotNull())
    d = df.select(id_col, cited.alias("cited"), labels.alias("labels"), sources.alias("_n"))
    invalid = F.size(F.filter("cited", lambda x: (x < 1) | (x > F.col("_n"))))
    return d.select(
        id_col, F.size("cited").alias("n_cited"), F.coalesce(F.array_max("cited"), F.lit(0)).alias("max_source"), invalid.alias("invalid"), F.size("labels").alias("uncited"),
        F.array_join("labels", "; ").alias("labels"), F.round(F.size("cited") / F.greatest("_n", F.lit(1)), 3).alias("coverage"), ((invalid == 0) & (F.size("labels") == 0)).alias("grounded"),
    )


def packed(df: DataFrame, group: str, order: str, size: Column, budget: int) -> DataFrame:
    """Greedy packing in order: a new pack begins when the next item does not fit."""
    items = df.select(group, order, size.alias("_n")).groupBy(group).agg(F.array_sort(F.collect_list(F.struct(order, "_n"))).alias("_i"))
    start = F.struct(F.lit(0).alias("g"), F.lit(0).alias("c"), F.array().cast("array<int>").alias("o"))

    def step(s: Column, x: Column) -> Column:
        full = (s["c"] > 0) & (s["c"] + x["_n"] > budget)
        g = F.when(full, s["g"] + 1).otherwise(s["g"])
        return F.struct(g.alias("g"), F.when(full, x["_n"]).otherwise(s["c"] + x["_n"]).cast("int").alias("c"), F.concat(s["o"], F.array(g)).alias("o"))

    out = items.select(group, F.explode(F.arrays_zip(F.col(f"_i.{order}").alias(order), F.aggregate("_i", start, step)["o"].alias("pack"))).alias("_z"))
    return out.select(group, F.col(f"_z.{order}").alias(order), F.col("_z.pack").alias("pack"))
