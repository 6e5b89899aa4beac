"""Facts out of pipe tables: rows as results or benefits, with the chunk they come from.

A text is split into lines, runs of table lines are folded into blocks, and each
block into headers and rows, all in the row of the text: facts inherit its
columns by ``explode`` and nothing is shuffled.

Defined results: a block needs a separator line below a header and above a row;
short rows are padded; null texts have no facts; every row counts, however many
a text has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlake.operators.metadata import iso_date

# Words that tell tables of results and of benefits.
CLINICAL_CONTEXT = r"\b(lab|laboratory|cbc|cmp|bmp|metabolic|chemistry|hematology|differential|thyroid|lipid|vitamin|ige|allergen|a1c|hba1c|glucose|creatinine|egfr|bun|electrolyte|vital|blood pressure|heart rate|pulse|temperature|spo2|oxygen|height|weight|bmi)\b"
ADMIN_CONTEXT = r"\b(benefit|coverage|copay|co-?insurance|deductible|policy|eligibility|allowance|covered|insurance|claim|premium|out[- ]of[- ]pocket|authorization|in[- ]network|out[- ]of[- ]network)\b"
ROW_LABEL = r"\b(wbc|rbc|hemoglobin|hgb|hematocrit|hct|platelet|plt|mcv|mch|mchc|rdw|neutrophil|lymphocyte|monocyte|eosinophil|basophil|sodium|potassium|chloride|bicarbonate|co2|bun|creatinine|egfr|glucose|calcium|albumin|bilirubin|ast|alt|alkaline|cholesterol|ldl|hdl|triglyceride|tsh|t4|inr|pt|ptt|a1c|hba1c|vitamin|ige|allergen|blood pressure|bp|heart rate|pulse|respiratory|spo2|temperature|height|weight|bmi)\b"
MEASUREMENT = r"^\s*([<>]=?\s*)?\d+(\.\d+)?(\s*/\s*\d+(\.\d+)?)?(\s*(%|mg/dl|g/dl|mmol/l|meq/l|iu/ml|iu/l|ku/l|ng/ml|pg/ml|ml/min(/1\.73m2)?|mmhg|bpm|beats/min|breaths/min|kg/m2|lbs?|kg|cm|mg|mcg|g|iu|units?))?(\s*\([^)]+\))?\s*$"
# Words of the headers that name each column.
HEADERS = {
    "label": [r"\btest\b", r"\bcomponent\b", r"\banalyte\b", r"\blab\b", r"\bname\b", r"\bitem\b", r"\bservice\b", r"\bbenefit\b", r"\bdescription\b", r"\bfield\b"],
    "value": [r"\bresult\b", r"\bvalue\b", r"\breading\b", r"\bobserved\b", r"\bmeasurement\b", r"\bcoverage\b", r"\bcovered\b", r"\bamount\b", r"\bdetails?\b"],
    "unit": [r"\bunit\b"], "reference": [r"\breference\b", r"\bref\b", r"\brange\b", r"\bnormal\b"], "flag": [r"\bflag\b", r"\babnormal\b", r"\bstatus\b"], "class": [r"\bclass\b", r"\bgrade\b", r"\bseverity\b"],
    "interpretation": [r"\binterpretation\b", r"\binterpret\b", r"\bcategory\b", r"\bcomment\b"], "copay": [r"\bcopay\b", r"\bco pay\b"], "coinsurance": [r"\bcoinsurance\b", r"\bco insurance\b"], "limit": [r"\blimit\b", r"\bmax\b", r"\bmaximum\b"],
    "date": [r"\bdate\b", r"\bcollected\b", r"\bresulted\b", r"\bservice\b"],
}
VALUE_IS_NOT = HEADERS["reference"]


def cells(line: Column) -> Column:
    """Trimmed cells of a table row; an escaped bar stands for itself."""
    s = F.regexp_replace(F.regexp_replace(F.trim(line), r"^\|", ""), r"\|$", "")
    parts = F.split(F.regexp_replace(s, r"\\\|", "\x00"), r"\|", -1)
    return F.transform(parts, lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "\x00", "|"), r"\s+", " ")))


def is_separator(line: Column) -> Column:
    return F.forall(cells(line), lambda c: c.rlike(r"^[:\-\s]+$"))


def defragmented(c: Column) -> Column:
    """Words that a parser glued together over cells, parted again."""
    for p, to in (
        (r"(?<=[a-z])(?=[A-Z])", " "), (r"(?<=\d)(?=[A-Za-z])", " "), (r"(?<=[A-Za-z])(?=\d)", " "), (r"(?i)\b(mg|mcg|g|iu|units?)(?=(?:oral|orally|intranasal|nasal|daily|spray|bid|tid|qd|qhs))", "$1 "),
        (r"(?i)\b(intranasal|nasal)(?=spray)", "$1 "), (r"(?i)\b(each)(?=nostril)", "$1 "), (r"\s+", " "),
    ):
        c = F.regexp_replace(c, p, to)
    return F.trim(c)


def plausible(value: Column) -> Column:
    """A measurement, not a piece of a sentence or a date."""
    v = F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"\s+", " "))
    return (v != "") & (F.length(v) <= 80) & v.rlike(r"\d") & ~v.rlike(r"\):|\(:") & ~v.rlike(r"^\d{1,2}/\d{1,2}/\d{1,4}$") & v.rlike("(?i)" + MEASUREMENT)


def header_index(headers: Column, patterns: list[str], but: list[str] | None = None) -> Column:
    """Place (from 1) of the first header with one of the words, 0 if none."""
    plain = lambda h: F.trim(F.regexp_replace(F.lower(h), "[^a-z0-9]+", " "))
    fits = lambda h: plain(h).rlike("|".join(patterns)) & ((~plain(h).rlike("|".join(but))) if but else F.lit(True))
    return F.array_position(F.transform(headers, lambda h: F.coalesce(fits(h), F.lit(False))), True).cast("int")


def table_blocks(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """One row a table: ``keep``, table_no (from 0), headers, body (arrays of cells of one length)."""
    lines = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), r"\r?\n"), lambda s: F.trim(s))
    is_row = lambda s: s.rlike(r"^\|[^\n]*\|")
    # lines outside tables become breaks, so that a split finds the runs of table lines
    joined = F.array_join(F.transform(lines, lambda s: F.when(is_row(s), s).otherwise("\x01")), "\n")
    runs = F.filter(F.transform(F.split(joined, "\x01"), lambda s: F.filter(F.split(s, "\n"), lambda x: x != "")), lambda r: F.size(r) > 0)
    d = df.select(*keep, F.posexplode(runs).alias("run_no", "run"))
    d = d.withColumn("sep", F.array_position(F.transform("run", is_separator), True).cast("int")).filter("sep > 1 AND sep < size(run)")
    d = d.withColumn("headers", cells(F.element_at("run", F.col("sep") - 1))).withColumn("body", F.transform(F.slice("run", F.col("sep") + 1, F.size("run")), cells))
    width = F.greatest(F.size("headers"), F.array_max(F.transform("body", lambda r: F.size(r))))
    pad = lambda a: F.slice(F.concat(a, F.array_repeat(F.lit(""), width)), 1, width)
    return d.select(*keep, "run_no", pad(F.col("headers")).alias("headers"), F.transform("body", lambda r: pad(r)).alias("body"))


def row_facts(df: DataFrame, text: str, section: str, document: str, *keep: str, dates: list[str] | None = None) -> DataFrame:
    """Facts of tables of results and benefits: ``keep``, table_id, row_index, fact_type, one column
    for each of ``HEADERS``, row_date and content.

    ``dates``: columns of the chunk that stand in for a row without a date.
    """
    dates = dates or []
    b = table_blocks(df, text, *dict.fromkeys([*keep, section, document, *dates]))
    context = F.concat_ws(" ", F.array_join("headers", " "), F.coalesce(F.col(section), F.lit("")))
    labels = F.array_join(F.transform(F.slice("body", 1, 12), lambda r: F.element_at(r, 1)), " ")
    first = F.array_join(F.transform(F.slice("body", 1, 6), lambda r: F.array_join(r, " ")), " ")
    b = b.withColumn("_admin", F.concat_ws(" ", context, first).rlike("(?i)" + ADMIN_CONTEXT)).withColumn("_clinical", context.rlike("(?i)" + CLINICAL_CONTEXT) | labels.rlike("(?i)" + ROW_LABEL))
    b = b.filter("_admin OR _clinical")
    for name, words in HEADERS.items():
        b = b.withColumn(f"_{name}", header_index(F.col("headers"), words, VALUE_IS_NOT if name == "value" else None))
    wide = F.size("headers") >= 2
    b = b.withColumn("_label", F.when((F.col("_label") == 0) & wide, 1).otherwise(F.col("_label")))
    b = b.withColumn("_value", F.when((F.col("_value") == 0) & wide & ~F.col("_admin") & (F.col("_reference") != 2), 2).otherwise(F.col("_value")))
    d = b.select("*", F.posexplode("body").alias("row_index", "_row")).filter(F.trim(F.array_join("_row", " ")) != "")
    cell = lambda name: F.when(F.col(f"_{name}") > 0, F.element_at("_row", F.col(f"_{name}"))).otherwise("")
    fallback = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in dates], F.lit(""))
    raw = cell("date")
    date = F.when(raw != "", F.coalesce(iso_date(raw), raw)).otherwise(fallback)
    d = d.select(*keep, F.concat_ws(":", F.coalesce(F.col(document), F.lit("")), F.lit("table"), F.col("run_no").cast("string")).alias("table_id"), "row_index", "_admin", "_row", *[cell(n).alias(n) for n in HEADERS if n != "date"], date.alias("row_date"))
    name = F.when(F.col("label") != "", F.col("label")).otherwise(F.substring(F.array_join(F.filter("_row", lambda c: c != ""), " "), 1, 80))
    cover = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("value", "copay", "coinsurance", "limit")], F.lit(""))
    lab = ~F.col("_admin") & (F.col("label") != "") & plausible(F.col("value")) & (F.col("label").rlike("(?i)" + ROW_LABEL) | (F.concat("unit", "reference", "flag") != ""))
    d = d.filter(lab | (F.col("_admin") & (name != "") & (cover != "")))
    content = F.when(
        F.col("_admin"), F.format_string("ADMINISTRATIVE_BENEFIT | Benefit: %s | Coverage: %s | Copay: %s | Coinsurance: %s | Limit: %s | Date: %s", name, cover, "copay", "coinsurance", "limit", "row_date")
    ).otherwise(F.format_string("LAB_OR_VITAL_RESULT | Test: %s | Value: %s | Unit: %s | Reference range: %s | Flag: %s | Document class: %s | Interpretation: %s | Date: %s", "label", "value", "unit", "reference", "flag", "class", "interpretation", "row_date"))
    kind = F.when(F.col("_admin"), "administrative_benefit").otherwise("lab_or_vital_result")
    return d.select(*keep, "table_id", "row_index", kind.alias("fact_type"), name.alias("label"), F.when(F.col("_admin"), cover).otherwise(F.col("value")).alias("value"), "unit", "reference", "flag", "row_date", content.alias("content"))


def fact_score(query: Column, fact_type: Column, content: Column) -> Column:
    """How well a fact answers a query: shared words, numbers, and the kind of fact the query asks for."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+(?:[.][0-9]+)?"), 0))
    q = F.lower(F.coalesce(query, F.lit("")))
    shared = F.size(F.array_intersect(words(query), words(content)))
    numbers = F.size(F.filter(F.array_intersect(words(query), words(content)), lambda w: w.rlike("[0-9]")))
    admin = q.rlike("benefit|coverage|copay|deductible|policy|insurance|limit")
    change = q.rlike("start|stop|chang|increas|decreas|discontinu")
    return (
        shared + 2 * (numbers > 0).cast("int") + 3 * (admin & (fact_type == "administrative_benefit")).cast("int") + (fact_type.isin("administrative_benefit", "lab_or_vital_result")).cast("int")
        + 5 * (change & (fact_type == "medication_change")).cast("int") - 2 * (change & (fact_type == "measurement")).cast("int")
    )
