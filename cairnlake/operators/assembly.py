"""Documents put together from their parts: offsets, positions, order, overlaps, patients, usage.

Windows run within one document, session or patient by a total order; what is
asked of a whole group is an aggregate with map-side combination.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters between two pages of a document.
PAGE_GAP = 2
#: Overlaps of consecutive chunks are looked for between these lengths.
LEAST_OVERLAP, MOST_OVERLAP = 31, 250


def page_offsets(pages: DataFrame, document: str, order: list[str], text: str) -> DataFrame:
    """``pages`` with ``start_pos``: where each page begins in the text of its document."""
    w = Window.partitionBy(document).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return pages.withColumn("start_pos", F.coalesce(F.sum(F.coalesce(F.length(text), F.lit(0)) + PAGE_GAP).over(w), F.lit(0)).cast("long"))


def page_at(positions: DataFrame, pages: DataFrame, document: str, pos: str, page: str) -> DataFrame:
    """``positions`` (document, pos) with the page on which each stands: the last one that begins
    at or before it. Both sides go through one window, so no position is compared with every page."""
    both = positions.select(document, F.col(pos).alias("_p"), F.lit(None).cast(pages.schema[page].dataType).alias("_page")).unionByName(pages.select(document, F.col("start_pos").alias("_p"), F.col(page).alias("_page")))
    w = Window.partitionBy(document).orderBy(F.col("_p"), F.col("_page").isNull(), "_page").rowsBetween(Window.unboundedPreceding, 0)
    d = both.withColumn(page, F.last("_page", ignorenulls=True).over(w)).filter("_page IS NULL")
    return d.select(document, F.col("_p").alias(pos), page)


def positions(chunks: DataFrame, document: str, order: list[str]) -> DataFrame:
    """``chunks`` with their place in the document: ``chunk_no`` from 0, ``position`` from 0.0 to 1.0."""
    w = Window.partitionBy(document).orderBy(*order)
    n = F.count(F.lit(1)).over(Window.partitionBy(document))
    d = chunks.withColumn("chunk_no", F.row_number().over(w) - 1)
    return d.withColumn("position", F.round(F.col("chunk_no") / F.greatest(n - 1, F.lit(1)), 4))


def shared_edge(before: Column, after: Column) -> Column:
    """Characters at the start of ``after`` that end ``before``: the longest run of
    ``LEAST_OVERLAP`` to ``MOST_OVERLAP``, else 0."""
    most = F.least(F.length(before), F.length(after), F.lit(MOST_OVERLAP))
    sizes = F.when(most >= LEAST_OVERLAP, F.reverse(F.sequence(F.lit(LEAST_OVERLAP), most)))
    fits = F.filter(sizes, lambda n: F.right(before, n) == F.left(after, n))
    return F.coalesce(F.try_element_at(fits, F.lit(1)), F.lit(0))


def without_overlap(chunks: DataFrame, source: str, order: list[str], text: str) -> DataFrame:
    """``chunks`` with ``text`` cut where it only repeats the end of the chunk before it in its source."""
    w = Window.partitionBy(source).orderBy(*order)
    d = chunks.withColumn("_before", F.lag(text).over(w))
    return d.withColumn(text, F.when(F.col("_before").isNull(), F.col(text)).otherwise(F.substring(F.col(text), shared_edge(F.col("_before"), F.col(text)) + 1, F.length(text)))).drop("_before")


def merged_text(chunks: DataFrame, by: str, source: str, order: list[str], text: str, gap: str = "\n\n") -> DataFrame:
    """(by, chunks, merged): all chunks of a patient or document as one text, without what overlaps."""
    d = without_overlap(chunks.filter(F.col(text).isNotNull()), source, order, text)
    keys = [c for c in dict.fromkeys([source, *order])]
    parts = F.array_sort(F.collect_list(F.struct(*keys, F.col(text).alias("_t"))))
    return d.groupBy(by).agg(F.count(F.lit(1)).alias("chunks"), F.array_join(F.filter(F.transform(parts, lambda x: x["_t"]), lambda t: F.trim(t) != ""), gap).alias("merged"))


def first_date(*columns: str) -> Column:
    """The first of several dates that is neither null nor empty, as text."""
    return F.coalesce(*[F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in columns], F.lit(""))


def chronological(df: DataFrame, by: str, dates: list[str], *ties: str) -> DataFrame:
    """``df`` with ``sort_date`` and its ``rank`` from the latest, by text order of the dates."""
    d = df.withColumn("sort_date", first_date(*dates))
    return d.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("sort_date"), *ties)))


def patients(pages: DataFrame, mrn: str, name: str, source: str, order: str) -> DataFrame:
    """One row a patient: the first name and source seen with a record number, or a name that never has one."""
    named = pages.withColumn("_n", F.nullif(F.trim(F.col(name)), F.lit("")))
    first = lambda c: F.min_by(c, F.struct(F.col(c).isNull(), order))
    known = named.filter(F.col(mrn).isNotNull()).groupBy(mrn).agg(first("_n").alias(name), first(source).alias(source), F.count(F.lit(1)).alias("pages"))
    loose = named.filter(F.col(mrn).isNull() & F.col("_n").isNotNull()).groupBy("_n").agg(first(source).alias(source), F.count(F.lit(1)).alias("pages"))
    loose = loose.join(named.filter(F.col(mrn).isNotNull()).select("_n").distinct(), "_n", "left_anti")
    return known.unionByName(loose.select(F.lit(None).cast(pages.schema[mrn].dataType).alias(mrn), F.col("_n").alias(name), source, "pages"))


# ---- usage --------------------------------------------------------------------------------------


def usage_totals(usage: DataFrame, by: str, order: str) -> DataFrame:
    """Tokens, cost and models, in the order they were first used."""
    models = usage.filter("model IS NOT NULL").groupBy(by, "model").agg(F.min(order).alias("_o"))
    models = models.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", "model"))), lambda x: x["model"]), ",").alias("models"))
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    sums = usage.groupBy(by).agg(n("input_tokens"), n("output_tokens"), n("total_tokens"), F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 8).alias("cost"), F.count(F.lit(1)).alias("requests"))
    return sums.join(models, by, "left")


def running_ledger(usage: DataFrame, by: str, order: str) -> DataFrame:
    """Each record with what its session has used up to it."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return usage.select(by, order, F.count(F.lit(1)).over(w).alias("requests"), F.coalesce(F.sum("total_tokens").over(w), F.lit(0)).alias("total_tokens"), F.round(F.coalesce(F.sum("cost_usd").over(w), F.lit(0.0)), 8).alias("cost"))


def totals_of(asked: DataFrame, ledger: DataFrame, by: str) -> DataFrame:
    """The ledger's row of every session asked for; zeros for one it does not know."""
    d = asked.select(by).distinct().join(ledger, by, "left")
    return d.na.fill(0).na.fill("")


def provider(model: Column) -> Column:
    m = F.lower(F.coalesce(model, F.lit("")))
    return F.when(F.contains(m, F.lit("gemini")), "google").when(m.rlike("gpt|o1|o3|o4"), "openai").otherwise("unknown")


def token_counts(reply: Column) -> Column:
    """(input, output, cached, total) of a reply's JSON, whatever names and nesting it uses."""
    first = lambda *paths: F.coalesce(*[F.get_json_object(reply, p).try_cast("long") for p in paths], F.lit(0))
    spots = [f"$.{a}{b}" for a in ("usage_metadata.", "response_metadata.token_usage.", "response_metadata.usage_metadata.", "token_usage.", "usage.", "") for b in ("{}",)]
    at = lambda *names: first(*[s.format(n) for s in spots for n in names])
    tin, tout = at("prompt_tokens", "input_tokens", "prompt_token_count"), at("completion_tokens", "output_tokens", "candidates_token_count")
    cached = at("cached_input_tokens", "cached_content_token_count", "cache_read_input_tokens", "prompt_tokens_details.cached_tokens", "input_token_details.cache_read", "input_tokens_details.cached_tokens")
    total = at("total_tokens", "total_token_count")
    return F.struct(tin.alias("input"), tout.alias("output"), F.least(cached, tin).alias("cached"), F.when(total > 0, total).otherwise(tin + tout).alias("total"))


# ---- grounding ----------------------------------------------------------------------------------

# Numbers of a reply that its sources must state.
STATED = [
    r"\b\d+(?:\.\d+)?\s*(?:mg|mcg|µg|mEq|mL|g|units?|IU)\b", r"\b\d+(?:\.\d+)?\s*(?:mg/dL|mmol/L|mEq/L|g/dL|pg/mL|ng/mL|IU/L|U/L)\b", r"\bBP\s+\d{2,3}/\d{2,3}\b|\b\d{2,3}/\d{2,3}\s*mmHg\b",
    r"\bHR\s+\d+\b|\bpulse\s+(?:of\s+)?\d+\b|\bheart\s+rate\s+(?:of\s+|was\s+)?\d+\b", r"\bSpO2\s+(?:of\s+)?\d+\b|\bO2\s+sat(?:uration)?\s+(?:of\s+)?\d+\b", r"\btemperature\s+(?:of\s+)?\d+(?:\.\d+)?\s*(?:°[CF]|degrees?)\b",
    r"\bweight\s+(?:of\s+)?\d+(?:\.\d+)?\s*(?:kg|lbs?|pounds?)\b", r"\bHbA1c\s+(?:of\s+)?\d+(?:\.\d+)?%?\b|\bA1c\s+(?:of\s+)?\d+(?:\.\d+)?%?\b", r"\b(?:BNP|NT-proBNP|troponin|creatinine|eGFR|LVEF)\s+(?:of\s+|was\s+|is\s+)?\d+(?:\.\d+)?\b",
]


def squeezed(c: Column) -> Column:
    """Lower case without white space, as numbers are compared."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", "")


def unsupported_numbers(reply: Column, source: Column) -> Column:
    """Numbers with a meaning in ``reply`` that ``source`` states nowhere, the first of each number."""
    every = F.flatten(F.array(*[F.regexp_extract_all(F.coalesce(reply, F.lit("")), F.lit("(?i)" + p), 0) for p in STATED]))
    number = lambda v: F.regexp_extract(v, r"\d+(?:\.\d+)?", 0)
    numbers = F.transform(every, number)
    once = F.filter(F.transform(every, lambda v, i: F.struct(v.alias("v"), (F.array_position(numbers, number(v)) == i + 1).alias("first"))), lambda x: x["first"])
    missing = F.filter(F.transform(once, lambda x: F.trim(x["v"])), lambda v: ~F.contains(squeezed(source), squeezed(v)) & ~F.contains(F.lower(F.coalesce(source, F.lit(""))), F.lower(v)))
    return F.when(F.coalesce(source, F.lit("")) != "", missing).otherwise(F.array().cast("array<string>"))


# ---- values -------------------------------------------------------------------------------------


def json_object(text: Column) -> Column:
    """The JSON object in a text, within fences or behind words; ``{}`` if there is none."""
    t = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"(?i)^```(?:json)?\s*", ""), r"\s*```$", "")
    t = F.when(F.substring(t, 1, 1) == "{", t).otherwise(F.regexp_extract(t, r"\{[\s\S]*\}", 0))
    return F.when(F.get_json_object(t, "$").rlike(r"^\s*\{"), F.get_json_object(t, "$")).otherwise("{}")


def id_list(value: Column) -> Column:
    """Ids of a text that is a JSON list, a list between commas or one id; trimmed, each once, none empty."""
    v = F.trim(F.coalesce(value, F.lit("")))
    parsed = F.when(v.startswith("["), F.coalesce(F.from_json(v, "array<string>"), F.array(v))).otherwise(F.split(v, ","))
    return F.array_distinct(F.filter(F.transform(parsed, lambda x: F.trim(x)), lambda x: x != ""))


def token_pieces(text: Column) -> Column:
    """White space and words in turn: joined they are the text again."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\s+|\S+"), 0)


def message_text(content: Column) -> Column:
    """The text of a message that may be a JSON list of parts; parts that only think are left out."""
    parts = F.from_json(content, "array<struct<type:string,text:string>>")
    spoken = F.filter(parts, lambda p: F.coalesce(p["type"], F.lit("text")) != "thinking")
    return F.when(content.rlike(r"^\s*\[\s*\{"), F.array_join(F.transform(spoken, lambda p: F.coalesce(p["text"], F.lit(""))), "")).otherwise(F.coalesce(content, F.lit("")))


def sentence_candidates(text: Column) -> Column:
    """Sentences of a text, each once whatever its case, in order."""
    s = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+|\n+"), lambda x: F.trim(x)), lambda x: x != "")
    low = F.transform(s, lambda x: F.lower(x))
    return F.transform(F.filter(F.transform(s, lambda x, i: F.struct(x.alias("x"), (F.array_position(low, F.lower(x)) == i + 1).alias("first"))), lambda y: y["first"]), lambda y: y["x"])


def coalesced(rows: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, rows)
