"""Pages of words with places and font sizes to marked-up text.

A page is one row: an array of words (text, x, top, size) and an array of table
boxes, as a parser gives them.  Words inside a table are left out, the others
are folded into lines, lines are told headings by font or form, and blocks are
put together by their height on the page.  All of it is built of array
functions, so a page never leaves its row.

Defined results: pages without words give empty text; sizes of 0 or below are
unknown; words that differ by at most ``LINE_GAP`` from the first of their line
belong to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINE_GAP, BOX_TOLERANCE, HEADING_FACTOR, LEAST_SIZE = 3.0, 2.0, 1.12, 4.0
LEAST_SUBSTANCE, LEAST_CHARS_A_PAGE, LEAST_READ, LEAST_ALPHA = 150, 50, 30, 0.25
# Lines of these forms are no headings.
NO_HEADING = [r"^[A-Z]\d+[\.\-]\d+", r"^\d+[A-Z0-9]{2,}[\-]", r"^\d{1,2}:\d{2}", r"\b\d{4,}\b", r"^[A-Z]{1,4}\d{4,}", r"\d+\.?\d*\s+\d+\.?\d*\s+\d+\.?\d*"]
UNITS = r"(?i)\b(?:mg|mL|mmHg|µ[Lg]|mcg|mEq|units?|%|mmol|µmol|ng|pg|IU|tablet|capsule|BID|TID|QID|PRN|qDay|kg|lbs?|cm|mm)\b"
NUMBERED = r"^(\d{1,2}(?:[a-d])?(?:\.\d{1,2})?)\.?\s+([A-Z][A-Za-z &/\-,()]{3,})$"
LINE = "array<struct<top:double,words:array<struct<x:double,text:string,size:double>>>>"


def in_box(word: Column, boxes: Column) -> Column:
    """Whether a word's place lies in one of the boxes (x0, top, x1, bottom)."""
    t = BOX_TOLERANCE
    return F.exists(boxes, lambda b: (word["x"] >= b["x0"] - t) & (word["x"] <= b["x1"] + t) & (word["top"] >= b["top"] - t) & (word["top"] <= b["bottom"] + t))


def lines_of(words: Column) -> Column:
    """Words by height and place, folded into lines that begin where a word is further down than ``LINE_GAP`` from the line's first."""
    ordered = F.array_sort(F.transform(words, lambda w: F.struct(w["top"].cast("double").alias("top"), w["x"].cast("double").alias("x"), w["text"].alias("text"), w["size"].cast("double").alias("size"))))

    def step(lines: Column, w: Column) -> Column:
        last = F.try_element_at(lines, F.lit(-1))
        word = F.struct(w["x"].alias("x"), w["text"].alias("text"), w["size"].alias("size"))
        begun = F.concat(lines, F.array(F.struct(w["top"].alias("top"), F.array(word).alias("words"))))
        longer = F.concat(F.slice(lines, 1, F.size(lines) - 1), F.array(F.struct(last["top"].alias("top"), F.concat(last["words"], F.array(word)).alias("words"))))
        return F.when(last.isNull() | (F.abs(w["top"] - last["top"]) > LINE_GAP), begun).otherwise(longer)

    folded = F.aggregate(ordered, F.array().cast(LINE), step)
    return F.transform(folded, lambda x: F.struct(x["top"].alias("top"), F.array_join(F.transform(F.array_sort(x["words"]), lambda w: w["text"]), " ").alias("text"), mean_size(x["words"]).alias("size")))


def mean_size(words: Column) -> Column:
    """Mean of the sizes above 0; 0 if there is none."""
    known = F.filter(F.transform(words, lambda w: w["size"]), lambda s: s > 0)
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, s: a + s) / F.size(known)).otherwise(0.0)


def body_size(words: Column) -> Column:
    """The size with most text, in tenths; 0 if none is known."""
    known = F.filter(F.transform(words, lambda w: F.struct(F.round(w["size"].cast("double"), 1).alias("size"), F.greatest(F.lit(1), F.floor(F.length(w["text"]) / 4).cast("int")).alias("n"))), lambda w: w["size"] > LEAST_SIZE)
    sizes = F.array_distinct(F.transform(known, lambda w: w["size"]))
    weigh = lambda s: F.aggregate(F.filter(known, lambda w: w["size"] == s), F.lit(0), lambda a, w: a + w["n"])
    return F.coalesce(F.array_max(F.transform(sizes, lambda s: F.struct(weigh(s).alias("n"), (-s).alias("order"), s.alias("size"))))["size"], F.lit(0.0))


def _real_words(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"\s+"), lambda w: w.rlike(r"^\p{L}{2,}$")))


def is_heading(text: Column, size: Column, body: Column) -> Column:
    """By font where sizes are known, else by number and title or by capitals; codes, times, values and sentences are none."""
    s = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    rejected = s.rlike("|".join(f"(?:{p})" for p in NO_HEADING)) | s.rlike(UNITS) | s.rlike(r"[.,;:]$") | (F.length(s) < 3)
    by_font = (size > 0) & (body > 0) & (size >= body * HEADING_FACTOR) & (F.length(s) < 100)
    numbered = s.rlike(NUMBERED) & (_real_words(F.regexp_extract(s, NUMBERED, 2)) >= 2)
    capitals = (F.upper(s) == s) & (F.lower(s) != s) & F.length(s).between(6, 79) & ~s.rlike(r"\d") & (_real_words(s) >= 2) & (_real_words(s) >= F.size(F.split(s, r"\s+")) * 0.85)
    return ~rejected & (by_font | numbered | capitals)


def sound_table(rows: Column) -> Column:
    """Whether rows found on a page are a table: two rows and columns, cells and header long enough."""
    cells = F.flatten(rows)
    short = F.size(F.filter(cells, lambda c: F.length(F.coalesce(c, F.lit(""))) <= 2)) / F.greatest(F.size(cells), F.lit(1))
    head = F.transform(rows[0], lambda c: F.length(F.trim(F.coalesce(c, F.lit("")))))
    mean = F.aggregate(head, F.lit(0), lambda a, n: a + n) / F.greatest(F.size(head), F.lit(1))
    return (F.size(rows) >= 2) & (F.size(head) >= 2) & (short <= 0.85) & (mean >= 4) & (F.size(F.filter(head, lambda n: n <= 2)) < 3)


def markdown_table(rows: Column) -> Column:
    """Rows as a pipe table: cells trimmed and escaped, short rows padded, empty ones left out."""
    clean = F.transform(rows, lambda r: F.transform(r, lambda c: F.replace(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")), F.lit("|"), F.lit("\\|"))))
    full = F.filter(clean, lambda r: F.array_join(r, "") != "")
    width = F.array_max(F.transform(full, lambda r: F.size(r)))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.slice(F.concat(r, F.array_repeat(F.lit(""), width)), 1, width), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    text = F.transform(full, line)
    return F.when(F.size(full) > 0, F.array_join(F.concat(F.slice(text, 1, 1), F.array(rule), F.slice(text, 2, F.size(text))), "\n")).otherwise("")


def assembled(blocks: Column) -> Column:
    """Blocks (top, text) by height, a blank line around headings."""
    text = F.transform(F.array_sort(blocks), lambda b: b["text"])
    spaced = F.transform(text, lambda t: F.when(t.startswith("##"), F.concat(F.lit("\x01"), t, F.lit("\x01"))).otherwise(t))
    t = F.array_join(spaced, "\n")
    t = F.regexp_replace(F.regexp_replace(t, "\n?\x01\n?\x01\n?", "\n\n"), "\x01\n|\n\x01", "\n\n")
    return F.regexp_replace(F.regexp_replace(t, "\x01", ""), r"^\n+|\n+$", "")


def clean(text: Column) -> Column:
    """No more than three line feeds in a row, no white space at the ends of lines or of the text."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"\n{4,}", "\n\n\n")
    return F.regexp_replace(F.regexp_replace(t, r"(?m)[ \t\r\f]+$", ""), r"^\s+|\s+$", "")


def page_markdown(pages: DataFrame, words: str = "words", boxes: str = "boxes", tables: str = "tables") -> DataFrame:
    """``pages`` with ``markdown``: text outside the boxes as lines and headings, tables (top, rows) where they stand."""
    free = F.filter(words, lambda w: ~in_box(w, F.col(boxes)))
    d = pages.withColumn("_body", body_size(F.col(words))).withColumn("_lines", lines_of(free))
    line = lambda x: F.struct(x["top"].alias("top"), F.when(is_heading(x["text"], x["size"], F.col("_body")), F.concat(F.lit("## "), F.trim(x["text"]))).otherwise(x["text"]).alias("text"))
    grid = lambda t: F.struct(t["top"].cast("double").alias("top"), markdown_table(t["rows"]).alias("text"))
    sound = F.filter(tables, lambda t: sound_table(t["rows"]))
    return d.withColumn("markdown", clean(assembled(F.concat(F.transform("_lines", line), F.transform(sound, grid))))).drop("_body", "_lines")


def has_substance(pages: Column) -> Column:
    """Whether the texts of a document have ``LEAST_SUBSTANCE`` characters together."""
    return F.aggregate(pages, F.lit(0), lambda n, p: n + F.length(F.trim(F.coalesce(p, F.lit(""))))) >= LEAST_SUBSTANCE


def needs_reading(pages: Column) -> Column:
    """Whether a document must be read as pictures: no pages, or too little text on them."""
    return (F.size(pages) == 0) | (F.aggregate(pages, F.lit(0), lambda n, p: n + F.length(F.trim(F.coalesce(p, F.lit(""))))) / F.greatest(F.size(pages), F.lit(1)) < LEAST_CHARS_A_PAGE)


def read_well(text: Column) -> Column:
    """Whether text read from a picture is long and wordy enough."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return (F.length(t) >= LEAST_READ) & (F.length(F.regexp_replace(t, r"\P{L}", "")) / F.greatest(F.length(t), F.lit(1)) >= LEAST_ALPHA)


def better_text(native: Column, read: Column) -> Column:
    """The text parsed, unless what was read from the picture is longer."""
    return F.when(F.length(F.coalesce(read, F.lit(""))) > F.length(F.coalesce(native, F.lit(""))), read).otherwise(native)
