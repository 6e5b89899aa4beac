"""Text scalars as Column builders; all of them stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalised(c: Column) -> Column:
    """Lower case, white space collapsed, ends trimmed; null stays null."""
    return F.trim(F.regexp_replace(F.lower(c), r"[ \t\r\n\f]+", " "))


def content_hash(c: Column) -> Column:
    """SHA-256 of the normalised text."""
    return F.sha2(F.coalesce(normalised(c), F.lit("")), 256)


def lexical_tokens(c: Column) -> Column:
    """Lower-case ASCII words and numbers; commas of thousands are dropped."""
    t = F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\x00-\x7F]", " "))
    for _ in range(2):
        t = F.regexp_replace(t, r"([0-9]),([0-9]{3})", "$1$2")
    return F.regexp_extract_all(t, F.lit(r"([a-z0-9]+(?:\.[0-9]+)?)"), 1)


def sentences(c: Column) -> Column:
    """Pieces behind a full stop, question or exclamation mark, or between lines."""
    return F.filter(F.split(c, r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s) != "")


def without_prefix(c: Column) -> Column:
    """The text without a leading ``[...]`` line."""
    return F.regexp_replace(c, r"^\[[^\]\n]*\]\n", "")


def version_of(document_id: Column) -> Column:
    """The ``vN`` at the end of an id, else ``v1``."""
    v = F.regexp_extract(document_id, r"v([0-9]+)$", 1)
    return F.when(v == "", F.lit("v1")).otherwise(F.concat(F.lit("v"), v))


def citations(c: Column) -> Column:
    """Distinct source numbers of ``[S3]``, ascending."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\[S([0-9]+)\]"), 1), lambda x: x.cast("int"))))


def first_match(c: Column, patterns: list[tuple[str, int]], least: int = 1) -> Column:
    """Group of the first pattern that matches with at least ``least`` characters."""
    out = F.lit(None).cast("string")
    for p, g in reversed(patterns):
        m = F.regexp_extract(F.coalesce(c, F.lit("")), p, g)
        out = F.when(F.length(m) >= least, m).otherwise(out)
    return out


def labelled(c: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """Label of the first rule whose pattern is found (case ignored)."""
    out = F.lit(default)
    for label, p in reversed(rules):
        out = F.when(F.coalesce(c, F.lit("")).rlike("(?i)" + p), F.lit(label)).otherwise(out)
    return out
