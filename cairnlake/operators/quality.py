"""Quality gate, audit, keep-first de-duplication and incremental loads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlake.functions.text import content_hash

MIN_CHARS, MIN_ALPHA, MAX_CONTROL, MIN_DENSITY, MAX_RUN = 100, 0.30, 0.05, 20, 20


def gate_reason(text: Column, pages: Column | None = None) -> Column:
    """Code of the first failed check, or ``ok``."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    n = F.length(t)
    letters = F.length(F.regexp_replace(t, r"[^A-Za-z]", ""))
    control = F.length(F.regexp_replace(t, "[^\x00-\x08\x0b\x0c\x0e-\x1f]", ""))
    reason = F.when(n == 0, "empty_text").when(n < MIN_CHARS, "too_short").when(letters / n < MIN_ALPHA, "low_alpha_ratio").when(control / n > MAX_CONTROL, "high_control_chars")
    if pages is not None:
        reason = reason.when((pages > 0) & (n / pages < MIN_DENSITY), "low_density")
    return reason.when(t.rlike(r"([^_\-=*.|~ \t])\1{%d}" % (MAX_RUN - 1)), "excessive_repetition").otherwise("ok")


def keep_first(df: DataFrame, key: Column, order: str) -> DataFrame:
    """(order, copies): the first row of every key and the number of its rows.

    An aggregate, so copies are combined before the shuffle and a hot key
    costs one row a task.
    """
    return df.groupBy(key.alias("key")).agg(F.min(order).alias(order), F.count(F.lit(1)).alias("copies")).select(order, "copies")


def new_only(incoming: DataFrame, stored: DataFrame, text: str) -> DataFrame:
    """Rows whose content is not stored yet."""
    have = stored.select(content_hash(F.col(text)).alias("_hash")).distinct()
    return incoming.withColumn("_hash", content_hash(F.col(text))).join(have, "_hash", "left_anti").drop("_hash")


def upsert_action(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """new, duplicate or replace for (document_id, hash, owner) rows against stored ones."""
    same_id = stored.select("document_id", F.col("hash").alias("_h"))
    by_hash = stored.filter("owner <> ''").groupBy("hash", "owner").agg(F.min("document_id").alias("_other"))
    d = incoming.join(same_id, "document_id", "left").join(by_hash, ["hash", "owner"], "left")
    action = F.when(F.col("_h") == F.col("hash"), "duplicate").when(F.col("_h").isNotNull(), "replace").when(F.col("_other").isNotNull(), "duplicate").otherwise("new")
    return d.select("document_id", action.alias("action"), F.when((action == "duplicate") & F.col("_h").isNull(), F.col("_other")).alias("duplicate_of"))


def audit_flags(text: Column, title: Column) -> Column:
    """Defects of a chunk."""
    t = F.coalesce(text, F.lit(""))
    return F.array_compact(
        F.array(
            F.when(F.length(t) < 50, "tiny"),
            F.when(F.length(t) > 3000, "oversize"),
            F.when(F.coalesce(title, F.lit("")) == "", "no_title"),
            F.when(t.rlike(r"^[a-z]"), "starts_inside"),
            F.when(t.rlike(r"[A-Za-z,]\z"), "ends_inside"),
            F.when(t.rlike(r"(?m)^\|[^|\n]*$"), "broken_row"),
            F.when(F.length(F.regexp_replace(t, "[^�]", "")) > 0, "bad_characters"),
        )
    )
