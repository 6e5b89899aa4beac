"""Scopes, cohorts, identities, merged extractions, prices, sessions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnlake.session import bounded, broadcast_if_small


@dataclass(frozen=True)
class Scope:
    """A conjunction of bounds that a request can only narrow."""

    patient_mrn: str | None = None
    tenant_id: str | None = None
    document_ids: tuple[str, ...] = ()

    def predicate(self) -> Column:
        terms = [F.col(c) == v for c, v in (("patient_mrn", self.patient_mrn), ("tenant_id", self.tenant_id)) if v]
        if self.document_ids:
            terms.append(F.col("document_id").isin(*self.document_ids))
        return reduce(lambda a, b: a & b, terms, F.lit(True))

    def narrow(self, other: "Scope") -> "Scope":
        """The intersection; where the documents asked for lie outside, the own ones stay."""
        inside = tuple(d for d in other.document_ids if d in self.document_ids) if self.document_ids else other.document_ids
        return Scope(self.patient_mrn or other.patient_mrn, self.tenant_id or other.tenant_id, inside or self.document_ids)


def best_reading(df: DataFrame, owner: str, value: str, at: str) -> DataFrame:
    """The largest value of each owner, the latest among equals."""
    return df.groupBy(owner).agg(F.max(F.struct(value, at)).alias("_b"), F.count(F.lit(1)).alias("n")).select(owner, F.col(f"_b.{value}").alias(value), F.col(f"_b.{at}").alias(at), "n")


def ownership_problem(d: DataFrame) -> DataFrame:
    """First problem of each requested document: (document_id, patient_mrn asked for) joined with its registry row."""
    problem = (
        F.when(F.col("status").isNull(), "not_found")
        .when((F.col("status") == "duplicate") & (F.col("duplicate_of") != F.col("document_id")), "duplicate")
        .when(~F.col("status").isin("ready", "duplicate"), "not_ready")
        .when(F.col("owner_mrn") != F.col("asked_mrn"), "belongs_to_other")
        .otherwise("ok")
    )
    return d.withColumn("verdict", problem)


def longest_prefix(df: DataFrame, prices: DataFrame, name: str, prefix: str, families: list[tuple[str, str]] | None = None) -> DataFrame:
    """Each row with the price whose name is the longest prefix of its own, else with that of the
    first of ``families`` (word in the name, name of the price); without either its columns are null.

    Every prefix of a name is a key of an equi-join, so no pair of row and
    price is compared that does not match.
    """
    # one join row a distinct name, not a row of the facts
    names = df.select(name).distinct()
    low = F.lower(F.col(name))
    cut = names.select(name, F.explode(F.transform(F.sequence(F.lit(1), F.length(name)), lambda n: F.substring(low, F.lit(1), n))).alias("_p"))
    family = F.coalesce(*[F.when(F.contains(low, F.lit(w)), F.lit(p)) for w, p in families or []], F.lit(None).cast("string"))
    wanted = cut.select(name, "_p", F.length("_p").alias("_n")).unionByName(names.select(name, F.lower(family).alias("_p"), F.lit(0).alias("_n")))
    hits = wanted.join(broadcast_if_small(prices), F.col("_p") == F.lower(prices[prefix]))
    best = hits.groupBy(name).agg(F.max_by(F.struct(*[F.col(c) for c in prices.columns]), F.col("_n")).alias("_best")).select(name, "_best.*")
    return df.join(best, name, "left")


def cost(tokens_in: Column, cached: Column, tokens_out: Column, rate_in: Column, rate_cached: Column, rate_out: Column) -> Column:
    c = F.greatest(F.lit(0), F.least(F.coalesce(cached, F.lit(0)), F.coalesce(tokens_in, F.lit(0))))
    return F.round(((F.coalesce(tokens_in, F.lit(0)) - c) * rate_in + c * F.coalesce(rate_cached, rate_in) + F.coalesce(tokens_out, F.lit(0)) * rate_out) / 1_000_000, 8)


def turn_pairs(df: DataFrame, session: str, turn: str, role: str, text: str) -> DataFrame:
    """Each question with the reply that follows it."""
    w = Window.partitionBy(session).orderBy(turn)
    d = df.select(session, turn, role, text, F.lead(role).over(w).alias("_next"), F.lead(text).over(w).alias("reply"))
    return d.filter(f"{role} = 'user' AND _next = 'assistant'").select(session, turn, F.col(text).alias("question"), "reply")


def name_key(c: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def identity_score(query: Column, mrn: Column, name: Column) -> Column:
    """How well a query names a patient: record number, whole name, parts of the name."""
    q, n = name_key(query), name_key(name)
    words = F.filter(F.split(n, " "), lambda w: F.length(w) > 1)
    hit = F.size(F.filter(words, lambda w: F.array_contains(F.split(q, " "), w))) / F.greatest(F.size(words), F.lit(1))
    return (
        F.when(F.contains(F.regexp_replace(F.lower(query), "[^a-z0-9]", ""), F.regexp_replace(F.lower(mrn), "[^a-z0-9]", "")), 100.0)
        .when((n != "") & F.contains(q, n), 100.0)
        .when(hit > 0, 60.0 + 35.0 * hit)
        .otherwise(0.0)
    )


def identity_matches(requests: DataFrame, request_id: str, text: str, patients: DataFrame, mrn: str, name: str, least: float = 70.0) -> DataFrame:
    """Patients of ``identity_score`` at ``least`` (over 60) or more for every request. Pairs meet by the last characters
    of the record number, the first ones of the name or a word of it, so each that can score is compared and no other.
    Requests move only with what patients have too, and a pair is taken where the first of these meets, so no pair moves."""

    def squeezed(c: Column) -> Column:
        return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")

    def pieces(c: Column, n: int) -> Column:
        return F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substring(c, i, n))).otherwise(F.array().cast("array<string>"))

    def tagged(tag: str, a: Column) -> Column:
        return F.transform(a, lambda x: F.concat(F.lit(tag), x))

    p = patients.select(F.when(squeezed(F.col(mrn)) != "", F.col(mrn)).alias("_m"), F.col(mrn), F.col(name), squeezed(F.col(mrn)).alias("_s"), name_key(F.col(name)).alias("_n")).distinct()
    tail, head = F.substring("_s", -6, 6), F.substring("_n", 1, 4)
    sizes = p.select(F.collect_set(F.length(tail)).alias("t"), F.collect_set(F.length(head)).alias("h")).first()
    named = lambda tag, c: F.when(c != "", F.array(F.struct(F.concat(F.lit(tag), c).alias("k"), F.array().cast("array<string>").alias("before")))).otherwise(F.array().cast("array<struct<k:string,before:array<string>>>"))
    words = F.array_distinct(F.filter(F.split("_n", " "), lambda x: x != ""))
    keys = F.concat(named("m", tail), named("n", head), F.transform(words, lambda x, i: F.struct(F.concat(F.lit("w"), x).alias("k"), F.slice(words, F.lit(1), i).alias("before"))))
    p = p.select("_m", mrn, name, tail.alias("_tail"), head.alias("_head"), F.explode(keys).alias("_e")).select("_m", mrn, name, "_tail", "_head", F.col("_e.k").alias("_k"), F.col("_e.before").alias("_before"))
    s, q = squeezed(F.col(text)), name_key(F.col(text))
    parts = [tagged("m", pieces(s, n)) for n in sizes.t if n] + [tagged("n", pieces(q, n)) for n in sizes.h if n] + [tagged("w", F.split(q, " "))]
    r = requests.select(request_id, text, F.explode(F.array_distinct(F.concat(*parts))).alias("_k"))
    shared = bounded(r.select("_k").distinct().join(p.select("_k").distinct(), "_k"), 100_000)
    met = r.join(shared, "_k").join(p, "_k")
    by_number, by_start = (F.col("_tail") != "") & F.contains(s, F.col("_tail")), (F.col("_head") != "") & F.contains(q, F.col("_head"))
    kind = F.substring("_k", 1, 1)
    first = (kind == "m") | ~by_number & ((kind == "n") | ~by_start & ~F.arrays_overlap("_before", F.split(q, " ")))
    pairs = met.filter(first)
    return pairs.withColumn("score", identity_score(F.col(text), F.col("_m"), F.col(name))).filter(F.col("score") >= least).select(request_id, mrn, name, "score")


def merged_lists(df: DataFrame, document: str, keys: list[str], order: str) -> DataFrame:
    """Items of several extractions as one list: the first of each composite key, blank keys dropped."""
    key = F.concat_ws("\x1f", *[name_key(F.col(k)) for k in keys])
    d = df.withColumn("_k", key).filter(F.regexp_replace("_k", "[\x1f ]", "") != "")
    return d.groupBy(document, "_k").agg(F.min_by(F.struct(*[F.col(c) for c in df.columns if c != document]), F.col(order)).alias("_i")).select(document, "_i.*")
