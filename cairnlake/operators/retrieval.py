"""Hybrid search: dense and lexical lists of many queries to ranked evidence with confidence.

Every stage is a DataFrame of (query_id, id, score, rank), so that any number
of queries runs in one plan, and a stage can be left out or replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnlake.functions.text import lexical_tokens
from cairnlake.operators.assembly import first_date
from cairnlake.operators.fusion import confidence
from cairnlake.operators.lexical import bm25_set
from cairnlake.operators.vectors import top_k_set

#: Rank constants of the fusion of lists, and of facts with what was fused.
FUSE, FUSE_FACTS = 60, 20
#: A list of fewer dense hits is supplemented by a lexical one.
FEW_DENSE = 3
LEAST_RERANKED, EVIDENCE_CHARS = 0.08, 900
#: Up to so many hits, and bytes of queries, are sent to where the texts are read; for more, texts are shuffled. No answer depends on it.
SENT_HITS, SENT_BYTES = 500_000, 32 << 20
RARE = r"(?i)\b(?:troponin|bnp|nt-probnp|ferritin|procalcitonin|d-dimer|lactate|ammonia|lipase|a1c|hba1c|egfr|inr|tsh)\b|\d+(?:\.\d+)?\s*(?:mg/dl|mmol/l|pg/ml|ng/ml|iu/l|u/l|meq/l|g/dl|%|mg|mcg)"


def fused(lists: list[DataFrame], query_id: str, id_col: str, k: int, constant: int = FUSE, kept: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, id, score, rank): ranks of several lists added as 1 / (constant + rank + 1).
    ``kept``: columns of which a hit carries the largest value of its lists."""
    every = reduce(DataFrame.unionByName, [d.select(query_id, id_col, (1.0 / (F.col("rank") + constant + 1)).alias("s"), *kept) for d in lists])
    d = every.groupBy(query_id, id_col).agg(F.sum("s").alias("score"), F.count(F.lit(1)).alias("lists"), *[F.max(c).alias(c) for c in kept])
    w = Window.partitionBy(query_id).orderBy(F.desc(F.round("score", 12)), id_col)
    return d.withColumn("rank", F.row_number().over(w) - 1).filter(F.col("rank") < k)


def wants_supplement(query: Column, dense_hits: Column) -> Column:
    """Whether a lexical list over the whole scope is asked for: few dense hits, a rare test, a number with its unit."""
    return (F.coalesce(dense_hits, F.lit(0)) < FEW_DENSE) | F.coalesce(query, F.lit("")).rlike(RARE)


def reranked(hits: DataFrame, query_id: str, score: str, k: int, *ties: str) -> DataFrame:
    """Hits of a reranker's score: those above ``LEAST_RERANKED``, the best ``k``; where all fall below, as they were."""
    d = hits.withColumn("_sound", F.max(score).over(Window.partitionBy(query_id)) >= LEAST_RERANKED)
    w = Window.partitionBy(query_id).orderBy(F.desc(F.when(F.col("_sound"), F.col(score))), "rank", *ties)
    d = d.filter(~F.col("_sound") | (F.col(score) >= LEAST_RERANKED)).withColumn("rank", F.row_number().over(w) - 1)
    return d.filter(F.col("rank") < k).withColumn("rejected", ~F.col("_sound")).drop("_sound")


def boosted(hits: DataFrame, query_id: str, hint: Column) -> DataFrame:
    """Hits that a hint of the query fits before the others, each group in its order; none is dropped."""
    w = Window.partitionBy(query_id).orderBy(F.coalesce(hint, F.lit(False)).cast("int").desc(), "rank")
    return hits.withColumn("rank", F.row_number().over(w) - 1)


def with_missing(hits: DataFrame, wanted: DataFrame | None, lexical: DataFrame, query_id: str, document: str) -> DataFrame:
    """``hits`` and, for every document wanted without one, its best lexical hit behind them.
    Without ``wanted`` all documents of the lexical hits are; then each list is made once."""
    if wanted is not None:
        lexical = lexical.join(wanted.select(query_id, document).distinct(), [query_id, document], "left_semi")
    late = lexical.filter(F.col(document).isNotNull()).select(*hits.columns)
    both = hits.withColumn("_late", F.lit(False)).unionByName(late.withColumn("_late", F.lit(True)))
    w = Window.partitionBy(query_id, document).orderBy("_late", "rank")
    return both.withColumn("_k", F.row_number().over(w)).filter("NOT _late OR _k = 1").drop("_k", "_late")


def latest_first(hits: DataFrame, query_id: str, wanted: Column, dates: list[str]) -> DataFrame:
    """Hits of queries about time from the latest date, the others as they are."""
    d = hits.withColumn("_d", F.when(wanted, first_date(*dates)))
    w = Window.partitionBy(query_id).orderBy(F.desc_nulls_last("_d"), "rank")
    return d.withColumn("rank", F.row_number().over(w) - 1).drop("_d")


def evidence_span(query: Column, text: Column, size: int = EVIDENCE_CHARS) -> Column:
    """The stretch of ``size`` characters, by steps of a quarter, with most of the query's words; whole texts within it stay."""
    t = F.coalesce(text, F.lit(""))
    words = F.filter(F.array_distinct(lexical_tokens(query)), lambda w: F.length(w) > 2)
    step = size // 4
    starts = F.sequence(F.lit(0), F.greatest(F.ceil((F.length(t) - size) / step).cast("int"), F.lit(0)))
    score = lambda i: F.size(F.filter(words, lambda w: F.contains(F.lower(F.substring(t, i * step + 1, F.lit(size))), w)))
    best = F.array_max(F.transform(starts, lambda i: F.struct(score(i).alias("n"), (-i).alias("i"))))
    return F.when(F.length(t) <= size, t).otherwise(F.substring(t, -best["i"] * step + 1, F.lit(size)))


def with_texts(hits: DataFrame, queries: DataFrame, docs: DataFrame, query_id: str, query_text: str, id_col: str, k: int) -> DataFrame:
    """``hits``, of which a query has at most ``k``, with the columns of their query and of their text.
    Hits are few beside the texts: they go to the texts, and no text is shuffled to meet them."""
    asked = queries.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length(query_text)), F.lit(0)).alias("bytes")).first()
    if asked["rows"] * k > SENT_HITS:
        return hits.join(queries, query_id).join(docs, id_col)
    return docs.join(F.broadcast(hits), id_col).join(F.broadcast(queries) if asked["bytes"] <= SENT_BYTES else queries, query_id)


def source_header(rank: Column, *parts: Column) -> Column:
    """``[Source n: a | b]`` of the parts that are known."""
    return F.concat(F.lit("[Source "), (rank + 1).cast("string"), F.lit(": "), F.concat_ws(" | ", *[F.nullif(p, F.lit("")) for p in parts]), F.lit("]"))


def hybrid(docs: DataFrame, vectors: DataFrame, queries: DataFrame, query_id: str, query_text: str, query_vector: str, id_col: str, text: str, vector: str, fetch: int = 20, k: int = 10) -> DataFrame:
    """(query_id, id, score, rank, in_dense, in_lexical, confidence): dense and lexical lists of every query fused.

    ``confidence`` weighs the number of hits in both lists and the similarity of the best dense one.
    """
    dense = top_k_set(vectors, queries.select(query_id, F.col(query_vector).alias(vector)).filter(F.col(vector).isNotNull()), query_id, id_col, vector, fetch)
    lexical = bm25_set(docs, queries, query_id, query_text, id_col, text, fetch)
    # each list is made once: what is asked of it beside its ranks goes with them
    marked = lambda d, similarity, inside: d.select(query_id, id_col, "rank", similarity.alias("similarity"), F.lit(not inside).alias("in_dense"), F.lit(inside).alias("in_lexical"))
    out = fused([marked(dense, F.col("similarity"), False), marked(lexical, F.lit(None).cast("double"), True)], query_id, id_col, k, kept=("similarity", "in_dense", "in_lexical"))
    by = Window.partitionBy(query_id)
    top = F.coalesce(F.max("similarity").over(by), F.lit(0.0))
    return out.select(query_id, id_col, "score", "rank", "in_dense", "in_lexical", confidence(F.count(F.lit(1)).over(by), top).alias("confidence"))
