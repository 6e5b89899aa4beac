"""Okapi scores and other lexical measures."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cairnlake.functions.text import lexical_tokens
from cairnlake.session import listed

K1, B, FLOOR = 1.5, 0.75, 0.25
#: Terms in more than this share of all texts are weighed by a dense product, the others by their few queries.
FREQUENT = 0.2
#: Scores of a block of texts; rows a task holds before it sorts them; slack that leaves the 9th place to the sort.
BLOCK_CELLS, SORTED_ROWS, EQUAL = 2_000_000, 600_000, 2e-9


def term_counts(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, length, term, tf)."""
    t = df.select(id_col, lexical_tokens(F.col(text)).alias("_tokens"))
    return t.select(id_col, F.size("_tokens").alias("length"), F.explode("_tokens").alias("term")).groupBy(id_col, "length", "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequencies(df: DataFrame, text: str) -> DataFrame:
    """(term, df): a text counts each of its terms once, before the shuffle combines the counts."""
    return df.select(F.explode(F.array_distinct(lexical_tokens(F.col(text)))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def _corpus(tokens: DataFrame, asked: list[str]) -> tuple[int, float, dict[str, int], dict[int, int]]:
    """Of a corpus of ``_t`` in one pass: texts, mean length, texts a term asked for, and how many terms of
    all are in so many texts."""
    each = tokens.select(F.size("_t").alias("n"), F.explode(F.concat(F.array_distinct("_t"), F.array(F.lit(None).cast("string")))).alias("term"))
    df = each.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("n"))
    named = listed(tokens.sparkSession, [(t,) for t in asked], "term string").withColumn("asked", F.lit(True))
    d = df.join(named, "term", "left").select(F.when(F.col("asked"), F.col("term")).alias("name"), F.col("term").isNull().alias("every"), "df", F.when(F.col("term").isNull(), F.col("n")).alias("n"))
    rows = d.groupBy("name", "every", "df", "n").agg(F.count(F.lit(1)).alias("terms")).collect()
    every = next((r for r in rows if r["every"]), None)
    sizes: dict[int, int] = {}
    for r in rows:
        if not r["every"]:
            sizes[r["df"]] = sizes.get(r["df"], 0) + r["terms"]
    return every["df"] if every else 0, every["n"] / every["df"] if every else 0.0, {r["name"]: r["df"] for r in rows if r["name"] is not None}, sizes


def _numbered(start: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Equal stretches of the columns get one number: that of each stretch, and the first stretch of each number."""
    known: dict[bytes, int] = {}
    first: list[int] = []
    out = np.empty(len(start) - 1, dtype=np.int64)
    for i, (a, b) in enumerate(zip(start[:-1], start[1:])):
        out[i] = n = known.setdefault(b"".join(c[a:b].tobytes() for c in columns), len(known))
        if n == len(first):
            first.append(i)
    return out, first


def _scorer(held, k: int, id_col: str, schema):
    """For ``mapInArrow``: the ``k`` best texts of a task for every number of a query, from (id, tokens)."""

    def best(parts: list[pd.DataFrame]) -> pd.DataFrame:
        d = pd.concat(parts)
        d["_r"] = np.round(d["score"].to_numpy(), 9)
        return d.sort_values(["_q", "_r", id_col], ascending=[True, False, True]).groupby("_q", sort=False).head(k)

    def run(batches):
        h = held.value
        vocabulary, frequent, start, q_of, weight, plain, sig = pa.array(h["terms"], pa.string()), h["frequent"], h["start"], h["q_of"], h["weight"], h["plain"], h["sig"]
        n_q, v = len(sig), len(h["terms"])
        size = max(1, BLOCK_CELLS // n_q)
        limit = np.zeros(n_q)  # scores up to it can't be among the best
        parts: list[pd.DataFrame] = []
        n = 0

        def packed(d: pd.DataFrame):
            return pa.RecordBatch.from_arrays([pa.array(d[c], type=schema.field(c).type) for c in schema.names], schema=schema)

        for b in batches:
            lists = b.column("_t")
            length = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            code = pc.fill_null(pc.index_in(lists.flatten(), value_set=vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(length)), length)
            key, tf = np.unique((row * v + code)[code >= 0], return_counts=True)
            row, code = np.divmod(key, v)
            w = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[row] / h["avg"]))
            ids = b.column(id_col).to_numpy(zero_copy_only=False)
            for at in range(0, len(ids), size):
                m = min(size, len(ids) - at)
                lo, hi = np.searchsorted(row, [at, at + m])
                r, t, x = row[lo:hi] - at, code[lo:hi], w[lo:hi]
                often = t < frequent
                dense = np.zeros((frequent, m))
                dense[t[often], r[often]] = x[often]
                s = (plain @ dense)[sig]
                r, t, x = r[~often], t[~often], x[~often]
                if len(t):
                    each = start[t + 1] - start[t]
                    place = np.arange(each.sum()) + np.repeat(start[t] - np.cumsum(each) + each, each)
                    s += np.bincount(q_of[place] * m + np.repeat(r, each), np.repeat(x, each) * weight[place], minlength=n_q * m).reshape(n_q, m)
                fits = s > limit[:, None]
                if m > k and np.count_nonzero(fits) > SORTED_ROWS // 4:
                    np.maximum(limit, np.partition(s, -k, axis=1)[:, -k] - EQUAL, out=limit)
                    fits = s > limit[:, None]
                i, j = np.nonzero(fits)
                if not len(i):
                    continue
                parts.append(pd.DataFrame({"_q": i, id_col: ids[at + j], "score": s[i, j]}))
                n += len(i)
                if n > SORTED_ROWS:
                    d = best(parts)
                    last = d.groupby("_q", sort=False)["_r"].agg(["size", "min"])
                    last = last[last["size"] == k]
                    limit[last.index] = np.maximum(limit[last.index], last["min"] - EQUAL)
                    parts, n = [d.drop(columns="_r")], len(d)
                    if n > SORTED_ROWS // 2:
                        yield packed(parts.pop())
                        n = 0
        if parts:
            yield packed(best(parts))

    return run


def bm25_set(df: DataFrame, queries: DataFrame, query_id: str, query_text: str, id_col: str, text: str, k: int) -> DataFrame:
    """(query_id, id, score, rank): the ``k`` best texts with a positive score for every query.

    Terms of the corpus are counted in one pass.  The query set, as numbers, goes
    to every task; there blocks of texts meet all queries and each task keeps
    ``k`` texts a query, so no pair of query and text is shuffled but those.
    Queries of equal terms are scored once, and so is what queries share of terms
    found in more than ``FREQUENT`` of all texts.  Rows of one id count as one
    text; ids that have several are joined.  Equal at 9 places counts as equal.
    """
    spark = df.sparkSession
    q = queries.select(query_id, F.explode(lexical_tokens(F.col(query_text))).alias("term")).groupBy(query_id, "term").agg(F.count(F.lit(1)).alias("qtf")).toArrow()
    tokens = df.select(id_col, lexical_tokens(F.col(text)).alias("_t"))
    n, avg, found, sizes = _corpus(tokens, pc.unique(q["term"]).to_pylist())
    idf = lambda x: math.log(n - x + 0.5) - math.log(x + 0.5)
    floor = FLOOR * sum(m * idf(x) for x, m in sizes.items()) / max(sum(sizes.values()), 1)
    terms = sorted(found, key=lambda t: (-found[t], t))
    q = q.filter(pc.is_in(q["term"], value_set=pa.array(terms, pa.string())))
    ids = q[query_id].combine_chunks().dictionary_encode("encode")
    number, code, qtf = ids.indices.to_numpy().astype(np.int64), pc.index_in(q["term"], value_set=pa.array(terms, pa.string())).to_numpy().astype(np.int64), q["qtf"].to_numpy()
    order = np.lexsort((code, number))
    number, code, qtf = number[order], code[order], qtf[order]
    same, first = _numbered(np.searchsorted(number, np.arange(len(ids.dictionary) + 1)), code, qtf)
    names = spark.createDataFrame(pa.table({"_q": same, query_id: ids.dictionary}), T.StructType([T.StructField("_q", T.LongType()), queries.schema[query_id]]))

    chosen = np.isin(number, first)
    number, code = np.searchsorted(first, number[chosen]), code[chosen]
    weights = np.array([x if (x := idf(found[t])) >= 0 else floor for t in terms])
    weight = qtf[chosen] * weights[code] if len(code) else np.zeros(0)
    frequent = sum(found[t] > FREQUENT * n for t in terms)
    often = code < frequent
    sig, shown = _numbered(np.searchsorted(number[often], np.arange(len(first) + 1)), code[often], weight[often])
    plain = np.zeros((len(shown), frequent))
    for i, x in enumerate(shown):
        plain[i, code[often & (number == x)]] = weight[often & (number == x)]
    rare = np.lexsort((number, code))
    held = spark.sparkContext.broadcast({"terms": terms, "avg": avg or 1.0, "frequent": frequent, "start": np.searchsorted(code[rare], np.arange(len(terms) + 1)), "q_of": number[rare], "weight": weight[rare], "plain": plain, "sig": sig})

    kinds = T.StructType([T.StructField("_q", T.LongType()), df.schema[id_col], T.StructField("score", T.DoubleType())])
    repeated = df.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n")).filter(F.col(id_col).isNull() | (F.col("_n") > 1)).select(F.col(id_col).alias("_i"))
    several = bool(repeated.head(1))
    single = tokens.join(repeated, F.col(id_col) == F.col("_i"), "left_anti").filter(F.col(id_col).isNotNull()) if several else tokens
    if not len(first):
        single = single.limit(0)
    scores = single.mapInArrow(_scorer(held, k, id_col, to_arrow_schema(kinds)), kinds)
    if several:
        asked = spark.createDataFrame(pa.table({"_q": number, "term": pa.array([terms[c] for c in code], pa.string()), "w": weight}))
        tf = tokens.join(repeated, F.col(id_col).eqNullSafe(F.col("_i")), "left_semi").select(id_col, F.size("_t").alias("length"), F.explode("_t").alias("term")).groupBy(id_col, "length", "term").agg(F.count(F.lit(1)).alias("tf"))
        part = F.col("w") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(float(avg or 1.0))))
        scores = scores.unionByName(tf.join(asked, "term").groupBy("_q", id_col).agg(F.sum(part).alias("score")).filter("score > 0"))
    w = Window.partitionBy("_q").orderBy(F.desc(F.round("score", 9)), id_col)
    best = scores.withColumn("rank", F.row_number().over(w) - 1).filter(F.col("rank") < k)
    return best.join(F.broadcast(names) if len(same) <= 100_000 else names, "_q").select(query_id, id_col, "score", "rank")


def _equals(q: str):
    return lambda x: x == q


def bm25(df: DataFrame, query: list[str], id_col: str, text: str, k: int | None = None) -> DataFrame:
    """(id, score) of texts with a positive score, best first.

    Texts are filtered to the query's terms inside the row, before anything is
    shuffled; corpus numbers are one row.  A term in more than half of all
    texts takes a quarter of the mean weight of all terms, which is computed
    only then.
    """
    weights: dict[str, int] = {}
    for q in query:
        weights[q] = weights.get(q, 0) + 1
    d = df.select(id_col, lexical_tokens(F.col(text)).alias("_t"))
    terms = sorted(weights)
    tf = {q: F.size(F.filter("_t", _equals(q))) for q in terms}
    d = d.select(id_col, F.size("_t").alias("_n"), *[tf[q].alias(f"_tf{i}") for i, q in enumerate(terms)])
    row = d.agg(F.count(F.lit(1)).alias("n"), F.avg("_n").alias("avg"), *[F.sum((F.col(f"_tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(terms))]).first()
    n, avg = row["n"], row["avg"] or 1.0
    idf = [math.log(n - (row[f"df{i}"] or 0) + 0.5) - math.log((row[f"df{i}"] or 0) + 0.5) for i in range(len(terms))] if n else []
    if any(x < 0 for x in idf):
        mean = document_frequencies(df, text).agg(F.avg(F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))).first()[0]
        idf = [FLOOR * mean if x < 0 else x for x in idf]
    score = F.lit(0.0)
    for i, q in enumerate(terms):
        f = F.col(f"_tf{i}")
        score = score + F.lit(float((idf[i] if n else 0.0) * weights[q])) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_n") / F.lit(float(avg))))
    out = d.select(id_col, score.alias("score")).filter("score > 0").orderBy(F.desc("score"), id_col)
    return out.limit(k) if k else out
