"""Vector search: cosine top-k, diversity, distance cuts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def top_k(df: DataFrame, query: list[float], id_col: str, vector: str, k: int) -> DataFrame:
    """The k nearest by cosine (unit vectors); the query is a literal, so rows never move before the limit."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return df.select(id_col, vector, dot(F.col(vector), q).alias("similarity")).orderBy(F.desc("similarity"), id_col).limit(k)


def _blocks(df: DataFrame, id_col: str, vector: str, size: int, prefix: str) -> DataFrame:
    """One row for up to ``size`` rows: their ids and their vectors end to end."""

    def pack(pdfs):
        for pdf in pdfs:
            for at in range(0, len(pdf), size):
                p = pdf.iloc[at : at + size]
                yield pd.DataFrame({f"{prefix}_ids": [p[id_col].to_numpy()], f"{prefix}_flat": [np.concatenate(p[vector].to_numpy())]})

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, F.col(vector).cast("array<double>").alias(vector)).filter(F.col(vector).isNotNull()).mapInPandas(pack, f"{prefix}_ids array<{kind}>, {prefix}_flat array<double>")


def top_k_set(df: DataFrame, queries: DataFrame, query_id: str, id_col: str, vector: str, k: int, block: int = 512) -> DataFrame:
    """The k nearest of every query: (query_id, id, similarity, rank). Blocks of queries are multiplied with blocks
    of rows; a task keeps k rows a query before the lists of all tasks are merged. Equal at 12 places counts as equal."""
    kinds = f"{query_id} {queries.schema[query_id].dataType.simpleString()}, {id_col} {df.schema[id_col].dataType.simpleString()}"

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.sort_values([query_id, "similarity", id_col], ascending=[True, False, True]).groupby(query_id, sort=False).head(k)

    def score(pdfs):
        held, n = [], 0
        for pdf in pdfs:
            for q_ids, q_flat, r_ids, r_flat in zip(pdf["q_ids"], pdf["q_flat"], pdf["r_ids"], pdf["r_flat"]):
                s = np.round(np.asarray(q_flat).reshape(len(q_ids), -1) @ np.asarray(r_flat).reshape(len(r_ids), -1).T, 12)
                # all that equal the k-th stay until the ids decide
                i, j = np.nonzero(s >= np.partition(s, -k, axis=1)[:, -k, None]) if len(r_ids) > k else np.indices(s.shape).reshape(2, -1)
                held.append(pd.DataFrame({query_id: np.asarray(q_ids)[i], id_col: np.asarray(r_ids)[j], "similarity": s[i, j]}))
                n += len(i)
                if n > 500_000:
                    held = [best(pd.concat(held))]
                    n = len(held[0])
                    if n > 250_000:
                        yield held.pop()
                        n = 0
        if held:
            yield best(pd.concat(held))

    pairs = _blocks(df, id_col, vector, block, "r").crossJoin(_blocks(queries, query_id, vector, block, "q"))
    w = Window.partitionBy(query_id).orderBy(F.desc("similarity"), id_col)
    return pairs.mapInPandas(score, f"{kinds}, similarity double").withColumn("rank", F.row_number().over(w) - 1).filter(F.col("rank") < k)


def _pick(pdf: pd.DataFrame, id_col: str, vector: str, k: int, balance: float) -> list[int]:
    """Places of the rows chosen, in order; rows come nearest first. Scores equal at 9 places count as equal: a query
    that is itself a row leaves all others at 0 after it, apart from rounding."""
    v = np.array(pdf[vector].tolist(), dtype=float)
    sim, near = pdf["similarity"].to_numpy(), np.full(len(pdf), -np.inf)
    left, order = list(range(len(pdf))), []
    while left and len(order) < k:
        best = max(left, key=lambda i: (round(balance * sim[i] - (1 - balance) * (near[i] if order else 0.0), 9), -i))
        left.remove(best)
        order.append(best)
        near = np.maximum(near, v @ v[best])
    return order


def mmr(df: DataFrame, query: list[float], id_col: str, vector: str, k: int, fetch_k: int, balance: float = 0.5) -> DataFrame:
    """Maximal marginal relevance over the ``fetch_k`` nearest (a bounded group)."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["similarity", id_col], ascending=[False, True]).reset_index(drop=True)
        order = _pick(pdf, id_col, vector, k, balance)
        return pd.DataFrame({id_col: pdf[id_col].iloc[order].to_numpy(), "rank": range(len(order))})

    near = top_k(df, query, id_col, vector, fetch_k)
    return near.groupBy(F.lit(1).alias("_g")).applyInPandas(pick, f"{id_col} {df.schema[id_col].dataType.simpleString()}, rank int")


def mmr_set(df: DataFrame, queries: DataFrame, query_id: str, id_col: str, vector: str, k: int, fetch_k: int, balance: float = 0.5) -> DataFrame:
    """Maximal marginal relevance for every query: (query_id, id, rank)."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank").reset_index(drop=True)
        order = _pick(pdf, id_col, vector, k, balance)
        return pd.DataFrame({query_id: pdf[query_id].iloc[order].to_numpy(), id_col: pdf[id_col].iloc[order].to_numpy(), "rank": range(len(order))})

    near = top_k_set(df, queries, query_id, id_col, vector, fetch_k).join(df.select(id_col, vector), id_col)
    kinds = f"{query_id} {queries.schema[query_id].dataType.simpleString()}, {id_col} {df.schema[id_col].dataType.simpleString()}"
    return near.groupBy(query_id).applyInPandas(pick, f"{kinds}, rank int")


def distance_cuts(df: DataFrame, group: str, order: str, vector: str, percentile: float) -> DataFrame:
    """Neighbours of a sequence whose distance exceeds the group's percentile."""
    w = Window.partitionBy(group).orderBy(order)
    d = df.select(group, order, (1 - dot(F.col(vector), F.lag(vector).over(w))).alias("distance")).filter("distance IS NOT NULL")
    limit = d.groupBy(group).agg(F.percentile("distance", percentile).alias("limit"))
    return d.join(limit, group).filter("distance > limit").select(group, order, "distance", "limit")
