"""Rank fusion, boosts, neighbours, overlap removal, confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fuse(lists: list[DataFrame], key: str, rank: str, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion; ranks begin at 0."""
    parts = [d.select(key, (1 / (k + F.col(rank) + 1)).alias("_s"), F.lit(i).alias("_list"), F.col(rank).alias("_rank")) for i, d in enumerate(lists)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(key).agg(F.sum("_s").alias("score"), F.min(F.struct("_list", "_rank")).alias("_first")).orderBy(F.desc("score"), "_first").drop("_first")


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """``rank`` from 0 over a list that a limit has bounded."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)) - 1)


def boosted(df: DataFrame, hint: Column, order: str) -> DataFrame:
    """Rows with the hint first, otherwise in their order; none is dropped."""
    return df.withColumn("boost", F.when(hint, 0).otherwise(1)).orderBy("boost", order)


def neighbours(hits: DataFrame, every: DataFrame, document: str, index: str, reach: int = 1) -> DataFrame:
    """Rows of the same document within ``reach`` of a hit, by an equi-join on the places wanted."""
    want = hits.select(document, F.explode(F.sequence(F.col(index) - reach, F.col(index) + reach)).alias(index)).distinct()
    return every.join(want, [document, index], "left_semi")


def confidence(n: Column, top: Column) -> Column:
    return (
        F.when(n == 0, "NO_EVIDENCE")
        .when(top == 0, F.when(n >= 2, "MODERATE").otherwise("LOW"))
        .when((top >= 0.8) & (n >= 3), "HIGH")
        .when((top >= 0.4) & (n >= 2), "MODERATE")
        .otherwise("LOW")
    )
