"""All queries of the core, by name, and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairnlake.plans import assembled, chunked, clinical, data_quality, facts, library, pages, search


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical top-k over the documents."""
    return library.bm25_topk(spark, sf_dir)


QUERIES = {**data_quality.QUERIES, **library.QUERIES, **clinical.QUERIES, **facts.QUERIES, **assembled.QUERIES, **pages.QUERIES, **search.QUERIES, **chunked.QUERIES}
ORACLES = {**data_quality.ORACLES, **library.ORACLES, **clinical.ORACLES, **facts.ORACLES, **assembled.ORACLES, **pages.ORACLES, **search.ORACLES, **chunked.ORACLES}
