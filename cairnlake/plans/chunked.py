"""Queries over chunks of documents; their counterparts state what must hold of every chunk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake.operators import chunking
from cairnlake.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _documents(spark: SparkSession, d: str) -> DataFrame:
    """Every document as one text, its pages in order."""
    p = table(spark, d, "doc_pages").filter("page_content IS NOT NULL")
    pages = F.transform(F.array_sort(F.collect_list(F.struct("page_number", "page_id", "page_content"))), lambda x: x["page_content"])
    return p.groupBy("document_id").agg(F.array_join(pages, "\n\n").alias("t"), F.min("patient_name").alias("patient_name"), F.min("patient_mrn").alias("patient_mrn"), F.min("document_type").alias("document_type"))


_LABELS = {"Patient": "patient_name", "MRN": "patient_mrn", "DocType": "document_type"}


def chunk_document(spark: SparkSession, d: str) -> DataFrame:
    """The chunks of every document with their section and place."""
    return chunking.chunk_documents(_documents(spark, d), "document_id", "t", _LABELS)


def chunk_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Of every document: whether its chunks keep the limit, begin with their labels, are numbered through and lose no word in lower case (titles and codes aside)."""
    docs = _documents(spark, d)
    c = chunking.chunk_documents(docs, "document_id", "t", _LABELS)
    words = lambda t: F.array_distinct(F.filter(F.split(t, r"[^\p{L}\p{N}]+"), lambda w: w.rlike(r"^\p{Ll}{1,64}$")))
    c = c.groupBy("document_id").agg(
        (F.max(F.length("body")) <= chunking.Sizes().most).alias("bounded"), F.min(F.col("content").rlike(r"^\[[^\n]*Section: [^\n]+\]\n")).alias("labelled"), (F.max("chunk_index") + 1 == F.count(F.lit(1))).alias("numbered"), F.array_distinct(F.flatten(F.collect_list(words(F.col("content"))))).alias("w")
    )
    return docs.filter(F.trim("t").rlike(r"\S")).join(c, "document_id", "left").select("document_id", "bounded", "labelled", "numbered", (F.size(F.array_except(words(F.col("t")), F.col("w"))) == 0).alias("whole"))


QUERIES |= {"chunk_document": chunk_document, "chunk_bounds": chunk_bounds}
ORACLES["chunk_bounds"] = "SELECT document_id, true AS bounded, true AS labelled, true AS numbered, true AS whole FROM doc_pages WHERE page_content IS NOT NULL GROUP BY document_id HAVING bool_or(regexp_matches(page_content, '\\S'))"
