"""Searches of query sets, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake.operators import lexical, retrieval
from cairnlake.plans.library import _COS, _TOK
from cairnlake.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


# Requests whose id is divisible by 20 are the queries; the vector of that number stands for the one a model would give.
_BM = f"""d AS (SELECT doc_id, {_TOK.format(c='text')} AS k FROM documents), s AS (SELECT count(*) AS n, avg(len(k)) AS a FROM d),
  i AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(k)) AS term FROM d) GROUP BY term), s), m AS (SELECT 0.25 * avg(idf) AS floor FROM i),
  q AS (SELECT request_id AS query_id, term, count(*) AS qtf FROM (SELECT request_id, unnest({_TOK.format(c='message')}) AS term FROM chat_requests WHERE request_id % 20 = 0) GROUP BY ALL),
  a AS (SELECT query_id, term, qtf, CASE WHEN idf < 0 THEN floor ELSE idf END AS idf FROM q JOIN i USING (term), m), tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(k) AS dl, unnest(k) AS term FROM d) GROUP BY ALL),
  lex AS (SELECT query_id, doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT a FROM s)))) AS score FROM tf JOIN a USING (term) GROUP BY ALL HAVING score > 0),
  lexk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) - 1 AS rank FROM lex QUALIFY rank < 20)"""


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chat_requests").filter("request_id % 20 = 0").select(F.col("request_id").alias("query_id"), F.col("message").alias("asked"))


@query(f"WITH {_BM} SELECT query_id, doc_id, rank, round(score, 6) AS score FROM lexk")
def bm25_set(spark: SparkSession, d: str) -> DataFrame:
    """The best texts for every request whose id is divisible by 20, over all documents."""
    s = lexical.bm25_set(table(spark, d, "documents"), _queries(spark, d), "query_id", "asked", "doc_id", "text", 20)
    return s.select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


_DENSE = f"""den AS (SELECT q.vec_id AS query_id, e.vec_id AS doc_id, round({_COS}, 12) AS c FROM embeddings e, embeddings q WHERE q.vec_id IN (SELECT request_id FROM chat_requests WHERE request_id % 20 = 0)),
  denk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, doc_id) - 1 AS rank FROM den QUALIFY rank < 20)"""


def _hybrid(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    q = _queries(spark, d).join(vectors.select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("v")), "query_id", "left")
    return retrieval.hybrid(table(spark, d, "documents"), vectors, q, "query_id", "asked", "v", "doc_id", "text", "embedding")


_FUSED = f"""WITH {_BM}, {_DENSE}, f AS (SELECT query_id, doc_id, sum(1.0 / (61 + rank)) AS score FROM (SELECT query_id, doc_id, rank FROM denk UNION ALL SELECT query_id, doc_id, rank FROM lexk) GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, doc_id) - 1 AS rank FROM f QUALIFY rank < 10),
  j AS (SELECT r.query_id, r.doc_id, r.score, r.rank, e.c, e.doc_id IS NOT NULL AS in_dense, l.doc_id IS NOT NULL AS in_lexical FROM r LEFT JOIN denk e ON e.query_id = r.query_id AND e.doc_id = r.doc_id LEFT JOIN lexk l ON l.query_id = r.query_id AND l.doc_id = r.doc_id),
  h AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n, coalesce(max(c) OVER (PARTITION BY query_id), 0) AS top FROM j)"""


@query(f"""{_FUSED} SELECT query_id, doc_id, rank, round(score, 8) AS score, in_dense, in_lexical, CASE WHEN top = 0 THEN CASE WHEN n >= 2 THEN 'MODERATE' ELSE 'LOW' END WHEN top >= 0.8 AND n >= 3 THEN 'HIGH' WHEN top >= 0.4 AND n >= 2 THEN 'MODERATE' ELSE 'LOW' END AS confidence FROM h""")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """Dense and lexical lists of the query set fused."""
    return _hybrid(spark, d).select("query_id", "doc_id", "rank", F.round("score", 8).alias("score"), "in_dense", "in_lexical", "confidence")


_WORDS = f"list_filter(list_distinct({_TOK.format(c='message')}), lambda w: length(w) > 2)"
_BEST = "list_max(list_transform(range(0, greatest(CAST(ceil((length(t) - 900) / 225) AS INT), 0) + 1), lambda i: {'n': len(list_filter(w, lambda x: contains(lower(substr(t, i * 225 + 1, 900)), x))), 'i': -i}))"


@query(f"""{_FUSED}, x AS (SELECT h.query_id, h.doc_id, h.rank, coalesce(d.text, '') AS t, {_WORDS} AS w, d.document_type, d.source FROM h JOIN documents d ON d.doc_id = h.doc_id JOIN chat_requests c ON c.request_id = h.query_id)
  SELECT query_id, doc_id, '[Source ' || (rank + 1) || ': ' || concat_ws(' | ', nullif(document_type, ''), nullif(source, '')) || ']' AS header, CASE WHEN length(t) <= 900 THEN t ELSE substr(t, -({_BEST}).i * 225 + 1, 900) END AS evidence FROM x""")
def search_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of the hybrid search: a header and the stretch of each text that fits the query best."""
    docs = table(spark, d, "documents").select("doc_id", "text", "document_type", "source")
    h = retrieval.with_texts(_hybrid(spark, d).select("query_id", "doc_id", "rank"), _queries(spark, d), docs, "query_id", "asked", "doc_id", 10)
    return h.select("query_id", "doc_id", retrieval.source_header(F.col("rank"), F.col("document_type"), F.col("source")).alias("header"), retrieval.evidence_span(F.col("asked"), F.col("text")).alias("evidence"))


@query(f"""WITH {_BM}, {_DENSE}, l AS (SELECT lexk.query_id, lexk.doc_id, lexk.rank, d.source FROM lexk JOIN documents d USING (doc_id)), e AS (SELECT denk.query_id, denk.doc_id, denk.rank, d.source FROM denk JOIN documents d USING (doc_id) WHERE denk.rank < 5),
  x AS (SELECT DISTINCT query_id, source FROM l WHERE source IS NOT NULL EXCEPT SELECT query_id, source FROM e)
  SELECT query_id, doc_id, source FROM e UNION ALL SELECT l.query_id, arg_min(l.doc_id, l.rank), l.source FROM l JOIN x ON x.query_id = l.query_id AND x.source = l.source GROUP BY l.query_id, l.source""")
def missing_sources(spark: SparkSession, d: str) -> DataFrame:
    """The first dense hits, and the best lexical hit of every source that has none among them."""
    docs = table(spark, d, "documents").select("doc_id", "source")
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    q = _queries(spark, d)
    asked = q.join(vectors.select(F.col("doc_id").alias("query_id"), "embedding"), "query_id").select("query_id", "embedding")
    near = retrieval.top_k_set(vectors, asked, "query_id", "doc_id", "embedding", 20).filter("rank < 5").join(docs, "doc_id").select("query_id", "doc_id", "source", "rank")
    words = lexical.bm25_set(table(spark, d, "documents"), q, "query_id", "asked", "doc_id", "text", 20).join(docs, "doc_id").select("query_id", "doc_id", "source", "rank")
    return retrieval.with_missing(near, None, words, "query_id", "source").select("query_id", "doc_id", "source")
