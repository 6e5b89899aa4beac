"""Queries over the operators of the library, each with its SQL counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnlake.functions.text import content_hash, lexical_tokens, version_of
from cairnlake.operators import documents, events, fusion, lexical, quality, records, vectors
from cairnlake.session import broadcast_if_small, listed, table
from cairnlake.streaming import windows

QUERY = ["worsening", "chest", "tightness", "creatinine", "review"]

# Invented prices a million tokens (input, cached input or null, output): names are matched whole, by longest prefix, then by family.
PRICES = [("clin-mini", 0.4, 0.1, 1.6), ("clin-mini-4", 0.5, 0.12, 2.0), ("clin-large", 2.0, 0.5, 8.0), ("fern-2-flash", 0.3, None, 2.5)]
FAMILIES = [("flash", "fern-2-flash"), ("large", "clin-large")]

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


_NORM = "trim(regexp_replace(lower(text), '[ \\t\\r\\n\\f]+', ' ', 'g'))"
_TOK = "regexp_extract_all(regexp_replace(regexp_replace(lower(regexp_replace(coalesce({c}, ''), '[^\\x00-\\x7F]', ' ', 'g')), '([0-9]),([0-9]{{3}})', '\\1\\2', 'g'), '([0-9]),([0-9]{{3}})', '\\1\\2', 'g'), '[a-z0-9]+(?:\\.[0-9]+)?')"
_TRIM = "regexp_replace(coalesce({c}, ''), '^\\s+|\\s+$', '', 'g')"


@query(f"""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN length(t) = 0 THEN 'empty_text' WHEN length(t) < 100 THEN 'too_short'
  WHEN length(regexp_replace(t, '[^A-Za-z]', '', 'g')) / length(t) < 0.3 THEN 'low_alpha_ratio'
  WHEN length(regexp_replace(t, '[^\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g')) / length(t) > 0.05 THEN 'high_control_chars'
  WHEN len(list_filter(range(1, length(t) - 18), lambda i: substr(t, i, 1) NOT IN ('_', '-', '=', '*', '.', '|', '~', ' ', chr(9), chr(10), chr(13)) AND substr(t, i, 20) = repeat(substr(t, i, 1), 20))) > 0 THEN 'excessive_repetition'
  ELSE 'ok' END AS reason FROM (SELECT {_TRIM.format(c='text')} AS t FROM documents)) GROUP BY reason""")
def quality_gate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(quality.gate_reason(F.col("text")).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY sha256(coalesce({_NORM}, ''))")
def content_hash_dedup(spark: SparkSession, d: str) -> DataFrame:
    return quality.keep_first(table(spark, d, "documents"), content_hash(F.col("text")), "doc_id")


@query(f"""SELECT doc_id FROM documents WHERE received_at >= TIMESTAMP '2026-01-01' AND sha256(coalesce({_NORM}, '')) NOT IN (SELECT sha256(coalesce({_NORM}, '')) FROM documents WHERE received_at < TIMESTAMP '2026-01-01')""")
def incremental_new_docs(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return quality.new_only(docs.filter("received_at >= '2026-01-01'"), docs.filter("received_at < '2026-01-01'"), "text").select("doc_id")


@query("""SELECT flag, count(*) AS n FROM (SELECT unnest(list_filter([
  CASE WHEN length(t) < 50 THEN 'tiny' END, CASE WHEN length(t) > 3000 THEN 'oversize' END, CASE WHEN coalesce(section_title, '') = '' THEN 'no_title' END,
  CASE WHEN regexp_matches(t, '^[a-z]') THEN 'starts_inside' END, CASE WHEN regexp_matches(t, '[A-Za-z,]\\z') THEN 'ends_inside' END,
  CASE WHEN regexp_matches(t, '(?m)^\\|[^|\\n]*$') THEN 'broken_row' END, CASE WHEN contains(t, chr(65533)) THEN 'bad_characters' END], lambda x: x IS NOT NULL)) AS flag
  FROM (SELECT coalesce(page_content, '') AS t, section_title FROM doc_pages)) GROUP BY flag""")
def chunk_audit(spark: SparkSession, d: str) -> DataFrame:
    flags = quality.audit_flags(F.col("page_content"), F.col("section_title"))
    return table(spark, d, "doc_pages").select(F.explode(flags).alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH t AS (SELECT source, {_TOK.format(c='text')} AS k FROM documents)
  SELECT source, sum(len(k)) AS tokens, max(len(k)) AS longest, count(*) AS n FROM t GROUP BY source""")
def token_stats(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("source", F.size(lexical_tokens(F.col("text"))).alias("n"))
    return t.groupBy("source").agg(F.sum("n").alias("tokens"), F.max("n").alias("longest"), F.count(F.lit(1)).alias("n"))


def _bm25_sql(terms: list[str], k: int) -> str:
    q = ", ".join(f"('{t}')" for t in terms)
    return f"""WITH d AS (SELECT doc_id, {_TOK.format(c='text')} AS k FROM documents), s AS (SELECT count(*) AS n, avg(len(k)) AS a FROM d),
  tf AS (SELECT doc_id, len(k) AS dl, unnest(k) AS term FROM d), c AS (SELECT doc_id, dl, term, count(*) AS tf FROM tf GROUP BY ALL),
  df AS (SELECT term, count(*) AS df FROM c GROUP BY term), i AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM df, s),
  w AS (SELECT q.term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM i) ELSE idf END AS idf FROM (VALUES {q}) q(term) JOIN i USING (term))
  SELECT doc_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))) AS score FROM c JOIN w USING (term), s GROUP BY doc_id HAVING score > 0 ORDER BY round(score, 9) DESC, doc_id LIMIT {k}"""


@query(f"SELECT doc_id, round(score, 6) AS score FROM ({_bm25_sql(QUERY, 20)})")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return lexical.bm25(table(spark, d, "documents"), QUERY, "doc_id", "text", 20).select("doc_id", F.round("score", 6).alias("score"))


def _probe(spark: SparkSession, d: str) -> list[float]:
    return list(table(spark, d, "embeddings").orderBy("vec_id").select("embedding").first()[0])


_COS = "list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"


@query(f"SELECT e.vec_id, round({_COS}, 5) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q ORDER BY {_COS} DESC, e.vec_id LIMIT 10")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return vectors.top_k(table(spark, d, "embeddings"), _probe(spark, d), "vec_id", "embedding", 10).select("vec_id", F.round("similarity", 5).alias("similarity"))


@query()
def mmr_topk(spark: SparkSession, d: str) -> DataFrame:
    return vectors.mmr(table(spark, d, "embeddings"), _probe(spark, d), "vec_id", "embedding", 10, 40)


def _query_set(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query(f"""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, round({_COS}, 12) AS c FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0)
  SELECT query_id, vec_id, rank, round(c, 5) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id) - 1 AS rank FROM s) WHERE rank < 10""")
def dense_topk_set(spark: SparkSession, d: str) -> DataFrame:
    near = vectors.top_k_set(table(spark, d, "embeddings"), _query_set(spark, d), "query_id", "vec_id", "embedding", 10)
    return near.select("query_id", "vec_id", "rank", F.round("similarity", 5).alias("similarity"))


@query()
def mmr_topk_set(spark: SparkSession, d: str) -> DataFrame:
    return vectors.mmr_set(table(spark, d, "embeddings"), _query_set(spark, d), "query_id", "vec_id", "embedding", 10, 40)


_DIST = "1 - list_sum(list_transform(list_zip(embedding, p), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"


@query(f"""WITH x AS (SELECT label, vec_id, embedding, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings), y AS (SELECT label, vec_id, {_DIST} AS distance FROM x WHERE p IS NOT NULL),
  z AS (SELECT label, quantile_cont(distance, 0.88) AS lim FROM y GROUP BY label) SELECT y.label, vec_id, round(distance, 5) AS distance FROM y JOIN z ON y.label = z.label WHERE distance > lim""")
def adjacent_distance_cut(spark: SparkSession, d: str) -> DataFrame:
    return vectors.distance_cuts(table(spark, d, "embeddings"), "label", "vec_id", "embedding", 0.88).select("label", "vec_id", F.round("distance", 5).alias("distance"))


_LIST = "SELECT doc_id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) - 1 AS r FROM ({})"


@query(f"""SELECT doc_id, round(sum(1.0 / (61 + r)), 8) AS score FROM ({_LIST.format(_bm25_sql(["chest", "tightness"], 30))} UNION ALL {_LIST.format(_bm25_sql(["creatinine", "review"], 30))}) GROUP BY doc_id""")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    lists = [fusion.ranked(lexical.bm25(docs, q, "doc_id", "text", 30), F.desc(F.round("score", 9)), F.col("doc_id")) for q in (["chest", "tightness"], ["creatinine", "review"])]
    return fusion.fuse(lists, "doc_id", "rank").select("doc_id", F.round("score", 8).alias("score"))


@query(f"""SELECT doc_id, CASE WHEN source = 'lab_reports' THEN 0 ELSE 1 END AS boost FROM ({_bm25_sql(QUERY, 25)}) JOIN documents USING (doc_id)""")
def metadata_boost(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    hits = fusion.ranked(lexical.bm25(docs, QUERY, "doc_id", "text", 25), F.desc("score"), F.col("doc_id"))
    hits = docs.select("doc_id", "source").join(broadcast_if_small(hits), "doc_id")
    return fusion.boosted(hits, F.coalesce(F.col("source") == "lab_reports", F.lit(False)), "rank").select("doc_id", "boost")


@query("""SELECT DISTINCT e.page_id FROM doc_pages e JOIN (SELECT document_id, page_number FROM doc_pages WHERE page_content LIKE '%chest tightness%') h ON e.document_id = h.document_id AND e.page_number BETWEEN h.page_number - 1 AND h.page_number + 1""")
def neighbor_expand(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "doc_pages").select("page_id", "document_id", "page_number", "page_content")
    hits = pages.filter(F.contains("page_content", F.lit("chest tightness"))).select("document_id", "page_number")
    return fusion.neighbours(hits, pages, "document_id", "page_number").select("page_id")


@query("""SELECT patient_mrn, best.v AS value, best.t AS date_time, n FROM (SELECT patient_mrn, max({'v': CAST(value AS DOUBLE), 't': date_time}) AS best, count(*) AS n FROM labs
  WHERE test = 'HbA1c' AND unit = '%' AND regexp_matches(value, '^[0-9]+[.][0-9]+$') AND CAST(value AS DOUBLE) > 9 AND date_time >= TIMESTAMP '2024-06-01' AND patient_mrn IS NOT NULL GROUP BY patient_mrn)""")
def cohort_best_reading(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "labs").filter((F.col("test") == "HbA1c") & (F.col("unit") == "%") & F.col("value").rlike("^[0-9]+[.][0-9]+$") & F.col("patient_mrn").isNotNull())
    x = x.select("patient_mrn", F.col("value").try_cast("double").alias("value"), "date_time").filter("value > 9 AND date_time >= '2024-06-01'")
    return records.best_reading(x, "patient_mrn", "value", "date_time")


@query("""SELECT session_id, count(*) AS n, min(turn) AS first_turn, substr(min_by(content, turn), 1, 80) AS title FROM chat_messages WHERE role = 'user' AND content IS NOT NULL AND content <> '' GROUP BY session_id""")
def session_list(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "chat_messages").filter("role = 'user' AND content <> ''")
    m = m.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("turn", "message_id")).alias("_f"), F.min_by("content", F.struct("turn", "message_id")).alias("_t"))
    return m.select("session_id", "n", F.col("_f.turn").alias("first_turn"), F.substring("_t", 1, 80).alias("title"))


ORACLES["session_list"] = ORACLES["session_list"].replace("min_by(content, turn)", "min_by(content, {'t': turn, 'm': message_id})")


@query("SELECT session_id, message_id, k FROM (SELECT session_id, message_id, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC, message_id DESC) AS k FROM chat_messages) WHERE k <= 8")
def last_n_turns(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("session_id").orderBy(F.desc("turn"), F.desc("message_id"))
    return table(spark, d, "chat_messages").select("session_id", "message_id", F.row_number().over(w).alias("k")).filter("k <= 8")


@query("""SELECT session_id, message_id, reply_id FROM (SELECT session_id, message_id, role, lead(role) OVER w AS nr, lead(message_id) OVER w AS reply_id FROM chat_messages WINDOW w AS (PARTITION BY session_id ORDER BY turn, message_id)) WHERE role = 'user' AND nr = 'assistant'""")
def turn_pairs(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "chat_messages").withColumn("_at", F.struct("turn", "message_id"))
    p = records.turn_pairs(m, "session_id", "_at", "role", "message_id")
    return p.select("session_id", F.col("question").alias("message_id"), F.col("reply").alias("reply_id"))


@query("""SELECT tenant_id, session_id, sum(input_tokens) AS input_tokens, sum(output_tokens) AS output_tokens, count(*) AS n, round(sum(cost_usd), 6) AS cost, count(DISTINCT model) AS models
  FROM usage_records GROUP BY ROLLUP (tenant_id, session_id)""")
def usage_ledger(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "usage_records")
    return u.rollup("tenant_id", "session_id").agg(
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.count(F.lit(1)).alias("n"), F.round(F.sum("cost_usd"), 6).alias("cost"), F.countDistinct("model").alias("models")
    )


_PRICE_ROWS = ", ".join(f"('{m}', {i}, {'NULL' if c is None else c}, {o})" for m, i, c, o in PRICES)
_FAMILY_ROWS = ", ".join(f"({k}, '{w}', '{m}')" for k, (w, m) in enumerate(FAMILIES))


@query(f"""WITH p(m, i, c, o) AS (VALUES {_PRICE_ROWS}), f(k, w, m) AS (VALUES {_FAMILY_ROWS}), n AS (SELECT DISTINCT model FROM usage_records),
  b AS (SELECT model, coalesce((SELECT arg_max(m, length(m)) FROM p WHERE starts_with(lower(model), m)), (SELECT arg_min(m, k) FROM f WHERE contains(lower(model), w))) AS priced_as FROM n)
  SELECT record_id, b.priced_as, CAST(round(((coalesce(input_tokens, 0) - k) * coalesce(p.i, 0) + k * coalesce(p.c, p.i, 0) + coalesce(output_tokens, 0) * coalesce(p.o, 0)) / 1000000, 8) AS DOUBLE) AS cost
  FROM (SELECT u.*, greatest(0, least(coalesce(cached_input_tokens, 0), coalesce(input_tokens, 0))) AS k FROM usage_records u) u LEFT JOIN b ON b.model IS NOT DISTINCT FROM u.model LEFT JOIN p ON p.m = b.priced_as""")
def price_longest_prefix(spark: SparkSession, d: str) -> DataFrame:
    prices = listed(spark, PRICES, "priced_as string, rate_in double, rate_cached double, rate_out double")
    u = records.longest_prefix(table(spark, d, "usage_records"), prices, "model", "priced_as", FAMILIES)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    c = records.cost(F.col("input_tokens"), F.col("cached_input_tokens"), F.col("output_tokens"), zero("rate_in"), F.coalesce("rate_cached", "rate_in", F.lit(0.0)), zero("rate_out"))
    return u.select("record_id", "priced_as", c.alias("cost"))


@query("SELECT model, count(*) AS n FROM (SELECT CASE WHEN contains(lower(coalesce(model, '')), 'gemini') THEN 'google' WHEN regexp_matches(lower(coalesce(model, '')), 'gpt|o1|o3|o4') THEN 'openai' ELSE 'unknown' END AS model FROM (SELECT model FROM usage_records UNION ALL SELECT 'gpt-' || model FROM usage_records UNION ALL SELECT 'Gemini ' || provider FROM usage_records)) GROUP BY model")
def model_provider(spark: SparkSession, d: str) -> DataFrame:
    """Providers told from names of models, some of them renamed for the check."""
    from cairnlake.operators.assembly import provider

    u = table(spark, d, "usage_records")
    every = u.select("model").unionByName(u.select(F.concat(F.lit("gpt-"), "model").alias("model"))).unionByName(u.select(F.concat(F.lit("Gemini "), "provider").alias("model")))
    return every.select(provider(F.col("model")).alias("model")).groupBy("model").agg(F.count(F.lit(1)).alias("n"))


def _first_sql(patterns: list[tuple[str, int]], least: int) -> str:
    return "CASE " + " ".join(f"WHEN length(regexp_extract(t, '{p}', {g})) >= {least} THEN regexp_extract(t, '{p}', {g})" for p, g in patterns) + " END"


@query(f"SELECT result_id, {_first_sql(documents.MRN, 4)} AS mrn, {_first_sql(documents.DATE, 1)} AS first_date FROM (SELECT result_id, coalesce(substr(question || ' ' || reply, 1, 3000), '') AS t FROM custom_robert_live_eval_results)")
def extract_mrn_date(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "custom_robert_live_eval_results").withColumn("_x", F.concat("question", F.lit(" "), "reply"))
    return documents.extracted(r, "result_id", "_x")


def _re2(p: str) -> str:
    """A pattern of the operators for DuckDB, which has neither look-ahead nor classes beyond ASCII."""
    return p.replace(r"(?!\w)", r"(?:[^\p{L}\p{N}_]|$)").replace(r"\w", r"\p{L}\p{N}_").replace(r"\d", r"\p{Nd}").replace(r"\s", r"[\s\p{Z}]")


def _keys_sql(patterns: list[tuple[str, int]], least: int) -> str:
    p = [("(?i)" + _re2(x), g) for x, g in patterns]
    return f"coalesce({_first_sql(p, least).replace('(t,', '(h,')}, {_first_sql(p, least)})"


@query(f"SELECT page_id, {_keys_sql(documents.RECORD_NUMBERS, 4)} AS mrn, {_keys_sql(documents.ENCOUNTER_DATES, 1)} AS encounter_date FROM (SELECT page_id, coalesce(page_content, '') AS t, substr(coalesce(page_content, ''), 1, 3000) AS h FROM doc_pages)")
def record_keys(spark: SparkSession, d: str) -> DataFrame:
    return documents.record_keys(table(spark, d, "doc_pages"), "page_id", "page_content")


@query("""WITH r AS (SELECT page_id, unnest(list_filter(string_split(coalesce(page_content, ''), chr(10)), lambda s: starts_with(s, '|') AND NOT regexp_matches(s, '^\\|[-| :]+\\|?$'))) AS r, generate_subscripts(list_filter(string_split(coalesce(page_content, ''), chr(10)), lambda s: starts_with(s, '|') AND NOT regexp_matches(s, '^\\|[-| :]+\\|?$')), 1) - 1 AS row_no FROM doc_pages),
  c AS (SELECT page_id, row_no, list_transform(string_split(regexp_replace(r, '^\\||\\|\\s*$', '', 'g'), '|'), lambda x: trim(x)) AS c FROM r)
  SELECT page_id, row_no, c[1] AS name, c[2] AS value, c[3] AS reference FROM c WHERE len(c) = 3 AND regexp_matches(c[2], '[0-9]') AND c[1] <> ''""")
def table_row_facts(spark: SparkSession, d: str) -> DataFrame:
    return documents.table_facts(table(spark, d, "doc_pages"), "page_id", "page_content")


_EV = ", ".join(f"list_transform(regexp_extract_all(coalesce(page_content, ''), '{p}', 1), lambda m: {{'e': '{e}', 'm': m}})" for e, p in documents.EVENTS)


@query(f"SELECT DISTINCT page_id, x.e AS event, x.m AS medication FROM (SELECT page_id, unnest(flatten([{_EV}])) AS x FROM doc_pages)")
def event_facts(spark: SparkSession, d: str) -> DataFrame:
    return documents.events(table(spark, d, "doc_pages"), "page_id", "page_content")


@query()
def clinical_events(spark: SparkSession, d: str) -> DataFrame:
    return events.clinical_events(table(spark, d, "doc_pages"), "page_id", "page_content", F.col("section_title"), F.col("document_type"))


@query("""SELECT page_id, count(*) AS sections, sum(CASE WHEN title THEN 1 ELSE 0 END) AS titled FROM (SELECT page_id, regexp_matches(s, '^#{1,4} [^\\n]') AS title, s FROM (SELECT page_id, unnest(string_split(regexp_replace(chr(10) || replace(coalesce(page_content, ''), chr(13), ''), '\\n(#{1,4} )', chr(1) || '\\1', 'g'), chr(1))) AS s FROM doc_pages))
  WHERE title OR trim(regexp_replace(regexp_replace(s, '^#{1,4} [^\\n]*', ''), '^\\n+|\\n+$', '', 'g')) <> '' GROUP BY page_id""")
def chunk_sections(spark: SparkSession, d: str) -> DataFrame:
    s = documents.sections(table(spark, d, "doc_pages"), "page_id", "page_content")
    return s.groupBy("page_id").agg(F.count(F.lit(1)).alias("sections"), F.sum((F.col("title") != "").cast("long")).alias("titled"))


_SENT = "list_filter(string_split_regex(regexp_replace(coalesce(reply, ''), '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+'), lambda s: trim(s) <> '')"


@query(f"""SELECT result_id, len(c) AS n_cited, coalesce(list_max(c), 0) AS max_source, len(list_filter(c, lambda x: x < 1 OR x > 9)) AS invalid, len(list_filter({_SENT}, lambda s: regexp_matches(s, '[0-9]+\\.[0-9]') AND NOT regexp_matches(s, '\\[S[0-9]+\\]'))) AS uncited, CAST(round(len(c) / 9, 3) AS DOUBLE) AS coverage
  FROM (SELECT result_id, reply, list_distinct(list_transform(regexp_extract_all(coalesce(reply, ''), '\\[S([0-9]+)\\]', 1), lambda x: CAST(x AS INT))) AS c FROM custom_robert_live_eval_results)""")
def grounding_check(spark: SparkSession, d: str) -> DataFrame:
    g = documents.grounding(table(spark, d, "custom_robert_live_eval_results"), "result_id", "reply", F.lit(9))
    return g.drop("grounded")


_CITED = r"\[S([0-9]+)(?:[,\s][^\]]+)?\]"
_CLAIM = " ".join(f"WHEN regexp_matches(s, '(?i){_re2(p)}') THEN '{label}'" for label, p in documents.CLAIMS)


@query(f"""SELECT result_id, len(c) AS n_cited, coalesce(list_max(c), 0) AS max_source, len(list_filter(c, lambda x: x < 1 OR x > 9)) AS invalid, len(l) AS uncited, array_to_string(l, '; ') AS labels, CAST(round(len(c) / 9, 3) AS DOUBLE) AS coverage, len(list_filter(c, lambda x: x < 1 OR x > 9)) = 0 AND len(l) = 0 AS grounded
  FROM (SELECT result_id, list_distinct(list_transform(regexp_extract_all(coalesce(reply, ''), '{_CITED}', 1), lambda x: CAST(x AS INT))) AS c,
  list_filter(list_transform({_SENT}, lambda s: CASE WHEN regexp_matches(s, '{_CITED}') THEN NULL {_CLAIM} END), lambda x: x IS NOT NULL) AS l FROM custom_robert_live_eval_results)""")
def grounding_claims(spark: SparkSession, d: str) -> DataFrame:
    return documents.claims(table(spark, d, "custom_robert_live_eval_results"), "result_id", "reply", F.lit(9))


@query("""SELECT document_id, page_number, page_id FROM doc_pages WHERE tenant_id = 'tn-01' AND document_id IN (SELECT document_id FROM doc_pages WHERE tenant_id = 'tn-01' ORDER BY document_id LIMIT 1)""")
def scope_filter(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "doc_pages")
    first = pages.filter("tenant_id = 'tn-01'").orderBy("document_id").select("document_id").first()
    asked = records.Scope(tenant_id="tn-01").narrow(records.Scope(document_ids=(first[0],) if first else ()))
    return pages.filter(asked.predicate()).select("document_id", "page_number", "page_id")


_REG = """SELECT document_id, CASE h % 5 WHEN 0 THEN 'processing' WHEN 1 THEN 'duplicate' ELSE 'ready' END AS status, CASE WHEN h % 5 = 1 THEN CASE WHEN h % 2 = 0 THEN document_id ELSE 'doc-first' END END AS duplicate_of, min(patient_mrn) AS owner FROM (SELECT document_id, patient_mrn, CAST(right(document_id, 4) AS INT) AS h FROM doc_pages) GROUP BY document_id, h"""


@query(f"""WITH reg AS ({_REG}), asked AS (SELECT request_id, CASE WHEN request_id % 3 = 0 THEN 'MRN-OTHER' ELSE patient_mrn END AS asked, unnest(list_append(document_ids, 'doc-unknown')) AS document_id FROM chat_requests)
  SELECT request_id, document_id, CASE WHEN status IS NULL THEN 'not_found' WHEN status = 'duplicate' AND duplicate_of <> document_id THEN 'duplicate' WHEN status NOT IN ('ready', 'duplicate') THEN 'not_ready' WHEN owner <> asked THEN 'belongs_to_other' ELSE 'ok' END AS verdict FROM asked LEFT JOIN reg USING (document_id)""")
def ownership_check(spark: SparkSession, d: str) -> DataFrame:
    """Documents asked for against a registry in which some are processing, duplicates or of another patient."""
    h = F.right(F.col("document_id"), F.lit(4)).cast("int")
    reg = table(spark, d, "doc_pages").groupBy("document_id").agg(F.min("patient_mrn").alias("owner_mrn")).select(
        "document_id", "owner_mrn", F.when(h % 5 == 0, "processing").when(h % 5 == 1, "duplicate").otherwise("ready").alias("status"), F.when(h % 5 == 1, F.when(h % 2 == 0, F.col("document_id")).otherwise("doc-first")).alias("duplicate_of")
    )
    asked = table(spark, d, "chat_requests").filter("document_ids IS NOT NULL").select("request_id", F.when(F.col("request_id") % 3 == 0, "MRN-OTHER").otherwise(F.col("patient_mrn")).alias("asked_mrn"), F.explode(F.concat("document_ids", F.array(F.lit("doc-unknown")))).alias("document_id"))
    return records.ownership_problem(asked.join(reg, "document_id", "left")).select("request_id", "document_id", "verdict")


@query("""SELECT patient_mrn, patient_name, round(score, 4) AS score FROM (SELECT patient_mrn, patient_name, CASE WHEN contains('mrn2020givemeasummary', regexp_replace(lower(patient_mrn), '[^a-z0-9]', '', 'g')) THEN 100.0 WHEN n <> '' AND contains(q, n) THEN 100.0 WHEN hit > 0 THEN 60.0 + 35.0 * hit ELSE 0.0 END AS score FROM (
  SELECT *, len(list_filter(w, lambda x: list_contains(string_split(q, ' '), x))) / greatest(len(w), 1) AS hit FROM (SELECT *, list_filter(string_split(n, ' '), lambda x: length(x) > 1) AS w FROM (
  SELECT DISTINCT patient_mrn, patient_name, 'show corin and tamsin results' AS q, trim(regexp_replace(lower(coalesce(patient_name, '')), '[^a-z0-9]+', ' ', 'g')) AS n FROM doc_pages WHERE patient_mrn IS NOT NULL)))) WHERE score >= 70""")
def identity_resolution(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "doc_pages").filter("patient_mrn IS NOT NULL").select("patient_mrn", "patient_name").distinct()
    s = p.withColumn("score", records.identity_score(F.lit("show Corin and Tamsin results"), F.col("patient_mrn"), F.col("patient_name")))
    return s.filter("score >= 70").select("patient_mrn", "patient_name", F.round("score", 4).alias("score"))


@query("""WITH p AS (SELECT *, list_filter(string_split(n, ' '), lambda x: length(x) > 1) AS w FROM (SELECT DISTINCT patient_mrn, patient_name, regexp_replace(lower(patient_mrn), '[^a-z0-9]', '', 'g') AS m, trim(regexp_replace(lower(coalesce(patient_name, '')), '[^a-z0-9]+', ' ', 'g')) AS n FROM doc_pages WHERE patient_mrn IS NOT NULL)),
  r AS (SELECT request_id, regexp_replace(lower(message), '[^a-z0-9]', '', 'g') AS s, trim(regexp_replace(lower(coalesce(message, '')), '[^a-z0-9]+', ' ', 'g')) AS q FROM chat_requests)
  SELECT request_id, patient_mrn, patient_name, round(score, 4) AS score FROM (SELECT request_id, patient_mrn, patient_name, CASE WHEN m <> '' AND contains(s, m) THEN 100.0 WHEN n <> '' AND contains(q, n) THEN 100.0 WHEN hit > 0 THEN 60.0 + 35.0 * hit ELSE 0.0 END AS score
  FROM (SELECT *, len(list_filter(w, lambda x: list_contains(string_split(q, ' '), x))) / greatest(len(w), 1) AS hit FROM r, p)) WHERE score >= 70""")
def identity_requests(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "doc_pages").filter("patient_mrn IS NOT NULL").select("patient_mrn", "patient_name")
    s = records.identity_matches(table(spark, d, "chat_requests"), "request_id", "message", p, "patient_mrn", "patient_name")
    return s.select("request_id", "patient_mrn", "patient_name", F.round("score", 4).alias("score"))


_KEY = "trim(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9]+', ' ', 'g'))"
_MKEY = " || chr(31) || ".join(_KEY.format(c=c) for c in ("name", "dose", "route", "frequency"))


@query(f"SELECT document_id, min(med_id) AS med_id FROM medications WHERE trim({' || '.join(_KEY.format(c=c) for c in ('name', 'dose', 'route', 'frequency'))}) <> '' GROUP BY document_id, {_MKEY}")
def merge_extractions(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "medications").select("document_id", "med_id", "name", "dose", "route", "frequency")
    return records.merged_lists(m, "document_id", ["name", "dose", "route", "frequency"], "med_id").select("document_id", "med_id")


@query()
def pack_groups(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "doc_pages").filter("page_content IS NOT NULL")
    return documents.packed(pages, "document_id", "page_id", F.length("page_content"), 22_000)


@query("SELECT result_id, passed, is_complex, CASE WHEN n = 0 THEN 'NO_EVIDENCE' WHEN s = 0 THEN CASE WHEN n >= 2 THEN 'MODERATE' ELSE 'LOW' END WHEN s >= 0.8 AND n >= 3 THEN 'HIGH' WHEN s >= 0.4 AND n >= 2 THEN 'MODERATE' ELSE 'LOW' END AS band FROM (SELECT *, score AS n, score / greatest(max_score, 1) AS s FROM custom_robert_live_eval_results)")
def confidence_band(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "custom_robert_live_eval_results")
    return r.select("result_id", "passed", "is_complex", fusion.confidence(F.col("score"), F.col("score") / F.greatest("max_score", F.lit(1))).alias("band"))


@query("SELECT run_id, is_complex, count(*) AS n, sum(CASE WHEN passed THEN 1 ELSE 0 END) AS passed, round(avg(latency_s), 6) AS latency FROM custom_robert_live_eval_results GROUP BY GROUPING SETS ((run_id, is_complex), (run_id), ())")
def eval_rollup(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "custom_robert_live_eval_results").select("run_id", "is_complex", "passed", "latency_s")
    return r.rollup("run_id", "is_complex").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("passed").cast("int")).alias("passed"), F.round(F.avg("latency_s"), 6).alias("latency"))


@query("SELECT document_id || CASE WHEN CAST(right(document_id, 2) AS INT) % 3 = 0 THEN '-v' || CAST(right(document_id, 1) AS INT) ELSE '' END AS document_id, CASE WHEN CAST(right(document_id, 2) AS INT) % 3 = 0 THEN 'v' || CAST(right(document_id, 1) AS INT) ELSE 'v1' END AS version, count(*) AS pages, count(DISTINCT page_number) AS numbers FROM doc_pages GROUP BY 1, 2")
def document_registry(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their version; every third id states one."""
    n = F.right(F.col("document_id"), F.lit(2)).cast("int")
    p = table(spark, d, "doc_pages").withColumn("document_id", F.concat("document_id", F.when(n % 3 == 0, F.concat(F.lit("-v"), F.right(F.col("document_id"), F.lit(1)))).otherwise("")))
    p = p.groupBy("document_id").agg(F.count(F.lit(1)).alias("pages"), F.countDistinct("page_number").alias("numbers"))
    return p.select("document_id", version_of(F.col("document_id")).alias("version"), "pages", "numbers")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def tumbling_rate(spark: SparkSession, d: str) -> DataFrame:
    return windows.rates(table(spark, d, "events"), "ts", "event_type")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 24 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS b FROM events),
  s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 24 HOUR AS session_end, count(*) AS n FROM s GROUP BY user_id, k""")
def idle_sessions(spark: SparkSession, d: str) -> DataFrame:
    return windows.sessions(table(spark, d, "events"), "ts", "user_id")


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderdate >= TIMESTAMP '1995-01-01' GROUP BY n_name""")
def star_join_agg(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").filter("o_orderdate >= '1995-01-01'").select("o_orderkey", "o_custkey")
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey").join(broadcast_if_small(table(spark, d, "nation").select("n_nationkey", "n_name")), F.col("c_nationkey") == F.col("n_nationkey"))
    x = table(spark, d, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return x.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.countDistinct("o_orderkey").alias("orders"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_totals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("qty"), F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT -s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_discount > 0.09)")
def semi_anti(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey")
    idle = c.join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")
    s = table(spark, d, "supplier").select("s_suppkey").join(table(spark, d, "lineitem").filter("l_discount > 0.09").select(F.col("l_suppkey").alias("s_suppkey")), "s_suppkey", "left_semi")
    return idle.unionByName(s.select((-F.col("s_suppkey")).alias("c_custkey")))


@query("""(SELECT patient_mrn FROM labs INTERSECT SELECT patient_mrn FROM medications) EXCEPT SELECT patient_mrn FROM chat_requests""")
def set_ops(spark: SparkSession, d: str) -> DataFrame:
    a, b, c = (table(spark, d, t).select("patient_mrn") for t in ("labs", "medications", "chat_requests"))
    return a.intersect(b).subtract(c)


@query("SELECT o_custkey, o_orderkey, k FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 3")
def window_rank(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("k")).filter("k <= 3")


@query("SELECT event_type, json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY 1, 2")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").alias("k")).groupBy("event_type", "k").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderstatus, " + ", ".join(f"sum(CASE WHEN o_orderpriority = '{p}' THEN 1 ELSE 0 END) AS p{p[0]}" for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")) + " FROM orders GROUP BY o_orderstatus")
def pivot_priorities(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy("o_orderstatus").agg(*[F.sum(F.substring("o_orderpriority", 1, 1).eqNullSafe(F.lit(str(i))).cast("long")).alias(f"p{i}") for i in range(1, 6)])
    return o
