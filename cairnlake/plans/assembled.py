"""Queries that put documents, patients, sessions and replies together, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake.operators import assembly
from cairnlake.plans.duck import quoted
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


_OFF = "SELECT page_id, document_id, coalesce(sum(coalesce(length(page_content), 0) + 2) OVER (PARTITION BY document_id ORDER BY page_number, page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_pos, coalesce(length(page_content), 0) AS n FROM doc_pages"


def _offsets(spark: SparkSession, d: str) -> DataFrame:
    return assembly.page_offsets(table(spark, d, "doc_pages").select("page_id", "document_id", "page_number", "page_content"), "document_id", ["page_number", "page_id"], "page_content")


@query(f"SELECT page_id, CAST(start_pos AS BIGINT) AS start_pos FROM ({_OFF})")
def page_offsets(spark: SparkSession, d: str) -> DataFrame:
    return _offsets(spark, d).select("page_id", "start_pos")


@query(f"""WITH o AS ({_OFF}), p AS (SELECT document_id, unnest(range(0, CAST(max(start_pos + n) AS BIGINT) + 1, 700)) AS pos FROM o GROUP BY document_id)
  SELECT p.document_id, pos, o.page_id FROM p ASOF JOIN (SELECT document_id, start_pos, max(page_id) AS page_id FROM o GROUP BY ALL) o ON p.document_id = o.document_id AND p.pos >= o.start_pos""")
def page_at_position(spark: SparkSession, d: str) -> DataFrame:
    """The page of every 700th character of every document."""
    pages = _offsets(spark, d).withColumn("n", F.coalesce(F.length("page_content"), F.lit(0)))
    spots = pages.groupBy("document_id").agg(F.max(F.col("start_pos") + F.col("n")).alias("_z")).select("document_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_z"), F.lit(700).cast("long"))).alias("pos"))
    return assembly.page_at(spots, pages, "document_id", "pos", "page_id")


@query("SELECT page_id, row_number() OVER w - 1 AS chunk_no, round((row_number() OVER w - 1) / greatest(count(*) OVER (PARTITION BY document_id) - 1, 1), 4) AS position FROM doc_pages WINDOW w AS (PARTITION BY document_id ORDER BY page_number, page_id)")
def chunk_positions(spark: SparkSession, d: str) -> DataFrame:
    return assembly.positions(table(spark, d, "doc_pages").select("page_id", "document_id", "page_number"), "document_id", ["page_number", "page_id"]).select("page_id", "chunk_no", "position")


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """Pages in windows of 1,000 characters, each of which begins 200 before the end of the last."""
    p = table(spark, d, "doc_pages").filter("page_content <> ''").select("page_id", "document_id", "patient_mrn", "page_number", "page_content")
    last = F.greatest(F.ceil((F.length("page_content") - 200) / 800).cast("int"), F.lit(1)) - 1
    return p.select("page_id", "document_id", "patient_mrn", "page_number", F.explode(F.sequence(F.lit(0), last)).alias("k"), "page_content").withColumn("t", F.substring("page_content", F.col("k") * 800 + 1, F.lit(1000))).drop("page_content")


_CH = "SELECT page_id, document_id, patient_mrn, page_number, k, substr(page_content, k * 800 + 1, 1000) AS t FROM (SELECT *, unnest(range(0, greatest(CAST(ceil((length(page_content) - 200) / 800) AS INT), 1))) AS k FROM doc_pages WHERE page_content <> '')"
_CUT = "SELECT * EXCLUDE (t, b), CASE WHEN b IS NULL THEN t ELSE substr(t, 1 + coalesce(list_max(list_filter(range(31, least(length(b), length(t), 250) + 1), lambda n: right(b, n) = left(t, n))), 0)) END AS t FROM (SELECT *, lag(t) OVER (PARTITION BY {by} ORDER BY {order}) AS b FROM ({ch}))"


@query(f"SELECT page_id, k, t AS piece FROM ({_CUT.format(by='page_id', order='k', ch=_CH)})")
def overlap_strip(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping windows of every page without what repeats the window before."""
    return assembly.without_overlap(_chunks(spark, d), "page_id", ["k"], "t").select("page_id", "k", F.col("t").alias("piece"))


@query(f"SELECT document_id, count(*) AS chunks, sha256(string_agg(CASE WHEN trim(t) <> '' THEN t END, chr(10) || chr(10) ORDER BY page_id, k)) AS digest FROM ({_CUT.format(by='page_id', order='k', ch=_CH)}) GROUP BY document_id")
def document_text(spark: SparkSession, d: str) -> DataFrame:
    """All chunks of every document as one text, as a digest."""
    m = assembly.merged_text(_chunks(spark, d), "document_id", "page_id", ["k"], "t")
    return m.select("document_id", "chunks", F.sha2("merged", 256).alias("digest"))


@query(f"SELECT patient_mrn, count(*) AS chunks, sha256(string_agg(CASE WHEN trim(t) <> '' THEN t END, chr(10) || chr(10) ORDER BY page_id, k)) AS digest FROM ({_CUT.format(by='page_id', order='k', ch=_CH)}) WHERE patient_mrn IS NOT NULL GROUP BY patient_mrn")
def patient_text(spark: SparkSession, d: str) -> DataFrame:
    """All chunks of every patient as one text, as a digest."""
    m = assembly.merged_text(_chunks(spark, d).filter("patient_mrn IS NOT NULL"), "patient_mrn", "page_id", ["k"], "t")
    return m.select("patient_mrn", "chunks", F.sha2("merged", 256).alias("digest"))


@query("SELECT page_id, sort_date, row_number() OVER (PARTITION BY document_id ORDER BY sort_date DESC, page_id) AS rank FROM (SELECT page_id, document_id, coalesce(nullif(trim(encounter_date), ''), strftime(ingested_at, '%Y-%m-%d'), '') AS sort_date FROM doc_pages)")
def chronology(spark: SparkSession, d: str) -> DataFrame:
    """Pages of every document from the latest date, by text order."""
    p = table(spark, d, "doc_pages").select("page_id", "document_id", "encounter_date", F.date_format("ingested_at", "yyyy-MM-dd").alias("ingested"))
    return assembly.chronological(p, "document_id", ["encounter_date", "ingested"], "page_id").select("page_id", "sort_date", "rank")


@query("""WITH p AS (SELECT patient_mrn, nullif(trim(patient_name), '') AS n, source_file, page_id FROM doc_pages)
  SELECT patient_mrn, arg_min(n, page_id) FILTER (WHERE n IS NOT NULL) AS patient_name, arg_min(source_file, page_id) FILTER (WHERE source_file IS NOT NULL) AS source_file, count(*) AS pages FROM p WHERE patient_mrn IS NOT NULL GROUP BY patient_mrn
  UNION ALL SELECT NULL, n, arg_min(source_file, page_id) FILTER (WHERE source_file IS NOT NULL), count(*) FROM p WHERE patient_mrn IS NULL AND n IS NOT NULL AND n NOT IN (SELECT n FROM p WHERE patient_mrn IS NOT NULL AND n IS NOT NULL) GROUP BY n""")
def list_patients(spark: SparkSession, d: str) -> DataFrame:
    return assembly.patients(table(spark, d, "doc_pages").select("patient_mrn", "patient_name", "source_file", "page_id"), "patient_mrn", "patient_name", "source_file", "page_id")


@query("""SELECT session_id, coalesce(sum(input_tokens), 0) AS input_tokens, coalesce(sum(output_tokens), 0) AS output_tokens, coalesce(sum(total_tokens), 0) AS total_tokens, round(coalesce(sum(cost_usd), 0), 8) AS cost, count(*) AS requests,
  (SELECT string_agg(model, ',' ORDER BY o, model) FROM (SELECT v.model, min(v.record_id) AS o FROM usage_records v WHERE v.session_id = u.session_id AND v.model IS NOT NULL GROUP BY v.model)) AS models FROM usage_records u WHERE session_id IS NOT NULL GROUP BY session_id""")
def usage_totals(spark: SparkSession, d: str) -> DataFrame:
    """What every session used, with its models in order of first use."""
    return assembly.usage_totals(table(spark, d, "usage_records").filter("session_id IS NOT NULL"), "session_id", "record_id")


@query("SELECT session_id, record_id, count(*) OVER w AS requests, coalesce(sum(total_tokens) OVER w, 0) AS total_tokens, round(coalesce(sum(cost_usd) OVER w, 0), 8) AS cost FROM usage_records WHERE session_id IS NOT NULL WINDOW w AS (PARTITION BY session_id ORDER BY record_id)")
def running_ledger(spark: SparkSession, d: str) -> DataFrame:
    return assembly.running_ledger(table(spark, d, "usage_records").filter("session_id IS NOT NULL"), "session_id", "record_id")


@query("""WITH l AS (SELECT session_id, sum(total_tokens) AS total_tokens, count(*) AS requests FROM usage_records GROUP BY session_id)
  SELECT a.session_id, CAST(coalesce(total_tokens, 0) AS BIGINT) AS total_tokens, coalesce(requests, 0) AS requests FROM (SELECT DISTINCT session_id FROM chat_requests WHERE session_id IS NOT NULL) a LEFT JOIN l USING (session_id)""")
def ledger_read(spark: SparkSession, d: str) -> DataFrame:
    """The ledger of every session that asks, zero for one without usage."""
    u = table(spark, d, "usage_records").groupBy("session_id").agg(F.sum("total_tokens").alias("total_tokens"), F.count(F.lit(1)).alias("requests"))
    return assembly.totals_of(table(spark, d, "chat_requests").filter("session_id IS NOT NULL"), u, "session_id")


_REPLY = "CASE record_id % 4 WHEN 0 THEN '{\"usage_metadata\": {\"input_tokens\": ' || i || ', \"output_tokens\": ' || o || ', \"input_token_details\": {\"cache_read\": ' || c || '}}}' WHEN 1 THEN '{\"response_metadata\": {\"token_usage\": {\"prompt_tokens\": ' || i || ', \"completion_tokens\": ' || o || ', \"total_tokens\": ' || (i + o) || ', \"prompt_tokens_details\": {\"cached_tokens\": ' || c || '}}}}' WHEN 2 THEN '{\"prompt_token_count\": \"' || i || '\", \"candidates_token_count\": ' || o || ', \"cached_content_token_count\": ' || c || '}' ELSE 'no json' END"


@query("""SELECT record_id, CASE WHEN record_id % 4 = 3 THEN 0 ELSE i END AS input, CASE WHEN record_id % 4 = 3 THEN 0 ELSE o END AS output, CASE WHEN record_id % 4 = 3 THEN 0 ELSE least(c, i) END AS cached, CASE WHEN record_id % 4 = 3 THEN 0 ELSE i + o END AS total
  FROM (SELECT record_id, coalesce(input_tokens, 0) AS i, coalesce(output_tokens, 0) AS o, coalesce(cached_input_tokens, 0) AS c FROM usage_records)""")
def token_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts read back from replies of three notations and of none."""
    u = table(spark, d, "usage_records").select("record_id", *[F.coalesce(c, F.lit(0)).alias(n) for c, n in (("input_tokens", "i"), ("output_tokens", "o"), ("cached_input_tokens", "c"))])
    return u.select("record_id", assembly.token_counts(F.expr(_REPLY)).alias("x")).select("record_id", "x.*")


_STATED = ", ".join(f"regexp_extract_all(coalesce(reply, ''), {quoted('(?i)' + p)}, 0)" for p in assembly.STATED)


@query(f"""WITH e AS (SELECT result_id, coalesce(question, '') AS q, flatten([{_STATED}]) AS v FROM custom_robert_live_eval_results), n AS (SELECT *, list_transform(v, lambda x: regexp_extract(x, '\\d+(?:\\.\\d+)?')) AS k FROM e)
  SELECT result_id, array_to_string(CASE WHEN q = '' THEN [] ELSE list_filter(list_transform(list_filter(range(1, len(v) + 1), lambda i: list_position(k, k[i]) = i), lambda i: trim(v[i])), lambda x: NOT contains(regexp_replace(lower(q), '\\s+', '', 'g'), regexp_replace(lower(x), '\\s+', '', 'g')) AND NOT contains(lower(q), lower(x))) END, '; ') AS unsupported FROM n""")
def numeric_support(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of every reply that its question does not state."""
    r = table(spark, d, "custom_robert_live_eval_results")
    return r.select("result_id", F.array_join(assembly.unsupported_numbers(F.col("reply"), F.col("question")), "; ").alias("unsupported"))


_JS = "CASE result_id % 4 WHEN 0 THEN '```json' || chr(10) || '{\"id\": ' || result_id || '}' || chr(10) || '```' WHEN 1 THEN 'Here it is: {\"id\": ' || result_id || '} as asked' WHEN 2 THEN '[1, 2]' ELSE label END"


@query("SELECT result_id, CASE WHEN result_id % 4 < 2 THEN CAST(result_id AS VARCHAR) END AS id FROM custom_robert_live_eval_results")
def tolerant_json(spark: SparkSession, d: str) -> DataFrame:
    """Objects in fences, behind words, or none."""
    r = table(spark, d, "custom_robert_live_eval_results")
    return r.select("result_id", F.get_json_object(assembly.json_object(F.expr(_JS.replace("chr(10)", "char(10)"))), "$.id").alias("id"))


@query("SELECT request_id, array_to_string(list_filter(list_distinct(list_transform(coalesce(document_ids, []), lambda x: trim(x))), lambda x: x <> ''), ',') AS ids FROM chat_requests WHERE len(coalesce(document_ids, [])) < 2 UNION ALL SELECT request_id, array_to_string(list_transform(list_filter(range(1, len(u) + 1), lambda i: list_position(u, u[i]) = i AND u[i] <> ''), lambda i: u[i]), ',') FROM (SELECT request_id, list_transform(document_ids, lambda x: trim(x)) AS u FROM chat_requests WHERE len(document_ids) >= 2)")
def document_id_lists(spark: SparkSession, d: str) -> DataFrame:
    """Ids written as JSON or between commas, read as lists again."""
    ids = F.coalesce("document_ids", F.array().cast("array<string>"))
    written = F.when(F.col("request_id") % 2 == 0, F.to_json(ids)).otherwise(F.array_join(ids, " , "))
    return table(spark, d, "chat_requests").select("request_id", F.array_join(assembly.id_list(written), ",").alias("ids"))


@query("SELECT message_id, length(coalesce(content, '')) AS n_chars, len(regexp_extract_all(coalesce(content, ''), '[\\s\\x{85}\\p{Z}]+|[^\\s\\x{85}\\p{Z}]+')) AS pieces, coalesce(content, '') AS text FROM chat_messages".replace("[\\s\\x{85}\\p{Z}]+|[^\\s\\x{85}\\p{Z}]+", "[ \\t\\n\\r\\f\\x0b]+|[^ \\t\\n\\r\\f\\x0b]+"))
def stream_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Messages in pieces for a stream, and put together again."""
    m = table(spark, d, "chat_messages").select("message_id", F.length(F.coalesce("content", F.lit(""))).alias("n_chars"), assembly.token_pieces(F.col("content")).alias("p"))
    return m.select("message_id", "n_chars", F.size("p").alias("pieces"), F.array_join("p", "").alias("text"))


@query("SELECT message_id, coalesce(content, '') AS text FROM chat_messages")
def message_parts(spark: SparkSession, d: str) -> DataFrame:
    """The spoken text of messages that are lists of parts, some of which only think."""
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    c = F.coalesce("content", F.lit(""))
    listed = F.to_json(F.array(part("thinking", F.lit("let me see")), part("text", F.substring(c, 1, 10)), part("text", F.substring(c, F.lit(11), F.length(c)))))
    m = table(spark, d, "chat_messages")
    return m.select("message_id", assembly.message_text(F.when(F.col("message_id") % 2 == 0, listed).otherwise(F.col("content"))).alias("text"))


_S = "list_filter(list_transform(string_split_regex(regexp_replace(coalesce(reply, ''), '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+'), lambda s: trim(s)), lambda s: s <> '')"


@query(f"SELECT result_id, array_to_string(list_transform(list_filter(range(1, len(s) + 1), lambda i: list_position(list_transform(s, lambda x: lower(x)), lower(s[i])) = i), lambda i: s[i]), '|') AS sentences FROM (SELECT result_id, {_S} AS s FROM custom_robert_live_eval_results)")
def reply_sentences(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "custom_robert_live_eval_results")
    return r.select("result_id", F.array_join(assembly.sentence_candidates(F.col("reply")), "|").alias("sentences"))


@query("SELECT CAST(received_at AS DATE)::VARCHAR AS day, session_id, count(*) AS n, min(turn) AS first_turn, substr(arg_min(content, {'t': turn, 'm': message_id}), 1, 80) AS title FROM chat_messages WHERE role = 'user' AND content <> '' GROUP BY ALL")
def session_days(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of each day with their first question."""
    m = table(spark, d, "chat_messages").filter("role = 'user' AND content <> ''").withColumn("day", F.date_format("received_at", "yyyy-MM-dd"))
    return m.groupBy("day", "session_id").agg(F.count(F.lit(1)).alias("n"), F.min("turn").alias("first_turn"), F.substring(F.min_by("content", F.struct("turn", "message_id")), 1, 80).alias("title"))
