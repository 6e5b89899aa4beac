"""Queries over the clinical texts: metadata, requests, orders, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake.operators import metadata, orders, understanding
from cairnlake.plans.duck import case, group, has, one_if, quoted, stripped, us_date
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


# ---- metadata -----------------------------------------------------------------------------------

_SECTION = case([(has("coalesce(section_title, '')", p), quoted(n)) for n, p in metadata.SECTION_RULES], "'other'")


@query(f"SELECT category, count(*) AS n FROM (SELECT {_SECTION} AS category FROM doc_pages) GROUP BY category")
def section_category(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "doc_pages").select(metadata.section_category(F.col("section_title")).alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


_HITS = ", ".join(" + ".join(f"len(regexp_extract_all(t, {quoted('(?i)' + p)}))" for p in ps) + f" AS h{i}" for i, (_, ps) in enumerate(metadata.TYPE_RULES))
_MOST = f"greatest({', '.join(f'h{i}' for i in range(len(metadata.TYPE_RULES)))})"


@query(f"SELECT page_id, {case([(f'{_MOST} > 0 AND h{i} = {_MOST}', quoted(n)) for i, (n, _) in enumerate(metadata.TYPE_RULES)], quoted('general'))} AS kind FROM (SELECT page_id, {_HITS} FROM (SELECT page_id, lower(substr(coalesce(page_content, ''), 1, 5000)) AS t FROM doc_pages))")
def doc_type_classify(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "doc_pages").select("page_id", metadata.document_type(F.col("page_content")).alias("kind"))


def _header(spark: SparkSession, d: str) -> DataFrame:
    """Every page with a head of labels, as a letter or export has one."""
    p = table(spark, d, "doc_pages")
    name = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("Patient Name: "), "patient_name")).when(F.col("page_id") % 3 == 1, F.concat(F.lit("Name: "), "patient_name", F.lit(","))).otherwise(F.concat(F.lit("**Patient** "), "patient_name"))
    day = F.date_format("ingested_at", "M/d/yy")
    label = F.element_at(F.array(*[F.lit(x) for x in ("Collected: ", "Resulted: ", "Order date: ", "Study date: ", "")]), (F.col("page_id") % 5 + 1).cast("int"))
    return p.select("page_id", F.concat_ws("\n", F.concat(F.lit("Facility: "), "source_file"), F.concat(F.lit("Unit: Ward "), "tenant_id"), name, F.concat(label, day), "page_content").alias("t"))


_HEADER = """SELECT page_id, concat_ws(chr(10), 'Facility: ' || source_file, 'Unit: Ward ' || tenant_id, CASE page_id % 3 WHEN 0 THEN 'Patient Name: ' || patient_name WHEN 1 THEN 'Name: ' || patient_name || ',' ELSE '**Patient** ' || patient_name END,
  ['Collected: ', 'Resulted: ', 'Order date: ', 'Study date: ', ''][page_id % 5 + 1] || strftime(ingested_at, '%-m/%-d/%y'), page_content) AS t FROM doc_pages"""
_NAME = [f"regexp_replace({stripped(group('substr(t, 1, 3000)', p))}, '[,.]+$', '')" for p in metadata.NAMES]
_NAME_SQL = case([(f"length({c}) > 2 AND regexp_matches({c}, '^\\p{{L}}') AND len(list_filter(string_split_regex({c}, '\\s+'), lambda w: regexp_matches(w, '^\\p{{L}}.'))) >= 2", c) for c in _NAME])
_FAC = [f"regexp_replace({stripped(group('substr(t, 1, 4000)', p, 1, 'im'))}, '[,.]+$', '')" for p in metadata.FACILITIES]
_LOC = [stripped(group("substr(t, 1, 8000)", p)) for p in metadata.LOCATIONS]
_DAYS = ", ".join(us_date(group("substr(t, 1, 2000)", p, 1, "im")) for p in metadata.CLINICAL_DATES)


@query(f"""SELECT page_id, {_NAME_SQL} AS patient_name, {case([(f'length({c}) > 4', c) for c in _FAC])} AS facility, {case([(f"{c} <> ''", c) for c in _LOC])} AS location, coalesce({_DAYS}) AS clinical_date FROM ({_HEADER})""")
def page_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Name, facility, location and clinical date of every page below a head of labels."""
    t = F.col("t")
    return _header(spark, d).select("page_id", metadata.patient_name(t).alias("patient_name"), metadata.facility(t).alias("facility"), metadata.location(t).alias("location"), metadata.clinical_date(t).alias("clinical_date"))


_DX = case([("contains(l, 'type 2 diabetes') OR contains(l, 't2dm')", "['diabetes', 'type 2 diabetes']"), ("contains(l, 'type 1 diabetes') OR contains(l, 't1dm')", "['diabetes', 'type 1 diabetes']"), ("contains(l, 'diabetes') OR contains(l, 'hba1c')", "['diabetes']")], "CAST([] AS VARCHAR[])")
_MEDS = f"CASE WHEN regexp_matches(l, {quoted(metadata.MEDICATION_HINT)}) THEN list_sort(list_distinct(list_transform(regexp_extract_all(t, {quoted('(?i)' + metadata.DOSED)}, 1), lambda x: lower(x)))) ELSE CAST([] AS VARCHAR[]) END"


@query(f"SELECT doc_id, array_to_string({_DX}, '; ') AS diagnoses, array_to_string({_MEDS}, '; ') AS medications FROM (SELECT doc_id, coalesce(text, '') AS t, lower(coalesce(text, '')) AS l FROM documents)")
def document_tags(spark: SparkSession, d: str) -> DataFrame:
    """Diagnoses and dosed medications of every document."""
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.array_join(metadata.diagnoses(t), "; ").alias("diagnoses"), F.array_join(F.array_sort(metadata.dosed_medications(t)), "; ").alias("medications"))


def _readings(spark: SparkSession, d: str) -> DataFrame:
    """Notes of one A1C series a patient, a third of them denied."""
    x = table(spark, d, "labs").filter("test = 'HbA1c' AND document_id IS NOT NULL AND date_time IS NOT NULL").select("document_id", "lab_id", "value", "date_time")
    line = F.concat(F.when(F.col("lab_id") % 3 == 0, "denied: ").otherwise("seen "), F.date_format("date_time", "MM/dd/yyyy"), F.lit(" HbA1c: "), F.coalesce("value", F.lit("open")), F.lit(" with rest and calm and long words behind it to part the lines from each other in full, as a chart of many lines would do; "))
    return x.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lab_id", line.alias("line")))), lambda r: r["line"]), "").alias("t"))


_A1C = metadata.A1C
_DENIED = " OR ".join(f"contains(lower(b), {quoted(w)})" for w in metadata.NEGATIONS)


@query(f"""WITH n AS (SELECT document_id, string_agg(CASE WHEN lab_id % 3 = 0 THEN 'denied: ' ELSE 'seen ' END || strftime(date_time, '%m/%d/%Y') || ' HbA1c: ' || coalesce(value, 'open') || ' with rest and calm and long words behind it to part the lines from each other in full, as a chart of many lines would do; ', '' ORDER BY lab_id) AS t FROM labs WHERE test = 'HbA1c' AND document_id IS NOT NULL AND date_time IS NOT NULL GROUP BY document_id),
  m AS (SELECT document_id, t, unnest(regexp_split_to_array(t, '(?i){_A1C}')[:-2]) AS g, unnest(regexp_extract_all(t, '(?i){_A1C}', 0)) AS h, generate_subscripts(regexp_extract_all(t, '(?i){_A1C}', 0), 1) AS i FROM n),
  p AS (SELECT *, sum(length(g) + length(h)) OVER (PARTITION BY document_id ORDER BY i) - length(h) AS pos FROM m), q AS (SELECT *, substr(t, greatest(pos - 100, 0)::INT + 1, least(pos, 100)::INT) AS b FROM p),
  dd AS (SELECT document_id, unnest(regexp_split_to_array(t, '\\b\\d{{1,2}}[/\\-]\\d{{1,2}}[/\\-]\\d{{2,4}}\\b')[:-2]) AS g, unnest(regexp_extract_all(t, '\\b\\d{{1,2}}[/\\-]\\d{{1,2}}[/\\-]\\d{{2,4}}\\b', 0)) AS h, generate_subscripts(regexp_extract_all(t, '\\b\\d{{1,2}}[/\\-]\\d{{1,2}}[/\\-]\\d{{2,4}}\\b', 0), 1) AS i FROM n),
  e AS (SELECT document_id, {us_date('h')} AS day, sum(length(g) + length(h)) OVER (PARTITION BY document_id ORDER BY i) - length(h) AS pos FROM dd),
  v AS (SELECT q.document_id, TRY_CAST(regexp_extract(q.h, '(\\d+(?:\\.\\d+)?)$', 1) AS DOUBLE) AS value, q.pos, (SELECT arg_min(e.day, {{'f': abs(e.pos - q.pos), 'a': e.pos}}) FROM e WHERE e.document_id = q.document_id AND e.day IS NOT NULL) AS day FROM q WHERE NOT ({_DENIED}))
  SELECT n.document_id, v.value, v.day FROM n LEFT JOIN (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY value DESC, (day IS NOT NULL) DESC, pos) = 1) v ON v.document_id = n.document_id""")
def a1c_readings(spark: SparkSession, d: str) -> DataFrame:
    """The highest A1C of every note that is not denied, with its nearest date."""
    return _readings(spark, d).select("document_id", metadata.a1c_reading(F.col("t")).alias("r")).select("document_id", "r.value", "r.day")


@query(f"SELECT page_id, {us_date('d')} AS month_first, CASE WHEN regexp_matches(trim(d), '^\\d{{1,2}}/\\d{{1,2}}/(\\d{{2}}|\\d{{4}})$') THEN CAST(TRY_CAST(printf('%04d-%02d-%02d', CASE WHEN regexp_matches(trim(d), '/\\d{{4}}$') THEN TRY_CAST(split_part(trim(d), '/', 3) AS INT) WHEN TRY_CAST(split_part(trim(d), '/', 3) AS INT) >= 69 THEN 1900 + TRY_CAST(split_part(trim(d), '/', 3) AS INT) ELSE 2000 + TRY_CAST(split_part(trim(d), '/', 3) AS INT) END, TRY_CAST(split_part(trim(d), '/', 1) AS INT), TRY_CAST(split_part(trim(d), '/', 2) AS INT)) AS DATE) AS VARCHAR) END AS pivoted FROM (SELECT page_id, encounter_date AS d FROM doc_pages)")
def us_dates(spark: SparkSession, d: str) -> DataFrame:
    """Dates written month first: two-digit years as 20xx, and with the pivot 1969."""
    c = F.col("encounter_date")
    return table(spark, d, "doc_pages").select("page_id", metadata.iso_date(c).alias("month_first"), metadata.encounter_date(c).alias("pivoted"))


# ---- requests -----------------------------------------------------------------------------------

_Q = "lower(coalesce(message, ''))"
_REWRITE = "concat_ws(' ', coalesce(message, ''), " + ", ".join(f"CASE WHEN regexp_matches({_Q}, {quoted(p)}) THEN {quoted(s)} END" for p, s in understanding.REWRITES) + ")"
_EXPAND = "concat_ws(' ', coalesce(message, ''), " + ", ".join(f"CASE WHEN regexp_matches({_Q}, '\\b{k}\\b') THEN {quoted(v)} END" for k, v in understanding.EXPANSIONS.items()) + ")"


@query(f"SELECT request_id, {', '.join(f'regexp_matches({_Q}, {quoted(p)}) AS is_{n}' for n, p in understanding.CLASSES.items())}, CASE WHEN {' + '.join(one_if(f'regexp_matches({_Q}, {quoted(p)})') for p in understanding.DOMAINS)} >= 2 THEN 20 ELSE 10 END AS fetch FROM chat_requests")
def request_classes(spark: SparkSession, d: str) -> DataFrame:
    """Classes of every request and the candidates to fetch for it."""
    m = F.col("message")
    return table(spark, d, "chat_requests").select("request_id", *[understanding.is_class(m, n).alias(f"is_{n}") for n in understanding.CLASSES], understanding.fetch_count(m, 10).alias("fetch"))


@query(f"SELECT request_id, {_REWRITE} AS rewritten, {_EXPAND} AS expanded FROM chat_requests")
def query_rewrite(spark: SparkSession, d: str) -> DataFrame:
    """Requests with the terms of their intents, and with abbreviations spelt out."""
    m = F.col("message")
    return table(spark, d, "chat_requests").select("request_id", understanding.rewritten(m).alias("rewritten"), understanding.expanded(m).alias("expanded"))


_BARE = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(coalesce({q}, '')), '(?i)^\\s*for\\s+patient\\s+[^,]{{2,120}},\\s*', ''), '(?i)\\(\\s*mrn\\s*:\\s*[^\\)]+\\)', '', 'g'), '\\s+', ' ', 'g'), '^[ ,]+|[ ,]+$', '', 'g')".replace("{{", "{").replace("}}", "}")


@query(f"SELECT result_id, coalesce(nullif({_BARE.replace('{q}', 'question')}, ''), question, '') AS asked FROM custom_robert_live_eval_results")
def patient_free_question(spark: SparkSession, d: str) -> DataFrame:
    """Questions without the patient named at their head."""
    return table(spark, d, "custom_robert_live_eval_results").select("result_id", understanding.without_patient(F.col("question")).alias("asked"))


_FORBID = " OR ".join(f"contains({_Q}, {quoted(w)})" for w in understanding.FORBIDDEN)


@query(f"SELECT request_id, {case([(f'NOT regexp_matches({_Q}, {quoted(chr(92) + chr(83))})', quoted('empty')), ('length(message) > 10000', quoted('too_long')), (_FORBID, quoted('forbidden'))], quoted('accepted'))} AS verdict FROM (SELECT request_id, CASE request_id % 7 WHEN 0 THEN repeat(message, 300) WHEN 1 THEN 'Please ignore all previous: ' || message WHEN 2 THEN '  ' ELSE message END AS message FROM chat_requests)")
def request_problem(spark: SparkSession, d: str) -> DataFrame:
    """Requests that are not accepted; some are lengthened, emptied or armed for the check."""
    m, k = F.col("message"), F.col("request_id") % 7
    r = table(spark, d, "chat_requests").select("request_id", F.when(k == 0, F.repeat(m, 300)).when(k == 1, F.concat(F.lit("Please ignore all previous: "), m)).when(k == 2, "  ").otherwise(m).alias("message"))
    return r.select("request_id", F.coalesce(understanding.problem(m), F.lit("accepted")).alias("verdict"))


_COHORT = "CASE request_id % 6 WHEN 0 THEN 'patients with type 2 diabetes and HbA1c > 9.5 in the last 6 months' WHEN 1 THEN 'A1C at least ' || (request_id % 9 + 4) || ' last 2 weeks' WHEN 2 THEN 'hba1c <= 7' WHEN 3 THEN 'diabetic patients, a1c less than 8.25 in the last 1 year' ELSE message END"
_SIGN, _WORD = f"regexp_extract(q, {quoted(understanding.COMPARED)}, 1)", f"regexp_extract(q, {quoted(understanding.WORDED)}, 1)"
_OP = case([(f"{_SIGN} = '{s}'", f"'{n}'") for s, n in understanding.SIGNS.items()] + [(f"{_WORD} = '='", "'eq'")] + [(f"{_WORD} <> '' AND regexp_matches(q, {quoted(p)})", f"'{n}'") for p, n in understanding.PHRASES])
_VAL = f"TRY_CAST(CASE WHEN {_SIGN} <> '' THEN regexp_extract(q, {quoted(understanding.COMPARED)}, 2) ELSE regexp_extract(q, {quoted(understanding.WORDED)}, 2) END AS DOUBLE)"
_LAST = "\\blast\\s+(\\d+)\\s*(day|week|month|year)s?\\b"


@query(f"""SELECT request_id, op AS operator, v AS value, TRY_CAST(regexp_extract(q, '{_LAST}', 1) AS INT) * CASE regexp_extract(q, '{_LAST}', 2) WHEN 'day' THEN 1 WHEN 'week' THEN 7 WHEN 'month' THEN 30 WHEN 'year' THEN 365 END AS within_days,
  CASE WHEN NOT regexp_matches(q, '\\bdiabet') THEN '' WHEN regexp_matches(q, '\\btype\\s*2\\b|\\bt2dm\\b') THEN 'diabetes; type 2 diabetes' WHEN regexp_matches(q, '\\btype\\s*1\\b|\\bt1dm\\b') THEN 'diabetes; type 1 diabetes' ELSE 'diabetes' END AS diagnoses
  FROM (SELECT request_id, q, {_OP} AS op, {_VAL} AS v FROM (SELECT request_id, lower(coalesce({_COHORT}, '')) AS q FROM chat_requests)) WHERE op IS NOT NULL AND v IS NOT NULL""")
def cohort_query(spark: SparkSession, d: str) -> DataFrame:
    """Filters that requests for cohorts state; some requests are replaced by such ones for the check."""
    k, m = F.col("request_id") % 6, F.col("message")
    t = (
        F.when(k == 0, "patients with type 2 diabetes and HbA1c > 9.5 in the last 6 months").when(k == 1, F.concat(F.lit("A1C at least "), (F.col("request_id") % 9 + 4).cast("string"), F.lit(" last 2 weeks")))
        .when(k == 2, "hba1c <= 7").when(k == 3, "diabetic patients, a1c less than 8.25 in the last 1 year").otherwise(m)
    )
    r = table(spark, d, "chat_requests").select("request_id", understanding.cohort_filter(t).alias("f")).filter("f IS NOT NULL")
    return r.select("request_id", "f.operator", "f.value", "f.within_days", F.array_join("f.diagnoses", "; ").alias("diagnoses"))


# ---- orders -------------------------------------------------------------------------------------

_U = "regexp_replace(upper(coalesce(page_content, '')), '[À-ɏ]', 'X', 'g')"  # letters beyond ASCII are letters


def _uhas(p: str) -> str:
    return f"regexp_matches({_U}, {quoted(p)})"


_SCORES = [
    f"{one_if(f'regexp_matches(upper(coalesce(section_title, {quoted(str())})), {quoted(orders.SECTION)})')} + {one_if(_uhas(orders.MEDICATION), 2)} + {one_if(_uhas(orders.DOSE), 2)} + {one_if(_uhas(orders.ROUTE))} + {one_if(_uhas(orders.FREQUENCY))} + {one_if(_uhas(orders.CODE) + ' AND ' + _uhas(orders.CODING))}",
    f"{one_if(_uhas(orders.LAB), 3)} + {one_if(_uhas(orders.LAB_UNIT) + ' AND (' + _uhas(orders.LAB) + ' OR ' + _uhas(chr(92) + 'bLAB' + chr(92) + 'b') + ')', 2)} + {one_if(_uhas(orders.CODING))}",
    f"{one_if(_uhas(orders.PROCEDURE), 3)} + {one_if(_uhas(orders.CODING))} + {one_if(_uhas(orders.CODE) + ' AND ' + _uhas('CPT|LOINC'))}",
    f"{one_if(_uhas(orders.REFERRAL), 3)} + {one_if(_uhas(orders.DISCHARGE) + ' AND ' + _uhas(orders.SPECIALTY))} + {one_if(_uhas(orders.CODING))}",
    f"{one_if(_uhas(orders.DISCHARGE), 3)} + {one_if(_uhas(orders.DOSE) + ' AND ' + _uhas(chr(92) + 'b(DISCHARGE|DISPOSITION)' + chr(92) + 'b'), 2)}",
    f"{one_if(_uhas(orders.DIRECTIVE), 2)} + {one_if(_uhas(orders.DISCHARGE))}",
]
_ORDERED = f"""SELECT page_id, document_id, page_number, CASE WHEN top = 0 THEN NULL {' '.join(f"WHEN s{i} = top THEN CASE WHEN {('top >= 4 OR dosed' if i == 0 else 'top >= 2' if i == 5 else 'top >= 3')} THEN {quoted(c)} END" for i, c in enumerate(orders.CATEGORIES))} END AS category
  FROM (SELECT *, greatest(s0, s1, s2, s3, s4, s5) AS top FROM (SELECT page_id, document_id, page_number, {_uhas(orders.DOSE)} AND ({_uhas(orders.ROUTE)} OR {_uhas(orders.FREQUENCY)}) AS dosed, {', '.join(f'{s} AS s{i}' for i, s in enumerate(_SCORES))} FROM doc_pages))"""


@query(f"SELECT page_id, category FROM ({_ORDERED}) WHERE category IS NOT NULL")
def order_category(spark: SparkSession, d: str) -> DataFrame:
    return orders.orders(table(spark, d, "doc_pages"), "page_content", "section_title", "page_id").select("page_id", "category")


@query(f"SELECT document_id, category, count(*) AS pages, min(page_number) AS first_page, string_agg(CAST(page_id AS VARCHAR), ',' ORDER BY page_number, page_id) AS page_ids FROM ({_ORDERED}) WHERE category IS NOT NULL GROUP BY document_id, category")
def order_groups(spark: SparkSession, d: str) -> DataFrame:
    """Order pages of every document by category, in reading order."""
    o = orders.orders(table(spark, d, "doc_pages"), "page_content", "section_title", "page_id", "document_id", "page_number")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("page_number", "page_id"))), lambda x: x["page_id"].cast("string"))
    return o.groupBy("document_id", "category").agg(F.count(F.lit(1)).alias("pages"), F.min("page_number").alias("first_page"), F.array_join(ids, ",").alias("page_ids"))
