"""Queries over facts of tables, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake.operators import facts
from cairnlake.plans.duck import case, has, quoted, us_date
from cairnlake.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

# Every page gets a table of results and one of benefits below its text; what the pages hold themselves is found as well.
_TABLES = """{page}\n\n| Test | Result | Unit | Reference Range | Flag | Collected |\n| --- | :---: | --- | --- | --- | --- |\n| Sodium | {n}.5 | mmol/L | 135-145 | H | 3/4/{y} |\n| WBC | see note | | | | |\n| Mood | 3/18/2 | | 1-2 | | |\n| pH \\| urine | {n} | | 5-8 | | on file |\n\ntext between\n\n| Service | Copay | Limit |\n|---|---|---|\n| Visit {n} | ${n} | |\n| Therapy | | {n} visits |\n| | | |\n| Drugs |\n"""


def _pages(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "doc_pages")
    n, y = (F.col("page_id") % 90 + 1).cast("string"), (F.col("page_id") % 30).cast("string")
    t = F.lit(_TABLES)
    t = F.replace(F.replace(t, F.lit("{n}"), n), F.lit("{y}"), y)
    return p.select("page_id", "document_id", "section_title", "encounter_date", F.replace(t, F.lit("{page}"), F.coalesce("page_content", F.lit(""))).alias("t"))


def table_facts(spark: SparkSession, d: str) -> DataFrame:
    """Rows of results and benefits of every page, with the page's own date where a row has none."""
    f = facts.row_facts(_pages(spark, d), "t", "section_title", "document_id", "page_id", dates=["encounter_date"])
    return f.select("page_id", "table_id", "row_index", "fact_type", "label", "value", "unit", "reference", "flag", "row_date", "content")


def _sql() -> str:
    pick = lambda n: case([(f"i_{n} > 0", f"r[i_{n}]")], "''")
    plain = "trim(regexp_replace(lower(h), '[^a-z0-9]+', ' ', 'g'))"
    at = lambda n: f"coalesce(list_position(list_transform(headers, lambda h: regexp_matches({plain}, {quoted('|'.join(facts.HEADERS[n]))})" + (f" AND NOT regexp_matches({plain}, {quoted('|'.join(facts.VALUE_IS_NOT))})" if n == "value" else "") + "), true), 0)"
    cells = "list_transform(string_split(replace(regexp_replace(regexp_replace(trim({x}), '^\\|', ''), '\\|$', ''), '\\|', chr(1)), '|'), lambda c: trim(regexp_replace(replace(c, chr(1), '|'), '[ \\t\\r\\f\\v\\n]+', ' ', 'g')))"
    sep = "len(list_filter(" + cells.replace("{x}", "x") + ", lambda q: NOT regexp_matches(q, '^[:\\-\\s]+$'))) = 0"
    return f"""WITH src AS (SELECT page_id, document_id, coalesce(section_title, '') AS section, coalesce(encounter_date, '') AS fallback, replace(replace(replace({quoted(_TABLES)}, '{{n}}', CAST(page_id % 90 + 1 AS VARCHAR)), '{{y}}', CAST(page_id % 30 AS VARCHAR)), '{{page}}', coalesce(page_content, '')) AS t FROM doc_pages),
  l AS (SELECT page_id, unnest(string_split(replace(t, chr(13) || chr(10), chr(10)), chr(10))) AS x, generate_subscripts(string_split(replace(t, chr(13) || chr(10), chr(10)), chr(10)), 1) AS i FROM src),
  g AS (SELECT page_id, trim(x) AS x, i, i - row_number() OVER (PARTITION BY page_id ORDER BY i) AS grp FROM l WHERE regexp_matches(trim(x), '^\\|[^\\n]*\\|')),
  s AS (SELECT *, row_number() OVER (PARTITION BY page_id, grp ORDER BY i) AS k, {sep} AS is_sep FROM g),
  b AS (SELECT page_id, grp, min(CASE WHEN is_sep THEN k END) AS sep, count(*) AS n, list(x ORDER BY i) AS run FROM s GROUP BY page_id, grp),
  n AS (SELECT *, dense_rank() OVER (PARTITION BY page_id ORDER BY grp) - 1 AS run_no FROM b),
  c AS (SELECT page_id, run_no, {cells.replace('{x}', 'run[sep - 1]')} AS headers, list_transform(run[sep + 1:], lambda y: {cells.replace('{x}', 'y')}) AS body FROM n WHERE sep > 1 AND sep < n),
  w AS (SELECT *, greatest(len(headers), list_max(list_transform(body, lambda r: len(r)))) AS width FROM c),
  p AS (SELECT page_id, run_no, list_resize(headers, width, '') AS headers, list_transform(body, lambda r: list_resize(r, width, '')) AS body, width FROM w),
  k AS (SELECT p.*, s.document_id, s.section, s.fallback, array_to_string(headers, ' ') || ' ' || section AS ctx FROM p JOIN src s USING (page_id)),
  m AS (SELECT *, {has("ctx || ' ' || array_to_string(list_transform(body[1:6], lambda r: array_to_string(r, ' ')), ' ')", facts.ADMIN_CONTEXT)} AS admin, {has('ctx', facts.CLINICAL_CONTEXT)} OR {has("array_to_string(list_transform(body[1:12], lambda r: r[1]), ' ')", facts.ROW_LABEL)} AS clinical, {', '.join(f'{at(n)} AS j_{n}' for n in facts.HEADERS)} FROM k),
  o AS (SELECT * EXCLUDE (body), CASE WHEN j_label = 0 AND width >= 2 THEN 1 ELSE j_label END AS i_label, CASE WHEN j_value = 0 AND width >= 2 AND NOT admin AND j_reference <> 2 THEN 2 ELSE j_value END AS i_value, {', '.join(f'j_{n} AS i_{n}' for n in facts.HEADERS if n not in ('label', 'value'))}, unnest(body) AS r, generate_subscripts(body, 1) - 1 AS row_index FROM m WHERE admin OR clinical),
  f AS (SELECT page_id, document_id || ':table:' || run_no AS table_id, row_index, admin, r, fallback, {', '.join(f'{pick(n)} AS v_{n}' for n in facts.HEADERS)} FROM o WHERE trim(array_to_string(r, ' ')) <> ''),
  e AS (SELECT *, CASE WHEN v_date <> '' THEN coalesce({us_date('v_date')}, v_date) ELSE fallback END AS row_date, CASE WHEN v_label <> '' THEN v_label ELSE substr(array_to_string(list_filter(r, lambda z: z <> ''), ' '), 1, 80) END AS name, coalesce(nullif(v_value, ''), nullif(v_copay, ''), nullif(v_coinsurance, ''), nullif(v_limit, ''), '') AS cover FROM f)
  SELECT page_id, table_id, CAST(row_index AS INT) AS row_index, CASE WHEN admin THEN 'administrative_benefit' ELSE 'lab_or_vital_result' END AS fact_type, name AS label, CASE WHEN admin THEN cover ELSE v_value END AS value, v_unit AS unit, v_reference AS reference, v_flag AS flag, row_date,
    CASE WHEN admin THEN 'ADMINISTRATIVE_BENEFIT | Benefit: ' || name || ' | Coverage: ' || cover || ' | Copay: ' || v_copay || ' | Coinsurance: ' || v_coinsurance || ' | Limit: ' || v_limit || ' | Date: ' || row_date
    ELSE 'LAB_OR_VITAL_RESULT | Test: ' || v_label || ' | Value: ' || v_value || ' | Unit: ' || v_unit || ' | Reference range: ' || v_reference || ' | Flag: ' || v_flag || ' | Document class: ' || v_class || ' | Interpretation: ' || v_interpretation || ' | Date: ' || row_date END AS content
  FROM e WHERE CASE WHEN admin THEN name <> '' AND cover <> '' ELSE v_label <> '' AND length(v_value) <= 80 AND regexp_matches(v_value, '\\d') AND NOT regexp_matches(v_value, '\\):|\\(:') AND NOT regexp_matches(v_value, '^\\d{{1,2}}/\\d{{1,2}}/\\d{{1,4}}$') AND {has('v_value', facts.MEASUREMENT)} AND ({has('v_label', facts.ROW_LABEL)} OR v_unit || v_reference || v_flag <> '') END"""


QUERIES["table_facts"] = table_facts
ORACLES["table_facts"] = _sql()
