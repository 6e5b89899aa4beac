"""Queries over the layout of pages, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake.operators import layout
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


def _words(spark: SparkSession, d: str) -> DataFrame:
    """Pages as words with places: a line is 12 high and its words jitter by up to 2, headings are larger; given backwards."""
    lines = F.filter(F.transform(F.split(F.coalesce("page_content", F.lit("")), "\n"), lambda s, i: F.struct(i.alias("i"), F.filter(F.split(s, r"[ \t]+"), lambda w: w != "").alias("w"))), lambda x: F.size(x["w"]) > 0)
    size = lambda x: F.when(F.try_element_at(x["w"], F.lit(1)).startswith("#"), 14.0).otherwise(10.0)
    words = F.flatten(F.transform(lines, lambda x: F.transform(x["w"], lambda w, j: F.struct(w.alias("text"), (j * 10).cast("double").alias("x"), (x["i"] * 12 + F.when(j == 0, 0).otherwise(j % 3)).cast("double").alias("top"), size(x).alias("size")))))
    return table(spark, d, "doc_pages").select("page_id", F.reverse(words).alias("words"))


_LINES = "SELECT page_id, i, trim(regexp_replace(s, '[ \\t]+', ' ', 'g')) AS s FROM (SELECT page_id, unnest(string_split(page_content, chr(10))) AS s, generate_subscripts(string_split(page_content, chr(10)), 1) AS i FROM doc_pages) WHERE regexp_matches(s, '[^ \\t]')"


@query(f"SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS line_no, s AS line FROM ({_LINES})")
def layout_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines put together from words."""
    return _words(spark, d).select("page_id", F.posexplode(layout.lines_of(F.col("words"))).alias("line_no", "x")).select("page_id", "line_no", F.col("x.text").alias("line"))


_BAD = "|".join(f"(?:{p})" for p in layout.NO_HEADING)
_ALPHA = "len(list_filter(string_split_regex({c}, '\\s+'), lambda w: regexp_matches(w, '^\\p{{L}}{{2,}}$')))"


@query(f"""SELECT page_id, CAST(i - 1 AS INT) AS line_no, s AS line FROM (SELECT *, regexp_replace(x, '^\\s+|\\s+$', '', 'g') AS s FROM (SELECT page_id, unnest(string_split(coalesce(page_content, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(page_content, ''), chr(10)), 1) AS i FROM doc_pages))
  WHERE length(s) >= 3 AND NOT regexp_matches(s, {quoted(_BAD)}) AND NOT regexp_matches(s, {quoted(layout.UNITS)}) AND NOT regexp_matches(s, '[.,;:]$')
  AND ((starts_with(s, '#') AND length(s) < 100) OR (regexp_matches(s, {quoted(layout.NUMBERED)}) AND {_ALPHA.format(c=f'regexp_extract(s, {quoted(layout.NUMBERED)}, 2)')} >= 2)
    OR (upper(s) = s AND lower(s) <> s AND length(s) BETWEEN 6 AND 79 AND NOT regexp_matches(s, '\\d') AND {_ALPHA.format(c='s')} >= 2 AND {_ALPHA.format(c='s')} >= 0.85 * len(string_split_regex(s, '\\s+'))))""")
def heading_lines(spark: SparkSession, d: str) -> DataFrame:
    """Headings by font (lines with a mark are larger), number or capitals."""
    p = table(spark, d, "doc_pages").select("page_id", F.posexplode(F.split(F.coalesce("page_content", F.lit("")), "\n")).alias("line_no", "x"))
    s = F.regexp_replace("x", r"^\s+|\s+$", "")
    size = F.when(s.startswith("#"), 14.0).otherwise(10.0)
    return p.filter(layout.is_heading(s, size, F.lit(10.0))).select("page_id", "line_no", s.alias("line"))


@query("""SELECT document_id, '| Test | Value | Unit |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || replace(trim(regexp_replace(coalesce(test, ''), '\\s+', ' ', 'g')), '|', '\\|') || ' | ' || replace(trim(regexp_replace(coalesce(value, ''), '\\s+', ' ', 'g')), '|', '\\|') || ' | ' || replace(trim(regexp_replace(coalesce(unit, ''), '\\s+', ' ', 'g')), '|', '\\|') || ' |', chr(10) ORDER BY lab_id) AS markdown
  FROM labs WHERE document_id IS NOT NULL AND regexp_replace(coalesce(test, '') || coalesce(value, '') || coalesce(unit, ''), '\\s+', '', 'g') <> '' GROUP BY document_id""")
def markdown_tables(spark: SparkSession, d: str) -> DataFrame:
    """Results of every document as one pipe table."""
    x = table(spark, d, "labs").filter("document_id IS NOT NULL").groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("lab_id", "test", "value", "unit"))).alias("r"))
    rows = F.concat(F.array(F.array(F.lit("Test"), F.lit("Value"), F.lit("Unit"))), F.transform("r", lambda r: F.array(r["test"], r["value"], r["unit"])))
    return x.select("document_id", layout.markdown_table(rows).alias("markdown"))


@query("""WITH p AS (SELECT document_id, sum(length(trim(coalesce(page_content, '')))) AS n, count(*) AS pages FROM doc_pages GROUP BY document_id)
  SELECT document_id, n >= 150 AS substance, n / pages < 50 AS needs_reading FROM p""")
def reading_need(spark: SparkSession, d: str) -> DataFrame:
    """Documents with text enough, and those to be read as pictures."""
    p = table(spark, d, "doc_pages").groupBy("document_id").agg(F.collect_list(F.coalesce("page_content", F.lit(""))).alias("t"))
    return p.select("document_id", layout.has_substance(F.col("t")).alias("substance"), layout.needs_reading(F.col("t")).alias("needs_reading"))


@query("""SELECT page_id, length(trim(t)) >= 30 AND length(regexp_replace(trim(t), '\\P{L}', '', 'g')) / greatest(length(trim(t)), 1) >= 0.25 AS sound, greatest(length(coalesce(page_content, '')), length(t)) AS n_chars
  FROM (SELECT page_id, page_content, CASE page_id % 3 WHEN 0 THEN coalesce(page_content, '') || ' read' WHEN 1 THEN substr(coalesce(page_content, ''), 1, 40) ELSE regexp_replace(coalesce(page_content, ''), '[a-zA-Z]', '1', 'g') END AS t FROM doc_pages)""")
def reading_quality(spark: SparkSession, d: str) -> DataFrame:
    """Readings of three qualities beside the parsed text: which are sound, and how long the better text is."""
    c, k = F.coalesce("page_content", F.lit("")), F.col("page_id") % 3
    p = table(spark, d, "doc_pages").select("page_id", "page_content", F.when(k == 0, F.concat(c, F.lit(" read"))).when(k == 1, F.substring(c, 1, 40)).otherwise(F.regexp_replace(c, "[a-zA-Z]", "1")).alias("t"))
    return p.select("page_id", layout.read_well(F.col("t")).alias("sound"), F.coalesce(F.length(layout.better_text(F.col("page_content"), F.col("t"))), F.lit(0)).alias("n_chars"))


@query("SELECT page_id, regexp_replace(regexp_replace(regexp_replace(coalesce(page_content, ''), '\\n{4,}', chr(10) || chr(10) || chr(10), 'g'), '[ \\t\\r\\f]+(\\n|$)', '\\1', 'g'), '^\\s+|\\s+$', '', 'g') AS text FROM doc_pages")
def cleaned_pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "doc_pages").select("page_id", layout.clean(F.col("page_content")).alias("text"))


@query("SELECT page_id, trim(replace(s, '##', '##')) AS heading FROM (SELECT page_id, regexp_replace(x, '^\\s+|\\s+$', '', 'g') AS s FROM (SELECT page_id, unnest(string_split(page_content, chr(10))) AS x FROM doc_pages)) WHERE starts_with(s, '## ')  AND length(s) < 97 AND NOT regexp_matches(s, '[.,;:]$') AND NOT regexp_matches(s, " + quoted(layout.UNITS) + ") AND NOT regexp_matches(s, " + quoted(_BAD) + ")")
def page_markdown(spark: SparkSession, d: str) -> DataFrame:
    """Marked headings of pages that went through words, lines, fonts and a table, and came out as text again."""
    p = _words(spark, d)
    boxes = F.array(F.struct(F.lit(0.0).alias("x0"), F.lit(-60.0).alias("top"), F.lit(90.0).alias("x1"), F.lit(-30.0).alias("bottom")))
    inside = F.array(F.struct(F.lit("covered").alias("text"), F.lit(5.0).alias("x"), F.lit(-45.0).alias("top"), F.lit(14.0).alias("size")))
    grid = F.array(F.struct(F.lit(-60.0).alias("top"), F.array(F.array(F.lit("Name"), F.lit("Result")), F.array(F.lit("Sodium"), F.lit("140"))).alias("rows")))
    m = layout.page_markdown(p.withColumn("words", F.concat("words", inside)).withColumn("boxes", boxes).withColumn("tables", grid))
    kept = F.filter(F.split("markdown", "\n"), lambda s: s.startswith("## ## ") | s.contains("covered"))
    return m.select("page_id", F.explode(kept).alias("h")).select("page_id", F.regexp_replace("h", "^## ", "").alias("heading"))
