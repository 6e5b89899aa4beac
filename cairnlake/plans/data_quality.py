"""Queries of the general data problems (1 and 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake.operators.instants import normalise_instants
from cairnlake.operators.quantities import to_common_units
from cairnlake.session import table


_DATES = (("doc_pages", "page_id", "encounter_date", True), ("usage_records", "record_id", "timestamp_utc", False))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    tenants = table(spark, sf_dir, "tenants")
    parts = [
        normalise_instants(table(spark, sf_dir, src), tenants, row_id, value, local)
        # the partition number keeps the filter above the steps: pushed down, it would repeat all of them
        .withColumn("_part", F.spark_partition_id())
        .filter(F.col("utc_us").isNotNull() & ~F.col("canonical") & (F.col("_part") >= 0))
        .select(F.lit(src).alias("src"), F.col("row_id").cast("long").alias("row_id"), "utc_us")
        for src, row_id, value, local in _DATES
    ]
    return parts[0].unionByName(parts[1])


def p1_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's instant, also of those already canonical."""
    tenants = table(spark, sf_dir, "tenants")
    parts = [
        normalise_instants(table(spark, sf_dir, src), tenants, row_id, value, local).select(F.lit(src).alias("src"), F.col("row_id").cast("long").alias("row_id"), "utc_us", "canonical")
        for src, row_id, value, local in _DATES
    ]
    return parts[0].unionByName(parts[1])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    labs = table(spark, sf_dir, "labs").select("lab_id", "test", "value", "unit")
    d = to_common_units(labs, table(spark, sf_dir, "lab_units"))
    d = d.filter(F.col("common_value").isNotNull() & (F.col("found_unit") != F.col("common_unit")))
    return d.select("lab_id", F.round(F.col("common_value") * 100 + 1e-7).cast("long").alias("common_x100"))


def p6_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many results of each test came from text, field or nowhere."""
    d = to_common_units(table(spark, sf_dir, "labs").select("lab_id", "test", "value", "unit"), table(spark, sf_dir, "lab_units"))
    return d.groupBy("test", F.coalesce("unit_from", F.lit("none")).alias("unit_from")).agg(F.count("*").alias("n"), F.count("common_value").alias("n_common"))


def p6_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results without any unit, in the unit that most results of the test state in the unit column."""
    labs = table(spark, sf_dir, "labs").select("lab_id", "test", "value", "unit")
    units = table(spark, sf_dir, "lab_units")
    usual = to_common_units(labs, units).filter("unit_from = 'field' AND common_unit IS NOT NULL").groupBy("test", "found_unit").agg(F.count("*").alias("n"))
    usual = usual.groupBy("test").agg(F.max_by("found_unit", F.struct("n", "found_unit")).alias("default_unit"))
    d = to_common_units(labs, units, usual).filter("unit_from = 'default' AND common_value IS NOT NULL")
    return d.select("lab_id", F.col("found_unit").alias("unit"), F.round(F.col("common_value") * 100 + 1e-7).cast("long").alias("common_x100"))


# The oracle takes units apart into a numerator and a volume, where the operator looks up whole notations.
_P6_KEY = "replace(replace(regexp_replace(replace(replace(replace(replace(lower(regexp_replace({c}, '[\\s\\x{{00a0}}\\x{{2007}}\\x{{202f}}]+', '', 'g')), chr(956), 'µ'), '×', 'x'), '⁹', '^9'), '³', '^3'), '^x', ''), 'per', '/'), '100ml', 'dl')"
_P6 = r"""WITH parsed AS (SELECT lab_id, test, value, unit,
    regexp_extract(value, '^\s*(?:[A-Za-z][A-Za-z0-9 \-]*:)?\s*(?:<=|>=|≤|≥|<|>|~|≈|=)?\s*([0-9][0-9.,]*)\s*((?:[eE][+-]?[0-9]+)|(?:[x×]\s*10\^[+-]?[0-9]+\s*$)|(?:[x×]\s*10\^[+-]?[0-9]+\s*[^/0-9\s]|[x×]\s*10\^[+-]?[0-9]+\s+[^/]))?', ['n', 'x']) AS g FROM labs),
  pulled AS (SELECT *, regexp_extract(g.x, '(?:[eE]|10\^)([+-]?[0-9]+)', 1) AS p,
    regexp_replace(regexp_replace(value, '^\s*(?:[A-Za-z][A-Za-z0-9 \-]*:)?\s*(?:<=|>=|≤|≥|<|>|~|≈|=)?\s*[0-9][0-9.,]*', ''), CASE WHEN g.x <> '' THEN '^\s*(?:[eE]|[x×]\s*10\^)[+-]?[0-9]+' ELSE '^$' END, '') AS rest FROM parsed),
  tidy AS (SELECT *, trim(regexp_replace(regexp_replace(rest, '^\s*(\*|\^|\((HH|LL|H|L)\)|(HH|LL|H|L)(\s|$))', ''), '\s(\*|\^|\((HH|LL|H|L)\)|HH|LL|H)\s*$', '')) AS tail,
    CASE WHEN regexp_matches(g.n, '^[0-9]{1,3}(,[0-9]{3})+([.][0-9]+)?$') THEN TRY_CAST(replace(g.n, ',', '') AS DOUBLE) WHEN regexp_matches(g.n, '^[0-9]+([.,][0-9]+)?$') THEN TRY_CAST(replace(g.n, ',', '.') AS DOUBLE) END
      * pow(10, coalesce(TRY_CAST(nullif(p, '') AS DOUBLE), 0)) AS amount FROM pulled),
  keyed AS (SELECT lab_id, test, amount, coalesce(tail, '') <> '' AS inside, """ + _P6_KEY.format(c="CASE WHEN tail <> '' THEN tail ELSE coalesce(unit, '') END") + r""" AS k FROM tidy),
  split AS (SELECT *, regexp_extract(regexp_replace(k, '-1$', ''), '^(µg|ug|mcg|mgs|mg|ng|pg|gms|grams|gram|gm|g|mmols|mmol|µmol|umol|mcmol|nmol|pmol|mol|meq)/?(dl|liter|litre|l|ml)$', ['a', 'v']) AS u FROM keyed),
  sized AS (SELECT *, CASE WHEN u.a IN ('g', 'gm', 'gms', 'gram', 'grams') THEN 'g' WHEN u.a IN ('mg', 'mgs') THEN 'mg' WHEN u.a IN ('µg', 'ug', 'mcg') THEN 'µg' WHEN u.a IN ('mmol', 'mmols') THEN 'mmol' WHEN u.a IN ('µmol', 'umol', 'mcmol') THEN 'µmol' ELSE u.a END
      || '/' || CASE u.v WHEN 'dl' THEN 'dL' WHEN 'ml' THEN 'mL' ELSE 'L' END AS plain FROM split),
  named AS (SELECT *, CASE WHEN u.a <> '' THEN replace(plain, 'meq', 'mEq') WHEN k = 'mm' THEN 'mmol/L' WHEN k IN ('mg%', 'g%') THEN replace(k, '%', '/dL') WHEN k IN ('%', 'pct', '/cent', '%ngsp', '%hb') THEN '%' WHEN k LIKE 'mmol/mol%' THEN 'mmol/mol'
      WHEN regexp_matches(k, '^x?10(\^|e|\*)9/l$') THEN '10^9/L' WHEN regexp_matches(k, '^(x?10(\^|e|\*)3|k|thou)/([uµ]l|mm\^?3|cumm)$') THEN '10^3/µL' WHEN regexp_matches(k, '^(cells)?/([uµ]l|mm\^?3|cumm)$') THEN '/µL' END AS name FROM sized),
  s(name, dim, size) AS (SELECT a || '/' || v, d, x * y FROM (VALUES ('g', 'm', 1.0), ('mg', 'm', 1e-3), ('µg', 'm', 1e-6), ('ng', 'm', 1e-9), ('pg', 'm', 1e-12), ('mol', 'n', 1.0), ('mmol', 'n', 1e-3), ('µmol', 'n', 1e-6), ('nmol', 'n', 1e-9), ('pmol', 'n', 1e-12), ('mEq', 'q', 1e-3)) t(a, d, x), (VALUES ('L', 1.0), ('dL', 10.0), ('mL', 1000.0)) w(v, y)
    UNION ALL VALUES ('%', 'p', 1.0), ('mmol/mol', 'r', 1.0), ('10^9/L', 'c', 1e9), ('10^3/µL', 'c', 1e9), ('/µL', 'c', 1e6)),
  way AS (SELECT l.test, l.common_unit, s.name, CASE WHEN s.name = l.unit THEN l.factor ELSE l.factor * (s.size / b.size) END AS factor, l.shift FROM lab_units l JOIN s b ON b.name = l.unit JOIN s ON s.dim = b.dim
    QUALIFY row_number() OVER (PARTITION BY l.test, s.name ORDER BY s.name <> l.unit, l.unit) = 1)
SELECT lab_id, n.test, n.name, n.inside, n.k, n.amount, w.common_unit, amount * factor + shift AS common_value FROM named n LEFT JOIN way w ON w.test = n.test AND w.name = n.name"""

QUERIES = {"p1_found": p1_found, "p1_normalised": p1_normalised, "p6_found": p6_found, "p6_common": p6_common, "p6_defaults": p6_defaults}
ORACLES = {
    "p6_found": f"SELECT lab_id, CAST(round(common_value * 100 + 1e-7) AS BIGINT) AS common_x100 FROM ({_P6}) z WHERE common_value IS NOT NULL AND name <> common_unit",
    "p6_common": f"SELECT test, CASE WHEN name IS NULL THEN 'none' WHEN inside THEN 'text' ELSE 'field' END AS unit_from, count(*) AS n, count(common_value) AS n_common FROM ({_P6}) z GROUP BY 1, 2",
    "p6_defaults": f"""WITH z AS ({_P6}), u AS (SELECT test, arg_max(name, {{'n': n, 'u': name}}) AS name FROM (SELECT test, name, count(*) AS n FROM z WHERE NOT inside AND common_unit IS NOT NULL GROUP BY test, name) GROUP BY test),
      f AS (SELECT DISTINCT z.test, z.name, w.factor, w.shift FROM z JOIN (SELECT l.test, l.unit AS name, l.factor, l.shift FROM lab_units l) w ON w.test = z.test AND w.name = z.name)
      SELECT lab_id, u.name AS unit, CAST(round((amount * factor + shift) * 100 + 1e-7) AS BIGINT) AS common_x100 FROM z JOIN u ON u.test = z.test JOIN f ON f.test = u.test AND f.name = u.name WHERE NOT inside AND k IN ('', '-', 'n/a') AND amount IS NOT NULL""",
}
