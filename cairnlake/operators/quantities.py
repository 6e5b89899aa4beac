"""Quantities recorded in different units to one common unit (problem 6).

Pure SQL: ``regexp_extract`` takes number and unit from the value, aliases are
normalised by a join, the unit is coalesced from the text, the unit field and
the source's default, then factor and offset of the test are applied.

One projection and three lookups: aliases, conversions and defaults are
broadcast where counting shows at most 10,000 rows, so the measurements are not
shuffled (beyond that the optimiser joins them).  The patterns use no look-around, so the same text runs in
any engine with linear-time regular expressions.

Defined results: ranges, words, no number, no or unfitting unit, unknown or
null test give null (the row stays); a unit inside the value outranks the unit
field; a comma before exactly three digits groups thousands, any other comma
is the decimal sign; comparison signs and flags are ignored; ties round away
from zero.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairnlake.session import bounded, listed

# Notations of mass, amount, charge, volume and cell-count units.
MASS = {"g": ("g", "gm", "gms", "gram", "grams"), "mg": ("mg", "mgs"), "µg": ("µg", "ug", "mcg"), "ng": ("ng",), "pg": ("pg",)}
AMOUNT = {"mol": ("mol",), "mmol": ("mmol", "mmols"), "µmol": ("µmol", "umol", "mcmol"), "nmol": ("nmol",), "pmol": ("pmol",)}
CHARGE = {"mEq": ("meq",)}
VOLUME = {"dL": ("dl", "100ml"), "L": ("l", "liter", "litre"), "mL": ("ml",)}
SHORT = {"mmol/L": ("mm",), "mg/dL": ("mg%",), "g/dL": ("g%",), "%": ("%", "percent", "pct", "%ngsp", "%hb"), "mmol/mol": ("mmol/mol", "mmol/molhb", "mmol/molifcc")}
CELLS = {
    "10^9/L": ("10^9/l", "10e9/l", "10*9/l", "x10^9/l", "x10e9/l", "x10*9/l", "g/l#cells"),
    "10^3/µL": ("10^3/µl", "10*3/µl", "10e3/µl", "x10^3/µl", "x10e3/µl", "x10*3/µl", "k/µl", "thou/µl", "k/mm3", "10^3/mm3", "10*3/mm3", "x10^3/mm3", "k/cumm"),
    "/µL": ("/µl", "perµl", "cells/µl", "/mm3", "cells/mm3", "/cumm", "cells/cumm"),
}
#: Size of each unit in its dimension's base (g/L, mol/L, Eq/L, 1/L, %, mmol/mol).
SCALE = {"g": 1.0, "mg": 1e-3, "µg": 1e-6, "ng": 1e-9, "pg": 1e-12, "mol": 1.0, "mmol": 1e-3, "µmol": 1e-6, "nmol": 1e-9, "pmol": 1e-12, "mEq": 1e-3}
PER_LITRE = {"dL": 10.0, "L": 1.0, "mL": 1000.0}


def alias_rows() -> list[tuple[str, str, str, float]]:
    """(alias, unit, dimension, size) built from the lists above; aliases have
    no white space and lower case."""
    rows = []
    for dimension, numerators in (("mass", MASS), ("amount", AMOUNT), ("charge", CHARGE)):
        for n, n_aliases in numerators.items():
            for v, v_aliases in VOLUME.items():
                size = SCALE[n] * PER_LITRE[v]
                for a in n_aliases:
                    for b in v_aliases:
                        rows += [(f"{a}{sep}{b}{end}", f"{n}/{v}", dimension, size) for sep, end in (("/", ""), ("per", ""), ("", "-1"))]
    sizes = {"mmol/L": ("amount", 1e-3), "mg/dL": ("mass", 1e-2), "g/dL": ("mass", 10.0), "%": ("percent", 1.0), "mmol/mol": ("ratio", 1.0)}
    rows += [(a, unit, *sizes[unit]) for unit, aliases in SHORT.items() for a in aliases]
    rows += [(a, unit, "cells", size) for (unit, aliases), size in zip(CELLS.items(), (1e9, 1e9, 1e6)) for a in aliases]
    return list(dict.fromkeys(rows))


# groups of the number: 2 the number, 3 to 5 its parts; a long run behind a comma is a fraction, three digits group thousands
_NUM = r"([0-9]+,[0-9]{4,}|[0-9]{1,3}(,[0-9]{3})+(\.[0-9]+)?|[0-9]+([.,][0-9]+)?)"
_PLAIN = r"^\s*([A-Za-z][A-Za-z0-9 \-]*:)?\s*(?:<=|>=|≤|≥|<|>|~|≈|=)?\s*"


def _unit_key(col: str) -> str:
    """Lower case, no white space, one micro sign, plain exponents."""
    return (
        "replace(replace(replace(replace(replace(replace(replace(replace(lower(regexp_replace("
        f"{col}, '[\\s   ]+', ''{{g}})), 'μ', 'µ'), '×', 'x'), '⁹', '^9'), '³', '^3'), 'ul', 'µl'), 'mµl', 'mul'), 'mm^3', 'mm3'), 'mcl', 'µl')"
    )


def factors_sql(conversions: str, aliases: str) -> str:
    """(test, common_unit, from_unit, factor, shift): the listed conversions and, within a
    dimension, those to every other scale of a listed unit."""
    return f"""
SELECT test, common_unit, from_unit, factor, shift FROM (
  SELECT v.test, v.common_unit, u.unit AS from_unit, CASE WHEN u.unit = v.unit THEN v.factor ELSE v.factor * (u.size / lu.size) END AS factor, v.shift,
    row_number() OVER (PARTITION BY v.test, u.unit ORDER BY CASE WHEN u.unit = v.unit THEN 0 ELSE 1 END, v.unit) AS rank
  FROM {conversions} v
  JOIN (SELECT DISTINCT unit, dimension, size FROM {aliases}) lu ON lu.unit = v.unit
  JOIN (SELECT DISTINCT unit, dimension, size FROM {aliases}) u ON u.dimension = lu.dimension) WHERE rank = 1"""


def sql(measurements: str, factors: str, aliases: str, defaults: str | None = None, value: str = "value", unit: str = "unit", test: str = "test") -> str:
    """The whole operator as one statement over registered tables."""
    rx = "regexp_extract"
    lit = lambda p: "'" + p.replace("\\", "\\\\") + "'"
    num_only = _PLAIN + _NUM
    exp_e = _PLAIN + _NUM + r"([eE][+-]?[0-9]+)"
    exp_x = _PLAIN + _NUM + r"\s*[x×]\s*10\^([+-]?[0-9]+)(\s*/)?"
    head = _PLAIN + _NUM + r"(?:[eE][+-]?[0-9]+)?"
    head_x = _PLAIN + _NUM + r"\s*[x×]\s*10\^[+-]?[0-9]+"
    flag = r"^\s*(\*|\^|\((?:HH|LL|H|L)\)|(?:HH|LL|H|L)(?:\s|$))"
    late = r"\s(\*|\^|\((?:HH|LL|H|L)\)|HH|LL|H)\s*$"  # behind the unit; a bare L could be its litre
    key = lambda c: _unit_key(c).replace("{g}", "").replace("\\s", "\\\\s")
    factor = "pow(CAST(10 AS DOUBLE), coalesce(try_cast(nullif(x10, '') AS DOUBLE), try_cast(nullif(substr(e10, 2), '') AS DOUBLE), 0))"
    default = f"LEFT JOIN {defaults} df ON df.test = m.{test}" if defaults else ""
    default_unit = "df.default_unit" if defaults else "CAST(NULL AS STRING)"
    none_given = "coalesce(m.field_key, '') IN ('', '-', 'n/a')"
    return f"""
WITH taken AS (
  SELECT m.*, {rx}({value}, {lit(num_only)}, 2) AS num,
    {rx}({value}, {lit(exp_e)}, 6) AS e10,
    CASE WHEN {rx}({value}, {lit(exp_x)}, 7) = '' THEN {rx}({value}, {lit(exp_x)}, 6) ELSE '' END AS x10
  FROM {measurements} m),
cutoff AS (
  SELECT t.*, CASE WHEN x10 <> '' THEN regexp_replace({value}, {lit(head_x)}, '') ELSE regexp_replace({value}, {lit(head)}, '') END AS tail0
  FROM taken t),
flagged AS (
  SELECT c.*, trim(regexp_replace(regexp_replace(tail0, {lit(flag)}, ''), {lit(late)}, '')) AS tail FROM cutoff c),
numbered AS (
  SELECT f.*,
    CASE WHEN num <> '' THEN try_cast(replace(CASE WHEN num RLIKE {lit('^[0-9]{1,3}(,[0-9]{3})+([.][0-9]+)?$')} THEN replace(num, ',', '') ELSE num END, ',', '.') AS DOUBLE) * {factor} END AS amount,
    {key('tail')} AS text_key, {key(unit)} AS field_key
  FROM flagged f),
aliased AS (
  SELECT m.*, ta.unit AS text_unit, fa.unit AS field_unit, {default_unit} AS default_unit,
    CASE WHEN m.text_key <> '' THEN ta.unit ELSE coalesce(fa.unit, CASE WHEN {none_given} THEN {default_unit} END) END AS found_unit,
    CASE WHEN m.text_key <> '' THEN CASE WHEN ta.unit IS NOT NULL THEN 'text' END WHEN fa.unit IS NOT NULL THEN 'field' WHEN {none_given} AND {default_unit} IS NOT NULL THEN 'default' END AS unit_from
  FROM numbered m LEFT JOIN {aliases} ta ON ta.alias = m.text_key LEFT JOIN {aliases} fa ON fa.alias = m.field_key {default})
SELECT a.*, k.common_unit, CASE WHEN a.amount IS NOT NULL THEN a.amount * k.factor + k.shift END AS common_value
FROM aliased a LEFT JOIN {factors} k ON k.test = a.{test} AND k.from_unit = a.found_unit"""


def to_common_units(df: DataFrame, lab_units: DataFrame, source_defaults: DataFrame | None = None) -> DataFrame:
    """``df`` (test, value, unit and any other columns) with ``amount``,
    ``found_unit``, ``unit_from``, ``common_unit`` and ``common_value``.

    ``source_defaults``: optional (test, default_unit), used where neither
    text nor field names a unit.
    """
    spark: SparkSession = df.sparkSession
    aliases = listed(spark, alias_rows(), "alias string, unit string, dimension string, size double")
    factors = bounded(spark.sql(factors_sql("{c}", "{a}"), c=lab_units, a=aliases))
    names = {"m": df, "f": factors, "a": aliases}
    if source_defaults is not None:
        names["d"] = bounded(source_defaults)
    text = sql("{m}", "{f}", "{a}", "{d}" if source_defaults is not None else None)
    for brace in ("{1,3}", "{3}", "{4,}"):
        text = text.replace(brace, "{" + brace + "}")
    return spark.sql(text, **names)
