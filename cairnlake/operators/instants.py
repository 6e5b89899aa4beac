"""Mixed timestamp notations to one UTC instant (problem 1).

An ordered cascade of anchored patterns recognises the notation; a value is
taken apart once by the first pattern that matches it and its parts are
checked strictly (``try_make_timestamp_ntz`` rejects 31 June).  A missing zone
is taken from the source's default, looked up by key.  Local times that occur
twice or never follow an explicit policy.  Everything stays in JVM
expressions: a narrow projection plus one broadcast join with a table whose
size is checked.

Defined results: null, empty, marks, words and impossible dates give null;
white space around a value is ignored; digits beyond microseconds are cut;
an explicit offset wins over a zone name beside it; rows are neither dropped
nor merged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlake.session import broadcast_if_small

# English month names and the zone abbreviations with their offsets in minutes.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "WET": 0, "BST": 60, "WEST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "AST": -240, "ADT": -180, "PKT": 300, "IST": 330,
}

_MONTH = "(" + "|".join([*(m for m in MONTHS), *(m[:3] for m in MONTHS), "Sept"]) + r")\.?"
_DAY = r"(?:(?:Mon|Tues?|Wed(?:nes)?|Thu(?:rs)?|Fri|Sat(?:ur)?|Sun)(?:day)?\.?,?\s+)?"
_TIME = r"(\d{1,2})[:.](\d{2})(?:[:.](\d{2})(?:[.,](\d{1,9}))?)?\s*([AaPp]\.?[Mm]\.?)?"
_ZONE = (
    r"(?:\s*([Zz]|[+\-−]\d{2}(?::?\d{2})?)(?:\s*\[[A-Za-z_]+(?:/[A-Za-z_+\-0-9]+)*\])?"
    r"|\s*\[?([A-Z][A-Za-z_]+(?:/[A-Z][A-Za-z_+\-0-9]*)+)\]?|\s*\(?([A-Z]{3,4})\)?)?"
)
_TAIL = rf"(?:(?:[Tt]|,?\s+(?:at\s+)?){_TIME}{_ZONE})?"

#: ``num``: month and day stand in the source's order.
#: (name, pattern, replacement): the replacement lists num or nothing|year|month|day|hour|minute|second|fraction|half|offset|zone|abbreviation.
_CASCADE = (
    ("year_first", rf"^(\d{{4}})([-/.])(\d{{1,2}})\2(\d{{1,2}}){_TAIL}$", "|$1|$3|$4|$5|$6|$7|$8|$9|$10|$11|$12"),
    ("compact_time", rf"^(\d{{4}})(\d{{2}})(\d{{2}})[T ]?(\d{{2}})(\d{{2}})(\d{{2}})?(?:[.,](\d{{1,9}}))?{_ZONE}$", "|$1|$2|$3|$4|$5|$6|$7||$8|$9|$10"),
    ("compact", rf"^(\d{{4}})(\d{{2}})(\d{{2}}){_TAIL}$", "|$1|$2|$3|$4|$5|$6|$7|$8|$9|$10|$11"),
    ("numeric", rf"^(\d{{1,2}})([-/.])(\d{{1,2}})\2(\d{{4}}|\d{{2}}){_TAIL}$", "num|$4|$1|$3|$5|$6|$7|$8|$9|$10|$11|$12"),
    ("day_month", rf"^(?i:{_DAY})(\d{{1,2}})(?:\.\s*|\s+|-)(?i:{_MONTH})(?:,?\s+|-)(\d{{4}}|\d{{2}}){_TAIL}$", "|$3|$2|$1|$4|$5|$6|$7|$8|$9|$10|$11"),
    ("month_day", rf"^(?i:{_DAY})(?i:{_MONTH})\s+(\d{{1,2}}),?\s+(\d{{4}}){_TAIL}$", "|$3|$1|$2|$4|$5|$6|$7|$8|$9|$10|$11"),
)
_EPOCH = r"^(\d{10})(?:\.(\d{1,9})|(\d{3})|(\d{6})|(\d{9}))?$"
CANONICAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?Z$"


def _int(c: Column) -> Column:
    return F.when(c != "", c).try_cast("int")


def add_instant(df: DataFrame, value: str, zone: Column, order: Column, out: str, ambiguous: str = "earlier", nonexistent: str = "null") -> DataFrame:
    """``df`` with ``out``: microseconds since 1970-01-01 UTC, or null.

    ``ambiguous``: which instant a local time that occurred twice means
    (``earlier``, ``later`` or ``null``); ``nonexistent``: what a local time
    inside a gap gives (``null`` or ``shift``, moved forward by the gap).
    Each step is a column of its own, so that no pattern runs twice.
    """
    if ambiguous not in ("earlier", "later", "null") or nonexistent not in ("null", "shift"):
        raise ValueError((ambiguous, nonexistent))
    v = F.col("_t_v")
    parts = F.lit(None).cast("array<string>")
    for _, pattern, to in reversed(_CASCADE):
        parts = F.when(v.rlike(pattern), F.split(F.regexp_replace(v, pattern, to), r"\|", -1)).otherwise(parts)
    epoch = F.when(
        v.rlike(_EPOCH),
        F.substring(v, 1, 10).cast("long") * 1_000_000 + F.substring(F.rpad(F.regexp_replace(F.substring(v, 11, 10), r"\.", ""), 6, "0"), 1, 6).cast("long"),
    )
    d = df.withColumn("_t_v", F.regexp_replace(F.regexp_replace(F.col(value), "[\u00a0\u202f\u3000]", " "), r"^\s+|\s+$", ""))
    d = d.withColumns({"_t_zone": zone, "_t_order": order, "_t_p": parts, "_t_epoch": epoch})
    d = d.withColumns(_read(F.col("_t_p"), F.col("_t_order")))
    h, half = F.col("_t_h"), F.col("_t_half")
    d = d.withColumns({
        "_t_date": F.coalesce(_date("_t_y", "_t_m", "_t_d"), F.when(F.col("_t_num"), _date("_t_y", "_t_d", "_t_m"))),
        "_t_hour": F.when(half == "", F.coalesce(h, F.lit(0))).when(h.between(1, 12), h % 12 + F.when(half == "p", 12).otherwise(0)),
    })
    h, mi, sec = F.col("_t_hour"), F.coalesce("_t_mi", F.lit(0)), F.coalesce("_t_s", F.lit(0))
    seconds = F.unix_date("_t_date").cast("long") * 86_400 + h * 3600 + mi * 60 + sec
    d = d.withColumn("_t_local", F.when((h < 24) & (mi < 60) & (sec < 60), F.timestamp_seconds(seconds)))
    offset = F.col("_t_minutes")
    d = d.withColumn("_t_known", F.when(offset.isNull() & F.col("_t_zone").rlike(_ZONE_NAME), F.coalesce(F.col("_t_named"), F.col("_t_zone"))))
    d = d.withColumn("_t_early", F.to_utc_timestamp("_t_local", F.col("_t_known")))
    early, wall, known = F.unix_micros("_t_early"), F.col("_t_local"), F.col("_t_known")
    zoned = early
    if ambiguous != "earlier":
        twice = F.from_utc_timestamp(F.timestamp_micros(early + 3_600_000_000), known) == wall
        zoned = F.when(~twice, early) if ambiguous == "null" else F.when(twice, early + 3_600_000_000).otherwise(early)
    if nonexistent == "null":
        zoned = F.when(F.from_utc_timestamp("_t_early", known) == wall, zoned)
    fixed = F.unix_micros("_t_local") - offset * F.lit(60_000_000).cast("long")
    d = d.withColumn(out, F.coalesce("_t_epoch", F.when(~F.col("_t_bad"), F.coalesce(fixed, zoned) + F.col("_t_micros"))))
    return d.drop(*[c for c in d.columns if c.startswith("_t_")])


_ZONE_NAME = r"^(UTC|GMT|[A-Z][A-Za-z_]+(/[A-Z][A-Za-z_+\-0-9]*)+)$"


def _date(y: str, m: str, d: str) -> Column:
    zero = F.lit(0)
    return F.to_date(F.try_make_timestamp_ntz(F.col(y), F.col(m), F.col(d), zero, zero, zero))


def _read(p: Column, date_order: Column) -> dict[str, Column]:
    """Date and time numbers, sub-second part, offset and zone of the parts."""
    year, first, second, num = p[1], p[2], p[3], p[0] == "num"
    year_first = num & (date_order == "ymd") & (F.length(year) == 2)
    day_first = num & (date_order == "dmy")
    y = F.when(year_first, first).otherwise(year)
    m = F.when(year_first | day_first, second).otherwise(first)
    d = F.when(year_first, year).when(day_first, first).otherwise(second)
    month = ((F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), F.lower(F.substring(m, 1, 3))) + 2) / 3).cast("int")
    offset, zone, short = p[9], p[10], p[11]
    digits = F.regexp_replace(offset, "[^0-9]", "")
    minutes = F.when(F.lower(offset) == "z", 0).when(
        offset != "",
        F.when(F.substring(offset, 1, 1) == "+", 1).otherwise(-1) * (F.substring(digits, 1, 2).cast("int") * 60 + F.coalesce(_int(F.substring(digits, 3, 2)), F.lit(0))),
    )
    known = F.element_at(F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv]), short)
    return {
        "_t_y": F.when(F.length(y) == 2, y.try_cast("int") + 2000).otherwise(y.try_cast("int")),
        "_t_m": F.coalesce(m.try_cast("int"), month),
        "_t_d": d.try_cast("int"),
        "_t_h": _int(p[4]),
        "_t_mi": _int(p[5]),
        "_t_s": _int(p[6]),
        "_t_half": F.lower(F.substring(p[8], 1, 1)),
        "_t_num": num,
        "_t_micros": F.when(p[7] == "", F.lit(0)).otherwise(F.substring(F.rpad(p[7], 6, "0"), 1, 6).cast("int")),
        "_t_minutes": F.coalesce(minutes, F.when(short != "", known)),
        "_t_named": F.when(zone != "", zone),
        "_t_bad": F.coalesce((short != "") & known.isNull(), F.lit(False)),
    }


def with_source_defaults(df: DataFrame, tenants: DataFrame, key: str) -> DataFrame:
    """Adds ``_zone`` and ``_order`` of the row's source; sources not in the
    lookup (or null) get UTC and month first.  The lookup is one row a source."""
    look = tenants.dropDuplicates(["tenant_id"]).select(F.col("tenant_id").alias("_tenant"), F.col("tz_name").alias("_zone"), F.col("date_order").alias("_order"))
    out = df.join(broadcast_if_small(look), df[key].eqNullSafe(F.col("_tenant")), "left")
    return out.withColumns({"_zone": F.coalesce("_zone", F.lit("UTC")), "_order": F.coalesce("_order", F.lit("mdy"))}).drop("_tenant")


def normalise_instants(df: DataFrame, tenants: DataFrame, row_id: str, value: str, local: bool, tenant: str = "tenant_id", ambiguous: str = "earlier", nonexistent: str = "null") -> DataFrame:
    """row_id, value, utc_us and whether the value was canonical already; one row per input row.

    ``local``: a value without a zone is local time of its source, else UTC.
    Needs a session in UTC, as the library sets it.
    """
    d = with_source_defaults(df.select(F.col(row_id).alias("row_id"), F.col(value).alias("value"), F.col(tenant).alias("_key")), tenants, "_key")
    zone = F.col("_zone") if local else F.lit("UTC")
    d = add_instant(d, "value", zone, F.col("_order"), "utc_us", ambiguous, nonexistent)
    return d.select("row_id", "value", "utc_us", F.coalesce(F.col("value").rlike(CANONICAL), F.lit(False)).alias("canonical"))
