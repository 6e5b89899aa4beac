"""Small parts of the SQL counterparts that DuckDB runs."""

from __future__ import annotations


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def has(column: str, pattern: str, flags: str = "i") -> str:
    """``column`` matches ``pattern``; linear-time engines know no look-behind, which the patterns used here can spare."""
    for spared in (r"(?<!file\s)", r"(?<!drug\s)", r"(?<!brand\s)"):
        pattern = pattern.replace(spared, "")
    return f"regexp_matches({column}, {quoted(f'(?{flags})' + pattern)})"


def group(column: str, pattern: str, g: int = 1, flags: str = "i") -> str:
    for spared in (r"(?<!file\s)", r"(?<!drug\s)", r"(?<!brand\s)"):
        pattern = pattern.replace(spared, "")
    return f"regexp_extract({column}, {quoted(f'(?{flags})' + pattern)}, {g})"


def stripped(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def case(rules: list[tuple[str, str]], default: str = "NULL") -> str:
    """CASE over (condition, value) of SQL."""
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in rules) + f" ELSE {default} END"


def one_if(c: str, n: int = 1) -> str:
    return f"(CASE WHEN {c} THEN {n} ELSE 0 END)"


def us_date(c: str) -> str:
    """``m/d/y`` with slashes, dashes or dots as an ISO date."""
    p = f"string_split_regex(trim({c}), '[./-]')"
    y = f"(CASE WHEN TRY_CAST({p}[3] AS INT) < 100 THEN TRY_CAST({p}[3] AS INT) + 2000 ELSE TRY_CAST({p}[3] AS INT) END)"
    return f"(CASE WHEN regexp_matches(trim({c}), '^\\d{{1,2}}[./-]\\d{{1,2}}[./-]\\d{{1,4}}$') THEN CAST(TRY_CAST(printf('%04d-%02d-%02d', {y}, TRY_CAST({p}[1] AS INT), TRY_CAST({p}[2] AS INT)) AS DATE) AS VARCHAR) END)"
