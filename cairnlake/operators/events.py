"""Clinical events of lines: medication changes, treatment actions, measurements (FCT-3)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Five families, the first that a line matches counts.
_MED = r"[A-Za-z][A-Za-z0-9/\-]{2,40}(?:\s+[A-Za-z][A-Za-z0-9/\-]{2,40}){0,2}"
_DOSE = r"(?:\d+(?:\.\d+)?\s*(?:mcg/spray|international\s+units?|mg|mcg|g|iu|units?|sprays?|ml)|po|oral(?:ly)?|intranasal|nasal|iv|bid|tid|qhs|daily|once\s+daily|twice\s+daily|dose|dosage)"
FAMILIES = [
    ("medication_change", "started", rf"\b(start(?:ed)?|initiated|added|began)\b.{{0,80}}?\b({_MED})\b.{{0,70}}?\b({_DOSE})\b"),
    ("medication_change", "stopped", rf"\b(stop(?:ped)?|discontinued|dc(?:'d)?|held|withheld)\b.{{0,80}}?\b({_MED})\b.{{0,70}}?\b({_DOSE})\b"),
    ("medication_change", "changed", rf"\b(increase(?:d)?|decrease(?:d)?|reduce(?:d)?|titrate(?:d)?|change(?:d)?|switch(?:ed)?)\b.{{0,100}}?\b({_MED})\b.{{0,90}}?\b({_DOSE})\b"),
    ("treatment_action", "initiated", r"\b(start(?:ed)?|initiated|began|ordered|recommended|referred|scheduled)\b.{0,140}\b(therapy|treatment|follow[- ]?up|consult|referral|monitor|plan|education)\b"),
    ("measurement", "documented", r"\b(bp|blood pressure|a1c|hba1c|creatinine|egfr|glucose|ldl|inr|weight)\b.{0,80}\b\d+(?:\.\d+)?(?:/\d{2,3})?\b"),
]
_FAMILIES = [(t, a, re.compile(p, re.I)) for t, a, p in FAMILIES]
_ACTION = re.compile(r"\b(plan|assessment|recommendation|orders?|instructions?|pharmacist|prescri)\b", re.I)
_PAST = re.compile(r"\b(as prescribed|already|previously|prior|home medication|current(?:ly)?|has been|have been|has started|had started|confirmed|reported starting|since last)\b", re.I)
_TARGET = re.compile(r"\bto\s+(\d+(?:\.\d+)?\s*(?:mcg/spray|international\s+units?|mg|mcg|g|iu|units?|ml))\b", re.I)
# Types and sections without events; a title of an earlier rule is no demographics.
_NO_EVENTS = {"billing", "consent_form", "insurance", "benefits", "physical_form"}
_EARLIER = r"(?i)\ballerg|\bmedication|\bcurrent\s+med|\bdischarge\s+med|\bmed\s+list|\bpharmac|\bprescri|\blab\b|\blaboratory|\bblood\s+(?:test|result|panel)|\bcbc|\bcmp|\bbmp|\bculture|\bcoagulat|\bvital|\bblood\s+pressure|\bheart\s+rate|\btemperature|\bpulse\s+ox|\bspo2|\bassessment|\bimpression|\bproblem\s+list|\bdiagnos|\bprocedure|\boperat|\bsurgical|\bintervention|\bimaging|\bradiol|\bct\b|\bmri\b|\becho|\bdischarge|\bsummary"
_DEMOGRAPHICS = r"(?i)\bdemographic|\bpatient\s+info|\bidentifi|\bregistration|\badmission\s+info"


def _cells(line: str) -> list[str]:
    raw = line.removeprefix("|").removesuffix("|").replace("\\|", "\0")
    return [re.sub(r"\s+", " ", c.replace("\0", "|")).strip() for c in raw.split("|")]


def _joined(cells: list[str]) -> str:
    """The text of a row that was torn into cells."""
    s = "".join(cells).strip()
    for p, r in ((r"(?<=[a-z])(?=[A-Z])", " "), (r"(?<=\d)(?=[A-Za-z])", " "), (r"(?<=[A-Za-z])(?=\d)", " ")):
        s = re.sub(p, r, s)
    for p in (r"\b(mg|mcg|g|iu|units?)(?=(oral|orally|intranasal|nasal|daily|spray|bid|tid|qd|qhs))", r"\b(intranasal|nasal)(?=spray)", r"\b(each)(?=nostril)"):
        s = re.sub(p, r"\1 ", s, flags=re.I)
    return re.sub(r"\s+", " ", s).strip()


def _lines(text: str) -> Iterator[tuple[str, bool]]:
    """Lines, and whether each is a row of a table."""
    for line in text.splitlines():
        raw = line.strip()
        if not (raw.startswith("|") and "|" in raw[1:]):
            yield line, False
            continue
        cells = _cells(raw)
        if not all(re.fullmatch(r"[:\-\s]+", c) for c in cells) and any(cells):
            yield _joined(cells) or " ".join(filter(None, cells)), True


def of_text(text: str, title: str) -> list[tuple[str, str, str, str, str]]:
    """(type, action, medication, value, evidence) of every line that tells an event, each once."""
    out, seen = [], set()
    for raw, in_table in _lines(text):
        line = re.sub(r"\s+", " ", raw).strip(" -\t")
        if len(line) < 12:
            continue
        for kind, action, pattern in _FAMILIES:
            if (in_table and kind == "measurement") or not (m := pattern.search(line)):
                continue
            name = value = ""
            if kind == "medication_change":
                name, value = re.sub(r"\s+(?:from|to|dose)$", "", m[2].strip(), flags=re.I).strip(), m[3].strip()
                if action == "started" and _PAST.search(line) and not _ACTION.search(title):
                    continue
                if action == "changed" and (to := _TARGET.search(line)):
                    value = to[1].strip()
                key = (kind, action, re.sub(r"[^a-z0-9]+", "", name.lower()), re.sub(r"\s+", "", value.lower()))
            else:
                key = (kind, action, line.lower()[:160])
            if key not in seen:  # one seen before leaves the line to the later families
                seen.add(key)
                out.append((kind, action, name, value, line))
                break
    return out


def clinical_events(df: DataFrame, id_col: str, text: str, title: Column, document_type: Column) -> DataFrame:
    """(id, event_no, event_type, action, medication, value, evidence), without a limit a text."""
    named = ["event_no", "event_type", "action", "medication", "value", "evidence"]

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            rows = [(i, n, *e) for i, t, s in zip(pdf[id_col], pdf["_t"], pdf["_s"]) for n, e in enumerate(of_text(t, s))]
            yield pd.DataFrame(rows, columns=[id_col, *named])

    t = F.coalesce(title, F.lit(""))
    kept = ~F.lower(F.coalesce(document_type, F.lit(""))).isin(*sorted(_NO_EVENTS)) & (t.rlike(_EARLIER) | ~t.rlike(_DEMOGRAPHICS))
    d = df.filter(kept & F.col(text).isNotNull()).select(id_col, F.col(text).alias("_t"), t.alias("_s"))
    return d.mapInPandas(run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, event_no int, " + ", ".join(f"{c} string" for c in named[1:]))
