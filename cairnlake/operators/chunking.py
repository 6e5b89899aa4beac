"""Documents to chunks by their structure: sections, entries, tables and running text.

A document is cut at its headings (marks, numbers or well-known titles, the
first kind that gives more than one section), a section at its dated entries,
an entry into tables and running text; tables part between rows and repeat
their header, running text parts at the best boundary and overlaps.  Small
pieces join a neighbour, repeated ones are dropped, and every chunk gets a line
that says where it belongs.  Texts go through one Arrow pass, row by row; a
document is a row, so nothing is shuffled.

Defined results: null and empty texts have no chunks; no chunk is longer than
``most`` plus its prefix line; a run without white space is cut at the limit.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Titles of sections, and words that tell a section's class.
TITLES = (
    r"subjective|objective|assessment(?:\s*[&/]\s*|\s+and\s+)?plan|assessment|a\s*/\s*p|hpi|history of present illness|ros|review of systems|physical exam(?:ination)?|impression|plan|chief complaint|past medical history|pmh|family history|fh|social history|sh|"
    r"vital signs?|vs|(?:current\s+)?medications?|allergies|allergy|discharge (?:instructions?|summary|diagnosis|medications?)|follow[\-\s]?up(?: instructions?| plan| appointments?)?|admission diagnosis|problem list"
)
LAB = re.compile(r"\blab(?:oratory|s)?\b|\bblood\s+(?:test|result|panel)\b|\bcbc\b|\bcmp\b|\bbmp\b|\bpanel\b|\bculture\b|\bcoagulation\b", re.I)
SOAP = re.compile(r"\bsubjective\b|\bobjective\b|\bassessment\b|\bplan\b|\bsoap\b|\ba\s*/\s*p\b|\bprogress\s+note\b|\bdaily\s+note\b", re.I)
DISCHARGE = re.compile(r"\bdischarge\b|\badmission\s+note\b|\bsummary\b", re.I)
MEASURED = re.compile(r"\b(?:mg|mL|mmHg|tablet|capsule|BID|TID|QID|mcg|mEq|units?)\b", re.I)
_MARK = re.compile(r"^(#{1,4}) +(\S.*)$", re.M)
_NUMBER = re.compile(r"^(\d{1,2}[a-d]?(?:\.\d{1,2})*)\.?\s+([A-Z][A-Za-z &/\-,()]+.*)$", re.M)
_TITLE = re.compile(rf"^({TITLES})\s*:?(?:[ \t]+(\S.*))?$", re.I | re.M)
_ENTRY = re.compile(r"^\W{0,4}(?:(?:hospital\s+)?day\s*#?\s*\d{1,3}\b|POD\s*#?\s*\d{1,3}\b|\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}\b)", re.I | re.M)
_ENDS = tuple(re.compile(p) for p in (r"\n\s*\n", r"\n", r"[.!?;][\"')\]]*\s+", r"\s+"))
_SENTENCE_END = re.compile(r"[.!?][\"')\]]*\s+|\n")


@dataclass(frozen=True)
class Sizes:
    """Characters: usual size, overlap, least size of a piece, most of a table and of any chunk."""

    usual: int = 1000
    overlap: int = 200
    least: int = 300
    table: int = 3000
    most: int = 1500
    snap: int = 120

    def of(self, title: str) -> int:
        """The size for a section's class."""
        return 400 if LAB.search(title) else 800 if SOAP.search(title) else 1500 if DISCHARGE.search(title) else self.usual


def valid_heading(title: str) -> bool:
    """A title of two words or more, short, mostly letters, without a code or a unit."""
    plain = sum(c.isalpha() or c.isspace() for c in title)
    return bool(title) and title[0].isupper() and len(title) <= 80 and len(re.findall("[A-Za-z]{2,}", title)) >= 2 and plain >= 0.6 * len(title) and not MEASURED.search(title) and not re.match(r"[A-Z]\d+\.\d+", title)


def _between(text: str, marks: list[tuple[int, int, str]], before: str) -> list[tuple[str, str]]:
    """(title, body) of the stretches between marks (where a stretch begins, where its body does, its title)."""
    out = []
    if marks[0][0] > 30 and text[: marks[0][0]].strip():
        out.append((before, text[: marks[0][0]].strip()))
    for (_, body, title), end in zip(marks, [m[0] for m in marks[1:]] + [len(text)]):
        out.append((title, text[body:end].strip() or title))
    return out


def by_marks(text: str) -> list[tuple[str, str]]:
    """Sections below ``#`` to ``####``; a title names those above it: ``A > B``."""
    path: dict[int, str] = {}
    marks = []
    for m in _MARK.finditer(text):
        level = len(m[1])
        path = {k: v for k, v in path.items() if k < level} | {level: m[2].strip()}
        marks.append((m.start(), m.start(), " > ".join(path[k] for k in sorted(path))))
    return _between(text, marks, "Introduction") if marks else []


def by_numbers(text: str) -> list[tuple[str, str]]:
    marks = [(m.start(), m.start(), f"{m[1]} {m[2].strip()}") for m in _NUMBER.finditer(text) if valid_heading(m[2].strip())]
    return _between(text, marks, "Document Header") if len(marks) > 1 else []


def by_titles(text: str) -> list[tuple[str, str]]:
    """Sections below well-known titles; text behind a title on its line is of the section."""
    marks = [(m.start(), m.start(2) if m[2] else m.end(), m[1].strip()) for m in _TITLE.finditer(text)]
    return _between(text, marks, "Preamble") if len(marks) > 1 else []


def sections(text: str) -> list[tuple[str, str]]:
    for cut in (by_marks, by_numbers, by_titles):
        found = cut(text)
        if len(found) > 1:
            return found
    return [("Document", text.strip())] if text.strip() else []


def entries(text: str) -> list[str]:
    """Dated entries, if there are two or more; what stands before the first belongs to it."""
    at = [m.start() for m in _ENTRY.finditer(text)]
    if len(at) < 2:
        return []
    return [e for a, z in zip([0, *at[1:]], [*at[1:], len(text)]) if (e := text[a:z].strip())]


def blocks(text: str) -> list[tuple[bool, str]]:
    """Runs of table lines and of other lines: (is a table, text)."""
    runs = ((k, "\n".join(g).strip("\n")) for k, g in groupby(text.split("\n"), lambda s: s.lstrip().startswith("|")))
    return [(k, t) for k, t in runs if t.strip()]


def _boundary(text: str, low: int, high: int) -> int:
    for ends in _ENDS:
        last = max((m.end() for m in ends.finditer(text, low, high) if m.end() <= high), default=-1)
        if last > low:
            return last
    return high


def running(text: str, size: int, overlap: int, snap: int) -> list[str]:
    """Pieces of at most ``size``, cut at the best boundary of their second half; each begins ``overlap``
    before the end of the last, or at a sentence's start up to ``snap`` characters later."""
    out, at = [], 0
    while len(text) - at > size:
        end = _boundary(text, at + max(size // 2, overlap + 1), at + size)
        out.append(text[at:end].strip())
        back = end - overlap
        near = _SENTENCE_END.search(text, back, min(end, back + snap)) if overlap else None
        at = near.end() if near else back
    out.append(text[at:].strip())
    return [p for p in out if p]


def table_pieces(text: str, size: int) -> list[str]:
    """Groups of whole rows within ``size``, each below the table's header; a longer row is cut itself."""
    rows = text.split("\n")
    head = rows[:2] if len(rows) > 1 and re.fullmatch(r"[|:\-\s]+", rows[1]) else []
    top = "\n".join(head)
    if len(top) > size // 2:
        return running(text, size, 0, 0)
    out, now = [], ""
    for row in rows[len(head) :]:
        for part in running(row, size - len(top) - 1, 0, 0) if len(row) + len(top) + 1 > size else [row]:
            if now and len(top) + len(now) + len(part) + 2 > size:
                out.append(now)
                now = ""
            now = f"{now}\n{part}" if now else part
    return [f"{top}\n{p}" if top else p for p in [*out, now] if p] or ([top] if top else [])


def section_pieces(title: str, body: str, sizes: Sizes) -> list[str]:
    size = sizes.of(title)
    parts = entries(body) or [body]
    out: list[str] = []
    for part in parts:
        if len(part) <= 1.5 * size:
            out.append(part)
            continue
        for is_table, text in blocks(part):
            out += table_pieces(text, min(sizes.table, max(size, sizes.usual))) if is_table else running(text, size, min(sizes.overlap, size // 3), sizes.snap)
    return out


def joined(pieces: list[tuple[str, str]], least: int, most: int) -> list[tuple[str, str]]:
    """(title, text) with pieces below ``least`` joined to the next of their section, the last of one to that before it."""
    out: list[tuple[str, str]] = []
    held: tuple[str, str] | None = None
    for title, text in pieces:
        if held:
            if held[0] == title and len(held[1]) + len(text) + 2 <= most:
                text = f"{held[1]}\n\n{text}"
            else:
                out.append(held)
        held = (title, text) if len(text) < least else None
        if held is None:
            out.append((title, text))
    if held:
        if out and out[-1][0] == held[0] and len(out[-1][1]) + len(held[1]) + 2 <= most:
            out[-1] = (held[0], f"{out[-1][1]}\n\n{held[1]}")
        else:
            out.append(held)
    return out


def semantic_segments(units: list[str], distances: list[float], percentile: float = 88.0, most: int = 20, least_chars: int = 360) -> list[str]:
    """Units joined until a distance to the next reaches the percentile (linear between ranks) and the segment is long enough."""
    if len(units) < 2:
        return ["\n".join(units)] if units else []
    ordered = sorted(distances)
    k = (len(ordered) - 1) * percentile / 100
    low = int(k)
    limit = ordered[low] + (ordered[min(low + 1, len(ordered) - 1)] - ordered[low]) * (k - low)
    out, now = [], units[0]
    for unit, d in zip(units[1:], distances):
        if d >= limit and len(now) >= least_chars and len(out) < most - 1:
            out.append(now)
            now = unit
        else:
            now = f"{now}\n{unit}"
    return [*out, now]


def chunks(text: str | None, sizes: Sizes = Sizes(), segment: Callable[[str], list[str]] | None = None) -> list[tuple[str, str]]:
    """(section title, chunk) of a document; ``segment``: cuts a document without sections where its matter changes."""
    if not text or not text.strip():
        return []
    found = sections(text)
    if len(found) == 1 and segment and len(text) >= 2 * sizes.usual:
        found = [(f"Part {i + 1}", s) for i, s in enumerate(segment(text)) if s.strip()]
    pieces = [(title, p) for title, body in found for p in section_pieces(title, body, sizes)]
    whole: list[tuple[str, str]] = []
    seen: set[str] = set()
    for title, piece in joined(pieces, sizes.least, sizes.most):
        key = " ".join(piece.lower().split())
        if len(piece) >= 100 and key in seen:
            continue
        seen.add(key)
        is_table = piece.lstrip().startswith("|")
        whole += [(title, p) for p in ([piece] if len(piece) <= sizes.most else table_pieces(piece, sizes.most) if is_table else running(piece, sizes.most, sizes.overlap, sizes.snap))]
    return whole


def chunk_documents(df: DataFrame, document: str, text: str, labels: dict[str, str] | None = None, sizes: Sizes = Sizes()) -> DataFrame:
    """(document, chunk_index, position, section_title, body, content): ``content`` is the body below
    a line of ``labels`` (name to column) and the section."""
    names = list((labels or {}).items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                found = chunks(b.column(1)[k].as_py(), sizes)
                known = [f"{n}: {v}" for i, (n, _) in enumerate(names) if (v := b.column(2 + i)[k].as_py())]
                n = len(found)
                heads = ["[" + " | ".join([*known, f"Section: {t}"]) + "]" for t, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array([k] * n, pa.int32())), pa.array(range(n), pa.int32()), pa.array([round(i / max(n - 1, 1), 4) for i in range(n)], pa.float64()), pa.array([t for t, _ in found], pa.string()), pa.array([p for _, p in found], pa.string()), pa.array([f"{h}\n{p}" for h, (_, p) in zip(heads, found)], pa.string())],
                    names=[document, "chunk_index", "position", "section_title", "body", "content"],
                )

    kind = df.schema[document].dataType.simpleString()
    return df.select(document, F.col(text), *[F.col(c).cast("string") for _, c in names]).mapInArrow(run, f"{document} {kind}, chunk_index int, position double, section_title string, body string, content string")
