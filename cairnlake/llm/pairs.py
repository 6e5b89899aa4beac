"""Broken prompt and response pairs (problem 3).

A multi-label linear classifier over hashed n-grams of the answer and features
of the pair; one logistic unit a defect, each with a threshold calibrated on
held-out synthetic pairs.  Training pairs are sound pairs and synthetic
defects of them (truncated, copied, refused, answered in another language),
see ``training.pairs``.

Narrow: one Arrow pass, no shuffle; the model goes to the workers with the
package.  Whole texts are read.

Defined results: a null answer or one of nothing but white space, marks, a
citation or a filler is ``empty`` and nothing else; a null or empty question
can't be copied or set a language; a pair gets the defect its units are surest
of, so at most one.
"""

from __future__ import annotations

import io
import pkgutil
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlake.session import spread

DEFECTS = ("truncated", "refusal", "copy", "language")
BUCKETS = 1 << 15

# Fillers that stand for no answer, and frequent words of each language.
FILLERS = ("n/a", "na", "none", "null", "nil", "nan", "empty", "no answer", "no response", "tbd", "undefined", "missing", "blank", "-", "no reply", "not available")
FUNCTION_WORDS = {
    "en": "the is of and to in was with on for this that what which when how does did by at from be has are not patient after",
    "de": "der die das und ist wurde mit am des im bei nach von für eine einen nicht wie hoch warum weil soll daher",
    "es": "el la los las de del en fue por que una con se y qué cuál es no según desde para sin paciente debe",
    "fr": "le la les des du de une est était par que pour avec dans quelle pourquoi ce cette qui sont après donc oui a été",
    "it": "il la di del della era stato che per con una sono è durante ricovero paziente dopo non",
    "pt": "o a os as de do da foi em que com para uma sem não segundo doente outras após",
}
_WORDS = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
_CITE = re.compile(r"\[\s*[A-Za-z]?\s*\d+\s*\]")
_ASKED = re.compile(r"^\s*(?:for patient [^?\n]*?\)[,:]\s*|patient [^:?\n]*\([^)]*\):\s*|for [^,\n]+,\s+)", re.I)
_NOTE = re.compile(r"\n[A-Z][a-z]+(?: [a-z]+)?: [^\n]{5,}$")  # a labelled line below the answer
_LEAD = re.compile(r"^\s*(?:>+|q(?:uestion)?\s*:|you asked\s*:|repeat(?:ing)?\s*:|question\s+was\s*:)\s*", re.I)


def bare(text: str) -> str:
    """Letters and digits in lower case, one blank between words."""
    return " ".join(re.findall(r"[^\W_]+", text.lower()))


def is_empty(answer: str | None) -> bool:
    """Null, nothing but white space, marks and citations, or a filler for nothing."""
    if answer is None:
        return True
    t = _CITE.sub(" ", answer)
    t = "".join(c for c in t if unicodedata.category(c) not in ("Cf", "Cc") or c in "\n\t").strip().lower()
    if not any(c.isalnum() for c in t):
        return True
    return t.strip("()[]{}<>\"'*_.!-– ").strip() in FILLERS or t in FILLERS


def script(text: str) -> str:
    n: dict[str, int] = {}
    for c in text:
        if c.isalpha():
            o = ord(c)
            k = "latin" if o < 0x250 or 0x1E00 <= o < 0x1F00 else "cyrillic" if 0x400 <= o < 0x530 else "arabic" if 0x600 <= o < 0x780 else "han" if 0x3040 <= o < 0xA000 else "other"
            n[k] = n.get(k, 0) + (3 if k == "han" else 1)
    return max(n, key=n.__getitem__) if n else "none"


def language_scores(text: str) -> dict[str, float]:
    words = re.findall(r"[^\W\d_]+", text.lower())
    n = max(len(words), 1)
    return {k: sum(w in v for w in words) / n for k, v in _WORDS.items()}


def word_codes(words: set[str]) -> np.ndarray:
    return np.unique(np.array([zlib.crc32(w.encode()) for w in words], np.uint32))


def _ending(word: str, known: frozenset[int]) -> str:
    """What kind of word an answer ends with: one cut short is seldom a known one."""
    if not word:
        return "none"
    if word[-1].isdigit():
        return "number"
    if zlib.crc32(word.lower().encode()) in known:
        return "known"
    return "proper" if word[0].isupper() and len(word) > 4 else "strange"


def pair_features(question: str | None, answer: str, known: frozenset[int] = frozenset()) -> list[tuple[str, float]]:
    """Named features of the pair; n-grams of the answer are added by ``vector``.
    ``known``: codes of the words of sound answers."""
    q = _ASKED.sub("", question or "", count=1)
    a = _NOTE.sub("", answer.rstrip()).strip()
    core = _CITE.sub("", a).strip()
    f: list[tuple[str, float]] = [("bias", 1.0)]
    # the end of the answer
    last = a[-1] if a else " "
    stripped_cite = bool(re.search(r"\[[A-Za-z]?\d+\][.。۔]?$", a))
    f.append((f"end={'stop' if last in '.!?。！？۔' else 'cite' if last == ']' else 'cont' if last in '…,;:-–([' else 'digit' if last.isdigit() else 'letter' if last.isalpha() else 'other'}", 1.0))
    if a.endswith(("...", "…", "..")):
        f.append(("end=dots", 2.0))
    if answer != answer.rstrip() and last not in ".!?]":
        f.append(("end=blank", 1.5))
    if re.search(r"\[[A-Za-z]?\d*$", a):
        f.append(("end=open_cite", 2.0))
    words = re.findall(r"[^\W_]+", core)
    tail = words[-1].lower() if words else ""
    f += [(f"tail={tail}", 1.0), (f"tail2={' '.join(words[-2:]).lower()}", 1.0), (f"tailend={tail[-3:]}", 0.5), (f"words={min(len(words), 12)}", 0.5)]
    ending = _ending(words[-1] if words else "", known)
    closed = last in ".!?。！？۔]"
    f += [(f"ending={ending}&closed={closed}", 1.5), (f"ending={ending}&closed={closed}&words={min(len(words) // 2, 5)}", 1.0), (f"opens={words[0].lower() if words else ''}&closed={closed}&ending={ending}", 0.7)]
    f.append((f"cited={bool(_CITE.search(a))}&end={'cite' if stripped_cite else 'other'}", 1.0))
    lines = [x for x in a.split("\n") if x.strip()]
    if len(lines) > 1:
        f.append((f"lines={min(len(lines), 4)}&last_short={len(lines[-1]) < 0.5 * max(map(len, lines))}", 1.0))
        style = [x.rstrip()[-1] in ".;!?]" for x in lines[1:]]
        marked = sum(bool(re.match(r"\s*(?:[-*•–]|\d+[.)])\s", x)) for x in lines)
        f += [(f"style={'even' if len(set(style)) == 1 else 'odd'}&closed={closed}&ending={ending}", 1.5), (f"marked={min(marked, 3)}&last={bool(re.match(r'[ ]*(?:[-*•–]|[0-9]+[.)])[ ]', lines[-1]))}&closed={closed}&ending={ending}", 1.0)]
        first_number = re.match(r"(\d+)\. ", lines[0]), re.match(r"(\d+)\. ", lines[-1])
        if first_number[0]:
            f.append((f"list={len(lines)}&with={' with ' in lines[-1]}", 1.0))
        if lines[0].rstrip().endswith(":"):
            f.append((f"announced&items={min(len(lines) - 1, 4)}", 1.0))
    head = " ".join(words[:2]).lower()
    f.append((f"head2={head}&end={'closed' if last in '.!?。！？۔]' else 'open'}", 1.0))
    f.append((f"shape={'closed' if last in '.!?。！？۔]' else 'open'}&len={min(len(words) // 3, 4)}&verb={bool(re.search(chr(92) + 'b(is|was|were|are|has|have|be|been)' + chr(92) + 'b', a.lower()))}", 1.0))
    # against the question
    bq, ba = bare(q), bare(_LEAD.sub("", core))
    raw = bare(question or "")
    copies = bool(bq) and (ba == bq or ba == raw or (len(bq) > 3 and re.fullmatch(rf"(?:{re.escape(bq)} ?)+", ba) is not None) or (bool(raw) and re.fullmatch(rf"(?:{re.escape(raw)} ?)+", ba) is not None))
    lead = bool(_LEAD.match(core))
    sq, sa = set(bq.split()), set(ba.split())
    over = len(sq & sa) / max(len(sa), 1)
    cover = len(sq & sa) / max(len(sq), 1)
    f += [("copy=whole", 8.0 * copies), ("copy=prefix", 1.0 * (bool(bq) and not copies and ba.startswith(bq))), ("copy=lead", 1.0 * lead), ("copy=over", over), ("copy=both", over * cover), ("copy=part", 2.0 * (bool(ba) and not copies and len(ba) >= 8 and bq.startswith(ba) and over == 1.0))]
    if not copies and bool(ba) and 0.95 < over and cover > 0.9:
        f.append(("copy=same_words", 1.0))
    # languages
    scq, sca = script(q), script(re.sub(r"\b[A-Z][a-z]{4,}\b", " ", re.sub(r'"[^"]*"|«[^»]*»|“[^”]*”', " ", core)) or core)
    if scq != "none" and sca != "none":
        f.append((f"script={'same' if scq == sca else 'other'}", 2.0 if scq != sca else 0.2))
    unquoted = re.sub(r'"[^"]*("|$)|«[^»]*(»|$)|“[^”]*(”|$)', " ", core)
    lq, la = language_scores(q), language_scores(unquoted)
    best_q, best_a = max(lq, key=lq.__getitem__), max(la, key=la.__getitem__)
    margin = la[best_a] - la[best_q]
    if lq[best_q] > 0 and len(re.findall(r"[^\W\d_]+", unquoted)) >= 4:
        f += [("lang=margin", 4.0 * margin), (f"lang={'same' if best_q == best_a or margin <= 0 else 'other'}", 1.0), (f"lang={best_q}>{best_a if margin > 0 else best_q}", 1.0)]
    return [x for x in f if x[1]]


def vector(question: str | None, answer: str, known: frozenset[int] = frozenset()) -> tuple[np.ndarray, np.ndarray]:
    """Hashed indices and values of one pair."""
    acc: dict[int, float] = {}
    for name, v in pair_features(question, answer, known):
        i = zlib.crc32(name.encode()) % BUCKETS
        acc[i] = acc.get(i, 0.0) + v
    # drug names, numbers and names carry no defect: masked
    text = re.sub(r"\d+", "0", re.sub(r"(?<=[a-z,;:] )[A-Z][a-z]{4,}\b", "Xx", _CITE.sub("[0]", answer.strip())))
    words = re.findall(r"[^\W_]+", text.lower())
    grams = words + [f"{a} {b}" for a, b in zip(words, words[1:])] + [f"{a} {b} {c}" for a, b, c in zip(words, words[1:], words[2:])]
    w = 1.0 / max(len(words), 1) ** 0.5
    for g in set(grams):
        i = zlib.crc32(b"g" + g.encode()) % BUCKETS
        acc[i] = acc.get(i, 0.0) + w
    return np.fromiter(acc, np.int64, len(acc)), np.fromiter(acc.values(), np.float64, len(acc))


@lru_cache(maxsize=1)
def model() -> tuple[np.ndarray, np.ndarray, frozenset[int]]:
    """(weights by defect and bucket, logit thresholds, codes of known words)."""
    m = np.load(io.BytesIO(pkgutil.get_data("cairnlake.llm", "models/pairs.npz")))
    w = np.zeros((len(DEFECTS), BUCKETS))
    w[:, m["at"]] = m["w"]
    return w, m["thresholds"], frozenset(m["known"].tolist())


def defect(question: str | None, answer: str | None) -> str | None:
    if is_empty(answer):
        return "empty"
    w, thresholds, known = model()
    at, v = vector(question, answer, known)
    z = w[:, at] @ v - thresholds
    k = int(z.argmax())
    return DEFECTS[k] if z[k] > 0 else None


def every_defect(question: str | None, answer: str | None) -> list[str]:
    """All defects whose unit passes its threshold, the surest first; the first is that of ``defect``."""
    if is_empty(answer):
        return ["empty"]
    w, thresholds, known = model()
    at, v = vector(question, answer, known)
    z = w[:, at] @ v - thresholds
    return [DEFECTS[k] for k in np.argsort(-z, kind="stable") if z[k] > 0]


def defects(df: DataFrame, row_id: str, question: str | Column, answer: str | Column) -> DataFrame:
    """(row_id, defect) of every pair; null where the pair is sound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [defect(q, a) for q, a in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.string())], names=["row_id", "defect"])

    q = F.col(question) if isinstance(question, str) else question
    a = F.col(answer) if isinstance(answer, str) else answer
    return spread(df.select(F.col(row_id).cast("long").alias("row_id"), q.alias("_q"), a.alias("_a"))).mapInArrow(run, "row_id long, defect string")


def all_defects(df: DataFrame, row_id: str, question: str, answer: str) -> DataFrame:
    """(row_id, defect), a row for every defect of a pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [every_defect(q, a) for q, a in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.string()))], names=["row_id", "found"])

    d = df.select(F.col(row_id).cast("long").alias("row_id"), F.col(question).alias("_q"), F.col(answer).alias("_a")).mapInArrow(run, "row_id long, found array<string>")
    return d.select("row_id", F.explode("found").alias("defect"))
