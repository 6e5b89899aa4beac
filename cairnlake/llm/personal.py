"""Personal information inside free text (problem 2).

A character-level bidirectional LSTM with CRF transitions, trained in numpy
from labelled spans (see ``training.personal``).  A text is read in
overlapping windows; every character takes its scores from the window in which
it stands most inside, and one Viterbi pass over the whole text reconciles
them, so that no item is cut at a window's edge.  Exact checks of form follow
for the items found: an item is fitted to the whole number, mail address or
words it lies in, titles are left out, and an item without the form of its
kind is dropped.

Narrow: one Arrow pass, equal texts of a batch are read once, no shuffle; the
weights (a few hundred kB) go to the workers with the package.

Defined results: null and empty texts have no items; texts of any length are
read whole; positions count code points; items never overlap.
"""

from __future__ import annotations

import io
import pkgutil
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.session import spread

KINDS = ("name", "email", "phone", "id_no", "address")
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
WINDOW, OVERLAP, BATCH = 192, 64, 512
_CHARS = " abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.,;:!?'’\"()[]{}<>@#$%&*+-–—/\\|_=~\n\t\xa0"
_INDEX = {c: i + 4 for i, c in enumerate(_CHARS)}
SYMBOLS = len(_CHARS) + 4

# Titles that stand before a name and are not part of it.
TITLES = ("dr", "mr", "mrs", "ms", "miss", "prof", "professor", "doctor", "sir", "madam", "herr", "frau", "señor", "señora", "sr", "sra", "mme", "nurse", "patient", "patientin", "paciente")


def codes(text: str) -> np.ndarray:
    """One small number a character; letters outside ASCII by case, the rest as others."""
    return np.array([_INDEX.get(c) or (1 if c.islower() else 2 if c.isalpha() else 3) for c in text], np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def lstm(x: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, keep: bool = False):
    """(time, batch, in) to (time, batch, hidden); gates in the order i, f, o, g."""
    t, n, _ = x.shape
    hidden = u.shape[0]
    pre = x @ w + b
    h = np.zeros((n, hidden), x.dtype)
    c = np.zeros((n, hidden), x.dtype)
    out = np.empty((t, n, hidden), x.dtype)
    saved = []
    for k in range(t):
        z = pre[k] + h @ u
        gates = _sigmoid(z[:, : 3 * hidden])
        g = np.tanh(z[:, 3 * hidden :])
        i, f, o = gates[:, :hidden], gates[:, hidden : 2 * hidden], gates[:, 2 * hidden :]
        before = c
        c = f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        out[k] = h
        if keep:
            saved.append((i, f, o, g, before, tc))
    return (out, saved) if keep else out


def scores(p: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Tag scores (time, batch, tags) of padded windows of codes (time, batch)."""
    e = p["embed"][x]
    ahead = lstm(e, p["w0"], p["u0"], p["b0"])
    back = lstm(e[::-1], p["w1"], p["u1"], p["b1"])[::-1]
    return np.concatenate([ahead, back], 2) @ p["out"] + p["bias"]


def prepared(p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Weights for reading: the input side as one row a symbol, and gates halved, so
    that one tanh serves all of them."""
    out = dict(p)
    for d in "01":
        half = np.ones(p[f"b{d}"].shape, np.float32)
        half[: 3 * len(half) // 4] = 0.5
        out[f"in{d}"] = ((p["embed"] @ p[f"w{d}"] + p[f"b{d}"]) * half).astype(np.float32)
        out[f"rec{d}"] = (p[f"u{d}"] * half).astype(np.float32)
    return out


def read(table: np.ndarray, u: np.ndarray, x: np.ndarray) -> np.ndarray:
    """As ``lstm`` over codes, by prepared weights."""
    t, n = x.shape
    hidden = u.shape[0]
    h, c = np.zeros((n, hidden), np.float32), np.zeros((n, hidden), np.float32)
    z, out = np.empty((n, 4 * hidden), np.float32), np.empty((t, n, hidden), np.float32)
    for k in range(t):
        np.dot(h, u, out=z)
        z += table[x[k]]
        np.tanh(z, out=z)
        gates = z[:, : 3 * hidden]
        gates += 1
        gates *= 0.5
        c *= z[:, hidden : 2 * hidden]
        c += z[:, :hidden] * z[:, 3 * hidden :]
        h = out[k]
        np.tanh(c, out=h)
        h *= z[:, 2 * hidden : 3 * hidden]
    return out


@lru_cache(maxsize=1)
def parameters() -> dict[str, np.ndarray]:
    m = np.load(io.BytesIO(pkgutil.get_data("cairnlake.llm", "models/personal.npz")))
    return prepared({k: m[k].astype(np.float32) for k in m.files})


def windows(n: int) -> list[tuple[int, int]]:
    step = WINDOW - OVERLAP
    return [(a, min(a + WINDOW, n)) for a in range(0, max(n - OVERLAP, 1), step)]


def emissions(texts: list[str], p: dict[str, np.ndarray]) -> list[np.ndarray]:
    """Tag scores of every character of every text."""
    p = p if "in0" in p else prepared(p)
    todo = []
    out = [np.zeros((len(t), len(TAGS)), np.float32) for t in texts]
    coded = [codes(t) for t in texts]
    for k, t in enumerate(texts):
        todo += [(z - a, k, a, z) for a, z in windows(len(t))]
    todo.sort()
    for s in range(0, len(todo), BATCH):
        part = todo[s : s + BATCH]
        longest = part[-1][0]
        # both directions must begin at the text: shorter windows are padded behind
        # for the one, before for the other, by giving each its own array
        x = np.zeros((longest, len(part)), np.int64)
        y = np.zeros((longest, len(part)), np.int64)
        for j, (n, k, a, z) in enumerate(part):
            x[:n, j] = coded[k][a:z]
            y[longest - n :, j] = coded[k][a:z]
        ahead = read(p["in0"], p["rec0"], x)
        back = read(p["in1"], p["rec1"], y[::-1])[::-1]
        half = ahead.shape[2]
        one, two = ahead @ p["out"][:half], back @ p["out"][half:] + p["bias"]
        for j, (n, k, a, z) in enumerate(part):
            e = one[:n, j] + two[longest - n :, j]
            # each character's scores come from the window in which it stands most inside
            left = OVERLAP // 2 if a else 0
            right = OVERLAP // 2 if z < len(texts[k]) else 0
            out[k][a + left : z - right] = e[left : n - right]
    return out




#: Scores that one Viterbi batch holds at most, and texts in it.
_CELLS, _TEXTS = 1 << 22, 512


def paths(scored: list[np.ndarray], p: dict[str, np.ndarray]) -> list[np.ndarray]:
    """The best path of tags over the whole of every text; texts of like length go side by side."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(scored)
    order = sorted((i for i in range(len(scored)) if len(scored[i])), key=lambda i: len(scored[i]))
    k = len(TAGS)
    while order:
        longest = len(scored[order[-1]])
        n = max(1, min(len(order), _TEXTS, _CELLS // (longest * k)))
        part, order = order[-n:], order[:-n]
        lengths = np.array([len(scored[i]) for i in part])
        e = np.zeros((longest, n, k), np.float32)
        for j, i in enumerate(part):
            e[: lengths[j], j] = scored[i]
        back = np.empty((longest, n, k), np.int8)
        s = p["start"] + e[0]
        stay = np.arange(k, dtype=np.int8)
        for t in range(1, longest):
            m = s[:, :, None] + p["move"]
            here = t < lengths
            back[t] = m.argmax(1)
            step = m.max(1) + e[t]
            if here.all():
                s = step
            else:
                s = np.where(here[:, None], step, s)
                back[t, ~here] = stay
        path = np.empty((longest, n), np.int64)
        path[-1] = s.argmax(1)
        rows = np.arange(n)
        for t in range(longest - 1, 0, -1):
            path[t - 1] = back[t, rows, path[t]]
        for j, i in enumerate(part):
            out[i] = path[: lengths[j], j]
    return out


def spans_of(path: np.ndarray) -> list[tuple[int, int, str]]:
    """Items of one path: a begin or a change of kind starts one."""
    if not path.any():
        return []
    kind = np.where(path > 0, (path - 1) // 2, -1)
    begins = (path > 0) & ((path % 2 == 1) | (kind != np.concatenate([[-1], kind[:-1]])))
    ends = np.flatnonzero((kind >= 0) & (np.concatenate([begins[1:], [True]]) | (kind != np.concatenate([kind[1:], [-1]])))) + 1
    return [(int(a), int(z), KINDS[kind[a]]) for a, z in zip(np.flatnonzero(begins), ends)]


# ---- exact checks -------------------------------------------------------------------------------

_MAIL = re.compile(r"[\w][\w.+%-]*(?:\s?@\s?|\s?\(at\)\s?|\s?\[at\]\s?)[\w-]+(?:\.[\w-]+)+", re.I)
_PHONE = re.compile(r"(?:\+|\()?\d[\d ()./–-]{5,}\d")
_ID = re.compile(r"[A-Z]{2,4}-?\d[\dA-Z-]*\d|\d[\d -]{4,}\d", re.I)
_WORD = re.compile(r"[^\W\d_]")
_TITLE = re.compile(rf"(?:{'|'.join(TITLES)})\.?\s+", re.I)


def _fit(pattern: re.Pattern, text: str, a: int, z: int) -> tuple[int, int] | None:
    """The match of ``pattern`` that overlaps [a, z) most."""
    best, most = None, 0
    for m in pattern.finditer(text, max(0, a - 320), min(len(text), z + 320)):
        over = min(z, m.end()) - max(a, m.start())
        if over > most:
            best, most = m.span(), over
    return best


def checked(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    out: list[tuple[int, int, str]] = []
    for a, z, kind in spans:
        if kind in ("email", "phone", "id_no"):
            fit = _fit({"email": _MAIL, "phone": _PHONE, "id_no": _ID}[kind], text, a, z)
            if fit is None:
                continue
            a, z = fit
            if kind == "phone":
                n = sum(c.isdigit() for c in text[a:z])
                if not 7 <= n <= 16:
                    continue
                if text[a:z].count(")") > text[a:z].count("(") and a and text[a - 1] == "(":
                    a -= 1
                if text[a] == "(" and ")" not in text[a:z]:  # the bracket is not of the number
                    a += 1
                if a and text[a - 1] == "+":
                    a -= 1
            if kind == "id_no" and sum(c.isdigit() for c in text[a:z]) < 6:
                continue
        else:
            while a < z and not text[a].isalnum():
                a += 1
            while z > a and not (text[z - 1].isalnum() or text[z - 1] == "."):
                z -= 1
            if a >= z:
                continue
            while a and text[a - 1].isalnum():
                a -= 1
            while z < len(text) and text[z].isalnum():
                z += 1
            if kind == "name":
                while m := _TITLE.match(text, a, z):
                    a = m.end()
                if text[a:z].lower().endswith(("'s", "’s")):
                    z -= 2
                if re.search(r"\w\w\w\.$", text[a:z]):
                    z -= 1
                if not _WORD.search(text, a, z) or z - a < 2:
                    continue
        if out and a < out[-1][1]:
            if out[-1][2] == kind:
                out[-1] = (out[-1][0], max(z, out[-1][1]), kind)
            continue
        out.append((a, z, kind))
    return out


def find(texts: list[str], p: dict[str, np.ndarray] | None = None) -> list[list[tuple[int, int, str]]]:
    p = parameters() if p is None else p
    return [checked(t, spans_of(path)) for t, path in zip(texts, paths(emissions(texts, p), p))]


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with a placeholder of its kind for each item."""
    out, at = [], 0
    for a, z, kind in spans:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = z
    return "".join([*out, text[at:]])


_ITEMS = "row_id long, items array<struct<start_pos:long,end_pos:long,kind:string>>, masked string"


def items(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """(row_id, items, masked) of every text that is not null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start_pos", pa.int64()), ("end_pos", pa.int64()), ("kind", pa.string())]))
        for batch in batches:
            for s in range(0, batch.num_rows, 2048):
                b = batch.slice(s, 2048)
                texts = b.column(1).to_pylist()
                once = list(dict.fromkeys(texts))
                seen = dict(zip(once, find(once)))
                rows = [seen[t] for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([[{"start_pos": a, "end_pos": z, "kind": k} for a, z, k in r] for r in rows], kind), pa.array([masked(t, r) for t, r in zip(texts, rows)], pa.string())], names=["row_id", "items", "masked"]
                )

    return spread(df.select(F.col(row_id).cast("long").alias("row_id"), F.col(text).alias("_t")).filter(F.col("_t").isNotNull())).mapInArrow(run, _ITEMS)
