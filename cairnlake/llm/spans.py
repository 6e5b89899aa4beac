"""Long exact spans shared between records (problem 10).

``repeated_units`` is line hashing as such: sentences and lines are normalised,
their digests grouped globally, the earliest ranked occurrence is kept and the
rest removed by original offsets.  It can't find a stretch that begins and ends
inside sentences, and normalised units are not verbatim, so ``shared_spans``
goes on by another method (content-defined fingerprints, then exact windows):
its line is a
unit of fixed length that starts at a content-defined break: the break is the
smallest hash among ``min_len - unit + 1`` neighbouring starts, so every
stretch of ``min_len`` characters that stands in two texts holds at least one
whole line of both.  Lines that occur in more than one text name candidates;
an exact check follows: windows of ``min_len`` characters around them are
digested by a second, independent hash and grouped globally in the same way.
The union of the windows that stand in two texts is exactly the union of all
stretches of at least ``min_len`` characters.

Scale: digests are grouped by aggregates with map-side combination (smallest
and largest text), never by collecting a group; joins go back by digest with
one row a digest on one side, so that a line that a third of all texts share
only makes a skewed side, which AQE splits.  Copies of whole texts are
collapsed first.  Nothing is broadcast by size unknown.

Defined results: null and texts shorter than ``min_len`` share nothing; a text
that another record repeats whole is shared whole; repeats inside one record
alone don't count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnlake.llm.staging import discard, staged
from cairnlake.session import spread

MIN_LEN, UNIT = 200, 120
#: Characters hashed at a time.
_BLOCK = 1 << 20
_LINE_BASE, _WINDOW_BASE = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of all substrings of one length, mod 2**64, by prefix sums."""

    def __init__(self, base: int):
        self.base, self.n = base, 0

    def _powers(self, n: int) -> None:
        if n > self.n:
            self.n = max(n, _BLOCK)
            up = np.full(self.n + 1, self.base, np.uint64)
            down = np.full(self.n + 1, pow(self.base, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)

    def __call__(self, codes: np.ndarray, length: int) -> np.ndarray:
        n = len(codes)
        self._powers(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_mix(codes.astype(np.uint64) + np.uint64(self.base)) * self.up[:n], out=sums[1:], dtype=np.uint64)
        return _mix((sums[length:] - sums[: n - length + 1]) * self.down[: n - length + 1])


_line_hash, _window_hash = Rolling(_LINE_BASE), Rolling(_WINDOW_BASE)


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of ``w`` neighbours, by doubling."""
    out, have = x, 1
    while have * 2 <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < w:
        out = np.minimum(out[: len(x) - w + 1], out[w - have :][: len(x) - w + 1])
    return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def line_starts(codes: np.ndarray, min_len: int, unit: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and digests of the content-defined lines of one run of characters."""
    h = _line_hash(codes, unit)
    w = min_len - unit + 1
    low = _sliding_min(h, w)
    # a start is chosen if it is the smallest of one of the w runs that hold it
    padded = np.concatenate([np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64)])
    high = ~_sliding_min(~padded, w)
    at = np.flatnonzero(h == high)
    return at, h[at]


def _lines(min_len: int, unit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ident = b.column(0).to_numpy()
            texts = b.column(1).to_pylist()
            i = 0
            while i < len(texts):
                parts, rows, total = [], [], 0
                while i < len(texts) and (not parts or total + len(texts[i]) <= _BLOCK):
                    parts.append(_codes(texts[i]))
                    rows.append(i)
                    total += len(parts[-1])
                    i += 1
                if len(parts) == 1:
                    at, h = line_starts(parts[0], min_len, unit)
                    yield _batch(("h", h.view(np.int64)), ("ident", np.full(len(at), ident[rows[0]])), ("pos", at.astype(np.int32)))
                    continue
                at, h, row, pos = _joined(parts, min_len, unit)
                yield _batch(("h", h.view(np.int64)), ("ident", ident[np.asarray(rows)][row]), ("pos", pos))

    return run


def _joined(parts: list[np.ndarray], min_len: int, unit: int):
    """``line_starts`` of many texts in one pass: what crosses a text's end is cut off."""
    lengths = np.array([len(p) for p in parts])
    begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    codes = np.concatenate(parts)
    h = _line_hash(codes, unit)
    n, w = len(h), min_len - unit + 1
    low = _sliding_min(h, w)
    # runs of w starts that leave the text hold no choice
    inside = np.zeros(len(codes) + 1, np.int8)
    np.add.at(inside, begins, 1)
    np.add.at(inside, begins + lengths - min_len + 1, -1)
    low = np.where(np.cumsum(inside)[: len(low)] > 0, low, np.uint64(0))
    padded = np.concatenate([np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64)])
    high = ~_sliding_min(~padded, w)
    at = np.flatnonzero((h == high[:n]) & (high[:n] != 0))
    row = np.searchsorted(begins, at, "right") - 1
    return at, h[at], row, (at - begins[row]).astype(np.int32)


def _batch(*columns: tuple[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) for _, v in columns], names=[k for k, _ in columns])


def _windows(min_len: int, unit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            reps = b.column(0).to_numpy()
            places = b.column(1)
            for k, text in enumerate(b.column(2).to_pylist()):
                codes = _codes(text)
                last = len(codes) - min_len
                if last < 0:
                    continue
                p = places[k].values.to_numpy()
                mark = np.zeros(last + 2, np.int32)
                np.add.at(mark, np.maximum(p + unit - min_len, 0), 1)
                np.add.at(mark, np.minimum(p, last) + 1, -1)
                at = np.flatnonzero(np.cumsum(mark)[: last + 1] > 0)
                h = _window_hash(codes, min_len)[at]
                yield _batch(("w", h.view(np.int64)), ("rep", np.full(len(at), reps[k])), ("start", at.astype(np.int32)))

    return run


def _union(min_len: int):
    """Starts of shared windows of one text to spans; ``first``: no earlier record has the window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans, later = [], []
            for starts, repeats in zip(b.column(1), b.column(2)):
                spans.append(_merge(np.sort(starts.values.to_numpy()), min_len))
                later.append(_merge(np.sort(repeats.values.to_numpy()), min_len))
            kind = pa.list_(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, kind), pa.array(later, kind)], names=["rep", "spans", "repeats"])

    return run


def _merge(starts: np.ndarray, length: int) -> list[list[int]]:
    if not len(starts):
        return []
    gap = np.flatnonzero(np.diff(starts) > length)
    a = starts[np.concatenate([[0], gap + 1])]
    z = starts[np.concatenate([gap, [len(starts) - 1]])] + length
    return np.stack([a, z], 1).tolist()


def shared_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_len: int = MIN_LEN, unit: int = UNIT, passes: int = 4) -> DataFrame:
    """(id, n_chars, copies, spans, repeats, shared_chars) of every record that shares a span.

    ``copies``: records with the same text; ``spans``: the shared stretches as
    [start, end); ``repeats``: the part of them that an earlier record (by id)
    has already, which a corpus would drop.  ``passes``: the windows are
    grouped in so many shares of their digests, which bounds the disk used.
    """
    docs = df.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).filter(F.length("_text") >= min_len)
    docs = docs.withColumn("_ident", F.xxhash64("_text"))
    texts = docs.groupBy("_ident").agg(F.min("_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min(F.length("_text")).alias("n_chars"))
    texts = staged(texts, "texts")

    lines = staged(docs.select("_ident", "_text").mapInArrow(_lines(min_len, unit), "h long, ident long, pos int"), "lines")
    often = lines.groupBy("h").agg(F.min("ident").alias("a"), F.max("ident").alias("b")).filter("a <> b").select("h")
    places = lines.join(often, "h", "left_semi").select("ident", "pos").distinct().groupBy("ident").agg(F.collect_list("pos").alias("places"))
    places = places.join(texts.select(F.col("_ident").alias("ident"), "rep"), "ident").select("rep", "places")
    places = staged(places, "places")
    discard(lines)
    near = places.join(docs.select(F.col("_id").alias("rep"), "_text"), "rep")
    windows = near.select("rep", "places", "_text").mapInArrow(_windows(min_len, unit), "w long, rep long, start int")
    windows = staged(windows.withColumn("share", F.pmod("w", F.lit(passes)).cast("int")), "windows", by="share")
    parts = []
    for i in range(passes):  # by digest, so that the shuffles of one pass are gone before the next
        some = windows.filter(F.col("share") == i)
        both = some.groupBy("w").agg(F.min("rep").alias("first"), F.max("rep").alias("last")).filter("first <> last").select("w", "first")
        parts.append(staged(some.join(both, "w").select("rep", "start", (F.col("rep") != F.col("first")).alias("later")), "hits"))
    discard(windows, places)
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)
    hits = hits.groupBy("rep").agg(F.collect_list("start").alias("starts"), F.collect_list(F.when(F.col("later"), F.col("start"))).alias("later"))
    spans = hits.select("rep", "starts", "later").mapInArrow(_union(min_len), "rep long, spans array<array<int>>, repeats array<array<int>>")

    merged = texts.join(spans, "rep", "left").filter("copies > 1 OR spans IS NOT NULL")
    whole = F.array(F.array(F.lit(0), F.col("n_chars")))
    out = docs.select("_id", "_ident").join(merged, "_ident")
    many = F.col("copies") > 1
    out = out.select(
        F.col("_id").cast(df.schema[id_col].dataType).alias(id_col), "n_chars", "copies",
        F.when(many, whole).otherwise(F.col("spans")).alias("spans"),
        F.when(many & (F.col("_id") != F.col("rep")), whole).otherwise(F.coalesce("repeats", F.array().cast("array<array<int>>"))).alias("repeats"),
    )
    return out.withColumn("shared_chars", F.aggregate("spans", F.lit(0), lambda n, s: n + s[1] - s[0]))


_SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*|[.!?\n]+")


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at, cols, held = [], [[], [], [], []], 0
        for k in range(b.num_rows):
            for i, m in enumerate(_SENTENCE.finditer(b.column(1)[k].as_py())):
                at.append(k)
                digest = blake2b(" ".join(m[0].lower().split()).encode("utf-8", "surrogatepass"), digest_size=16).digest()
                for c, v in zip(cols, (i, m.start(), m.end(), digest)):
                    c.append(v)
                held += 1
            if held > 1 << 16:
                yield _unit_batch(b, at, cols)
                at, cols, held = [], [[], [], [], []], 0
        yield _unit_batch(b, at, cols)


def _unit_batch(b: pa.RecordBatch, at: list[int], cols: list[list]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["id", "i", "a", "z", "digest"])


def repeated_units(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_len: int = MIN_LEN) -> DataFrame:
    """(id, start_pos, end_pos): stretches of at least ``min_len`` characters made of whole
    sentences or lines that an earlier record (by id) has too.

    Units are normalised (case and white space) and their 128-bit digests
    grouped globally; the earliest ranked occurrence is kept, the others make
    up the stretches, with offsets of the original text.  A unit that only its
    own record repeats is kept.
    """
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("_t")).filter(F.length("_t") >= min_len)
    units = staged(spread(texts).mapInArrow(_units, "id long, i int, a int, z int, digest binary"), "units")
    first = units.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first <> last").select("digest", "first")
    later = units.join(first, "digest").filter("id <> first").select("id", "i", "a", "z")
    w = Window.partitionBy("id").orderBy("i")
    runs = later.withColumn("run", F.col("i") - F.row_number().over(w))
    runs = runs.groupBy("id", "run").agg(F.min("a").alias("start_pos"), F.max("z").alias("end_pos")).filter(F.col("end_pos") - F.col("start_pos") >= min_len)
    return runs.select(F.col("id").cast(df.schema[id_col].dataType).alias(id_col), "start_pos", "end_pos")


def kept(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, start_pos, end_pos, piece) of what is left of every record without its ``repeats``, by original offsets."""
    cuts = shared_spans(df, id_col, text_col, **options).select(id_col, "repeats")
    d = df.select(id_col, F.col(text_col).alias("_text")).filter(F.length("_text") > 0).join(cuts, id_col, "left")
    r = F.coalesce("repeats", F.array().cast("array<array<int>>"))
    starts = F.concat(F.array(F.lit(0)), F.transform(r, lambda s: s[1]))
    ends = F.concat(F.transform(r, lambda s: s[0]), F.array(F.length("_text")))
    d = d.select(id_col, "_text", F.explode(F.arrays_zip(starts.alias("a"), ends.alias("z"))).alias("_s")).filter("_s.a < _s.z")
    return d.select(id_col, F.col("_s.a").alias("start_pos"), F.col("_s.z").alias("end_pos"), F.expr("substring(_text, _s.a + 1, _s.z - _s.a)").alias("piece"))
