"""Splitting oversized items at natural boundaries (problem 7).

Items are handled by ranges: a worker sees one range with halos of its
neighbours, measures it and finds its boundaries; the ranges' tables are
stitched by prefix sums over their lengths, and each range emits its pieces
with offsets of the whole item.  Files are read range by range by seeking, on
any file system that Arrow opens by address, and no worker loads one whole;
texts in a column are cut into ranges in a narrow pass, and only measures and
pieces of texts with several ranges are shuffled.

A piece ends at the best boundary of its second half: after a paragraph, a
line, a sentence, a clause, a word; with none of these it is cut at the limit.
The next piece begins exactly ``overlap`` characters before that end.  Between
ranges both neighbours choose the same cut from the same characters.

Defined results: null and empty items give no pieces; items within the limit
give one; lengths and offsets count code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnlake.llm.staging import staged

LIMIT, OVERLAP = 1000, 200
RANGE_CHARS = 1 << 12
RANGE_BYTES = 1 << 24
_BOUNDARIES = tuple(re.compile(p) for p in (r"\n[^\S\n]*\n\s*", r"\n", r"[.!?。！？][\"')\]]*\s+", r"[,;:]\s+", r"\s"))
_SPACE = re.compile(r"\s")


def best_end(text: str, low: int, high: int) -> int:
    """End of a piece in (low, high]: behind the last boundary of the best class, else ``high``."""
    for boundary in _BOUNDARIES:
        end = -1
        for m in boundary.finditer(text, low, high):
            if low < m.end() <= high:
                end = m.end()
        if end > 0:
            return end
    return high


def cut(text: str, begin: int, end: int, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Pieces over [begin, end): at most ``limit`` long, each begins ``overlap``
    before the end of the one before it."""
    out, at = [], begin
    while True:
        if end - at <= limit:
            out.append((at, end))
            return out
        to = best_end(text, at + max(limit // 2, overlap + 1), at + limit)
        out.append((at, to))
        at = to - overlap


def range_cut(text: str, edge: int, limit: int) -> int:
    """The cut that two ranges agree on: in the last half limit before their edge."""
    return best_end(text, max(0, edge - limit // 2), edge)


_RANGE = "range_no int, n_ranges int, body string, left string, right string"
_MEASURES = "range_no int, n_ranges int, chars int, lead int, trail int, longest int"
#: Characters of pieces that a Python worker holds before it hands them on.
_HOLD = 1 << 20


def _runs(text: str) -> tuple[int, int, int]:
    """Characters without white space at the start, at the end and the most in a row."""
    if not _SPACE.search(text):
        return len(text), len(text), len(text)
    parts = _SPACE.split(text)
    return len(parts[0]), len(parts[-1]), max(map(len, parts))


def _with(key: T.DataType, rest: str) -> T.StructType:
    return T.StructType([T.StructField("key", key), *T._parse_datatype_string(rest).fields])


def _batch(keys: pa.Array, at: list[int], columns: list[list], kinds: tuple, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int32())), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=names)


def measures_of_column(df: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """The boundary table: per range of ``size`` characters its length and its runs without white space."""
    schema = _with(df.schema[key].dataType, _MEASURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, cols = [], [[] for _ in range(6)]
            for k, t in enumerate(b.column(1)):
                t = t.as_py()
                n = max(1, -(-len(t) // size))
                for r in range(n):
                    body = t[r * size : (r + 1) * size]
                    at.append(k)
                    for c, v in zip(cols, (r, n, len(body), *_runs(body))):
                        c.append(v)
            yield _batch(b.column(0), at, cols, (pa.int32(),) * 6, schema.names)

    return df.select(F.col(key), F.col(text)).filter(F.col(text).isNotNull()).mapInArrow(run, schema)


def measures(ranges: DataFrame) -> DataFrame:
    """As ``measures_of_column``, of ranges at hand."""
    schema = _with(ranges.schema["key"].dataType, _MEASURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs = [(len(t), *_runs(t)) for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *(pa.array([r[i] for r in runs], pa.int32()) for i in range(4))], names=schema.names)

    return ranges.select("key", "range_no", "n_ranges", "body").mapInArrow(run, schema)


def stitched(table: DataFrame) -> DataFrame:
    """Per range its offset in the item; ``run`` is the longest run without
    white space that ends in or passes through the range."""
    one = table.filter("n_ranges = 1").select("key", "range_no", "n_ranges", "chars", F.lit(0).cast("long").alias("offset"), F.col("longest").cast("long").alias("run"))
    w = Window.partitionBy("key").orderBy("range_no")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    d = table.filter("n_ranges > 1").withColumn("offset", F.coalesce(F.sum("chars").over(before), F.lit(0)).cast("long"))
    # an open run began where the last range with white space left off
    broken = F.when(F.col("lead") < F.col("chars"), F.col("offset") + F.col("chars") - F.col("trail"))
    d = d.withColumn("_begin", F.coalesce(F.max(broken).over(before), F.lit(0)))
    d = d.withColumn("run", F.greatest(F.col("longest").cast("long"), F.col("offset") + F.col("lead") - F.col("_begin")))
    return one.unionByName(d.select(one.columns))


def sizes(df: DataFrame, key: str, text: str, range_chars: int = RANGE_CHARS) -> DataFrame:
    """(key, n_chars, longest_run) of every item that is not null, from the boundary table."""
    s = stitched(staged(measures_of_column(df, key, text, range_chars), "measures"))
    one = s.filter("n_ranges = 1").select("key", F.col("chars").cast("long").alias("n_chars"), F.col("run").alias("longest_run"))
    many = s.filter("n_ranges > 1").groupBy("key").agg(F.sum("chars").alias("n_chars"), F.max("run").alias("longest_run"))
    return one.unionByName(many).withColumnRenamed("key", key)


def range_pieces(r: int, n: int, body: str, left: str, limit: int, overlap: int) -> Iterator[tuple[int, str]]:
    """(offset from the range's first character, piece) of one range, whose left halo stands before it."""
    if not body:
        return
    text = left + body
    begin = 0 if r == 0 else range_cut(text, len(left), limit) - overlap
    end = len(text) if r == n - 1 else range_cut(text, len(text), limit)
    for a, z in cut(text, max(0, begin), end, limit, overlap):
        yield a - len(left), text[a:z]


_PIECES = "range_no int, n_ranges int, at long, piece string"
_PIECE_KINDS = (pa.int32(), pa.int32(), pa.int64(), pa.string())


def _emitter(limit: int, overlap: int, names: list[str], ranges_of_row):
    """Batches of pieces of at most about ``_HOLD`` characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, cols, held = [], [[], [], [], []], 0
            for k in range(b.num_rows):
                for r, n, body, left in ranges_of_row(b, k):
                    for start, piece in range_pieces(r, n, body, left, limit, overlap):
                        at.append(k)
                        held += len(piece)
                        for c, v in zip(cols, (r, n, start, piece)):
                            c.append(v)
                    if held > _HOLD:
                        yield _batch(b.column(0), at, cols, _PIECE_KINDS, names)
                        at, cols, held = [], [[], [], [], []], 0
            yield _batch(b.column(0), at, cols, _PIECE_KINDS, names)

    return run


def placed(pieces: DataFrame, table: DataFrame) -> DataFrame:
    """(key, start, piece): offsets of the ranges are added where an item has several."""
    one = pieces.filter("n_ranges = 1").select("key", F.col("at").alias("start"), "piece")
    many = pieces.filter("n_ranges > 1").join(table.filter("n_ranges > 1").select("key", "range_no", "offset"), ["key", "range_no"])
    return one.unionByName(many.select("key", (F.col("at") + F.col("offset")).alias("start"), "piece"))


def split_column(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, range_chars: int = RANGE_CHARS) -> DataFrame:
    """(key, start, piece) of every item; ``key`` must be unique."""
    if not 0 <= overlap < limit // 2 or range_chars < 4 * limit:
        raise ValueError("need 0 <= overlap < limit / 2 and ranges of four limits at least")

    def ranges_of_row(b: pa.RecordBatch, k: int) -> Iterator[tuple[int, int, str, str]]:
        t = b.column(1)[k].as_py()
        n = max(1, -(-len(t) // range_chars))
        for r in range(n):
            a = r * range_chars
            yield r, n, t[a : a + range_chars], t[max(0, a - limit) : a]

    schema = _with(df.schema[key].dataType, _PIECES)
    table = stitched(staged(measures_of_column(df, key, text, range_chars), "measures"))
    pieces = df.select(F.col(key), F.col(text)).filter(F.col(text).isNotNull()).mapInArrow(_emitter(limit, overlap, schema.names, ranges_of_row), schema)
    return placed(staged(pieces, "pieces"), table).withColumnRenamed("key", key)


def split_files(spark: SparkSession, path: str, limit: int = LIMIT, overlap: int = OVERLAP, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, start, piece) of UTF-8 files in a folder all executors share, by byte ranges."""
    if not 0 <= overlap < limit // 2 or range_bytes < 16 * limit:
        raise ValueError("need 0 <= overlap < limit / 2 and ranges of sixteen limits at least")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length").filter("length > 0")
    n = F.ceil(F.col("length") / range_bytes).cast("int")
    todo = files.select(F.col("path").alias("key"), n.alias("n_ranges"), F.explode(F.sequence(F.lit(0), n - 1)).alias("range_no"), "length")
    todo = staged(todo.repartition(F.col("key"), F.col("range_no")), "ranges")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, n_ranges, r in zip(*(b.column(i).to_pylist() for i in range(3))):
                body, left, right = _read_range(key, r, range_bytes, 4 * limit)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key]), pa.array([r], pa.int32()), pa.array([n_ranges], pa.int32()), pa.array([body]), pa.array([left[-limit:]]), pa.array([right[:limit]])], names=["key", "range_no", "n_ranges", "body", "left", "right"]
                )

    ranges = staged(todo.select("key", "n_ranges", "range_no").mapInArrow(read, "key string, " + _RANGE), "range_texts")

    def ranges_of_row(b: pa.RecordBatch, k: int) -> Iterator[tuple[int, int, str, str]]:
        yield tuple(b.column(i)[k].as_py() for i in range(1, 5))

    schema = _with(T.StringType(), _PIECES)
    pieces = ranges.select("key", "range_no", "n_ranges", "body", "left").mapInArrow(_emitter(limit, overlap, schema.names, ranges_of_row), schema)
    return placed(pieces, stitched(measures(ranges.select("key", "range_no", "n_ranges", "body")))).withColumnRenamed("key", "path")


def _read_range(path: str, r: int, size: int, halo: int) -> tuple[str, str, str]:
    """Characters whose first byte lies in the range, and the halos."""
    system, name = fs.FileSystem.from_uri(path if re.match(r"[a-z0-9]+://", path) else re.sub(r"^file:/+", "/", path))
    a, z = r * size, min((r + 1) * size, system.get_file_info(name).size)
    with system.open_input_file(name) as f:
        f.seek(max(0, a - halo))
        data = f.read(z - max(0, a - halo) + halo)
    first = a - max(0, a - halo)
    lead = _aligned(data, first)
    last = _aligned(data, first + z - a)
    return data[lead:last].decode("utf-8", "replace"), data[_aligned(data, 0) : lead].decode("utf-8", "replace"), data[last:].decode("utf-8", "ignore")


def _aligned(data: bytes, at: int) -> int:
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return at
