"""Duplicates hidden by formatting differences (problem 4).

Canonical bytes: letters and digits in lower case; white space and marks go,
but a mark directly between two digits stays; the fields are put in order, so
their order in the record is of no account.  Copies of a batch are first
counted in a local trie.  The rest is recursive radix partitioning: buckets of
a byte prefix that are too large are split by the first byte in which their
keys differ until each fits; then each bucket is counted in a trie of its own
with counters at the terminals.

Scale: ``bucket_rows`` is hard, whatever the size of the table: buckets are
columns of staged tables and their sizes distributed counts, so no tree grows
on the driver or in a task; a round reads only what is still open.  A record
with very many copies arrives as one partial a batch; a bucket of a single key
ends the recursion.  The shuffle is
by bucket, the copies are named by a join with one row a record on one side.

Defined results: null and nothing-but-marks are equal (also to a missing
field at any place); a null group is a group of its own, as null is not equal
to another document, its rows are never merged; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlake.llm.staging import discard, staged
from cairnlake.session import bounded, spread

FIELDS = ("name", "dose", "frequency", "route")
_STRIDE = 8
_DROP = r"[\s\p{Z}]|(?<!\p{N})[^\p{L}\p{N}\s\p{Z}]|[^\p{L}\p{N}\s\p{Z}](?!\p{N})"


def canonical(group: Column, fields: list[Column]) -> Column:
    """Canonical bytes of a record; null where the group is null."""
    clean = [F.lower(F.regexp_replace(F.coalesce(f.cast("string"), F.lit("")), _DROP, "")) for f in fields]
    return F.encode(F.concat_ws("\x1f", group.cast("string"), F.concat_ws("\x1f", F.sort_array(F.array(*clean), asc=False))), "UTF-8")


class Trie:
    """Keys by strides of bytes; a terminal counts its key and keeps the smallest id."""

    __slots__ = ("root",)

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, key: bytes, count: int, smallest: int) -> None:
        node = self.root
        for i in range(0, len(key), _STRIDE):
            part = key[i : i + _STRIDE]
            child = node.get(part)
            if child is None:
                child = node[part] = {}
            node = child
        end = node.get(None)
        if end is None:
            node[None] = [count, smallest]
        else:
            end[0] += count
            if smallest < end[1]:
                end[1] = smallest

    def items(self) -> Iterator[tuple[bytes, int, int]]:
        stack = [(b"", self.root)]
        while stack:
            prefix, node = stack.pop()
            for part, child in node.items():
                if part is None:
                    yield prefix, child[0], child[1]
                else:
                    stack.append((prefix + part, child))


_KEYS = pa.schema([("key", pa.binary()), ("n", pa.int64()), ("smallest", pa.int64())])


def _partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        trie = Trie()
        for key, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            trie.add(key, 1, i)
        yield _table(trie)


def _table(trie: Trie) -> pa.RecordBatch:
    rows = list(trie.items())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_KEYS.types)], schema=_KEYS)


def _shared_prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per bucket the number of bytes in which its smallest and largest key, and so all, agree."""
    for b in batches:
        at = [_common(x, y) for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at, pa.int32())], names=["bucket", "at"])


def radix_buckets(partials: DataFrame, bucket_rows: int) -> list[DataFrame]:
    """Parts of ``partials`` with ``bucket``, a prefix of the key: a bucket has at most
    ``bucket_rows`` rows or one key.

    A round counts the buckets still open; those too large are split at the
    first byte in which their keys differ, the others are done and not read
    again.  Nothing of it passes through the driver.
    """
    parts, open_ = [], partials.withColumn("bucket", F.expr("substring(key, 1, 1)"))
    while True:
        sizes = open_.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
        large = sizes.filter((F.col("n") > bucket_rows) & (F.col("low") != F.col("high"))).select("bucket", "low", "high")
        large = staged(large.mapInArrow(_shared_prefix, "bucket binary, at int"), "large")
        if large.isEmpty():
            return [*parts, open_]
        marked = open_.join(bounded(large), "bucket", "left")
        parts.append(staged(marked.filter("at IS NULL").select("key", "n", "smallest", "bucket"), "closed"))
        wider = marked.filter("at IS NOT NULL").select("key", "n", "smallest", F.expr("substring(key, 1, at + 1)").alias("bucket"))
        before, open_ = open_, staged(wider, "open")
        discard(large, *([before] if len(parts) > 1 else []))


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def _count_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trie = Trie()
    for b in batches:
        for key, n, smallest in zip(b.column("key").to_pylist(), b.column("n").to_pylist(), b.column("smallest").to_pylist()):
            trie.add(key, n, smallest)
    yield _table(trie)


def keyed(df: DataFrame, id_col: str, group_col: str, fields: tuple[str, ...]) -> DataFrame:
    d = df.select(F.col(id_col).cast("long").alias("id"), F.col(group_col).alias("_g"), *[F.col(f).alias(f"_f{i}") for i, f in enumerate(fields)])
    group = F.when(F.col("_g").isNull(), F.concat(F.lit("\x1e"), F.col("id").cast("string"))).otherwise(F.col("_g").cast("string"))
    return d.select("id", canonical(group, [F.col(f"_f{i}") for i in range(len(fields))]).alias("key"))


def records(df: DataFrame, id_col: str = "med_id", group_col: str = "document_id", fields: tuple[str, ...] = FIELDS, bucket_rows: int = 20_000) -> DataFrame:
    """(key, copies, keep_id): one row a record, with the number of its rows and the smallest id."""
    return _records(keyed(df, id_col, group_col, fields), bucket_rows)


def _records(rows: DataFrame, bucket_rows: int) -> DataFrame:
    partials = staged(spread(rows.select("key", "id")).mapInArrow(_partials, "key binary, n long, smallest long"), "partials")
    parts = radix_buckets(partials, bucket_rows)
    placed = reduce(DataFrame.unionByName, parts)
    return placed.groupBy("bucket").applyInArrow(_counted, "key binary, copies long, keep_id long")


def _counted(t: pa.Table) -> pa.Table:
    out = pa.Table.from_batches(_count_bucket(iter(t.to_batches())))
    return out.rename_columns(["key", "copies", "keep_id"])


def copies(df: DataFrame, id_col: str = "med_id", group_col: str = "document_id", fields: tuple[str, ...] = FIELDS, bucket_rows: int = 20_000) -> DataFrame:
    """(keep_id, copy_id): every other row of a record beside the one kept."""
    rows = keyed(df, id_col, group_col, fields)
    many = staged(_records(rows, bucket_rows).filter("copies > 1").select("key", "keep_id"), "many")
    return rows.join(many, "key").filter("id <> keep_id").select("keep_id", F.col("id").alias("copy_id"))
