"""Byte-level BPE encoding with a public vocabulary (problem 8).

Each word of the pattern is merged by a segment tree over the ranks of its
adjacent pairs: a node holds the lowest rank below it and the leftmost place
where it stands, so the root names the next merge, and a merge updates two
leaves (its neighbours) in logarithmic time until no mergeable pair is left.
Words repeat (Zipf), so bounded caches of encoded pieces are kept per worker.

Defined results: null and empty texts give an empty list, strings that look
like special tokens are ordinary text, lone surrogates become U+FFFD; texts of
any length are encoded whole.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-tokenisation pattern published with the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Encoded words kept per worker.
CACHE_WORDS = 1 << 19
_NONE = 1 << 60


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word by a segment tree over its adjacent pairs.

    A leaf's key is ``rank * n + place``: the smallest key is the lowest rank
    and, among equals, the leftmost place.
    """
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    n = len(word)
    if n == 1:
        return [ranks[word]]
    size = 1
    while size < n - 1:
        size *= 2
    tree = [_NONE] * (2 * size)
    get = ranks.get
    for i in range(n - 1):
        r = get(word[i : i + 2])
        if r is not None:
            tree[size + i] = r * n + i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    ends = list(range(1, n + 1))  # end of the part that starts here
    starts = list(range(-1, n))  # start of the part that ends here, by end

    def put(leaf: int, key: int) -> None:
        i = size + leaf
        tree[i] = key
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            low = a if a < b else b
            if tree[i] == low:
                break
            tree[i] = low
            i >>= 1

    while tree[1] < _NONE:
        left = tree[1] % n
        middle = ends[left]
        end = ends[middle]
        ends[left] = end
        starts[end] = left
        if middle < n - 1:
            put(middle, _NONE)
        key = _NONE
        if end < n:
            r = get(word[left : ends[end]])
            if r is not None:
                key = r * n + left
        put(left, key)
        if left:
            before = starts[left]
            r = get(word[before:end])
            put(before, _NONE if r is None else r * n + before)
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : ends[i]]])
        i = ends[i]
    return out


class _Pieces(dict):
    """Ids (as int32 bytes) of the text between two blanks, filled on demand."""

    def __init__(self, encoder: "Encoder", lead: str):
        super().__init__()
        self.encoder, self.lead = encoder, lead

    def __missing__(self, piece: str) -> bytes:
        ids = self.encoder.slow(self.lead + piece)
        if len(self) >= self.encoder.cache_words:
            self.clear()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class Encoder:
    """One vocabulary with its bounded caches.

    Where no blank follows other white space, no word of the pattern crosses
    the place before a blank: such texts are cut at blanks, and the pieces'
    ids are looked up and joined without a Python step a word.
    """

    def __init__(self, path: str, pattern: str = PATTERN, cache_words: int = CACHE_WORDS):
        self.ranks = load_ranks(path)
        self.find = regex.compile(pattern).findall
        self.runs = regex.compile(r"\s ").search
        self.cache_words = cache_words
        self.words: dict[str, bytes] = {}
        self.first, self.next = _Pieces(self, ""), _Pieces(self, " ")

    def slow(self, text: str) -> bytes:
        words, out = self.words, []
        for w in self.find(text):
            ids = words.get(w)
            if ids is None:
                ids = array("i", merge(w.encode("utf-8", "replace"), self.ranks)).tobytes()
                if len(words) >= self.cache_words:
                    words.clear()
                if len(w) <= 64:
                    words[w] = ids
            out.append(ids)
        return b"".join(out)

    def encode_bytes(self, text: str | None) -> bytes:
        """The ids as int32 in the machine's byte order."""
        if not text:
            return b""
        if self.runs(text):
            return self.slow(text)
        pieces = text.split(" ")
        return self.first[pieces[0]] + b"".join(map(self.next.__getitem__, pieces[1:]))

    def encode(self, text: str | None) -> list[int]:
        return array("i", self.encode_bytes(text)).tolist()

    def length(self, text: str | None) -> int:
        return len(self.encode_bytes(text)) // 4


@lru_cache(maxsize=4)
def encoder(path: str = VOCABULARY) -> Encoder:
    """The worker's encoder of a vocabulary file (read once a worker)."""
    return Encoder(path)


def encode_table(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, ids): token ids of every text; narrow, no shuffle, Arrow in and out."""
    id_type = df.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        for b in batches:
            parts = [e.encode_bytes(t) for t in b.column(1).to_pylist()]
            offsets = pa.array(accumulate((len(p) // 4 for p in parts), initial=0), pa.int32())
            flat = b"".join(parts)
            ids = pa.ListArray.from_arrays(offsets, pa.Array.from_buffers(pa.int32(), len(flat) // 4, [None, pa.py_buffer(flat)]))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=[id_col, "ids"])

    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def lengths(df: DataFrame, keep: list[str], text_col: str = "text", vocabulary: str = VOCABULARY, out: str = "n_tokens") -> DataFrame:
    """``keep`` and the exact token length of every text."""
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField(out, T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        for b in batches:
            n = pa.array([e.length(t) for t in b.column(len(keep)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), n], names=[*keep, out])

    return df.select(*keep, text_col).mapInArrow(run, schema)
