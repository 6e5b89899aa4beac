"""Noise in text from scanned pages (problem 5).

Lines are labelled header, page number, body or break by a linear-chain model
over layout features (Viterbi decoding; weights from an averaged structured
perceptron, see ``training.layout``).  Words split over lines and misread
words are judged by counts over the whole corpus; paragraphs are put together
from the labelled lines.

Scale: the corpus' vocabulary is an aggregate with counts combined before the
shuffle; readings that confusions of the scanner explain are found by a join
of words with words.  A bounded list of the most frequent sound words
(``COMMON``) goes to every task, so only rare words are shuffled to meet the
table of misreadings.  Running lines are found by counts of line digests
within a document; pages are joined by their own id, so that a document with
very many pages makes no hot key.

Defined results: a run of more than ``LONGEST_WORD`` characters without white
space is no word; null and empty pages have no lines to report; lines are split
at line feeds; header and page-number lines have no other kind; words at the
break are judged as one word, the misread character names its line.
"""

from __future__ import annotations

import json
import pkgutil
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.llm.staging import staged
from cairnlake.session import spread

#: Most frequent sound words that go to every task.
COMMON = 50_000
#: A reading counts as misread if its correction is so many times as frequent.
RATIO = 12
LABELS = ("body", "break", "header", "page_no")

# What a scanner reads, and what may have stood there.
CONFUSIONS = (
    ("1", "l"), ("1", "i"), ("!", "i"), ("|", "l"), ("0", "o"), ("5", "s"), ("$", "s"), ("@", "a"), ("9", "g"), ("6", "b"), ("8", "b"),
    ("c", "e"), ("f", "t"), ("b", "h"), ("rn", "m"), ("m", "rn"), ("ii", "u"), ("d", "cl"), ("rm", "nn"), ("i)", "d"), ("vv", "w"), ("li", "h"), ("l", "i"), ("i", "l"),
)
DIGIT_CONFUSIONS = {"O": "0", "o": "0", "l": "1", "I": "1", "S": "5", "b": "6", "B": "8", "Z": "2", "!": "1", "|": "1"}
HYPHENS = "-‐‑¬\u00ad"

_STRIP_LEFT, _STRIP_RIGHT = "([{\"'*•–—#>", ".,;:)]}\"'?–—"
_BREAK = re.compile(rf"([^\W_][\w'’@!$|-]*?)[{HYPHENS}]\s*$")
_NUMBER = re.compile(r"[0-9]+(?:[.,:/-][0-9]+)*%?")


#: A longer run without white space is a code, an address or a drawing, and no word.
LONGEST_WORD = 64


def tokens(line: str) -> list[str]:
    return [w for w in (t.lstrip(_STRIP_LEFT).rstrip(_STRIP_RIGHT) for t in line.split()) if w]


# ---- layout -------------------------------------------------------------------------------------

_PAGE_NO = re.compile(r"\s*(?:(?:page|pg|p|seite|página)\.?\s*)?[-–—\[(]*\s*[0-9OolISb]{1,4}\s*[-–—\])]*(?:\s*(?:of|/|von|de)\s*[0-9OolISb]{1,4})?\s*", re.I)
_ROMAN = re.compile(r"\s*[-–—\[(]?\s*[ivxlc!1]{1,6}\s*[-–—\])]?\s*")
_SHAPES = (
    ("number", re.compile(r"\s*\d{1,4}\s*")),
    ("dressed", re.compile(r"\s*[-–—\[(]\s*\w{1,4}\s*[-–—\])]\s*")),
    ("of", re.compile(r"\s*\w{0,5}\.?\s*\w{1,4}\s*(?:/|of)\s*\w{1,4}\s*", re.I)),
    ("paged", re.compile(r"\s*p(?:a?ge?)?\.?\s*\w{1,4}\s*", re.I)),
    ("roman", _ROMAN),
)
_HAS = (
    ("page", re.compile(r"\bpage\s+[\dOolISb]+\s*$", re.I)),
    ("clock", re.compile(r"\d\d[/.-]\d\d[/.-]\d{2,4}\s+\d\d:\d\d")),
    ("long_date", re.compile(r"\d\d/\d\d/\d{4}")),
    ("record", re.compile(r"\b[A-Z]{2,4}[-\d]*\d{4,}")),
    ("gap", re.compile(r"\S\s{2,}\S")),
    ("bar", re.compile(r"\w \| \w")),
    ("slash", re.compile(r" / ")),
    ("continued", re.compile(r"\bcont", re.I)),
    ("secret", re.compile(r"confid|printed|copy\b", re.I)),
    ("place", re.compile(r"\b(?:clinic|hospital|cent(?:er|re)|practice|institute)\b", re.I)),
)
#: One of these stands in every line that has one of the above.
_ANY = re.compile(r"page|\d\d[/.-]\d\d|[a-z]{2}[-\d]*\d{4}|\S\s{2,}\S|\||/|cont|confid|printed|copy|clinic|hospital|cent(?:er|re)|practice|institute", re.I)
_SOLE_WORD = re.compile(r"[A-Z]\w+(?: \w+)?")


def top_depth(k: int) -> str:
    """How far a line stands from its end of the page, coarser with distance."""
    return str(k) if k < 3 else "3" if k < 6 else "6" if k < 12 else "m"


def normalised(line: str) -> str:
    """A line as its repetitions are told: case, white space and numbers aside."""
    return re.sub(r"\d+", "#", re.sub(r"\s+", " ", line.strip().lower()))


def traits(line: str) -> tuple[str, ...]:
    """Features of a line that is not blank, wherever it stands."""
    s = line.strip()
    words = s.split()
    lower = sum(w[:1].islower() for w in words)
    case = "upper" if s.isupper() else "title" if not lower else "mixed" if lower < len(words) / 2 else "lower"
    stop = "stop" if s[-1] in ".;," else "colon" if s[-1] == ":" else "open"
    first = "lower" if s[0].islower() else "digit" if s[0].isdigit() else "mark" if not s[0].isalnum() else "upper"
    f = [f"len={min(len(s) // 12, 8)}", f"words={min(len(words), 9)}", f"case={case}", f"end={stop}", f"first={first}", f"case={case}&end={stop}"]
    short = " ".join(words)
    if len(short) <= 24:
        f += [f"shape={n}" for n, r in _SHAPES if r.fullmatch(short)]
    if _ANY.search(line):
        f += [f"has={n}" for n, r in _HAS if r.search(line)]
    if line[0] in " \t":
        f += ["indent", f"indent&case={case}"]
    if s[0] == "|" or s[0] == "#":
        f.append("markup")
    return tuple(f)


#: A line that other pages have too stands in its place if its line numbers, from the top or from the bottom, differ by no more.
SAME_PLACE = 2


def features(lines: list[str], repeated: dict[int, bool]) -> list[tuple[str, ...]]:
    """Features of every line, by its own traits, its place and the lines around it;
    ``repeated``: lines that other pages have too, and whether in their place."""
    full = [i for i, s in enumerate(lines) if s.strip()]
    n = len(full)
    out: list[tuple[str, ...]] = [("blank",)] * len(lines)
    after_word = False
    for k, i in enumerate(full):
        top, bottom = k, n - 1 - k
        edge = f"t{top_depth(top)}" if top <= bottom else f"b{top_depth(bottom)}"
        before = "none" if not i else "text" if lines[i - 1].strip() else "blank"
        after = "none" if i + 1 == len(lines) else "text" if lines[i + 1].strip() else "blank"
        out[i] = (f"edge={edge}", "once" if i not in repeated else "aligned" if repeated[i] else "repeated", "after_word" if after_word else "after_text", f"between={before},{after}", *traits(lines[i]))
        after_word = _SOLE_WORD.fullmatch(lines[i].strip()) is not None
    return out


def expanded(f: tuple[str, ...]) -> list[str]:
    """The features and their products with place, repetition and the line before."""
    if len(f) == 1:
        return list(f)
    edge, again, after, between, *own = f
    own.append(between)
    return [edge, again, f"{again}&{edge}", after, *own, f"{between}&{again}&{edge}", f"{between}&{again}", *(f"{x}&{between}&{again}" for x in own if x.startswith("case=")), *(f"{x}&{edge}" for x in own), *(f"{x}&{again}" for x in own), *(f"{x}&{after}" for x in own if x.startswith("shape")), *(f"{x}&{again}&{edge}" for x in own if x.startswith(("shape", "has", "case=")))]


def viterbi(emits: list[tuple[float, ...]], moves: list[list[float]]) -> list[int]:
    """The best path of labels; ``moves[-1]`` is the start."""
    n = len(LABELS)
    score, back = [0.0] * n, []
    for k, emit in enumerate(emits):
        if not k:
            score = [moves[n][j] + emit[j] for j in range(n)]
            continue
        step, now = [], []
        for j in range(n):
            best = max(range(n), key=lambda a: score[a] + moves[a][j])
            step.append(best)
            now.append(score[best] + moves[best][j] + emit[j])
        score = now
        back.append(step)
    if not emits:
        return []
    at = max(range(n), key=score.__getitem__)
    path = [at]
    for step in reversed(back):
        at = step[at]
        path.append(at)
    return path[::-1]


class Layout:
    """The line model: emissions are kept by features, and a line whose lead over
    every other label exceeds all that its neighbours could add is decided alone,
    which splits the path without changing it."""

    def __init__(self, weights: dict[str, list[float]], moves: list[list[float]]):
        n = len(LABELS)
        self.weights, self.moves = weights, moves
        into = [[max(moves[p][j] - moves[p][g] for p in range(n + 1)) for j in range(n)] for g in range(n)]
        out = [[max(0.0, *(moves[j][p] - moves[g][p] for p in range(n))) for j in range(n)] for g in range(n)]
        self.bound = [[into[g][j] + out[g][j] for j in range(n)] for g in range(n)]
        self.known: dict[tuple[str, ...], tuple[tuple[float, ...], int]] = {}

    def emit(self, f: tuple[str, ...]) -> tuple[tuple[float, ...], int]:
        """Scores by label, and the label if it is certain, else -1."""
        have = self.known.get(f)
        if have is None:
            n = len(LABELS)
            e = [0.0] * n
            for x in expanded(f):
                w = self.weights.get(x)
                if w is not None:
                    for j in range(n):
                        e[j] += w[j]
            g = max(range(n), key=e.__getitem__)
            sure = all(j == g or e[g] - e[j] > self.bound[g][j] for j in range(n))
            if len(self.known) >= 1 << 16:
                self.known.clear()
            have = self.known[f] = tuple(e), g if sure else -1
        return have

    def path(self, feats: list[tuple[str, ...]]) -> list[int]:
        out = [0] * len(feats)
        emits = [self.emit(f) for f in feats]
        i, n = 0, len(feats)
        while i < n:
            if emits[i][1] >= 0:
                out[i] = emits[i][1]
                i += 1
                continue
            z = i
            while z < n and emits[z][1] < 0:
                z += 1
            a, b = max(0, i - 1), min(n, z + 1)
            # the certain neighbours stand in as lines that can only have their label
            part = [emits[k][0] if emits[k][1] < 0 else tuple(0.0 if j == emits[k][1] else -1e9 for j in range(len(LABELS))) for k in range(a, b)]
            moves = self.moves if not a else [*self.moves[:-1], [0.0] * len(LABELS)]
            out[a:b] = viterbi(part, moves)
            i = z
        return out


@lru_cache(maxsize=1)
def layout_model() -> Layout:
    m = json.loads(pkgutil.get_data("cairnlake.llm", "models/layout.json"))
    return Layout(m["weights"], m["moves"])


def label_lines(lines: list[str], repeated: dict[int, bool]) -> list[str]:
    """The label of every line of the page; lines of a table or with a heading
    mark are text, and a page number must read as one."""
    out = []
    for line, k in zip(lines, layout_model().path(features(lines, repeated))):
        label = LABELS[k]
        if not line.strip():
            label = "break"
        elif label == "break" or line[0] in "|#" or (label == "page_no" and not (_PAGE_NO.fullmatch(line) or _ROMAN.fullmatch(line))):
            label = "body"
        out.append(label)
    return out


# ---- words --------------------------------------------------------------------------------------


def broken(lines: list[str], labels: list[str]) -> dict[int, tuple[str, str, str, int]]:
    """Lines that end in a hyphen: (first part, word joined, word with hyphen, next line or -1)."""
    body = [i for i, lab in enumerate(labels) if lab == "body"]
    out = {}
    for k, i in enumerate(body):
        end = lines[i].rstrip()
        if end[-1:] not in HYPHENS or not end:
            continue
        last = end[-LONGEST_WORD - 8 :].split()[-1]
        m = _BREAK.search(last)
        if not m:
            continue
        before = last[: m.end(1)].lstrip(_STRIP_LEFT)
        if len(before) > LONGEST_WORD:
            continue
        if k + 1 < len(body):
            rest = tokens(lines[body[k + 1]])
            second = rest[0] if rest else ""
            if len(second) > LONGEST_WORD:
                continue
            out[i] = (before, before + second, before + "-" + second, body[k + 1])
        else:
            out[i] = (before, "", before + "-", -1)
    return out


def page_words(lines: list[str], labels: list[str]) -> Iterator[tuple[int, str]]:
    """(line, word) of the body; a word over a break counts once, at its first line."""
    breaks = broken(lines, labels)
    skip = {b[3] for b in breaks.values() if b[3] >= 0}
    for i, lab in enumerate(labels):
        if lab != "body":
            continue
        ws = tokens(lines[i])
        if i in skip and ws:
            ws = ws[1:]
        if i in breaks and ws:
            ws = ws[:-1]
        for w in ws:
            if len(w) <= LONGEST_WORD:
                yield i, w


def corrections(word: str) -> set[str]:
    """Words (lower case) that the scanner may have read as ``word``."""
    w, out = word.lower(), set()
    for wrong, right in CONFUSIONS:
        if wrong not in w:
            continue
        out.add(w.replace(wrong, right))
        at = w.find(wrong)
        while at >= 0:
            out.add(w[:at] + right + w[at + len(wrong) :])
            at = w.find(wrong, at + 1)
    out.discard(w)
    return out


def as_number(word: str) -> str | None:
    """The number that ``word`` misreads, if it mixes digits with letters taken for digits."""
    if not any(c.isdigit() for c in word) or not any(c in DIGIT_CONFUSIONS for c in word):
        return None
    fixed = "".join(DIGIT_CONFUSIONS.get(c, c) for c in word)
    return fixed if _NUMBER.fullmatch(fixed) else None


# ---- plan ---------------------------------------------------------------------------------------

#: Characters of text that a Python worker holds as lines and rows at a time.
SLICE_CHARS = 1 << 18


def _lines_of(text: str | None) -> list[str]:
    return text.split("\n") if text else []


def _slices(b: pa.RecordBatch, text: int) -> Iterator[range]:
    """Row ranges of a batch whose texts have about ``SLICE_CHARS`` together."""
    begin = size = 0
    lengths = pc.binary_length(b.column(text))
    for k in range(b.num_rows):
        size += lengths[k].as_py() or 0
        if size >= SLICE_CHARS:
            yield range(begin, k + 1)
            begin, size = k + 1, 0
    if begin < b.num_rows:
        yield range(begin, b.num_rows)


def running_lines(pages: DataFrame) -> DataFrame:
    """(page_id, repeated, aligned): lines, digits aside, that another page of the document
    has too, and those of them that stand in the same place everywhere."""
    norm = F.regexp_replace(F.regexp_replace(F.lower(F.trim("line")), r"\s+", " "), "[0-9]+", "#")
    split = F.split("page_content", "\n")
    d = pages.select("page_id", F.coalesce(F.col("page_number").cast("long"), -F.col("page_id")).alias("page"), "document_id", F.size(split).alias("n"), F.posexplode(split).alias("line_no", "line"))
    d = d.filter(F.col("line").rlike(r"\S")).select("page_id", "page", "line_no", (F.col("n") - F.col("line_no")).alias("up"), F.xxhash64("document_id", norm).alias("digest"))
    spread = F.least(F.max("line_no") - F.min("line_no"), F.max("up") - F.min("up"))
    many = d.groupBy("digest").agg(F.min("page").alias("a"), F.max("page").alias("z"), (spread <= SAME_PLACE).alias("aligned")).filter("a <> z").select("digest", "aligned")
    d = d.select("page_id", "line_no", "digest").join(many, "digest")
    return d.groupBy("page_id").agg(F.collect_list("line_no").alias("repeated"), F.collect_list(F.when(F.col("aligned"), F.col("line_no"))).alias("aligned"))


def _label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for rows in _slices(b, 1):
            part = b.slice(rows.start, len(rows))
            marks = ["".join(str(LABELS.index(x)) for x in label_lines(_lines_of(t), dict.fromkeys(r or (), False) | dict.fromkeys(a or (), True))) for t, r, a in zip(*(part.column(c).to_pylist() for c in (1, 2, 3)))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(marks, pa.string())], names=["page_id", "page_content", "labels"])


def labelled_pages(pages: DataFrame) -> DataFrame:
    """page_id, page_content and one digit a line, the label's place in ``LABELS``."""
    p = pages.select(F.col("page_id").cast("long"), "document_id", "page_number", "page_content").filter("length(page_content) > 0")
    d = spread(p.select("page_id", "page_content"), "page_id").join(running_lines(p), "page_id", "left")
    return d.mapInArrow(_label, "page_id long, page_content string, labels string")


def _labelled(b: pa.RecordBatch, rows: range) -> Iterator[tuple[int, list[str], list[str]]]:
    part = b.slice(rows.start, len(rows))
    for page, t, marks in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist()):
        yield page, _lines_of(t), [LABELS[int(m)] for m in marks]


_WORDS = pa.schema([("word", pa.string()), ("n", pa.int64())])


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n: Counter[str] = Counter()
    for b in batches:
        for rows in _slices(b, 1):
            for _, lines, labels in _labelled(b, rows):
                n.update(w.lower() for _, w in page_words(lines, labels) if not _NUMBER.fullmatch(w) and not as_number(w))
            if len(n) > 1 << 16:
                yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], schema=_WORDS)
                n.clear()
    yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], schema=_WORDS)


def _readings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for s in range(0, b.num_rows, 4096):
            part = b.slice(s, 4096)
            rows = [(w, n, c) for w, n in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for c in corrections(w)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], names=["word", "n", "fix"])


#: A digit or mark between letters is no letter that the writer meant.
_INSIDE = r"\p{L}[0-9@!$|]+\p{L}"


def vocabulary(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(word, n) over all body lines, and (word, fix) of the misread ones.

    A reading of letters only is misread if its correction is ``RATIO`` times
    as frequent; one with a digit or mark between letters, if its correction
    is more frequent at all.
    """
    words = labelled.mapInArrow(_vocabulary, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = staged(words, "words")
    maybe = words.mapInArrow(_readings, "word string, n long, fix string")
    known = words.select(F.col("word").alias("fix"), F.col("n").alias("fix_n"))
    inside = F.col("word").rlike(_INSIDE) & F.col("fix").rlike(r"^\p{L}{4,}$") & (F.col("fix_n") > F.greatest(F.col("n"), F.lit(1)))
    bad = maybe.join(known, "fix").filter((F.col("fix_n") >= F.greatest(F.lit(4), F.col("n") * RATIO)) | inside).groupBy("word").agg(F.max_by("fix", "fix_n").alias("fix"))
    return words, staged(bad, "misread")


_FOUND = pa.schema([("page_id", pa.int64()), ("line_no", pa.int32()), *[(c, pa.string()) for c in ("kind", "word", "alt", "fix")]])


def _judge(common: frozenset[str]):
    """Rows of ``_FOUND``: what is certain here and (with ``?``) what the vocabulary decides.
    ``common`` only spares rows of words known to be sound; no answer depends on it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows in _slices(b, 1):
                out: list[tuple] = []
                for page, lines, labels in _labelled(b, rows):
                    out += [(page, i, lab, None, None, None) for i, lab in enumerate(labels) if lab in ("header", "page_no")]
                    for i, (first, joined, compound, after) in broken(lines, labels).items():
                        if after < 0:
                            out.append((page, i, "stem?", compound.lower(), None, None))
                        else:
                            out.append((page, i, "hyphen?", joined.lower(), compound.lower(), f"{after} {first.lower()}"))
                    for i, w in page_words(lines, labels):
                        low = w.lower()
                        if low in common or _NUMBER.fullmatch(w):
                            continue
                        number = as_number(w)
                        if number:
                            out.append((page, i, "char", w, None, number))
                        elif len(low) > 1:
                            out.append((page, i, "char?", low, w, None))
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(_FOUND.types)], schema=_FOUND)

    return run


def found(pages: DataFrame, common_words: int = COMMON) -> DataFrame:
    """(page_id, line_no, kind, word, fix): every furniture line, broken word and misread word."""
    return _found(staged(labelled_pages(pages), "pages"), common_words)


def _found(labelled: DataFrame, common_words: int) -> DataFrame:
    words, bad = vocabulary(labelled)
    sound = words.join(bad, "word", "left_anti")
    common = frozenset(r.word for r in sound.filter("n > 1").orderBy(F.desc("n"), "word").limit(common_words).collect())  # at most ``common_words``
    rows = staged(labelled.mapInArrow(_judge(common), "page_id long, line_no int, kind string, word string, alt string, fix string"), "judged")
    sure = rows.filter("kind IN ('header', 'page_no', 'char')").select("page_id", "line_no", "kind", "word", "fix")

    # the last word of a page: broken unless a compound of the corpus begins so
    stems = sound.filter("n > 1 AND instr(word, '-') > 0").select(F.explode(F.expr("filter(transform(sequence(1, length(word)), i -> CASE WHEN substring(word, i, 1) = '-' THEN left(word, i) END), x -> x IS NOT NULL)")).alias("word")).distinct()
    last = rows.filter("kind = 'stem?'").join(stems, "word", "left_anti").select("page_id", "line_no", F.lit("hyphen").alias("kind"), F.lit(None).cast("string").alias("word"), F.lit(None).cast("string").alias("fix"))

    ask = rows.filter("kind = 'hyphen?'").withColumn("after", F.substring_index("fix", " ", 1).cast("int")).withColumn("first", F.substring_index("fix", " ", -1)).drop("fix", "kind")
    both = ask.select("word").unionByName(ask.select(F.col("alt").alias("word"))).distinct().withColumn("n", F.lit(1).cast("long"))
    fixes = both.mapInArrow(_readings, "word string, n long, fix string").join(words.select(F.col("word").alias("fix"), F.col("n").alias("fix_n")), "fix")
    fixes = fixes.filter(F.col("fix_n") >= RATIO).groupBy("word").agg(F.max_by("fix", "fix_n").alias("fix"), F.max("fix_n").alias("fix_n"))
    sure_n = both.select("word").join(words, "word", "left").join(fixes, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("fix_n", F.lit(0)).alias("fix_n"), "fix")
    sure_n = staged(sure_n, "breaks")
    d = ask.join(sure_n.toDF("word", "n1", "m1", "fix1"), "word").join(sure_n.toDF("alt", "n2", "m2", "fix2"), "alt")
    whole = F.greatest("n1", "m1") >= F.greatest("n2", "m2")
    hyphens = d.filter(whole).select("page_id", "line_no", F.lit("hyphen").alias("kind"), "word", F.lit(None).cast("string").alias("fix"))
    misread = F.when(whole, (F.col("m1") >= RATIO * F.greatest("n1", F.lit(1)))).otherwise(F.col("m2") >= RATIO * F.greatest("n2", F.lit(1)))
    fix = F.when(whole, F.col("fix1")).otherwise(F.col("fix2"))
    split = d.filter(misread).select("page_id", F.when(fix.startswith(F.col("first")), F.col("after")).otherwise(F.col("line_no")).alias("line_no"), F.lit("char").alias("kind"), F.when(whole, F.col("word")).otherwise(F.col("alt")).alias("word"), fix.alias("fix"))

    chars = rows.filter("kind = 'char?'").join(bad.select("word", F.col("fix").alias("_fix")), "word")
    chars = chars.select("page_id", "line_no", F.lit("char").alias("kind"), F.col("alt").alias("word"), F.col("_fix").alias("fix"))

    return sure.unionByName(last).unionByName(hyphens).unionByName(chars).unionByName(split)


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for rows in _slices(b, 1):
            part = b.slice(rows.start, len(rows))
            texts = []
            for t, digits, marks in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist()):
                hyphen, fix = set(), {}
                for m in marks or ():
                    if m["kind"] == "hyphen":
                        hyphen.add(m["line_no"])
                    elif m["word"] and m["fix"]:
                        fix.setdefault(m["line_no"], []).append((m["word"], m["fix"]))
                texts.append(paragraphs(_lines_of(t), [LABELS[int(x)] for x in digits or ""], hyphen, fix))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["page_id", "text"])


def paragraphs(lines: list[str], labels: list[str], hyphen: set[int], fix: dict[int, list[tuple[str, str]]]) -> str:
    """Continuous paragraphs of the body lines; breaks, headings, lists and table rows end one."""
    out: list[str] = []
    now = ""
    for i, (line, label) in enumerate(zip(lines, labels)):
        if label in ("header", "page_no"):
            continue
        s = line.strip()
        for wrong, right in fix.get(i, ()):
            right = right.upper() if wrong.isupper() and len(wrong) > 1 else right[:1].upper() + right[1:] if wrong[:1].isupper() else right
            s = s.replace(wrong, right)
        if label == "break" or re.match(r"[#|•*]|- ", s):
            if now:
                out.append(now)
            now = ""
            if s:
                out.append(s)
            continue
        glue = "" if not now or now.endswith("\x00") else " " if now[-1] != "-" else ""
        now = now.rstrip("\x00") + glue + (s.rstrip(HYPHENS + " ") + "\x00" if i in hyphen else s)
    if now:
        out.append(now.rstrip("\x00"))
    return "\n\n".join(out)


def repair(pages: DataFrame) -> DataFrame:
    """(page_id, text): the page without furniture, words whole, misreadings mended."""
    labelled = staged(labelled_pages(pages), "pages")
    marks = _found(labelled, COMMON).filter("kind IN ('hyphen', 'char')").groupBy("page_id").agg(F.collect_list(F.struct("line_no", "kind", "word", "fix")).alias("marks"))
    d = labelled.join(marks, "page_id", "left").select("page_id", "page_content", "labels", "marks")
    bare = pages.filter("coalesce(length(page_content), 0) = 0").select(F.col("page_id").cast("long"), F.lit("").alias("text"))
    return d.mapInArrow(_rebuild, "page_id long, text string").unionByName(bare)
