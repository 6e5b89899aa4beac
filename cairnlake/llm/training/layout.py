"""Train the line model: clean page bodies are wrapped and furnished like scans, so every line's label is known.

python -m cairnlake.llm.training.layout PAGES.parquet
"""

from __future__ import annotations

import json
import random
import sys
import textwrap
from collections import defaultdict
from pathlib import Path

import pyarrow.parquet as pq

from cairnlake.llm.scans import CONFUSIONS, LABELS, SAME_PLACE, Layout, expanded, features, normalised, viterbi

_SYLLABLES = ("bar", "cle", "don", "esk", "fair", "gil", "hun", "ing", "jar", "kel", "lin", "mor", "net", "over", "pres", "quin", "ros", "shel", "tor", "ull", "ver", "whit", "yar")
_ENDS = ("ton", "ley", "worth", "dale", "wick", "pool", "gate", "bridge", "well", "moor")
_HOUSES = ("Hospital", "Infirmary", "Surgery", "Clinic", "Health Centre", "Medical Group", "Polyclinic", "Practice", "Rehabilitation Centre", "Institute of Cardiology", "Children's Hospital", "Laboratories")
_KINDS = ("Summary", "Letter", "Ward round", "Report of findings", "Consultation", "Transfer form", "Theatre record", "Medication chart", "Request", "Nursing note", "Imaging", "Record", "Notes", "Outpatient letter")
_WORDS = ("Confidential", "Original", "Duplicate", "Draft", "Copy", "Printed", "Internal use only", "Restricted", "Continuation sheet", "cont'd", "continued", "Do not remove", "File copy", "Form", "Version", "Sheet")
_SECTIONS = ("Summary", "Findings", "Diagnosis", "Plan", "Social History", "Medication on admission", "Examination", "Advice", "Coverage")
_TESTS = ("Glucose", "Sodium", "Ferritin", "Albumin", "Urea", "Calcium", "Platelets", "Hemoglobin", "Lactate", "Magnesium")
_SEPARATORS = (" | ", " - ", " – ", ", ", "   ", " / ", ": ", "    ", " ", "; ")


def _word(r: random.Random) -> str:
    return "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 2))).capitalize() + r.choice(("", "", r.choice(_ENDS)))


def _running(r: random.Random) -> str:
    """A running line: a few parts in any order, between any marks, in any case."""
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    parts = {
        "house": lambda: f"{_word(r)} {r.choice(_HOUSES)}", "kind": lambda: r.choice(_KINDS), "word": lambda: r.choice(_WORDS), "person": lambda: f"{_word(r)} {_word(r)}", "family": lambda: f"{_word(r).upper()}, {_word(r)}",
        "number": lambda: r.choice(("", "No. ", "ID ", "Ref ")) + "".join(r.choice("ABCDEFGHJKLMNPRSTW") for _ in range(r.randint(0, 3))) + r.choice(("", "-")) + digits(r.randint(4, 10)),
        "date": lambda: r.choice((f"{digits(2)}/{digits(2)}/20{digits(2)}", f"{digits(2)}.{digits(2)}.{digits(2)}", f"20{digits(2)}-{digits(2)}-{digits(2)} {digits(2)}:{digits(2)}", f"born {digits(2)}/{digits(2)}/19{digits(2)}")),
        "page": lambda: r.choice(("Page #", "page # of @", "p. #", "Sheet #/@", "(#)")),
    }
    chosen = r.sample(("house", "house", "kind", "word", "person", "family", "number", "date", "page"), r.choice((1, 1, 2, 2, 2, 3, 4)))
    if len(chosen) == 1 and chosen[0] in ("number", "date", "page"):
        chosen = ["house"]
    line = r.choice(_SEPARATORS).join(parts[c]() for c in dict.fromkeys(chosen))
    if r.random() < 0.15:
        line += f" ({parts[r.choice(('kind', 'word', 'number'))]()})"
    x = r.random()
    return line.upper() if x < 0.2 else line.lower() if x < 0.25 else line


def _document(r: random.Random, bodies: list[str]) -> list[list[tuple[str, str]]]:
    """Pages of one scan: (line, label)."""
    numbers = ["#", "- # -", "– # –", "[#]", "Page #", "Page # of @", "Pg #", "p. #", "# / @", "roman", "(#)", "-#-", "page #/@", "# of @", "PAGE #"]
    heads = [_running(r) for _ in range(r.choice((0, 1, 1, 2, 3)))]
    number = r.choice(numbers) if r.random() < 0.75 else None
    top_number, top = r.random() < 0.3, [r.random() < 0.6 for _ in heads]
    first, pages, width = r.choice((1, 1, 1, r.randint(2, 20))), r.choice((1, 2, 3, r.randint(1, 9))), r.randint(40, 96)
    own = [r.choice((r.choice(_SECTIONS), r.choice((" ", " ", " and ", " of ")).join(_word(r) for _ in range(r.randint(1, 3))))) for _ in range(r.randint(1, 4))]
    often = r.choice((0.06, 0.12, 0.25))
    tall = r.random() < 0.12  # a letterhead of many lines above the running one
    out = []
    for p in range(pages):
        rows: list[tuple[str, str]] = []
        want = r.choice((r.randint(0, 3), r.randint(4, 45), r.randint(10, 45), r.randint(10, 45)))
        while len(rows) < want:
            x = r.random()
            if x < often:
                s = r.choice(own)
                rows += [("", "break")] * r.randint(0, 1) + [(r.choice((s, s + ":", "## " + s)), "body")] + [("", "break")] * r.randint(0, 1)
            elif x < often + 0.1:
                for _ in range(r.randint(1, 5)):
                    rows += [(r.choice(_TESTS), "body"), (str(r.choice((r.randint(2, 400), r.randint(2, 99)))), "body")]
            elif x < often + 0.15:
                what = r.choice(("form", "booklet", "diary", "questionnaire", "order set", "care plan"))
                rows.append((r.choice((f"See page {r.randint(1, 30)} of the {what} for details.", f"The {what} has {r.randint(2, 9)} pages.", f"Pages {r.randint(1, 5)} to {r.randint(6, 9)} of the {what} were completed at home.", f"Page {r.randint(1, 9)} of the {what} is missing.", f"Page {r.randint(1, 9)} of the {what} was read with the {r.choice(('ward', 'evening', 'outreach'))} team.")), "body"))
            else:
                rows += [(s, "body") for s in textwrap.wrap(r.choice(bodies), width)] + [("", "break")] * r.randint(0, 1)
        rows = rows[r.randint(0, 4) :] if p else rows
        rows = rows[: max(0, len(rows) - r.randint(0, 6))] if want > 3 else rows

        def dress(s: str, n: int = p) -> str:
            shown = str(first + n)
            if s == "roman":
                shown = ["", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x", "xi", "xii", "xiii", "xiv", "xv", "xvi", "xvii", "xviii", "xix", "xx"][min(first + n, 20)]
                s = "#"
            s = s.replace("#", shown).replace("@", str(first + pages - 1))
            if r.random() < 0.1:
                wrong, right = r.choice([(a, b) for a, b in CONFUSIONS if b in s.lower()] or [("", "")])
                at = s.lower().find(right)
                s = s[:at] + wrong + s[at + len(right) :] if right else s
            return s

        ups, downs = [], []
        for h, up in zip(heads, top):
            if r.random() < 0.93:
                (ups if up else downs).append(("   " * (r.random() < 0.4) + dress(h), "header"))
        if number and r.random() < 0.95:
            line = ("      " * (r.random() < 0.3) + dress(number), "page_no")
            ups.insert(0, line) if top_number else downs.append(line)
        gap = [("", "break")] * (r.random() < 0.4)
        if tall and not p and ups:
            letter = [(s, "body") for k in range(r.randint(2, 4)) for s in textwrap.wrap(r.choice(bodies), width)[:2]]
            ups = letter[: r.randint(3, 9)] + ups
        page = ups + (gap if ups else []) + rows + downs
        if tall and out and r.random() < 0.3 and len(out[-1]) + len(page) < 90:
            out[-1] = out[-1] + page  # two sheets in one page of the table
        else:
            out.append(page)
    return [p for p in out if p]


def examples(bodies: list[str], documents: int, seed: int):
    """(lines, numbers of repeated lines, labels) of pages."""
    r = random.Random(seed)
    for _ in range(documents):
        if r.random() < 0.3:  # pages that were never on paper
            if r.random() < 0.3:  # a page of a few words, which may come again
                s = r.choice(("Blank page", "No text on this side", "See overleaf", "Page left empty on purpose", "End of record", "Nothing recorded", " ".join(_word(r) for _ in range(r.randint(1, 4)))))
                yield [s], {0: r.random() < 0.5} if r.random() < 0.5 else {}, ["body"]
            for text in r.sample(bodies, min(3, len(bodies))):
                yield text.split("\n\n")[:1], {}, ["body"]
            continue
        pages = _document(r, bodies)
        seen = defaultdict(list)
        for p, page in enumerate(pages):
            for i, (s, _) in enumerate(page):
                seen[normalised(s)].append((p, i, len(page) - 1 - i))
        again = {}
        for s, at in seen.items():
            if s and len({x[0] for x in at}) > 1:
                again[s] = any(max(x[k] for x in at) - min(x[k] for x in at) <= SAME_PLACE for k in (1, 2))
        for page in pages:
            lines = [s for s, _ in page]
            yield lines, {i: again[normalised(s)] for i, s in enumerate(lines) if normalised(s) in again}, ["break" if not s.strip() else lab for s, lab in page]


def train(bodies: list[str], documents: int = 3600, rounds: int = 4, seed: int = 3) -> dict:
    n = len(LABELS)
    w, total = defaultdict(lambda: [0.0] * n), defaultdict(lambda: [0.0] * n)
    moves, moves_total, t = [[0.0] * n for _ in range(n + 1)], [[0.0] * n for _ in range(n + 1)], 1
    data = [([expanded(f) for f in features(a, b)], [LABELS.index(x) for x in c]) for a, b, c in examples(bodies, documents, seed)]
    r = random.Random(seed)
    for _ in range(rounds):
        r.shuffle(data)
        for feats, gold in data:
            emits = []
            for f in feats:
                rows = [w[x] for x in f if x in w]
                emits.append([sum(v[j] for v in rows) for j in range(n)])
            guess = viterbi(emits, moves)
            t += 1
            if guess == gold:
                continue
            for k, (g, h) in enumerate(zip(gold, guess)):
                if g != h:
                    for x in feats[k]:
                        for lab, d in ((g, 1.0), (h, -1.0)):
                            w[x][lab] += d
                            total[x][lab] += t * d
                pg, ph = (gold[k - 1], guess[k - 1]) if k else (n, n)
                for a, lab, d in ((pg, g, 1.0), (ph, h, -1.0)):
                    moves[a][lab] += d
                    moves_total[a][lab] += t * d
    weights = {x: [round(v[j] - total[x][j] / t, 3) for j in range(n)] for x, v in sorted(w.items())}
    return {"weights": {x: v for x, v in weights.items() if any(v)}, "moves": [[round(moves[a][j] - moves_total[a][j] / t, 3) for j in range(n)] for a in range(n + 1)]}


def held_out(model: dict, bodies: list[str], seed: int = 99) -> dict[str, tuple[int, int, int]]:
    """(right, found, true) of each label on documents not trained on."""
    n = {x: [0, 0, 0] for x in LABELS}
    layout = Layout(model["weights"], model["moves"])
    for lines, repeated, gold in examples(bodies, 300, seed):
        for g, k in zip(gold, layout.path(features(lines, repeated))):
            n[LABELS[k]][1] += 1
            n[g][2] += 1
            n[g][0] += g == LABELS[k]
    return {k: tuple(v) for k, v in n.items()}


if __name__ == "__main__":
    text = pq.read_table(sys.argv[1], columns=["page_content"]).column(0).to_pylist()
    clean = [p for t in text if t for p in t.split("\n\n") if 150 < len(p) < 900 and "\n" not in p]
    model = train(clean[: len(clean) // 2])
    print(held_out(model, clean[len(clean) // 2 :]))
    Path(__file__).parents[1].joinpath("models/layout.json").write_text(json.dumps(model, sort_keys=True))
