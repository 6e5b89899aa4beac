"""Text operators: against SQL, brute force, exact round trips or held-out accuracy."""

import os
import random

import pytest
from pyspark.sql import functions as F

from cairnlake.llm import bpe, copies, mixing, pairs, personal, pieces, queries, scans, spans

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, same, name):
    same(queries.QUERIES[name](spark, SMALL), queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_runs(spark, name):
    assert queries.QUERIES[name](spark, SMALL).count() > 0


# ---- 2
def test_personal_items(spark):
    made = [
        ("call Zephan back on 555-0152 about the stress test", [("name", "Zephan"), ("phone", "555-0152")]),
        ("Patient Corin Kolmenstead, health service number: 999 426 4232, lives at 4869 Cinderwick St., Dunford.", [("name", "Corin Kolmenstead"), ("id_no", "999 426 4232"), ("address", "4869 Cinderwick St., Dunford")]),
        ("Check lot 305-56-3842 against doc-08807564.", []),
        ("cc lucan81@clinic.example; DARIO.SARNEDOTTIR@EXAMPLE.NET", [("email", "lucan81@clinic.example"), ("email", "DARIO.SARNEDOTTIR@EXAMPLE.NET")]),
        ("x" * 3000 + " call Maren Sarnofield back on (350) 555-0164 about the biopsy", [("name", "Maren Sarnofield"), ("phone", "(350) 555-0164")]),
        ("", []), (None, None), ("   ", []),
    ]
    df = spark.createDataFrame([(i, t, "a") for i, (t, _) in enumerate(made)], "id long, t string, row_id string")
    got = {r.row_id: r for r in personal.items(df, "id", "t").collect()}
    for i, (t, want) in enumerate(made):
        if t is None:
            assert i not in got
            continue
        assert [(x["kind"], t[x["start_pos"] : x["end_pos"]].rstrip(".")) for x in got[i]["items"]] == want, t
    assert got[0].masked == "call [NAME] back on [PHONE] about the stress test"
    assert personal.items(df.limit(0), "id", "t").count() == 0


def test_personal_windows_agree():
    p = personal.parameters()
    text = "call Zephan Quillorey back on 555-0152 about it. " * 12
    e = personal.emissions([text, "short"], p)
    assert e[0].shape == (len(text), len(personal.TAGS)) and e[1].shape[0] == 5
    assert sum(k == "phone" for _, _, k in personal.checked(text, personal.spans_of(personal.paths(e, p)[0]))) == 12


# ---- 3
def test_defects(spark):
    cases = [
        ("Does it hurt?", None, "empty"), ("Does it hurt?", " \n", "empty"), ("Does it hurt?", "[S1]", "empty"), ("Does it hurt?", "N/A", "empty"), ("Does it hurt?", "​", "empty"),
        ("What did the renal scan show?", "WHAT DID THE RENAL SCAN SHOW?", "copy"), ("When is the next visit planned?", "You asked: When is the next visit planned?", "copy"),
        ("What was the sodium on 12/27/26?", "As an AI language model, I am unable to access clinical records.", "refusal"),
        ("List the discharge diagnoses.", "Пациент принимал Lixmicillin 80 мг до 10/05, затем лечение остановили из-за слабости [S8].", "language"),
        ("What was the lactate on 07/22/2025?", "The lactate on 07/22/2025 was 12.2, with no const", "truncated"),
        ("Does the patient have gout?", "Not stated in this record.", None), ("What is the blood pressure trend?", "137/68, then 123/94", None),
        ("What did the patient say about reflux?", 'The note of 04/22/26 quotes the patient: "llevo días con mareo y no duermo bien"; reflux was recorded as the main complaint [S2].', None),
        (None, "The next visit is planned for 06/27/2025, after the biopsy and a repeat of triglycerides [S2].", None),
    ]
    df = spark.createDataFrame([(i, q, a) for i, (q, a, _) in enumerate(cases)], "id long, question string, answer string")
    got = {r.row_id: r.defect for r in pairs.defects(df, "id", "question", "answer").collect()}
    assert [got[i] for i in range(len(cases))] == [c[2] for c in cases]


# ---- 4
def test_copies_against_brute_force(spark):
    r = random.Random(5)
    rows = []
    for i in range(600):
        f = [r.choice(("Aspirin", "aspirin ", "Ibu-Profen", None)), r.choice(("12.5 mg", "125 mg", "12.5mg", "1/2 tab", "12 tab", "")), r.choice(("BID", "b.i.d", None)), r.choice(("PO", "po.", None))]
        if r.random() < 0.3:
            r.shuffle(f)
        rows.append((i, r.choice(("d1", "d1", "d2", None)), *f))
    df = spark.createDataFrame(rows, "med_id long, document_id string, name string, dose string, frequency string, route string")

    def canon(x):
        x = x or ""
        out = []
        for k, c in enumerate(x):
            between = 0 < k < len(x) - 1 and x[k - 1].isdigit() and x[k + 1].isdigit()
            if c.isalnum() or (between and not c.isspace()):
                out.append(c.lower())
        return "".join(out)

    groups = {}
    for i, d, *f in rows:
        groups.setdefault((d if d is not None else ("null", i), tuple(sorted(map(canon, f)))), []).append(i)
    want = sorted((min(g), x) for g in groups.values() for x in g if x != min(g))
    got = sorted((x.keep_id, x.copy_id) for x in copies.copies(df, bucket_rows=3).collect())
    assert got == want
    assert copies.copies(df.limit(0)).count() == 0


def test_radix_buckets_fit(spark):
    keys = [bytes(f"doc-{i % 97:05d}-{i}", "ascii") for i in range(2000)] + [b"doc-00001-1"] * 90
    df = spark.createDataFrame([(bytearray(k), 1, 1) for k in keys], "key binary, n long, smallest long")
    rows = [r for part in copies.radix_buckets(df, 50) for r in part.collect()]
    assert sorted(bytes(r.key) for r in rows) == sorted(keys)
    sizes, held = {}, {}
    for r in rows:
        b = bytes(r.bucket)
        assert bytes(r.key).startswith(b)
        sizes[b] = sizes.get(b, 0) + 1
        held.setdefault(b, set()).add(bytes(r.key))
    assert all(n <= 50 or len(held[b]) == 1 for b, n in sizes.items()) and len(sizes) > 20
    assert len({k for b in held.values() for k in b}) == sum(map(len, held.values()))  # no key in two buckets
    t = copies.Trie()
    for k in keys:
        t.add(k, 1, 7)
    assert sum(n for _, n, _ in t.items()) == 2090 and len(list(t.items())) == 2000


# ---- 5
def test_scan_repair(spark):
    body = ["The patient reports mild dizziness in the right wrist and", "was seen by the ward nurse. Oxygen was reduced to 6 liters", "and the family was advised to call if the dizziness ret-", "urns within 5 weeks. A well-", "controlled course was noted."] * 2
    pages, k = [], 0
    for p in range(1, 7):
        lines = [f"Redcombe Day Unit | Progress Note", *body, f"Page {p} of 6"]
        if p == 3:
            lines[2] = "was seen by the w@rd nurse. Oxygen was reduced to 6 liters"
            lines[4] = "urns within 5O weeks. A well-"
        pages.append((p, "doc", p, "\n".join(lines)))
    pages += [(50 + i, "other", i, "returns mild dizziness well-controlled ward nurse " * 6) for i in range(8)] + [(90, "x", 1, None), (91, "x", 2, ""), (92, None, None, "No content.")]
    df = spark.createDataFrame(pages, "page_id long, document_id string, page_number int, page_content string")
    got = {(r.page_id, r.line_no, r.kind) for r in scans.found(df).collect()}
    for p in range(1, 7):
        assert (p, 0, "header") in got and (p, 11, "page_no") in got and (p, 3, "hyphen") in got and (p, 8, "hyphen") in got
        assert (p, 4, "hyphen") not in got and (p, 9, "hyphen") not in got
    assert (3, 2, "char") in got and (3, 4, "char") in got
    assert not any(p > 6 for p, _, _ in got)
    text = {r.page_id: r.text for r in scans.repair(df).collect()}
    assert "Redcombe" not in text[1] and "returns within" in text[1] and "well-controlled" in text[1] and "ward nurse" in text[3] and text[91] == ""


# ---- 7
def test_pieces_cover_and_overlap(spark):
    r = random.Random(2)
    texts = ["", "short", "x" * 5000, "word " * 3000, "é" * 1000, "é" * 1001] + ["".join(r.choice(("alpha beta. ", "gamma, ", "\n\n", "delta\n", "z" * 50)) for _ in range(r.randint(10, 900))) for _ in range(12)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)], "id long, t string")
    for limit, overlap, size in ((1000, 200, 1 << 16), (100, 20, 400)):
        by = {}
        for x in pieces.split_column(df, "id", "t", limit, overlap, size).collect():
            by.setdefault(x.id, []).append((x.start, x.piece))
        assert 99 not in by and 0 not in by
        for i, t in enumerate(texts):
            if not t:
                continue
            parts = sorted(by[i])
            assert parts[0][0] == 0 and parts[-1][0] + len(parts[-1][1]) == len(t)
            for (a, p), (b, _) in zip(parts, parts[1:]):
                assert b == a + len(p) - overlap
            assert all(t[a : a + len(p)] == p and len(p) <= limit for a, p in parts)
    got = {x.id: (x.n_chars, x.longest_run) for x in pieces.sizes(df, "id", "t", 400).collect()}
    assert got == {i: (len(t), max(map(len, __import__("re").split(r"\s", t)))) for i, t in enumerate(texts)}


def test_pieces_of_files(spark, tmp_path):
    r = random.Random(4)
    text = "".join(r.choice(("wörter ", "日本語。 ", "line\n", "sentence. ", "🙂")) for _ in range(9000))
    (tmp_path / "big.txt").write_text(text, encoding="utf-8")
    parts = sorted((x.start, x.piece) for x in pieces.split_files(spark, str(tmp_path), 200, 40, 4096).collect())
    assert parts[0][0] == 0 and parts[-1][0] + len(parts[-1][1]) == len(text)
    assert all(text[a : a + len(p)] == p and len(p) <= 200 for a, p in parts)
    assert all(b == a + len(p) - 40 for (a, p), (b, _) in zip(parts, parts[1:]))


# ---- 8
def test_encoding_round_trip():
    import tiktoken

    e = bpe.Encoder(bpe.VOCABULARY)
    other = tiktoken.Encoding("own", pat_str=r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", mergeable_ranks=e.ranks, special_tokens={})
    r = random.Random(3)
    texts = ["", "a" * 3000, " " * 99, "<|endoftext|>", "naïve 日本語 🙂\n\n x", "it's  a\t b"] + ["".join(r.choice("abc \n.,é1'") for _ in range(200)) for _ in range(100)]
    back = {i: b for b, i in e.ranks.items()}
    for t in texts:
        ids = e.encode(t)
        assert ids == other.encode_ordinary(t) and b"".join(back[i] for i in ids).decode() == t and e.length(t) == len(ids)
    assert e.encode(None) == []


# ---- 9
def test_fit_is_close():
    import numpy as np

    r = np.random.default_rng(1)
    for _ in range(20):
        sizes = np.unique(r.integers(1, 900, 60))
        counts = r.integers(1, 50, len(sizes))
        total = int((sizes * counts).sum())
        budget = int(total * r.random())
        take = mixing.fit(sizes, counts, budget)
        assert (take >= 0).all() and (take <= counts).all()
        assert 0 <= budget - int((take * sizes).sum()) <= 2


def test_mix_shares(spark):
    docs = [(i, "word " * (3 + i % 40), "big") for i in range(900)] + [(2000 + i, "tiny text here " * (2 + i % 7), "small") for i in range(60)] + [(5000, None, "small"), (5001, "", "big"), (5002, "x", None), (5003, "x", "unknown")]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    t = spark.createDataFrame([("big", 0.6, 1), ("small", 0.3, 3), ("absent", 0.1, 4), ("big", 0.6, 1)], "source string, target_share double, max_repeats int")
    m = mixing.mix(d, t, bucket_rows=5)
    s = {r.source: r for r in mixing.shares(m, t).collect()}
    assert s["absent"].tokens == 0 and abs(s["big"].actual_share - 2 / 3) < 0.01 and abs(s["small"].actual_share - 1 / 3) < 0.01
    assert s["big"].most_repeats <= 1 and s["small"].most_repeats <= 3
    assert m.count() == m.select("doc_id").distinct().count()
    assert sorted(m.collect()) == sorted(mixing.mix(d, t, bucket_rows=5).collect())
    assert mixing.mix(d.limit(0), t).count() == 0


# ---- 10
def brute(rows, n):
    own = {}
    for i, t in rows:
        for s in range(len(t or "") - n + 1):
            g = t[s : s + n]
            own[g] = i if own.get(g, i) == i else None
    out = {}
    for i, t in rows:
        cover = bytearray(len(t or ""))
        for s in range(len(t or "") - n + 1):
            if own[t[s : s + n]] is None:
                cover[s : s + n] = b"\1" * n
        if any(cover):
            out[i] = sum(cover)
    return out


def test_shared_spans_against_brute_force(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6)))
    passages = [" ".join(word() for _ in range(r.randint(5, 60))) for _ in range(12)]
    rows = []
    for i in range(60):
        t = " ".join(word() for _ in range(r.randint(0, 60)))
        for _ in range(r.randint(0, 2)):
            p = r.choice(passages)
            a = r.randint(0, len(p) // 3)
            t += p[a : len(p) - r.randint(0, 20)] + " " + " ".join(word() for _ in range(r.randint(0, 20)))
        rows.append((i, t))
    rows += [(100, rows[3][1] * 1), (101, rows[3][1]), (102, None), (103, ""), (104, "ab" * 300), (105, "🙂é" * 120), (106, "x" + "🙂é" * 120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for n, unit in ((40, 24), (60, 25)):
        got = {x.doc_id: x for x in spans.shared_spans(df, min_len=n, unit=unit).collect()}
        want = brute(rows, n)
        assert {k: v.shared_chars for k, v in got.items()} == want
        text = dict(rows)
        for k, v in got.items():
            assert all(0 <= a < z <= len(text[k]) for a, z in v.spans)
        assert got[100].repeats and not got[3].repeats if 3 in got and got[3].copies > 1 else True
    assert spans.shared_spans(df.limit(0)).count() == 0
