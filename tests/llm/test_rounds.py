"""Answers that must not depend on sizes and parameters, and the operators added beside the listed cases."""

import random

from cairnlake.llm import pairs, personal, scans, spans
from cairnlake.llm.personal import KINDS


def scanned(spark):
    r = random.Random(3)
    words = "ward nurse seen with mild pain over the left wrist and asked for rest until friday while sodium stayed normal".split()
    body = lambda n: [" ".join(r.choice(words) for _ in range(11)) for _ in range(n)]
    head = "Quarry Hill Infirmary | Transfer form"
    pages = [(1, "doc", 1, "\n".join([*body(9), head, *body(12), "1"]))]
    for p in range(2, 7):
        lines = [head, *body(20), str(p)]
        if p == 3:
            lines[5] = "the nurse saw the pat-"
            lines[6] = "ient with w@rd sister and a well-"
        pages.append((p, "doc", p, "\n".join(lines)))
    pages += [(50 + i, f"d{i}", None, "the patient was well-known to the ward " * 4) for i in range(12)]
    pages += [(90, None, None, None), (91, None, 1, ""), (92, "z", 1, "x" * 70_000), (93, "y", 1, head)]
    return spark.createDataFrame(pages, "page_id long, document_id string, page_number int, page_content string")


def test_header_below_a_letterhead(spark):
    got = {(r.page_id, r.line_no, r.kind) for r in scans.found(scanned(spark)).collect()}
    assert (1, 9, "header") in got and all((p, 0, "header") in got for p in range(2, 7))
    assert {p for p, _, k in got if k == "page_no"} == {1, 2, 3, 4, 5, 6}
    assert (3, 5, "hyphen") in got and (3, 6, "char") in got


def test_common_words_change_nothing(spark):
    df = scanned(spark)
    every = [sorted((r.page_id, r.line_no, r.kind) for r in scans.found(df, n).distinct().collect()) for n in (0, 3, 100_000)]
    assert every[0] == every[1] == every[2]


def test_certain_lines_split_the_path_unchanged():
    m, r = scans.layout_model(), random.Random(9)
    lines = ["Ward round", "", "the nurse saw the patient", "12", "- 4 -", "Hill Clinic | Notes", "| a | b |", "see page 3", "1"]
    for _ in range(200):
        page = [r.choice(lines) for _ in range(r.randint(1, 30))]
        feats = scans.features(page, {i: r.random() < 0.5 for i in range(len(page)) if r.random() < 0.3})
        emits = [m.emit(f)[0] for f in feats]
        score = lambda path: sum(e[k] for e, k in zip(emits, path)) + m.moves[-1][path[0]] + sum(m.moves[a][b] for a, b in zip(path, path[1:]))  # noqa: B023, E731
        assert abs(score(m.path(feats)) - score(scans.viterbi(emits, m.moves))) < 1e-6


def test_paths_side_by_side_are_the_best(spark):
    import numpy as np

    p, r = personal.parameters(), np.random.default_rng(2)
    scored = [r.standard_normal((n, len(personal.TAGS))).astype(np.float32) * 3 for n in (1, 2, 40, 7, 0, 33)]

    def total(e, path):
        return p["start"][path[0]] + sum(e[i, k] for i, k in enumerate(path)) + sum(p["move"][a, b] for a, b in zip(path, path[1:]))

    for e, path in zip(scored, personal.paths(scored, p)):
        assert len(path) == len(e)
        if len(e):
            alone = personal.paths([e], p)[0]
            assert (alone == path).all() and all(total(e, path) >= total(e, q) - 1e-3 for q in (r.integers(0, len(personal.TAGS), len(e)) for _ in range(50)))


def test_spans_of_a_path():
    import numpy as np

    path = np.array([0, 1, 2, 2, 0, 1, 1, 3, 4, 0, 6])
    assert personal.spans_of(path) == [(1, 4, KINDS[0]), (5, 6, KINDS[0]), (6, 7, KINDS[0]), (7, 9, KINDS[1]), (10, 11, KINDS[2])]
    assert personal.spans_of(np.zeros(4, int)) == [] and personal.spans_of(np.zeros(0, int)) == []


def test_training_sets_are_apart():
    from cairnlake.llm.training import pairs as training

    made = training.examples([("What was it?", "The value on the ward was 4.1 and the team was content [S1].")] * 40, 3)
    assert {d for _, _, d in made} >= {-1, 0, 1, 2, 3}
    assert all(not pairs.is_empty(a) for _, a, _ in made)


def test_repeated_units(spark):
    long = "The ward nurse saw the patient at noon and noted that the left wrist was swollen but warm. Sodium and potassium were sent to the laboratory again before the evening round. The family was told to call if the pain returned within the next few days. "
    rows = [(1, "First. " + long), (2, "Other. " + long.upper().replace(". ", ".  ")), (3, long + long), (4, "short. " * 3), (5, None), (6, "")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, digest string")
    got = sorted((r.doc_id, r.start_pos, r.end_pos) for r in spans.repeated_units(df).collect())
    assert [g[0] for g in got] == [2, 3] and got[0][1] == 6 and got[1][1] == 0 and got[1][2] == 2 * len(long)
    assert spans.repeated_units(df.limit(0)).count() == 0
