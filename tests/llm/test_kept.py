"""Texts without their repeats, by original offsets."""

import random

from cairnlake.llm import spans


def test_kept_is_the_complement_of_the_repeats(spark):
    r = random.Random(4)
    word = lambda n: "".join(r.choice("abcdefghij é\U0001f600") for _ in range(n))
    a = word(1500)
    texts = [word(200) + a + word(300), word(50) + a + word(80) + a[:900] + word(40), a, a, word(900), "short", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    cuts = {x.doc_id: x.repeats for x in spans.shared_spans(df).collect()}
    got = {}
    for x in spans.kept(df).orderBy("doc_id", "start_pos").collect():
        assert x.piece == texts[x.doc_id][x.start_pos : x.end_pos]
        got.setdefault(x.doc_id, []).append((x.start_pos, x.end_pos))
    assert cuts[1] and cuts[3]
    for i, t in enumerate(texts):
        left = set(range(len(t or ""))) - {k for s in cuts.get(i, []) for k in range(*s)}
        assert {k for s in got.get(i, []) for k in range(*s)} == left, i
