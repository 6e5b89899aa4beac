"""Forms of the searches that take a set of queries, against brute force."""

import math
import random
from collections import Counter

import numpy as np

from cairnlake.operators import lexical, records, retrieval, vectors
from cairnlake.plans import search

from conftest import SMALL


def _vectors(spark, n=60, d=8):
    v = np.random.default_rng(5).standard_normal((n, d))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[7] = v[3]  # equals are told apart by id
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(v)] + [(1000, None)]
    df = spark.createDataFrame(rows, "id long, e array<double>").repartition(3)
    return v, df, df.filter("id % 20 = 0 OR id = 3").selectExpr("id AS query_id", "e")


def test_top_k_of_every_query(spark):
    v, df, queries = _vectors(spark)
    got = {}
    for r in vectors.top_k_set(df, queries, "query_id", "id", "e", 5, block=7).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert got == {q: sorted(range(60), key=lambda i: (-round(float(v[i] @ v[q]), 12), i))[:5] for q in (0, 3, 20, 40)}
    assert vectors.top_k_set(df.limit(0), queries, "query_id", "id", "e", 5).count() == 0
    assert vectors.top_k_set(df, queries, "query_id", "id", "e", 99).count() == 4 * 60


def test_mmr_of_every_query(spark):
    v, df, queries = _vectors(spark)
    got = {}
    for r in vectors.mmr_set(df, queries, "query_id", "id", "e", 4, 20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    for q in (0, 3, 20, 40):
        one = [r.id for r in vectors.mmr(df.filter("e IS NOT NULL"), v[q].tolist(), "id", "e", 4, 20).orderBy("rank").collect()]
        assert got[q] == one


def test_identity_of_every_request(spark):
    p = spark.createDataFrame([("MRN-2024-0000001", "Ann Lee"), ("MRN-2024-0000002", "Corin Tamsin Vale"), ("X7", None), ("--", "Bo")], "mrn string, name string")
    asked = ["for mrn 2024 0000001 please", "show joann leeds", "corin results", "tamsin or lee", "x-7?", "bo", "nothing", None]
    r = spark.createDataFrame(list(enumerate(asked)), "id int, t string")
    got = sorted((x.id, x.mrn, round(x.score, 2)) for x in records.identity_matches(r, "id", "t", p, "mrn", "name").collect())
    assert got == [
        (0, "MRN-2024-0000001", 100.0), (1, "MRN-2024-0000001", 100.0), (2, "MRN-2024-0000002", 71.67), (3, "MRN-2024-0000001", 77.5),
        (3, "MRN-2024-0000002", 71.67), (4, "X7", 100.0), (5, "--", 100.0),
    ]


def shuffled_rows(spark):
    """Rows that all stages so far have written for a shuffle."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _okapi(texts, asked, k):
    """Brute force over (id, text) and (query, text); rows of one id count as one text."""
    words = [(i, (t or "").split()) for i, t in texts]
    n, avg = len(words), sum(len(w) for _, w in words) / len(words)
    idf = {x: math.log(n - m + 0.5) - math.log(m + 0.5) for x, m in Counter(x for _, w in words for x in set(w)).items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    tf = Counter((i, len(w), x) for i, w in words for x in w)
    out = set()
    for q in {q for q, _ in asked}:
        qtf, score = Counter(x for p, t in asked if p == q for x in t.split()), Counter()
        for (i, length, x), f in tf.items():
            score[i] += qtf[x] * (idf[x] if idf[x] >= 0 else floor) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * length / avg))
        best = sorted((-round(s, 9), i) for i, s in score.items() if s > 0)[:k]
        out |= {(q, i, r, round(-s, 6)) for r, (s, i) in enumerate(best)}
    return out


def test_lexical_search_of_every_query_without_its_pairs(spark):
    draw = random.Random(3)
    some = [f"w{i}" for i in range(40)]
    texts = [(i, " ".join(["note", *draw.choices(some, range(1, 41), k=draw.randrange(2, 30))])) for i in range(600)]
    texts += [(9000 + i, t) for i, t in texts[:40]] + [(700, "w1 w2"), (700, "w1 w2"), (700, "w1 w5 w6"), (701, None), (702, "")]
    asked = [(20 * i, " ".join(["note", *draw.choices(some, k=i % 7)])) for i in range(80)] + [(20, "w3"), (2000, "w1 w1 w2"), (2020, "nowhere"), (2040, "note")]
    df, queries = spark.createDataFrame(texts, "id long, t string").repartition(3), spark.createDataFrame(asked, "q long, asked string")
    before = shuffled_rows(spark)
    got = {(r.q, r.id, r["rank"], round(r.score, 6)) for r in lexical.bm25_set(df, queries, "q", "asked", "id", "t", 5).collect()}
    assert got == _okapi(texts, asked, 5)
    assert shuffled_rows(spark) - before < 10_000  # of 80 x 640 pairs nearly all share a word
    assert lexical.bm25_set(df.limit(0), queries, "q", "asked", "id", "t", 5).count() == 0 and lexical.bm25_set(df, queries.limit(0), "q", "asked", "id", "t", 5).count() == 0


def test_lexical_search_in_blocks(spark, monkeypatch):
    """Whatever is held at once, the best are the same, equal ones by id."""
    monkeypatch.setattr(lexical, "BLOCK_CELLS", 40)
    monkeypatch.setattr(lexical, "SORTED_ROWS", 30)
    texts = [(f"d{i:03}", f"note {'pain ' * (i % 4)}{'cough' if i % 3 else ''}".strip()) for i in range(200)]
    asked = [(1, "pain"), (2, "cough note"), (3, "pain cough"), (4, "pain")]
    df, queries = spark.createDataFrame(texts, "id string, t string").coalesce(1), spark.createDataFrame(asked, "q long, asked string")
    got = {(r.q, r.id, r["rank"], round(r.score, 6)) for r in lexical.bm25_set(df, queries, "q", "asked", "id", "t", 7).collect()}
    assert got == _okapi(texts, asked, 7)


def test_hybrid_search_makes_each_list_once(spark):
    plan = _plan(search.hybrid_search(spark, SMALL))
    assert (plan.count("MapInArrow"), plan.count("MapInPandas"), plan.count("SortMergeJoin")) == (1, 3, 0)


def test_missing_sources_makes_each_list_once(spark):
    plan = _plan(search.missing_sources(spark, SMALL))
    assert (plan.count("MapInArrow"), plan.count("MapInPandas")) == (1, 3)


def test_evidence_makes_each_list_once(spark):
    plan = _plan(search.search_evidence(spark, SMALL))
    assert (plan.count("MapInArrow"), plan.count("MapInPandas")) == (1, 3)


def test_evidence_without_a_shuffle_of_texts(spark, same, monkeypatch):
    """Beside the searches no join is shuffled, whatever the sizes; where hits are too many to be sent, the answer is the same."""
    sizes = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(sizes, "-1")
    try:
        ours, lists = (_plan(f(spark, SMALL)).count("SortMergeJoin") for f in (search.search_evidence, search.hybrid_search))
        assert ours == lists
        same(search.search_evidence(spark, SMALL), search.ORACLES["search_evidence"])
    finally:
        spark.conf.unset(sizes)
    for bound in ("SENT_BYTES", "SENT_HITS"):
        monkeypatch.setattr(retrieval, bound, 0)
        same(search.search_evidence(spark, SMALL), search.ORACLES["search_evidence"])


def test_texts_of_hits_go_out_of_their_task_only_as_hits(spark):
    """Queries and texts whose id is there twice count twice; hits without a text or a query do not count."""
    docs = spark.range(4000).selectExpr("id AS i", "repeat('x', 50) || id AS t").union(spark.createDataFrame([(7, "again")], "i long, t string")).coalesce(3)
    queries = spark.createDataFrame([(20, "a"), (20, "b"), (40, None), (60, "c")], "q long, asked string")
    hits = spark.createDataFrame([(20, 7, 0), (20, 8, 1), (40, 7, 0), (40, 9999, 1), (80, 1, 0)], "q long, i long, rank int")
    before = shuffled_rows(spark)
    got = sorted((r.q, r.asked or "", r.i, r["rank"], r.t) for r in retrieval.with_texts(hits, queries, docs, "q", "asked", "i", 2).collect())
    assert shuffled_rows(spark) - before < 100
    x = "x" * 50
    assert got == sorted([(20, a, 7, 0, t) for a in "ab" for t in ("again", x + "7")] + [(20, a, 8, 1, x + "8") for a in "ab"] + [(40, "", 7, 0, t) for t in ("again", x + "7")])


def test_identities_without_their_pairs(spark):
    """Neither are pairs moved nor patients sent through the driver; requests that are there twice count twice."""
    p = spark.createDataFrame([(f"MRN-2024-{i:07}", f"Ann Lee W{i}") for i in range(120)], "mrn string, name string")
    r = spark.createDataFrame([(i, "results of ann lee, please") for i in range(100)] + [(0, "results of ann lee, please")], "id int, t string")
    before = shuffled_rows(spark)
    d = records.identity_matches(r, "id", "t", p, "mrn", "name")
    assert d.count() == 101 * 120
    assert shuffled_rows(spark) - before < 10_000
