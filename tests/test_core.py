"""Core operators: against SQL on the small tables, and on cases with known results."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from cairnlake.functions.text import citations, content_hash, version_of
from cairnlake.operators import assembly, documents, fusion, lexical, quality, records, vectors
from cairnlake.operators.instants import normalise_instants
from cairnlake.operators.quantities import to_common_units
from cairnlake.plans import registry
from cairnlake.sources import files
from cairnlake.streaming import windows

from conftest import SMALL


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, same, name):
    same(registry.QUERIES[name](spark, SMALL), registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_runs(spark, name):
    assert registry.QUERIES[name](spark, SMALL).count() > 0


def us(*a, **k):
    return int(dt.datetime(*a, tzinfo=dt.timezone.utc, **k).timestamp() * 1_000_000)


INSTANTS = [
    ("2025-08-27T21:17:02+0000", us(2025, 8, 27, 21, 17, 2)), ("30/08/2024 10:26PM", us(2024, 8, 31, 2, 26)), ("16 July 2024", us(2024, 7, 16, 4)), ("Nov 2, 2025", us(2025, 11, 2, 4)),
    ("2023-01-31 04:42:24 -05:00", us(2023, 1, 31, 9, 42, 24)), ("1759716886146", 1759716886146000), ("1743700615030505261", 1743700615030505), ("1782960914.018", 1782960914018000),
    ("Sun, 26 Mar 2023 00:33:07 GMT", us(2023, 3, 26, 0, 33, 7)), ("2023-11-25T18:03:01+00:00[Europe/London]", us(2023, 11, 25, 18, 3, 1)), ("2024-05-04 07:23:02 America/Chicago", us(2024, 5, 4, 12, 23, 2)),
    ("07-APR-2024", us(2024, 4, 7, 4)), ("30-May-25", us(2025, 5, 30, 4)), ("29. May 2026", us(2026, 5, 29, 4)), ("20230627053603", us(2023, 6, 27, 9, 36, 3)), ("202411030129", us(2024, 11, 3, 5, 29)),
    ("2025-09-25 21.09", us(2025, 9, 26, 1, 9)), ("2026-02-18T08:13:45.329412350Z", us(2026, 2, 18, 8, 13, 45, 329412)), ("Nov 15, 2025 9:58 PM CST", us(2025, 11, 16, 3, 58)),
    ("  2024-01-01 ", us(2024, 1, 1, 5)), ("2024-11-03 01:30:00", us(2024, 11, 3, 5, 30)), ("2024-11-03 01:30:00 EST", us(2024, 11, 3, 6, 30)),
    ("2024-03-10 02:30:00", None), ("2025-02-30", None), ("31/31/2024", None), ("pending", None), ("", None), (None, None), ("2024-01-01 25:00", None), ("13:99", None),
]


def test_instants(spark):
    tenants = spark.createDataFrame([("a", "America/New_York", "mdy"), ("b", "Europe/Berlin", "dmy")], "tenant_id string, tz_name string, date_order string")
    rows = spark.createDataFrame([(i, v, "a") for i, (v, _) in enumerate(INSTANTS)] + [(100, "02/03/2026", "b"), (101, "02/13/2026", "b"), (102, "02/03/2026", None)], "id long, v string, tenant_id string")
    got = {r.row_id: r.utc_us for r in normalise_instants(rows, tenants, "id", "v", True).collect()}
    for i, (v, want) in enumerate(INSTANTS):
        assert got[i] == want, v
    assert got[100] == us(2026, 3, 1, 23) and got[101] == us(2026, 2, 12, 23) and got[102] == us(2026, 2, 3)
    later = normalise_instants(rows.filter(f"id = {[v for v, _ in INSTANTS].index('2024-11-03 01:30:00')}"), tenants, "id", "v", True, ambiguous="later").first()
    assert later.utc_us == us(2024, 11, 3, 6, 30)
    gap = normalise_instants(rows.filter(f"id = {[v for v, _ in INSTANTS].index('2024-03-10 02:30:00')}"), tenants, "id", "v", True, nonexistent="shift").first()
    assert gap.utc_us == us(2024, 3, 10, 7, 30)
    assert normalise_instants(rows.limit(0), tenants, "id", "v", True).count() == 0


def test_quantities(spark):
    units = spark.read.parquet(f"{SMALL}/lab_units.parquet")
    cases = [
        ("Glucose", "5.5", "mmol/L", 99.088), ("Glucose", "1,947", "mg/L", 194.7), ("Glucose", "0,4561 g/L", None, 45.61), ("Glucose", "<= 5,5 mmol/l H", "mg/dL", 99.088), ("Sodium", "1.430E+2 mEq/L", None, 143.0),
        ("Leukocytes", "17,804", "/uL", 17.804), ("Platelets", "1.770 x 10^2  10^9 / L", None, 177.0), ("Leukocytes", "19.0 x10E9/L", "mg", 19.0), ("HbA1c", "53", "mmol/mol IFCC", 53 * 0.0915 + 2.15), ("Albumin", "45 g/L", "g/dL", 4.5),
        ("Glucose", "15.76-20.49", "mg/dL", None), ("Glucose", "positive", "mg/dL", None), ("Glucose", "5", None, None), ("Glucose", "5", "bpm", None), (None, "5", "mg/dL", None), ("Glucose", None, None, None), ("Glucose", "", "", None),
    ]
    df = spark.createDataFrame([(i, *c[:3], "x") for i, c in enumerate(cases)], "lab_id long, test string, value string, unit string, tail_other string")
    got = {r.lab_id: r.common_value for r in to_common_units(df, units).collect()}
    for i, c in enumerate(cases):
        assert got[i] == pytest.approx(c[3]) if c[3] is not None else got[i] is None, c
    defaults = spark.createDataFrame([("Glucose", "mg/dL")], "test string, default_unit string")
    assert to_common_units(df.filter("lab_id = 12"), units, defaults).first().common_value == 5.0


def test_gate_and_hash(spark):
    long = "Clinical notes with sufficient content. " * 5
    cases = [("", "empty_text"), (None, "empty_text"), (" \n\t ", "empty_text"), ("Hello world", "too_short"), ("1234567890" * 50 + "abc", "low_alpha_ratio"), (long, "ok"), (long + "a" * 30, "excessive_repetition"), (long + "-" * 40, "ok")]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "id int, t string")
    got = {r.id: r.r for r in df.select("id", quality.gate_reason(F.col("t")).alias("r")).collect()}
    assert [got[i] for i in range(len(cases))] == [w for _, w in cases]
    h = [r[0] for r in spark.createDataFrame([("A  b\n",), ("a b",), ("a c",)], "t string").select(content_hash(F.col("t"))).collect()]
    assert h[0] == h[1] != h[2] and len(h[0]) == 64
    assert [r[0] for r in spark.createDataFrame([("doc-v3",), ("doc",)], "t string").select(version_of(F.col("t"))).collect()] == ["v3", "v1"]


def test_bm25_and_fusion(spark):
    df = spark.createDataFrame([(1, "Metformin for diabetes"), (2, "Blood pressure was stable"), (3, "Aspirin given"), (4, None), (5, "")], "id long, t string")
    assert [r.id for r in lexical.bm25(df, ["metformin", "diabetes"], "id", "t").collect()] == [1]
    assert lexical.bm25(df.limit(0), ["x"], "id", "t").count() == 0
    a = spark.createDataFrame([("a", 0), ("b", 1)], "k string, rank int")
    b = spark.createDataFrame([("b", 0), ("c", 1)], "k string, rank int")
    assert [r.k for r in fusion.fuse([a, b], "k", "rank").collect()] == ["b", "a", "c"]
    bands = spark.createDataFrame([(3, 0.8), (2, 0.4), (1, 0.9), (0, 0.0), (2, 0.0)], "n int, top double").select(fusion.confidence(F.col("n"), F.col("top")))
    assert [r[0] for r in bands.collect()] == ["HIGH", "MODERATE", "LOW", "NO_EVIDENCE", "MODERATE"]
    shared = "the discharge plan was read with the family twice"
    e = spark.createDataFrame([("x " + shared, shared + " y"), ("abc", "abc"), (None, "x")], "a string, b string").select(assembly.shared_edge(F.col("a"), F.col("b")))
    assert [r[0] for r in e.collect()] == [len(shared), 0, 0]


def test_mmr_is_greedy(spark):
    import numpy as np

    r = np.random.default_rng(3)
    v = r.standard_normal((30, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "id long, e array<double>")
    q = r.standard_normal(8)
    q /= np.linalg.norm(q)
    got = [r.id for r in vectors.mmr(df, q.tolist(), "id", "e", 5, 20).orderBy("rank").collect()]
    sim = v @ q
    pool, want = sorted(range(30), key=lambda i: (-sim[i], i))[:20], []
    while len(want) < 5:
        best = max(pool, key=lambda i: 0.5 * sim[i] - 0.5 * max((v[i] @ v[j] for j in want), default=0.0))
        pool.remove(best)
        want.append(best)
    assert got == want


def test_records_and_documents(spark):
    prices = spark.createDataFrame([("m", 2.0, 0.5, 8.0), ("m-mini", 0.4, 0.1, 1.6)], "name string, i double, c double, o double")
    u = spark.createDataFrame([("m", 1_000_000, 500_000, 1_000_000), ("m-mini-2026", 1_000_000, None, 1_000_000), ("other", 1, 0, 1)], "model string, a long, k long, b long")
    got = records.longest_prefix(u, prices, "model", "name").select("model", records.cost(F.col("a"), F.col("k"), F.col("b"), F.col("i"), F.col("c"), F.col("o")).alias("x")).collect()
    assert {r.model: r.x for r in got} == {"m": 9.25, "m-mini-2026": 2.0, "other": None}
    s = records.Scope(tenant_id="t", document_ids=("a", "b"))
    assert s.narrow(records.Scope(document_ids=("b", "z"))).document_ids == ("b",)
    assert s.narrow(records.Scope(document_ids=("z",))).document_ids == ("a", "b")
    c = spark.createDataFrame([("x [S1]. y [S3][S1].",), (None,)], "t string").select(citations(F.col("t")))
    assert [r[0] for r in c.collect()] == [[1, 3], []]
    p = spark.createDataFrame([("d", i, n) for i, n in enumerate((5, 6, 7, 3, 9))], "g string, i int, n int")
    assert [r.pack for r in documents.packed(p, "g", "i", F.col("n"), 12).orderBy("i").collect()] == [0, 0, 1, 1, 2]
    t = spark.createDataFrame([(1, "# A\n\n| Test | Result | Ref |\n|---|---|---|\n| Iron | 5.1 | 3-12 |\n\n## B\ntext"), (2, None)], "id int, t string")
    assert [(r.name, r.value) for r in documents.table_facts(t, "id", "t").collect()] == [("Iron", "5.1")]
    assert [r.title for r in documents.sections(t, "id", "t").orderBy("section_no").collect()] == ["A", "B"]
    st = spark.createDataFrame([("a", "h1", "p"), ("b", "h2", "p")], "document_id string, hash string, owner string")
    n = spark.createDataFrame([("a", "h1", "p"), ("b", "h9", "p"), ("c", "h2", "p"), ("d", "h2", "q")], "document_id string, hash string, owner string")
    assert {r.document_id: r.action for r in quality.upsert_action(n, st).collect()} == {"a": "duplicate", "b": "replace", "c": "duplicate", "d": "new"}


def test_streaming(spark, tmp_path):
    e = spark.createDataFrame([(1, "k", dt.datetime(2024, 1, 1, 0, 5), 1.0), (2, "k", dt.datetime(2024, 1, 1, 0, 50), 2.0), (3, "k", dt.datetime(2024, 1, 3, 0, 0), 4.0)], "id long, key string, ts timestamp, value double")
    e.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    seen = []
    q = windows.ingest(windows.once(stream, "id", "ts"), lambda d, i: seen.extend(r.id for r in d.collect()), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert sorted(seen) == [1, 2, 3]
    q = windows.rates(stream, "ts", "key").writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.n for r in spark.table("rates").collect()) == [1, 2]
    assert sorted(r.n for r in windows.sessions(e, "ts", "key").collect()) == [1, 2]


def test_files(spark, tmp_path):
    import zipfile

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Plan</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    (tmp_path / "b.html").write_text("<h1>T</h1><ul><li>one</li></ul>")
    (tmp_path / "c.txt").write_text("page one\fpage two")
    (tmp_path / "d.exe").write_text("x")
    d = files.checked(files.files(spark, str(tmp_path)))
    assert {os.path.basename(r.path): r.problem for r in d.select("path", "problem").collect()} == {"a.docx": None, "b.html": None, "c.txt": None, "d.exe": "unsupported"}
    got = sorted((os.path.basename(r.path), r.page_number, r.markdown) for r in files.pages(d).collect())
    assert got == [("a.docx", 1, "## Plan\n\n| x |\n|---|"), ("b.html", 1, "# T\n\n- one"), ("c.txt", 1, "page one"), ("c.txt", 2, "page two")]
    files.write_history(spark.createDataFrame([("t", "2024-01-01", 'a "q"', "line\nbreak")], "thread_id string, timestamp string, user_query string, response string"), str(tmp_path / "h"))
    assert files.history(spark, str(tmp_path / "h")).first().user_query == 'a "q"'
