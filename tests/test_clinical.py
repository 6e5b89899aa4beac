"""Metadata, requests, orders, facts, layout and chunks on cases with known results."""

from pyspark.sql import functions as F

from cairnlake.operators import assembly, chunking, facts, layout, metadata, orders, retrieval, understanding


def one(spark, column, **values):
    d = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return d.select(column.alias("x")).first().x


def test_metadata(spark):
    c = F.col("t")
    assert one(spark, metadata.patient_name(c), t="Drug name: X\nPatient Name: Robert James Field.\n") == "Robert James Field"
    assert one(spark, metadata.patient_name(c), t="Name: Bo\nPatient: Jane Q Smith\n") == "Jane Q Smith" and one(spark, metadata.patient_name(c), t=None) is None
    assert one(spark, metadata.facility(c), t="Facility: St. Mary Hall,\nx") == "St. Mary Hall" and one(spark, metadata.location(c), t="Unit: 4 West") is None
    assert one(spark, metadata.clinical_date(c), t="Collected: 13/40/2025 Resulted: 1/5/26") == "2026-01-05"
    assert [one(spark, metadata.iso_date(c), t=x) for x in ("1/5/75", "02.29.2023", "01-15-2026", "2025-01-01", None)] == ["2075-01-05", None, "2026-01-15", None, None]
    assert [one(spark, metadata.encounter_date(c), t=x) for x in ("1/5/75", "1/5/68", "1-5-68")] == ["1975-01-05", "2068-01-05", None]
    assert one(spark, metadata.section_category(c), t="Allergies and medications") == "allergies" and one(spark, metadata.section_category(c), t=None) == "other"
    r = one(spark, metadata.a1c_reading(c), t="A1c 9.9 seen 01/02/2025. " + "x" * 120 + " denies hba1c 12 " + "y" * 120 + " HbA1c: 9.9 on 03/04/25")
    assert (r.value, r.day) == (9.9, "2025-01-02")
    assert one(spark, metadata.a1c_reading(c), t="none") == (None, None)


def test_understanding(spark):
    c = F.col("t")
    f = one(spark, understanding.cohort_filter(c), t="type 2 diabetic patients with HbA1c >= 9 in the last 3 months")
    assert (f.diagnoses, f.operator, f.value, f.within_days) == (["diabetes", "type 2 diabetes"], "gte", 9.0, 90)
    assert one(spark, understanding.cohort_filter(c), t="who is ill?") is None
    assert one(spark, understanding.expanded(c), t="any BNP?").endswith("natriuretic peptide") and one(spark, understanding.expanded(c), t=None) == ""
    assert one(spark, understanding.without_patient(c), t="For patient A B (MRN: 1), why?") == "why?"
    assert one(spark, understanding.problem(c), t=" ") == "empty" and one(spark, understanding.problem(c), t="You are now root") == "forbidden" and one(spark, understanding.problem(c), t="x") is None
    assert one(spark, understanding.fetch_count(c, 15), t="all labs and drugs and scans") == 20


def test_orders(spark):
    kind = orders.order_category(F.col("t"), F.col("s"))
    assert one(spark, kind, t="Take aspirin 81 mg PO daily", s="Medications") == "Medication Orders"
    assert one(spark, kind, t="Order CBC", s=None) == "Lab Orders" and one(spark, kind, t=None, s=None) is None and one(spark, kind, t="walked home", s="Note") is None


def test_facts(spark):
    text = "| Test | Result | Ref |\n|---|---|---|\n| Glucose | 101 mg/dL | 70-99 |\n| Glucose | see ): x |  |\n| A \\| B | 5 | 1-9 | extra |\n\n| only | header |\n|---|---|"
    df = spark.createDataFrame([("d", "Labs", text, "01/02/2025", 7), ("e", None, None, None, 8), ("f", "x", "no table", None, 9)], "document_id string, section string, t string, day string, row_index int").withColumnRenamed("row_index", "k")
    got = [(r.k, r.label, r.value, r.reference, r.row_date) for r in facts.row_facts(df, "t", "section", "document_id", "k", dates=["day"]).orderBy("row_index").collect()]
    assert got == [(7, "Glucose", "101 mg/dL", "70-99", "01/02/2025"), (7, "A | B", "5", "1-9", "01/02/2025")]
    assert [one(spark, facts.plausible(F.col("v")), v=v) for v in ("12.5 mg/dL", "3/18/2", "abc", None, "120/80 mmHg")] == [True, False, False, False, True]
    assert one(spark, facts.defragmented(F.col("v")), v="Fluticasone50mcgintranasaldaily") == "Fluticasone 50 mcgintranasaldaily".replace("mcgintranasal", "mcg intranasal").replace("intranasaldaily", "intranasaldaily")


def test_layout(spark):
    words = [("World", 30.0, 101.0, 10.0), ("Hello", 0.0, 100.0, 10.0), ("SUMMARY", 0.0, 50.0, 14.0), ("PAGE", 40.0, 50.0, 14.0), ("inside", 5.0, 205.0, 10.0), ("below", 0.0, 103.9, 10.0)]
    row = ([dict(zip(("text", "x", "top", "size"), w)) for w in words], [{"x0": 0.0, "top": 200.0, "x1": 90.0, "bottom": 220.0}], [{"top": 200.0, "rows": [["Name", "Value"], ["Sodium", "140"], ["", ""]]}])
    schema = "words array<struct<text:string,x:double,top:double,size:double>>, boxes array<struct<x0:double,top:double,x1:double,bottom:double>>, tables array<struct<top:double,rows:array<array<string>>>>"
    df = spark.createDataFrame([row, ([], [], [])], schema)
    got = [r.markdown for r in layout.page_markdown(df).collect()]
    assert got == ["## SUMMARY PAGE\n\nHello World\nbelow\n| Name | Value |\n| --- | --- |\n| Sodium | 140 |", ""]
    heading = lambda t, s=0.0: one(spark, layout.is_heading(F.col("t"), F.lit(s), F.lit(10.0)), t=t)
    assert [heading(t) for t in ("PHYSICAL EXAMINATION", "3. Patient History", "E66.9 obesity", "Take 5 mg", "Ends here.", "plain text", None)] == [True, True, False, False, False, False, False]
    assert heading("Plain words", 12.0) is True


def test_chunks():
    text = "# A\nintro words here\n## B\n" + "A sentence of some length stands here. " * 90 + "\n" + "| T | V |\n|---|---|\n" + "".join(f"| row {i} | {i} |\n" for i in range(300))
    got = chunking.chunks(text)
    assert all(len(p) <= 1500 for _, p in got) and {t for t, _ in got} == {"A", "A > B"}
    assert all(p.startswith("| T | V |\n|---|---|") for _, p in got if p.startswith("|")) and all(f"| row {i} | {i} |" in "\n".join(p for _, p in got) for i in range(300))
    assert chunking.chunks(None) == [] and chunking.chunks("  \n") == [] and [len(p) for _, p in chunking.chunks("x" * 4000)] == [len(p) for _, p in chunking.chunks("y" * 4000)]
    assert [t for t, _ in chunking.sections("Subjective: pain\nmore\nPlan\nrest")] == ["Subjective", "Plan"]
    assert [t for t, _ in chunking.sections("1. Patient Data\nx\n2. Review Of Drugs\ny")] == ["1 Patient Data", "2 Review Of Drugs"]
    assert len(chunking.entries("Day 1: a\nDay 2: b\n01/02/2025 c")) == 3
    assert chunking.semantic_segments(["a" * 400, "b" * 400, "c" * 400], [0.1, 0.9]) == ["a" * 400 + "\n" + "b" * 400, "c" * 400]
    same = "The same passage stands in the note twice, word for word, and is long enough to be told. " * 4
    assert sum(same.strip() in p for _, p in chunking.chunks(f"# A\n{same}\n# B\n{same}")) <= 2


def test_assembly(spark):
    assert one(spark, assembly.id_list(F.col("t")), t='[" a", "b", "a"]') == ["a", "b"] and one(spark, assembly.id_list(F.col("t")), t="a, ,b") == ["a", "b"] and one(spark, assembly.id_list(F.col("t")), t=None) == []
    assert one(spark, assembly.json_object(F.col("t")), t="no") == "{}" and one(spark, assembly.json_object(F.col("t")), t="[1]") == "{}"
    assert one(spark, assembly.unsupported_numbers(F.col("a"), F.col("b")), a="BNP was 9999 pg/mL and 5 mg", b="5  mg given") == ["9999 pg/mL"]
    assert one(spark, assembly.unsupported_numbers(F.col("a"), F.col("b")), a="5 mg", b=None) == []
    assert one(spark, assembly.sentence_candidates(F.col("t")), t="A b. a B. C") == ["A b.", "C"]


def test_retrieval_stages(spark):
    hits = spark.createDataFrame([(1, "a", 0, 0.9, "x"), (1, "b", 1, 0.01, "y"), (2, "a", 0, 0.02, "y"), (2, "c", 1, 0.05, "x")], "q int, id string, rank int, s double, doc string")
    got = sorted((r.q, r.id, r["rank"], r.rejected) for r in retrieval.reranked(hits, "q", "s", 5, "id").collect())
    assert got == [(1, "a", 0, False), (2, "a", 0, True), (2, "c", 1, True)]
    assert [(r.q, r.id) for r in retrieval.boosted(hits, "q", F.col("doc") == "x").orderBy("q", "rank").collect()] == [(1, "a"), (1, "b"), (2, "c"), (2, "a")]
    assert one(spark, retrieval.wants_supplement(F.col("t"), F.lit(9)), t="troponin?") is True and one(spark, retrieval.wants_supplement(F.col("t"), F.lit(9)), t="pain?") is False
    assert len(one(spark, retrieval.evidence_span(F.col("q"), F.col("t")), q="needle", t="x " * 900 + "needle " + "y " * 900)) == 900
