"""Record numbers and encounter dates by all labels, anywhere in a text."""

from cairnlake.operators import documents


def test_record_keys(spark):
    far = "x " * 2000
    cases = [
        ("Medical Record Number: 123456", "123456", None), ("Med Rec No.: ABC-12345", "ABC-12345", None), ("Record Number: 7890", "7890", None), ("MRN is MRN-2026-004782", "MRN-2026-004782", None), ("MR#: 123456", "123456", None),
        ("MRN | A123456", "A123456", None), ("see MRN-2026-0047", "MRN-2026-0047", None), ("MRN: 12", None, None), (far + "MRN: 987654", "987654", None), (far + "see MRN-2026-0047 here", "MRN-2026-0047", None),
        ("record no. 5566 " + far + " MRN: 987654", "5566", None), ("Admission Date: 01/15/2026", None, "01/15/2026"), ("Date of Service: 1-5-26", None, "1-5-26"), ("a\nDate: 02/03/2025", None, "02/03/2025"),
        ("seen 02/03/2025", None, None), (far + "Visit date: 3/4/2024", None, "3/4/2024"), ("visit date: 3/4/2024 " + far + "admit date: 5/6/2024", None, "3/4/2024"), (None, None, None),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "id int, t string")
    got = {r.id: (r.mrn, r.encounter_date) for r in documents.record_keys(df, "id", "t").collect()}
    for i, (t, mrn, day) in enumerate(cases):
        assert got[i] == (mrn, day), t
