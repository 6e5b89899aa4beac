"""Events of all five families."""

from pyspark.sql import functions as F

from cairnlake.operators import events


def test_families(spark):
    cases = [
        ("Started Metformin 500 mg", "", "note", [("medication_change", "started", "Metformin", "500 mg")]),
        ("Discontinued Lisinopril 10 mg", "", "note", [("medication_change", "stopped", "Lisinopril", "10 mg")]),
        ("Increased Warfarin from 2 mg to 5 mg", "", "note", [("medication_change", "changed", "Warfarin", "5 mg")]),
        ("Referred for physical therapy", "", "note", [("treatment_action", "initiated", "", "")]),
        ("Blood pressure today 130/80", "", "note", [("measurement", "documented", "", "")]),
        ("| Blood pressure today | 130/80 |\n|---|---|\n| Stopped Aspirin | 81mg daily |", "", "note", [("medication_change", "stopped", "Aspirin", "81 mg")]),
        ("Previously started Metformin 500 mg", "", "note", []), ("Previously started Metformin 500 mg", "Plan", "note", [("medication_change", "started", "Metformin", "500 mg")]),
        ("Started Metformin 500 mg", "", "billing", []), ("Started Metformin 500 mg", "Patient information", "note", []), (None, "", "note", []),
        ("\n".join(f"glucose level was {i} again" for i in range(12)) + "\nglucose level was 3 again", "", "note", [("measurement", "documented", "", "")] * 12),
    ]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "id int, t string, s string, k string")
    got = {}
    for r in events.clinical_events(df, "id", "t", F.col("s"), F.col("k")).orderBy("id", "event_no").collect():
        got.setdefault(r.id, []).append((r.event_type, r.action, r.medication, r.value))
    for i, c in enumerate(cases):
        assert got.get(i, []) == c[3], c[0]
