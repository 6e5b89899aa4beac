"""Claims without a source, by every pattern."""

from pyspark.sql import functions as F

from cairnlake.operators import documents


def test_every_claim_is_found(spark):
    cases = [
        ("Murxemab was kept at 20 mg", "medication/dose value"), ("Glucose 180 mg/dL", "medication/dose value"), ("Saturated at 97%.", "lab value"), ("ferritin was 80 ng/mL", "lab value"), ("BP 120/80", "blood pressure"),
        ("it read 130/85 mmHg", "blood pressure"), ("a pulse of 88", "heart rate"), ("Heart rate was 92", "heart rate"), ("SpO2 of 93", "oxygen saturation"), ("temperature of 38 degrees", "temperature"),
        ("weight 70 kg", "weight"), ("HbA1c 7", "HbA1c value"), ("kept at 20 mg [S2, chart]", ""), ("kept at 20 mg [S2].", ""), ("seen on 2024", ""), (None, ""), ("12 mg. 5 µg [S1]. HR 70\nweight 3 lbs", "medication/dose value; heart rate; weight"),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "id int, t string")
    got = {r.id: r for r in documents.claims(df, "id", "t", F.lit(9)).collect()}
    for i, (t, want) in enumerate(cases):
        assert got[i].labels == want, t
        assert got[i].grounded == (want == "")
    assert got[12].n_cited == 1 and got[12].max_source == 2
