"""Orders in clinical text: their category by evidence, and lists of them by category.

Defined results: a null text or section counts as empty; a text without
enough evidence of one category has none; ties go to the first category.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Evidence of orders, on text in capitals.
DOSE = r"\b\d+(\.\d+)?\s*(MG|MCG|G)\b|\b\d+(\.\d+)?\s*(MILLIGRAMS|MICROGRAMS|GRAMS)\b"
ROUTE = r"\b(PO|IV|IM|SC|SUBCUTANEOUS|INTRAVENOUS|INTRAMUSCULAR|ORAL|SL|TOPICAL|INHALED|INHAL)\b"
FREQUENCY = r"\b(QD|QAM|QPM|BID|TID|QID|QHS|Q4H|Q6H|Q8H|PRN|DAILY|TWICE DAILY|THREE TIMES DAILY|FOUR TIMES DAILY)\b"
LAB = r"\b(CBC|BMP|CMP|A1C|HEMOGLOBIN\s*A1C|GLUCOSE|CREATININE|BNP|TROPONIN|PT|INR|PTT|PLATELET|WBC|HGB|HBA1C|MICROALBUMIN)\b"
LAB_UNIT = r"\b(MG/DL|MMOL/L|PG/ML|UIU/ML|K/UL|IU/L|MEQ/L|G/DL|NG/ML|UL|%|ML)\b"
PROCEDURE = r"\b(CT|MRI|ULTRASOUND|X-?RAY|ECHOCARDIOGRAM|CATHETERIZATION|CATH|THORACENTESIS|ENDOSCOPY|BIOPSY|PROCEDURE)\b"
DISCHARGE = r"\b(DISCHARGE|DISPOSITION|FOLLOW[- ]?UP|RETURN TO|HOME HEALTH|FOLLOW UP|APPOINTMENT|CARE DIRECTIVE|DISCHARGE MEDICATIONS)\b"
CODING = r"\b(CPT|LOINC|RXNORM|SNOMED)\b"
CODE = r"\b\d{4,6}\b"
MEDICATION = r"\b(RX|SIG|PRESCRIBE|PRESCRIPTION|MEDICATION|MEDICATIONS|DISCHARGE MEDICATIONS)\b"
REFERRAL = r"\b(REFERRAL|CONSULT|CONSULTATION)\b"
SPECIALTY = r"\b(CARDIOLOGY|NEPHROLOGY|ONCOLOGY|PULMON|GASTRO|ENDOCRIN|UROLOGY|NEURO)\b"
DIRECTIVE = r"\b(NO CHANGE|AVOID|MONITOR|INSTRUCTIONS|RETURN PRECAUTIONS|WOUND CARE|DIET|ACTIVITY|WEIGHT)\b"
SECTION = r"MED|RX|PRESCR|CURRENT|DISCONT"
CATEGORIES = ("Medication Orders", "Lab Orders", "Procedure Orders", "Referrals/Consults", "Discharge Prescriptions/Disposition", "Care Directives/Follow-up")


def order_scores(text: Column, section: Column) -> list[Column]:
    """Evidence of each of ``CATEGORIES``."""
    u, s = F.upper(F.coalesce(text, F.lit(""))), F.upper(F.coalesce(section, F.lit("")))
    has = lambda p: u.rlike(p)
    n = lambda c, k=1: F.when(c, k).otherwise(0)
    coded = has(CODING)
    return [
        n(s.rlike(SECTION)) + n(has(MEDICATION), 2) + n(has(DOSE), 2) + n(has(ROUTE)) + n(has(FREQUENCY)) + n(has(CODE) & coded),
        n(has(LAB), 3) + n(has(LAB_UNIT) & (has(LAB) | has(r"\bLAB\b")), 2) + n(coded),
        n(has(PROCEDURE), 3) + n(coded) + n(has(CODE) & has("CPT|LOINC")),
        n(has(REFERRAL), 3) + n(has(DISCHARGE) & has(SPECIALTY)) + n(coded),
        n(has(DISCHARGE), 3) + n(has(DOSE) & has(r"\b(DISCHARGE|DISPOSITION)\b"), 2),
        n(has(DIRECTIVE), 2) + n(has(DISCHARGE)),
    ]


def order_category(text: Column, section: Column) -> Column:
    """The category with most evidence, if there is enough of it."""
    u = F.upper(F.coalesce(text, F.lit("")))
    scores = F.array(*order_scores(text, section))
    best = F.array_max(scores)
    k = F.array_position(scores, best)
    enough = F.when(k == 1, (best >= 4) | (u.rlike(DOSE) & (u.rlike(ROUTE) | u.rlike(FREQUENCY)))).when(k == 6, best >= 2).otherwise(best >= 3)
    return F.when((best > 0) & enough, F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), k.cast("int")))


def orders(df: DataFrame, text: str, section: str, *keep: str) -> DataFrame:
    """Texts that hold orders with their category and its rank, for a list by category, page and chunk."""
    d = df.select(*keep, order_category(F.col(text), F.col(section)).alias("category")).filter("category IS NOT NULL")
    return d.withColumn("priority", F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), F.col("category")).cast("int"))
