"""Results of a problem cover every table it names."""

from cairnlake.llm import queries
from cairnlake.plans import registry

from conftest import SMALL


def _counts(spark, *names):
    return {n: spark.read.parquet(f"{SMALL}/{n}.parquet").count() for n in names}


def test_masked_texts_of_every_table(spark):
    got = {r.src: r["count"] for r in queries.p2_masked(spark, SMALL).groupBy("src").count().collect()}
    assert got == _counts(spark, "chat_messages", "chat_requests", "custom_robert_live_eval_results")


def test_instants_of_every_table(spark):
    d = registry.QUERIES["p1_normalised"](spark, SMALL)
    assert {r.src: r["count"] for r in d.groupBy("src").count().collect()} == _counts(spark, "doc_pages", "usage_records")
    found = registry.QUERIES["p1_found"](spark, SMALL)
    assert sorted(d.filter("utc_us IS NOT NULL AND NOT canonical").select("src", "row_id", "utc_us").collect()) == sorted(found.collect())
