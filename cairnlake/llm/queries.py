"""Queries of the text problems and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnlake.llm import bpe, copies, mixing, pairs, personal, pieces, scans, spans
from cairnlake.session import table


_TEXTS = (("chat_messages", "message_id", "content"), ("chat_requests", "request_id", "message"), ("custom_robert_live_eval_results", "result_id", "reply"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        personal.items(table(spark, sf_dir, src), row_id, text).select(F.lit(src).alias("src"), "row_id", F.explode("items").alias("i")).select("src", "row_id", "i.start_pos", "i.kind")
        for src, row_id, text in _TEXTS
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p2_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with placeholders for its items."""
    parts = [
        personal.items(table(spark, sf_dir, src), row_id, text).select(F.lit(src).alias("src"), "row_id", F.size("items").alias("n_items"), "masked")
        for src, row_id, text in _TEXTS
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        pairs.defects(table(spark, sf_dir, src), "result_id", "question", answer).filter("defect IS NOT NULL").select(F.lit(src).alias("src"), "row_id", "defect")
        for src, answer in (("sample_questions_eval_results", "answer"), ("custom_robert_live_eval_results", "reply"))
    ]
    return parts[0].unionByName(parts[1])


def p3_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``p3_found``, with every defect of a pair."""
    parts = [
        pairs.all_defects(table(spark, sf_dir, src), "result_id", "question", answer).select(F.lit(src).alias("src"), "row_id", "defect")
        for src, answer in (("sample_questions_eval_results", "answer"), ("custom_robert_live_eval_results", "reply"))
    ]
    return parts[0].unionByName(parts[1])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.copies(table(spark, sf_dir, "medications"))


def p4_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a record with the number of its copies."""
    return copies.records(table(spark, sf_dir, "medications")).select("keep_id", "copies")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.found(table(spark, sf_dir, "doc_pages")).select("page_id", "line_no", "kind").distinct()


def p5_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as continuous paragraphs."""
    return scans.repair(table(spark, sf_dir, "doc_pages"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the stitched boundary table that the pieces get their offsets from."""
    s = pieces.sizes(table(spark, sf_dir, "doc_pages"), "page_id", "page_content")
    s = s.filter(F.col("n_chars") > pieces.LIMIT)
    kinds = F.array_compact(F.array(F.lit("long"), F.when(F.col("longest_run") > pieces.LIMIT, F.lit("unbroken"))))
    return s.select("page_id", F.explode(kinds).alias("kind"))


def p7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every page under its section title."""
    pages = table(spark, sf_dir, "doc_pages")
    cut = pieces.split_column(pages, "page_id", "page_content")
    return cut.join(pages.select("page_id", "section_title"), "page_id").select("page_id", "section_title", "start", "piece")


def p7_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of each tenant as text files, cut by byte ranges: whether all are within the limit, their overlaps, and the characters they cover."""
    from cairnlake.llm.staging import staged_texts

    path = staged_texts(table(spark, sf_dir, "doc_pages").filter("page_content IS NOT NULL").select(F.coalesce("tenant_id", F.lit("none")).alias("tenant_id"), "page_content"), "page_files", "tenant_id")
    p = pieces.split_files(spark, path, range_bytes=1 << 15)
    w = Window.partitionBy("path").orderBy("start")
    p = p.select("path", "start", F.length("piece").alias("n"), (F.lag(F.col("start") + F.length("piece")).over(w) - F.col("start")).alias("shared"))
    return p.groupBy(F.regexp_extract("path", "tenant_id=([^/]*)/", 1).alias("tenant_id")).agg(
        (F.max("n") <= pieces.LIMIT).alias("within"), F.min(F.coalesce("shared", F.lit(pieces.OVERLAP))).alias("least_overlap"), F.max(F.coalesce("shared", F.lit(pieces.OVERLAP))).alias("most_overlap"), (F.sum("n") - F.sum(F.coalesce("shared", F.lit(0)))).alias("chars"),
    )


def p7_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page put together again from its pieces, as a digest, and whether each piece is within the limit."""
    cut = pieces.split_column(table(spark, sf_dir, "doc_pages"), "page_id", "page_content").filter("piece <> ''")
    again = cut.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("start", "piece"))).alias("p"), F.max(F.length("piece")).alias("longest"))
    text = F.aggregate("p", F.lit(""), lambda t, x: F.concat(t, F.substring(x["piece"], F.length(t) - x["start"].cast("int") + 1, F.lit(pieces.LIMIT))))
    return again.select("page_id", (F.col("longest") <= pieces.LIMIT).alias("within"), F.sha2(text, 256).alias("digest"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_table(table(spark, sf_dir, "documents"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares reached by the mix."""
    return mixing.shares(p9_mix(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spans.shared_spans(table(spark, sf_dir, "documents"))
    return d.select("doc_id", (F.col("shared_chars") / 100).cast("long").alias("shared_hundreds"))


def p10_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shared stretches of every document with their offsets."""
    return spans.shared_spans(table(spark, sf_dir, "documents")).select("doc_id", "n_chars", "copies", "spans", "repeats")


def p10_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stretches of whole sentences that an earlier document has too."""
    return spans.repeated_units(table(spark, sf_dir, "documents"))


def p10_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeats."""
    return spans.kept(table(spark, sf_dir, "documents"))


_CANON = "lower(regexp_replace(regexp_replace(regexp_replace(coalesce({c}, ''), '([\\p{{N}}])([^\\p{{L}}\\p{{N}}\\s\\p{{Z}}])([\\p{{N}}])', '\\1\x02\\2\x02\\3', 'g'), '([\\p{{N}}])([^\\p{{L}}\\p{{N}}\\s\\p{{Z}}\x02])([\\p{{N}}])', '\\1\x02\\2\x02\\3', 'g'), '\x02([^\x02])\x02|[^\\p{{L}}\\p{{N}}]', '\\1', 'g'))"
_P4 = f"SELECT med_id, min(med_id) OVER w AS keep_id, count(*) OVER w AS copies FROM medications WINDOW w AS (PARTITION BY coalesce(document_id, '#' || med_id), list_sort([{', '.join(_CANON.format(c=c) for c in copies.FIELDS)}]))"

QUERIES = {
    "p2_found": p2_found, "p2_masked": p2_masked, "p3_found": p3_found, "p3_all": p3_all, "p4_found": p4_found, "p4_records": p4_records, "p5_found": p5_found, "p5_repaired": p5_repaired, "p7_found": p7_found, "p7_pieces": p7_pieces, "p7_files": p7_files, "p7_rebuilt": p7_rebuilt, "p8_ids": p8_ids,
    "p9_mix": p9_mix, "p9_shares": p9_shares, "p10_found": p10_found, "p10_spans": p10_spans, "p10_kept": p10_kept, "p10_units": p10_units,
}
ORACLES = {
    "p4_found": f"SELECT keep_id, med_id AS copy_id FROM ({_P4}) WHERE med_id <> keep_id",
    "p4_records": f"SELECT keep_id, any_value(copies) AS copies FROM ({_P4}) GROUP BY keep_id",
    "p7_found": "SELECT page_id, 'long' AS kind FROM doc_pages WHERE length(page_content) > 1000 UNION ALL SELECT page_id, 'unbroken' AS kind FROM doc_pages WHERE len(list_filter(string_split_regex(page_content, '[\\s\\p{Z}\\x1c-\\x1f\\x85]'), lambda x: length(x) > 1000)) > 0",
    "p10_units": """WITH p AS (SELECT doc_id, regexp_extract_all(text, '[^.!?\\n]+[.!?\\n]*|[.!?\\n]+') AS p FROM documents WHERE length(text) >= 200),
      u AS (SELECT doc_id, unnest(p) AS s, generate_subscripts(p, 1) AS i FROM p), o AS (SELECT doc_id, i, sum(length(s)) OVER (PARTITION BY doc_id ORDER BY i) AS z, length(s) AS n, trim(regexp_replace(lower(s), '[\\s\\p{Z}\\x1c-\\x1f\\x85]+', ' ', 'g')) AS k FROM u),
      f AS (SELECT k, min(doc_id) AS first FROM o GROUP BY k HAVING min(doc_id) <> max(doc_id)), l AS (SELECT doc_id, z - n AS a, z, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM o JOIN f USING (k) WHERE doc_id <> first)
      SELECT doc_id, CAST(min(a) AS INT) AS start_pos, CAST(max(z) AS INT) AS end_pos FROM l GROUP BY doc_id, run HAVING max(z) - min(a) >= 200""",
    # pieces overlap by 200 and are within 1,000; together they are the whole files (a line feed behind each page)
    "p7_files": "SELECT coalesce(tenant_id, 'none') AS tenant_id, true AS within, 200 AS least_overlap, 200 AS most_overlap, sum(length(page_content) + 1) AS chars FROM doc_pages WHERE page_content IS NOT NULL GROUP BY 1",
    "p7_rebuilt": "SELECT page_id, sha256(page_content) AS digest, true AS within FROM doc_pages WHERE page_content <> ''",
}
