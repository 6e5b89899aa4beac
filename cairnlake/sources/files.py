"""File sources and sinks: documents of several formats, logs, histories."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = ("pdf", "docx", "png", "jpg", "jpeg", "tiff", "tif", "bmp", "txt", "md", "html")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, extension, length, content) of the files below a folder; content is read only where used."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return d.select("path", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("extension"), "length", "modificationTime", "content")


def checked(d: DataFrame, most_bytes: int = 50 << 20) -> DataFrame:
    """``problem`` of each file: unsupported, empty, too_large or null."""
    return d.withColumn("problem", F.when(~F.col("extension").isin(*EXTENSIONS), "unsupported").when(F.col("length") == 0, "empty").when(F.col("length") > most_bytes, "too_large"))


def docx_markdown(data: bytes) -> str:
    """Paragraphs (headings marked), then tables as pipe rows."""
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    body, out = root.find(f"{_W}body"), []
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
    for p in body.findall(f"{_W}p"):
        style = p.find(f"{_W}pPr/{_W}pStyle")
        name = style.get(f"{_W}val", "") if style is not None else ""
        level = re.fullmatch(r"[Hh]eading\s?([1-4])", name)
        if s := text(p).strip():
            out.append(("#" * int(level[1]) + " " if level else "# " if name == "Title" else "") + s)
    for t in body.findall(f"{_W}tbl"):
        rows = [[text(c).strip().replace("|", "\\|") for c in r.findall(f"{_W}tc")] for r in t.findall(f"{_W}tr")]
        if rows:
            out.append("\n".join(["| " + " | ".join(rows[0]) + " |", "|" + "---|" * len(rows[0]), *("| " + " | ".join(r) + " |" for r in rows[1:])]))
    return "\n\n".join(out)


def html_markdown(data: bytes) -> str:
    """Headings, list items and paragraphs of simple HTML."""
    s = data.decode("utf-8", "replace")
    s = re.sub(r"(?is)<(script|style).*?</\1>", "", s)
    s = re.sub(r"(?i)<h([1-4])[^>]*>", lambda m: "\n" + "#" * int(m[1]) + " ", s)
    s = re.sub(r"(?i)<li[^>]*>", "\n- ", s)
    s = re.sub(r"(?i)</?(p|div|br|tr|h[1-4]|ul|ol)[^>]*>", "\n", s)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", re.sub(r"<[^>]+>", "", s))).strip()


def pages(d: DataFrame, parsers: dict[str, Callable[[bytes], list[str]]] | None = None) -> DataFrame:
    """(path, page_number, markdown); formats without a parser here (scans) need one given."""
    known: dict[str, Callable[[bytes], list[str]]] = {
        "txt": lambda b: b.decode("utf-8", "replace").split("\f"), "md": lambda b: [b.decode("utf-8", "replace")], "docx": lambda b: [docx_markdown(b)], "html": lambda b: [html_markdown(b)],
    } | (parsers or {})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(r.path, i + 1, text) for r in b.itertuples() if r.extension in known for i, text in enumerate(known[r.extension](bytes(r.content)))]
            yield pd.DataFrame(rows, columns=["path", "page_number", "markdown"])

    return d.select("path", "extension", "content").mapInPandas(run, "path string, page_number int, markdown string")


def needs_reading(d: DataFrame, least: float = 50.0) -> DataFrame:
    """Files whose pages hold too few characters on average and need recognition."""
    return d.groupBy("path").agg(F.avg(F.length(F.trim("markdown"))).alias("mean_chars")).withColumn("needs_reading", F.col("mean_chars") < least)


def history(spark: SparkSession, path: str) -> DataFrame:
    """Daily CSV logs of (thread_id, timestamp, user_query, response); the day comes from the file's name."""
    d = spark.read.schema("thread_id string, timestamp string, user_query string, response string").option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    return d.withColumn("day", F.regexp_extract(F.input_file_name(), r"(\d{4}-\d{2}-\d{2})", 1))


def write_history(d: DataFrame, path: str) -> None:
    d.write.mode("append").option("header", "true").option("escape", '"').csv(path)


def registry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def replace_where_absent(spark: SparkSession, table_path: str, keys: DataFrame, on: str, target: str) -> DataFrame:
    """Delete by key: the rest of a table is written to ``target``."""
    rest = spark.read.parquet(table_path).join(keys, on, "left_anti")
    rest.write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)
