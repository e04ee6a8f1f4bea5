"""Document sources and sinks: files to text by kind, uploads, gazetteers, glossary files, latest versions."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Limits of uploads.
MAX_BYTES = 10 * 1024 * 1024
EXTENSIONS = ("txt", "pdf", "docx", "png", "jpg", "jpeg")

Extractor = Callable[[bytes], str]
_EXTRACTORS: dict[str, Extractor] = {}


def register_extractor(extension: str, extractor: Extractor) -> None:
    """Add a function of a file's bytes that returns its text, for example one that needs a library for PDF or OCR."""
    _EXTRACTORS[extension.lower()] = extractor


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def decoded(content: Column) -> Column:
    """Text of bytes: UTF-8 without byte order mark where valid, else Latin-1, which reads any bytes."""
    body = F.when(F.hex(F.substring(content, 1, 3)) == "EFBBBF", F.substring(content, F.lit(4), F.length(content))).otherwise(content)
    # Invalid bytes would fail the UTF-8 decoder, so only valid ones reach it.
    return F.when(F.is_valid_utf8(body.cast("string")), body.cast("string")).otherwise(F.decode(body, "iso-8859-1"))


def docx_text(content: bytes) -> str:
    """Paragraphs and table rows of a DOCX file, in order."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{w}body")
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{w}t"))
    out = []
    for e in body:
        if e.tag == f"{w}p":
            out.append(text(e))
        elif e.tag == f"{w}tbl":
            out += [" | ".join(text(cell) for cell in row.iter(f"{w}tc")) for row in e.iter(f"{w}tr")]
    return "\n".join(x for x in out if x.strip())


register_extractor("docx", docx_text)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """path, ext, text, error of all files under a path; plain text stays in the JVM, others go to their extractor."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", extension(F.col("path")).alias("ext"), "length", "content")
    plain = files.filter(~F.col("ext").isin(*sorted({*_EXTRACTORS, "pdf", "png", "jpg", "jpeg"}))).select("path", "ext", decoded(F.col("content")).alias("text"), F.lit(None).cast("string").alias("error"))
    extractors = dict(_EXTRACTORS)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts, errors = [], []
            for ext, content in zip(part["ext"], part["content"]):
                try:
                    texts.append(extractors[ext](content))
                    errors.append(None)
                except KeyError:
                    texts.append(None)
                    errors.append(f"no extractor for {ext}")
                except Exception as x:  # a broken file is a row of its own, not the end of the job
                    texts.append(None)
                    errors.append(f"{type(x).__name__}: {x}")
            yield pd.DataFrame({"path": part["path"], "ext": part["ext"], "text": texts, "error": errors})

    others = files.filter(F.col("ext").isin(*sorted({*_EXTRACTORS, "pdf", "png", "jpg", "jpeg"}))).select("path", "ext", "content")
    return plain.unionByName(others.mapInPandas(run, "path string, ext string, text string, error string"))


def upload_verdict(name: Column, size: Column, text: Column) -> Column:
    """Why an upload is refused, or ok."""
    return F.when(~extension(name).isin(*EXTENSIONS), "unsupported").when(size > MAX_BYTES, "too large").when((size <= 0) | (F.length(F.trim(text)) == 0), "empty").otherwise("ok")


def latest(rows: DataFrame, keys: list[str], version: list[Column]) -> DataFrame:
    """Upsert as union and latest version wins."""
    w = Window.partitionBy(*keys).orderBy(*[v.desc() for v in version])
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def names_long(wide: DataFrame, key: str, decades: list[str]) -> DataFrame:
    """A wide gazetteer (a column for each decade) as rows of name, decade, frequency."""
    return wide.unpivot([key], decades, "decade", "frequency").filter("frequency > 0")


def municipalities(rows: DataFrame) -> DataFrame:
    """Postal codes of five digits with their municipalities, sorted and distinct."""
    return rows.groupBy(F.lpad(F.col("postal").cast("string"), 5, "0").alias("postal")).agg(F.array_sort(F.collect_set("name")).alias("names"))


def write_glossary(entries: DataFrame, path: str, form: str = "csv") -> None:
    """Four columns as CSV with a header, or one JSON object a line."""
    rows = entries.select("original", "alias", "category", "occurrences")
    rows.write.option("header", "true").option("quoteAll", "true").option("escape", '"').csv(path) if form == "csv" else rows.write.json(path)
