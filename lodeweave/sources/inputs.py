"""Requirement inputs (text, HTML, JSON, DOCX, images) as facts."""

from __future__ import annotations

import html
import io
import json
import os
import re
import shutil
import subprocess
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import FACTS

MOST_BYTES = 20 << 20
IMAGES = {".png", ".jpg", ".jpeg", ".webp"}
# Patterns of paths, field names and tags.
PATH = r"/(?:[A-Za-z0-9._-]+/?)+"
FIELD = r"""(?i)(?:name|id)\s*=\s*["']([A-Za-z_][A-Za-z0-9_]*)["']"""
TAG = r"<[^>]+>"
PATH_KEYS = {"route", "path", "url"}


def text_facts(rows: DataFrame, text_col: str, source_col: str) -> DataFrame:
    """(kind, value, source_path, line, confidence): paths, and the lines without any, once a source each."""
    paths = rows.select(F.col(source_col).alias("source_path"), F.explode(F.regexp_extract_all(text_col, F.lit(f"({PATH})"), 1)).alias("value"))
    paths = paths.select(F.lit("api_path").alias("kind"), "value", "source_path", F.lit(0).alias("line"), F.lit("certain").alias("confidence"))
    lines = rows.select(F.col(source_col).alias("source_path"), F.posexplode(F.split(text_col, "\n")).alias("line", "value"))
    lines = lines.select(F.lit("business_term").alias("kind"), F.trim("value").alias("value"), "source_path", (F.col("line") + 1).alias("line"), F.lit("probable").alias("confidence"))
    lines = lines.filter((F.col("value") != "") & ~F.col("value").rlike(PATH))
    both = paths.unionByName(lines)
    return both.groupBy("kind", "value", "source_path").agg(F.min("line").alias("line"), F.first("confidence").alias("confidence"))


def documents_facts(rows: DataFrame, name_col: str, data_col: str) -> DataFrame:
    """Facts of many documents (a name whose ending tells the kind, and its text or bytes): the reading that parse_inputs()
    does of one, in partitions; each fact once a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple, None] = {}
            for name, data in zip(*[batch.column(i).to_pylist() for i in (0, 1)]):
                found |= dict.fromkeys(document_facts(name or "", data or b"")[0])
            columns = list(zip(*found)) or [[]] * 5
            kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["kind", "value", "source_path", "line", "confidence"])

    named = rows.select(F.col(name_col).alias("name"), F.col(data_col).cast("binary").alias("data"))
    return named.mapInArrow(run, FACTS).dropDuplicates(["kind", "value", "source_path"])


def link_paths(rows: DataFrame, html_col: str, id_col: str) -> DataFrame:
    """(id, path): the local paths that a page's links lead to, as often as they are there."""
    return rows.select(F.col(id_col), F.explode(F.regexp_extract_all(html_col, F.lit(r'href="(/[^"?#]*)'), 1)).alias("path"))


def _plain(text: str, source: str) -> list[tuple]:
    found = [("api_path", m, source, 0, "certain") for m in re.findall(PATH, text)]
    for number, line in enumerate(text.split("\n"), 1):
        line = line.strip()
        if line and not re.search(PATH, line):
            found.append(("business_term", line, source, number, "probable"))
    return found


def _visit(value, source: str) -> list[tuple]:
    if isinstance(value, dict):
        found = []
        for key in sorted(value):
            if key not in PATH_KEYS:
                found.append(("field", key, source, 0, "certain"))
            found += _visit(value[key], source)
        return found
    if isinstance(value, list):
        return [fact for child in value for fact in _visit(child, source)]
    return _plain(value, source) if isinstance(value, str) else []


def _docx(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        if "word/document.xml" not in archive.namelist():
            raise ValueError("docx has no word/document.xml")
        root = ElementTree.fromstring(archive.read("word/document.xml"))
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    return "\n".join("".join(t.text or "" for t in p.iter(f"{space}t")) for p in root.iter(f"{space}p"))


def document_facts(name: str, data: bytes) -> tuple[list[tuple], list[str]]:
    """Facts and diagnostics of one input file."""
    if len(data) > MOST_BYTES:
        raise ValueError(f"input is larger than {MOST_BYTES} bytes: {name}")
    kind = os.path.splitext(name)[1].lower()
    if kind in IMAGES:
        if not shutil.which("tesseract"):
            return [], ["ocr_unavailable"]
        done = subprocess.run(["tesseract", name, "stdout"], capture_output=True, text=True)
        return ([], ["ocr_failed"]) if done.returncode else (_plain(done.stdout, name), [])
    if kind == ".docx":
        return _plain(_docx(data), name), []
    text = data.decode("utf-8", "replace")
    if kind == ".json":
        try:
            return _visit(json.loads(text), name), []
        except ValueError:
            return _plain(text, name), []
    if kind in (".html", ".htm"):
        fields = [("field", m, name, 0, "certain") for m in re.findall(FIELD, text)]
        paths = [("api_path", m, name, 0, "certain") for m in re.findall(r"""(?i)(?:action|href)\s*=\s*["'](/[^"'?#]*)""", text)]
        return [*fields, *paths, *_plain(html.unescape(re.sub(TAG, "\n", text)), name)], []
    return _plain(text, name), []


def parse_inputs(spark: SparkSession, text: str = "", paths: list[str] = (), source_ref: str = "text") -> tuple[DataFrame, list[dict]]:
    """Facts of a text and of local files, the first of each (kind, value, source), in order; and diagnostics."""
    found, told = _plain(text, source_ref), []
    for path in paths:
        if not os.path.isfile(path):
            raise ValueError(f"not a regular file: {path}")
        with open(path, "rb") as opened:
            facts, problems = document_facts(path, opened.read(MOST_BYTES + 1))
        found += facts
        told += [{"message": p, "source_path": path, "confidence": "unresolved"} for p in problems]
    once = list({(f[0], f[1], f[2]): f for f in reversed(found)}.values())[::-1]
    return spark.createDataFrame(once, FACTS), told


def input_digest(values: list[str]):
    import hashlib

    return hashlib.sha256("\n".join(values).encode()).hexdigest()
