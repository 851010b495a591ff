"""Extraction: a file's text gives symbols, relations, contracts and diagnostics.

Grammars that one pattern covers run natively (native.py); Java, mapper XML and
nested configuration are read by small parsers, in partitions (extract_files).
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import config, java, markup
from .rows import Found

ROW = (
    "repository_id string, path string, table string, name string, kind string, line int, end_line int, signature string, source string, target string, "
    "confidence string, source_signature string, target_arity int, role string, service string, symbol string, reason string, broker string"
)
_COLUMNS = [(name, pa.int32() if kind == "int" else pa.string()) for name, kind in (c.split() for c in ROW.split(", "))]


def extract_text(path: str, text: str) -> Found:
    """Dispatch by file name."""
    name = os.path.basename(path).lower()
    kind = os.path.splitext(name)[1]
    if name == "pom.xml":
        return markup.maven(text)
    if kind == ".xml":
        return markup.mapper(text)
    if kind == ".java":
        return java.extract(text)
    return config.extract(path, text)


def extract_files(files: DataFrame, folder: str | None = None) -> dict[str, DataFrame]:
    """symbols, edges, contracts and diagnostics of files (repository_id, path, content).

    folder: where to keep what is found, so that each file is read once for all four; without it each is read for the
    tables that are used.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for repository, path, content in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                for row in extract_text(path or "", content or "").rows():
                    rows.append({"repository_id": repository, "path": path} | row)
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in _COLUMNS], names=[n for n, _ in _COLUMNS])

    found = files.select("repository_id", "path", "content").mapInArrow(run, ROW)
    if folder:
        found.write.partitionBy("table").parquet(folder)
        found = files.sparkSession.read.schema(ROW).parquet(folder)
    return {
        "symbols": found.filter("table = 'symbol'").select("repository_id", "path", "name", "kind", "line", "signature", "end_line"),
        "edges": found.filter("table = 'edge'").select("repository_id", "path", "source", "target", "kind", "line", "confidence", "source_signature", "target_arity"),
        "contracts": found.filter("table = 'contract'").select(
            "repository_id", "path", "kind", "role", "service", F.col("target").alias("contract_key"), "symbol", "signature", "line", "confidence", "reason", "broker"
        ),
        "diagnostics": found.filter("table = 'diagnostic'").select("repository_id", "path", F.col("reason").alias("message"), "line", "confidence"),
    }
