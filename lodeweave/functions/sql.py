"""The engine's functions by name in SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..operators.extract import ROW, extract_text

#: extract_evidence() returns what extract_files() finds, but for the file, which the query has.
FOUND = ROW.removeprefix("repository_id string, path string, ")
_NAMES = [c.split()[0] for c in FOUND.split(", ")]


class _ExtractEvidence:
    def eval(self, path: str, content: str) -> Iterator[tuple]:
        for row in extract_text(path or "", content or "").rows():
            yield tuple(row.get(n) for n in _NAMES)


def register(spark: SparkSession) -> None:
    """extract_evidence(path, content): a table function; `from files, lateral extract_evidence(path, content)`."""
    spark.udtf.register("extract_evidence", udtf(_ExtractEvidence, returnType=FOUND))
