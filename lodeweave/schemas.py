"""Schemas of the evidence tables and of results."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Of the tables below and of the graph stored with them; older snapshots are made anew.
SCHEMA_VERSION = 14

FILES = "repository_id string, path string, content_hash string, content string"
REPOSITORIES = "repository_id string, baseline_branch string, baseline_commit string, baseline_state string, indexed_at string"
SYMBOLS = "repository_id string, path string, name string, kind string, line int, uid string, signature string, end_line int"
EDGES = (
    "repository_id string, path string, source string, target string, kind string, line int, confidence string, "
    "source_signature string, target_arity int"
)
CONTRACTS = (
    "repository_id string, path string, kind string, role string, service string, contract_key string, symbol string, "
    "signature string, line int, confidence string, reason string, broker string"
)
DIAGNOSTICS = "repository_id string, path string, message string, line int, confidence string"
REPORTS = "id string, created_at string, baseline_snapshot string, input_digest string, report_json string"
FEEDBACK = (
    "revision long, id string, report_id string, subject_kind string, subject_key string, decision string, note string, created_at string"
)
FACTS = "kind string, value string, source_path string, line int, confidence string"
EVIDENCE = (
    "repository string, file string, line int, name string, kind string, confidence string, id string, signature string, "
    "end_line int, source string, target string, score double, reason string, match_sources array<string>"
)

TABLES = {
    "files": FILES,
    "repositories": REPOSITORIES,
    "symbols": SYMBOLS,
    "edges": EDGES,
    "contracts": CONTRACTS,
    "diagnostics": DIAGNOSTICS,
}


@dataclass(frozen=True)
class Evidence:
    """The tables of one immutable snapshot."""

    files: DataFrame
    symbols: DataFrame
    edges: DataFrame
    contracts: DataFrame
    diagnostics: DataFrame
    repositories: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self.symbols.sparkSession

    def within(self, repository: str) -> Evidence:
        """Every table of one repository; the filter reaches the scans."""
        mine = F.col("repository_id") == repository
        return replace(self, **{t: getattr(self, t).filter(mine) for t in ("files", "symbols", "edges", "contracts", "diagnostics")})


def evidence(spark: SparkSession, **tables: DataFrame) -> Evidence:
    """An Evidence whose missing tables are empty and whose missing columns are null."""
    made = {}
    for name, schema in TABLES.items():
        empty = spark.createDataFrame([], schema).filter(F.lit(False))  # known to be empty before it is run
        given = tables.get(name)
        made[name] = empty if given is None else empty.unionByName(given, allowMissingColumns=True).select(*empty.columns)
    symbols = made["symbols"]
    made["symbols"] = symbols.withColumns(
        {
            "signature": F.coalesce("signature", F.lit("")),
            "end_line": F.coalesce("end_line", F.lit(0)),
            "line": F.coalesce("line", F.lit(0)),
        }
    ).withColumn("uid", F.when(F.coalesce("uid", F.lit("")) == "", symbol_id("repository_id", "path", "name", "signature")).otherwise(F.col("uid")))
    return Evidence(**made)


def symbol_id(repository, path, name, signature):
    """Identity of a symbol: its line is left out, so that edits above it do not matter."""
    parts = [F.col(x) if isinstance(x, str) else x for x in (repository, path, name, signature)]
    return F.concat(F.lit("sym:"), F.sha2(F.concat_ws("\u0000", *parts), 256))
