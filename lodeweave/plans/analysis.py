"""Composite analyses: requirement, change, report, feedback rules."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import identifiers as fn
from ..operators import context as X
from ..operators import graph as G
from ..operators import search as S
from ..operators.ranking import first_of_key, merge_coverage, top_per_key
from ..schemas import Evidence
from ..staging import stage

# Limits and kinds.
MOST_KEYWORDS, MOST_EVIDENCE, MOST_TRACES = 64, 200, 8
ENTRY_KINDS = ["controller_method", "route", "mapper_statement"]
CHANGE_KINDS = [*ENTRY_KINDS, "service_method", "application_method", "calls", "queries_table"]
TRACED_KINDS = ["controller_method", "mapper_statement"]
RISK_TABLE, RISK_REPOSITORIES, ASK_EVIDENCE = "table_migration_and_rollback", "contracts_and_release_order", "no_verifiable_evidence"


def keyword_rows(texts: DataFrame, id_col: str, text_col: str, most: int = MOST_KEYWORDS) -> DataFrame:
    """(id, keyword_no from 0, keyword): each once whatever its case, in order of appearance, then cut to `most`."""
    rows = texts.select(id_col, F.posexplode(fn.keywords(F.coalesce(F.col(text_col), F.lit("")))).alias("pos", "keyword"))
    once = first_of_key(rows.withColumn("_key", F.lower("keyword")), [id_col, "_key"], ["pos"]).drop("_key")
    top = top_per_key(once, [id_col], [F.col("pos")], most)
    return top.select(id_col, (F.col("rank_no") - 1).cast("int").alias("keyword_no"), "keyword")


def requirement_evidence(found: Evidence, keywords: list[str], limit: int = MOST_EVIDENCE) -> tuple[DataFrame, DataFrame]:
    """(evidence with rank_no, coverage by query): scores summed over all keywords, one search for all of them."""
    top, coverage = S.ranked_search(found, S.queries_frame(found.spark, keywords), limit=S.DEFAULT_LIMIT)
    rest = F.struct("query_no", "confidence", "id", "signature", "end_line", "source", "target", "reason")
    summed = top.groupBy("repository", "file", "line", "name", "kind").agg(F.sum("score").alias("score"), F.min(rest).alias("first"))
    order = [F.col("score").desc(), F.concat_ws("/", "repository", "file", F.col("line").cast("string"), "kind", "name")]
    ranked = summed.orderBy(*order).limit(limit)
    ranked = ranked.withColumn("rank_no", F.row_number().over(Window.orderBy(*order)))  # `limit` rows
    return ranked.select("rank_no", "repository", "file", "line", "name", "kind", "score", *[F.col(f"first.{c}").alias(c) for c in ("confidence", "id", "signature", "end_line", "source", "target", "reason")]), coverage


def repository_candidates(evidence: DataFrame) -> DataFrame:
    """Repositories by the sum over files of the best score in each, with their number of evidence rows."""
    by_file = evidence.groupBy("repository", "file").agg(F.max("score").alias("best"), F.count(F.lit(1)).alias("rows"))
    return by_file.groupBy("repository").agg(F.sum("rows").cast("long").alias("evidence"), F.sum("best").alias("score")).orderBy(F.col("score").desc(), "repository")


def points(evidence: DataFrame, found: Evidence) -> tuple[DataFrame, DataFrame]:
    """Entry and change points: of the evidence itself, then of the files that it has text hits in."""
    own = evidence.select("rank_no", F.lit(0).alias("via"), "repository", "file", "line", "name", "kind")
    hit = evidence.filter("kind = 'text'").groupBy("repository", "file").agg(F.min("rank_no").alias("rank_no"))
    files = F.broadcast(hit)  # MOST_EVIDENCE rows at most
    related = S.file_evidence(found.symbols, found.edges).join(files, ["repository", "file"])
    both = own.unionByName(related.select("rank_no", F.lit(1).alias("via"), "repository", "file", "line", "name", "kind"))
    order = ["via", "rank_no", "kind"]
    entries = first_of_key(both.filter(F.col("kind").isin(*ENTRY_KINDS)), ["repository", "file", "line", "name"], order)
    changes = both.filter(F.col("kind").isin(*CHANGE_KINDS))
    by = ["via", "rank_no", "repository", "file", "line", "name", "kind"]
    return entries.orderBy(*by).limit(MOST_EVIDENCE + 1), changes.orderBy(*by).limit(MOST_EVIDENCE + 1)


def analyze_requirement(found: Evidence, text: str, graph: G.Graph | None = None) -> dict:
    if not text.strip():
        raise ValueError("requirement text must not be empty")
    spark = found.spark
    row = spark.createDataFrame([(0, text)], "id int, text string")
    words = [r["keyword"] for r in keyword_rows(row, "id", "text", MOST_KEYWORDS + 1).orderBy("keyword_no").collect()]
    reasons = ["keyword_limit"] if len(words) > MOST_KEYWORDS else []
    words = words[:MOST_KEYWORDS]
    if not words:
        return {"keywords": [], "evidence": [], "repositories": [], "entry_points": [], "change_points": [], "impacts": [], "flows": [], "risks": [], "questions": [ASK_EVIDENCE], "coverage": {"complete": True, "reasons": []}}
    evidence, searched = requirement_evidence(found, words, MOST_EVIDENCE + 1)
    evidence = stage(evidence, "evidence")
    rows = [r.asDict() for r in evidence.orderBy("rank_no").collect()]
    if len(rows) > MOST_EVIDENCE:
        reasons.append("evidence_limit")
        evidence, rows = evidence.filter(F.col("rank_no") <= MOST_EVIDENCE), rows[:MOST_EVIDENCE]
    merged = merge_coverage(searched, "query_no").first()
    reasons += [r for r in merged["reasons"] if r not in reasons]
    repositories = [r.asDict() for r in repository_candidates(evidence).collect()]
    entries, changes = ([r.asDict() for r in p.collect()] for p in points(evidence, found))
    for items, reason in ((entries, "entry_limit"), (changes, "change_point_limit")):
        if len(items) > MOST_EVIDENCE:
            reasons.append(reason)
            del items[MOST_EVIDENCE:]
    graph = graph or G.load_graph(found)
    impacts, flows = [], []
    targets = [e for e in entries if e["kind"] in TRACED_KINDS and e["name"]]
    if len(targets) > MOST_TRACES:
        reasons.append("flow_entry_limit")
    for entry in targets[:MOST_TRACES]:
        start, _, why = G.one_start(graph, entry["name"], entry["repository"])
        walked = G.walk(graph, start, 6, 20) if start else None
        coverage = walked.coverage() if walked else G.empty_coverage(20, why)
        reasons += [r for r in coverage["reasons"] if r not in reasons]
        if walked and walked.paths:  # one walk gives the paths and their stages
            told = {"target": entry["name"], "candidates": [], "gaps": walked.gaps, "coverage": coverage}
            impacts.append(told | {"start": start, "paths": walked.paths})
            flows.append(told | {"flows": X.flows(graph, walked, start)})
    risks = [RISK_TABLE] if any(r["kind"] == "queries_table" for r in rows) else []
    risks += [RISK_REPOSITORIES] if len(repositories) > 1 else []
    return {
        "keywords": words, "evidence": rows, "repositories": repositories, "entry_points": entries, "change_points": changes, "impacts": impacts, "flows": flows,
        "risks": [*risks, *reasons], "questions": [] if rows else [ASK_EVIDENCE],
        "coverage": {"complete": not reasons, "truncated": merged["truncated"] or bool(reasons), "reasons": reasons, "matched": len(rows), "returned": len(rows), "limit": MOST_EVIDENCE},
    }


def change_evidence(found: Evidence, files: DataFrame) -> DataFrame:
    """Evidence in changed files (repository_id, path)."""
    return S.file_evidence(found.symbols, found.edges, files)


def analyze_change(found: Evidence, files: DataFrame, revision: str) -> dict:
    evidence = change_evidence(found, files).orderBy("repository", "file", "line", "name")
    rows = [r.asDict() for r in evidence.collect()]
    changed = [r.asDict() for r in files.orderBy("repository_id", "path").collect()]
    risks = [RISK_REPOSITORIES] if len({f["repository_id"] for f in changed}) > 1 else []
    risks += [RISK_TABLE] if any(r["kind"] == "queries_table" for r in rows) else []
    return {"range": revision, "files": changed, "evidence": rows, "risks": risks, "questions": [] if rows else ["refresh_baseline_first"]}


# --- feedback and rules ---------------------------------------------------------


def rules_at(feedback: DataFrame, revision: int | None = None, kind: str | None = None) -> DataFrame:
    """Rules as of a revision of the log: per kind, pattern and target the last feedback. Revision 0 has none."""
    log = feedback if revision is None else feedback.filter(F.col("revision") <= revision)
    log = log.select("revision", F.col("subject_kind").alias("kind"), F.col("subject_key").alias("pattern"), F.col("decision").alias("target"), "note", "created_at")
    if kind:
        log = log.filter(F.col("kind") == kind)
    last = F.max(F.struct("revision", "note", "created_at")).alias("last")
    rules = log.groupBy("kind", "pattern", "target").agg(last)
    return rules.select("kind", "pattern", "target", F.col("last.note").alias("note"), F.col("last.revision").alias("revision"))


def echo_rules(rules: DataFrame, modules: DataFrame) -> DataFrame:
    """The repository rules of the modules found; they are shown, not applied."""
    wanted = modules.select(F.col("repository").alias("pattern")).distinct()
    return rules.filter("kind = 'repository'").join(wanted, "pattern", "left_semi")


def report_record(report: dict, baseline: str, digest: str) -> dict:
    """A report as it is stored."""
    made = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    return {"id": report.get("id") or str(uuid.uuid4()), "created_at": made, "baseline_snapshot": baseline, "input_digest": digest, "report_json": json.dumps(report, default=str, sort_keys=True)}
