"""Staged flows and the context of one symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import identifiers as fn
from .graph import Graph, OpenGraph, Walk, check_walk, empty_coverage, one_start, walk

SUMMARY_FLOWS, SUMMARY_STEPS = 3, 4
RUNTIME_RISK = "static_contract_does_not_prove_runtime_routing"


def flow_steps(paths: DataFrame, symbols: DataFrame, start: dict) -> DataFrame:
    """One row per path and step with its stage; step 0 is the entry. A step has the kind of the symbol it leads to,
    contract relations and open ends keep their own."""
    ends = F.broadcast(paths.select("target_id").distinct())  # limit * max_depth at most
    kinds = symbols.select(F.col("uid").alias("target_id"), F.col("kind").alias("target_kind")).join(ends, "target_id", "left_semi")
    steps = paths.join(kinds, "target_id", "left")
    own = F.startswith("kind", F.lit("contract_")) | F.col("target_kind").isNull()
    steps = steps.select(
        "path_no", F.col("hop_no").alias("step_no"), F.col("target").alias("name"), "kind",
        fn.stage(F.when(own, F.col("kind")).otherwise(F.col("target_kind"))).alias("stage"),
        F.coalesce(F.col("target_repository") != F.col("repository"), F.lit(False)).alias("crosses"),
    )
    entries = paths.select("path_no").distinct().select(
        "path_no", F.lit(0).alias("step_no"), F.lit(start["name"]).alias("name"), F.lit(start["kind"]).alias("kind"),
        fn.stage(F.lit(start["kind"])).alias("stage"), F.lit(False).alias("crosses"),
    )
    return entries.unionByName(steps)


def flows(graph: Graph | OpenGraph, found: Walk, start: dict) -> list[dict]:
    kinds = {}
    ids = sorted({e["target_id"] for path in found.paths for e in path if e["target_id"]})
    if ids:
        nodes = F.broadcast(graph.symbols.sparkSession.createDataFrame([(i,) for i in ids], "uid string"))
        kinds = {r[0]: r[1] for r in graph.symbols.join(nodes, "uid").select("uid", "kind").collect()}
    names = {kind: name for name, group in fn.STAGES.items() for kind in group}
    out = []
    for path in found.paths:
        steps = [{"stage": names.get(start["kind"], "domain_or_service"), "evidence": start}]
        for e in path:
            kind = e["kind"] if e["kind"].startswith("contract_") else kinds.get(e["target_id"], e["kind"])
            steps.append({"stage": names.get(kind, "domain_or_service"), "evidence": e})
        crossings = sum(bool(e["target_repository"]) and e["target_repository"] != e["repository"] for e in path)
        out.append({"entry": start, "steps": steps, "crossings": crossings})
    return out


def flow(graph: Graph | OpenGraph, target: str, repository: str | None = None, max_depth: int = 6, limit: int = 20) -> dict:
    check_walk(max_depth, limit)
    start, choices, why = one_start(graph, target, repository)
    if start is None:
        return {"target": target, "flows": [], "candidates": choices, "gaps": [], "coverage": empty_coverage(limit, why)}
    found = walk(graph, start, max_depth, limit)
    return {"target": target, "flows": flows(graph, found, start), "candidates": [], "gaps": found.gaps, "coverage": found.coverage()}


def neighbours(relations: DataFrame, symbol_id: str) -> DataFrame:
    """Callers, callees and related relations of a symbol with their place in the shared budget."""
    into = relations.filter(F.col("target_id") == symbol_id).withColumn("category", F.lit("callers"))
    callee = (F.col("kind") == "calls") | F.startswith("kind", F.lit("contract_"))
    out = relations.filter(F.col("source_id") == symbol_id).withColumn("category", F.when(callee, "callees").otherwise("related"))
    # Ends and place make a relation one; equal rows count once.
    return into.unionByName(out).dropDuplicates(["category", "repository", "file", "line", "name", "kind", "source_id", "target_id"])


def budgeted(rows: DataFrame, limit: int) -> DataFrame:
    """The first `limit` of all categories together: callers, then callees, then related."""
    order = F.expr("case category when 'callers' then 0 when 'callees' then 1 else 2 end")
    return rows.orderBy(order, "repository", "file", "line", "kind", "target", "source", "edge_no").limit(limit)


def context(graph: Graph | OpenGraph, target: str, repository: str | None = None, max_depth: int = 6, limit: int = 20, detail: bool = False) -> dict:
    check_walk(max_depth, limit)
    start, choices, why = one_start(graph, target, repository)
    if start is None:
        return {"target": target, "symbol": None, "candidates": choices, "counts": {}, "coverage": empty_coverage(limit, why)}
    uid = start["uid"]
    near = neighbours(graph.touching([uid]), uid)
    counts = {r[0]: r[1] for r in near.groupBy("category").count().collect()}
    kept = [r.asDict() for r in budgeted(near, limit).collect()]
    found = walk(graph, start, max_depth, limit)
    staged = flows(graph, found, start)
    mine = graph.links.filter((F.col("consumer_id") == uid) | (F.col("provider.symbol_id") == uid)).orderBy("contract_id")
    linked = [r.asDict(recursive=True) for r in mine.limit(limit + 1).collect()]
    coverage = found.coverage()
    reasons = coverage["reasons"]

    def gap(reason: str, cuts: bool = True) -> None:
        coverage["truncated"] = coverage["truncated"] or cuts
        if reason not in reasons:
            reasons.append(reason)

    for link in linked[:limit]:
        if link["status"] != "matched":
            coverage["unresolved"] += 1
            gap(link["reason"], False)
    if sum(counts.values()) > limit:
        gap("context_relation_limit")
    if len(linked) > limit:
        gap("context_contract_limit")
    expand = {}
    if not detail:
        if len(staged) > SUMMARY_FLOWS:
            gap("summary_flow_limit")
        if any(len(f["steps"]) > SUMMARY_STEPS for f in staged[:SUMMARY_FLOWS]):
            gap("summary_step_limit")
        staged = [f | {"steps": f["steps"][:SUMMARY_STEPS]} for f in staged[:SUMMARY_FLOWS]]
        expand = {"get_symbol_context": uid, "trace_code_path": uid, "analyze_change_impact": uid, "list_contracts": start["name"]}
    gaps = found.gaps
    if len(gaps) > limit:
        gap("context_gap_limit")
    coverage |= {"complete": not reasons, "returned": len(kept)}
    grouped = {c: [r for r in kept if r["category"] == c] for c in ("callers", "callees", "related")}
    totals = {c: counts.get(c, 0) for c in grouped} | {"flows": len(found.paths), "contracts": len(linked), "gaps": len(gaps)}
    risks = [*reasons, RUNTIME_RISK] if linked else list(reasons)
    return {
        "target": target, "symbol": start, "candidates": [], **grouped, "flows": staged, "contracts": linked[:limit], "gaps": gaps[:limit],
        "counts": totals, "expand": expand, "risks": risks, "coverage": coverage,
    }
