"""The operations of the engine over a snapshot store, and a command line.

    python -m lodeweave.api STORE OPERATION [key=value ...] [workspace=FOLDER]
    python -m lodeweave.api STORE serve [workspace=FOLDER]       JSON-RPC, one message a line
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import context as X
from .operators import contracts as C
from .operators import graph as G
from .operators import index as I
from .operators import search as S
from .operators.extract import extract_files
from .plans import analysis as A
from .plans.refresh import advance
from .plans.snapshots import SnapshotStore
from .rpc import serve
from .schemas import evidence
from .sources import inputs, workspace
from .staging import stage

VIEWS, FRESHNESS = ("summary", "detail"), ("stable", "latest")
#: Seconds that a request for the latest state waits for a refresh.
WAIT = 30.0
#: Operations that do not read a snapshot.
UNPINNED = ("discover", "refresh", "get_analysis_report", "record_analysis_feedback")


def _text(given: dict, key: str, needed: bool = True) -> str:
    value = given.get(key, "")
    if not isinstance(value, str):
        raise ValueError(f"{key} must be a string")
    if needed and not value.strip():
        raise ValueError(f"{key} is required")
    return value


def _number(given: dict, key: str, default: int, least: int, most: int) -> int:
    value = given.get(key, default)
    if isinstance(value, bool) or not isinstance(value, int) or not least <= value <= most:
        raise ValueError(f"{key} must be an integer between {least} and {most}")
    return value


def _choice(given: dict, key: str, choices: tuple[str, ...]) -> str:
    value = given.get(key, choices[0])
    if value not in choices:
        raise ValueError(f"{key} must be one of {', '.join(choices)}")
    return value


class EvidenceSession:
    """One request reads one snapshot, chosen once; its graph is kept until another snapshot is read."""

    def __init__(self, spark: SparkSession, store: str, workspace_root: str | None = None, wait: float = WAIT):
        self.spark, self.store, self.root, self.wait = spark, SnapshotStore(spark, store), workspace_root, wait
        self._graphs: dict[str, G.Graph] = {}
        self.operations: dict[str, Callable[[dict], dict]] = {
            "discover": self.discover, "refresh": self.refresh, "workspace_status": self.status, "find_business_context": self.search, "get_evidence": self.search,
            "trace_code_path": self.trace, "analyze_change_impact": self.impact, "trace_business_flow": self.flow, "get_symbol_context": self.context,
            "list_contracts": self.contracts, "analyze_change": self.change, "analyze_requirement": self.requirement, "analyze_inputs": self.inputs,
            "get_analysis_report": self.report, "record_analysis_feedback": self.feedback,
        }

    def call(self, operation: str, arguments: dict | None = None) -> dict:
        if operation not in self.operations:
            raise ValueError(f"unknown operation: {operation}")
        given = dict(arguments or {})
        freshness = _choice(given, "freshness", FRESHNESS)
        if operation in UNPINNED:
            result = self.operations[operation](given)
            return {"snapshot_id": self.store.active, "rule_revision": self.store.revision} | result
        chosen, told = self._choose(_text(given, "snapshot_id", False), freshness)
        return told | self.operations[operation](given | {"snapshot_id": chosen})

    def _choose(self, pinned: str, freshness: str) -> tuple[str, dict]:
        """The snapshot a request reads, and what to say of it.

        A pinned one is read as it is. If the workspace's baselines moved, a refresh starts: a stable request reads the
        active snapshot meanwhile, a latest one waits up to `wait` seconds and then reads what there is.
        """
        told = lambda entry, state, **more: (entry["id"], {"snapshot_id": entry["id"], "rule_revision": self.store.revision, "freshness": state, "active_baseline": entry["baseline"]} | more)
        if pinned or not self.root:
            return told(self.store.entry(pinned or None), "up_to_date")
        target = I.baseline_text(self._repositories()).first()[0]
        active = self.store.entry() if self.store.active else None
        if active and active["baseline"] == target:
            return told(active, "up_to_date")
        running = self.store.start(self._refresh)
        if active and freshness != "latest":
            return told(active, "refreshing", refresh_target=target)
        try:
            return told(self.store.entry(running.result(timeout=self.wait)), "up_to_date")
        except Exception:
            if active is None:
                raise
            return told(active, "stale", refresh_target=target)

    def _found(self, given: dict):
        return self.store.read(given["snapshot_id"])

    def _graph(self, given: dict) -> G.Graph:
        name = given["snapshot_id"]
        if name not in self._graphs:
            found, stored = self._found(given), self.store.derived(name)
            self._graphs = {name: G.stored_graph(found.symbols, stored) if stored else G.load_graph(found)}
        graph = self._graphs[name]
        repository = _text(given, "repository", False)
        if repository:
            known = graph.symbols.select("repository_id").unionByName(graph.contracts.select("repository_id"))
            if known.filter(F.col("repository_id") == repository).limit(1).isEmpty():
                raise ValueError(f"repository is not present in this snapshot: {repository}")
        return graph

    @staticmethod
    def _walk(given: dict) -> tuple[str, str | None, int, int]:
        return _text(given, "target"), _text(given, "repository", False) or None, _number(given, "max_depth", 6, 1, 32), _number(given, "limit", 20, 1, 200)

    def search(self, given: dict) -> dict:
        text, limit = _text(given, "text").strip(), _number(given, "limit", 50, 1, 1000)
        found, entry = self._found(given), self.store.entry(given["snapshot_id"])
        stored = S.Indexed(self.store.index, entry["index"], found.files) if entry["index"] else None
        top, coverage = S.ranked_search(found, S.queries_frame(self.spark, [text]), _text(given, "repository", False) or None, limit, stored=stored)
        rows = [r.asDict() for r in top.orderBy("rank_no").drop("query_no").collect()]
        return {"evidence": rows, "coverage": coverage.drop("query_no").first().asDict()}

    def trace(self, given: dict) -> dict:
        target, *rest = self._walk(given)
        return G.trace(self._graph(given), target, *rest)

    def impact(self, given: dict) -> dict:
        target, *rest = self._walk(given)
        return G.impact(self._graph(given), target, *rest)

    def flow(self, given: dict) -> dict:
        target, *rest = self._walk(given)
        return X.flow(self._graph(given), target, *rest)

    def context(self, given: dict) -> dict:
        target, *rest = self._walk(given)
        return X.context(self._graph(given), target, *rest, detail=_choice(given, "view", VIEWS) == "detail")

    def contracts(self, given: dict) -> dict:
        graph, limit = self._graph(given), _number(given, "limit", 20, 1, 200)
        told = C.contract_report(graph.contracts, graph.links, graph.diagnostics, _text(given, "repository", False) or None, _text(given, "text", False), limit)
        out = {name: [r.asDict(recursive=True) for r in told[name].collect()] for name in ("contracts", "links", "gaps")}
        return out | {"coverage": told["coverage"].first().asDict()}

    def _repositories(self):
        if not self.root:
            raise ValueError("this session has no workspace")
        return workspace.discover(self.spark, self.root)

    def discover(self, given: dict) -> dict:
        return {"repositories": [r.asDict() for r in self._repositories().collect()]}

    def status(self, given: dict) -> dict:
        found = self._found(given)
        rows = I.workspace_status(found.repositories, found.files, found.diagnostics).orderBy("repository_id")
        return {"repositories": [r.asDict() for r in rows.collect()]}

    def refresh(self, given: dict) -> dict:
        return {"snapshot_id": self.store.refresh(self._refresh)}

    def _refresh(self) -> str:
        """A snapshot of all baselines; if no repository's commit is another than in the active one, that one stays.

        Only repositories with another commit are read, and only files of theirs with another hash are extracted again;
        evidence of all other files is taken over, that of files a baseline has no more goes.
        """
        repositories = self._repositories()
        if repositories.filter("baseline_commit <> ''").isEmpty():
            raise ValueError("no repository has a baseline")
        active = self.store.entry() if self.store.active else None
        old = self.store.read(active["id"]) if active else evidence(self.spark)
        states = I.repository_states(repositories, old.repositories)
        stale = repositories.join(states.filter("state = 'stale'"), "repository_id", "left_semi")
        moved = [r[0] for r in stale.select("repository_id").collect()]  # of the list of repositories, which the driver made
        if active and not moved:
            return active["id"]
        now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
        again = stale.select("repository_id", now.alias("indexed_at"))
        held = old.repositories.select("repository_id", F.col("indexed_at").alias("held_at"))
        named = repositories.join(again, "repository_id", "left").join(held, "repository_id", "left").withColumn("indexed_at", F.coalesce("indexed_at", "held_at"))
        named = named.select("repository_id", "baseline_branch", "baseline_commit", "baseline_state", "indexed_at")
        files = stage(workspace.archived_files(stale), "files")
        return advance(self.store, files, moved, named, I.baseline_text(repositories).first()[0], extract=extract_files)

    def change(self, given: dict) -> dict:
        revision = _text(given, "range")
        files = workspace.changed_files(self.spark, self._repositories(), revision)
        return A.analyze_change(self._found(given), files, revision)

    def requirement(self, given: dict) -> dict:
        return A.analyze_requirement(self._found(given), _text(given, "text"), self._graph(given))

    def inputs(self, given: dict) -> dict:
        facts, told = inputs.parse_inputs(self.spark, _text(given, "text", False), given.get("paths", []), _text(given, "source_ref", False) or "text")
        rows = [r.asDict() for r in facts.collect()]
        values = [r["value"] for r in rows]
        report = A.analyze_requirement(self._found(given), " ".join(values) or " ", self._graph(given))
        revision = self.store.revision
        modules = [m["repository"] for m in report["repositories"]]
        rules = A.rules_at(self.store.feedback(), revision, "repository").filter(F.col("pattern").isin(modules))
        record = A.report_record(
            report | {"facts": rows, "diagnostics": told, "rule_revision": revision, "feedback": [r.asDict() for r in rules.collect()],
                      "test_points": [f"verify_main_and_error_flows:{m}" for m in modules] or ["confirm_input_locates_code"]},
            given["snapshot_id"], inputs.input_digest(values),
        )
        self.store.save_report(record)
        return {"report_id": record["id"], "recommended_branches": [f"feature/{record['id'][:8]}"] if modules else []} | json.loads(record["report_json"])

    def report(self, given: dict) -> dict:
        row = self.store.reports().filter(F.col("id") == _text(given, "report_id")).first()
        if row is None:
            raise ValueError("no such report")
        return row.asDict() | {"report": json.loads(row["report_json"])}

    def feedback(self, given: dict) -> dict:
        row = {k: _text(given, k) for k in ("report_id", "subject_kind", "subject_key", "decision")}
        return {"revision": self.store.add_feedback(row | {"note": _text(given, "note", False)})}


def main(args: list[str]) -> int:
    if len(args) < 2:
        print(__doc__)
        return 2
    given: dict = {}
    for item in args[2:]:
        key, _, value = item.partition("=")
        given[key] = int(value) if value.isdigit() else value
    spark = SparkSession.builder.appName("lodeweave").getOrCreate()
    session = EvidenceSession(spark, args[0], given.pop("workspace", None))
    if args[1] == "serve":
        serve(session, sys.stdin, sys.stdout)
        return 0
    print(json.dumps(session.call(args[1], given), default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
