"""Snapshots share what did not change; several writers; changes named by path."""

import json
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodeweave.api import EvidenceSession
from lodeweave.operators import graph as G
from lodeweave.operators import search as S
from lodeweave.operators.extract.config import settings
from lodeweave.plans import refresh, snapshots
from lodeweave.plans.snapshots import SnapshotStore
from lodeweave.sources.workspace import changed_files
from lodeweave.schemas import CONTRACTS, evidence
from lodeweave.staging import stage
from tests.test_engine import contract, edges, git, symbols
from tests.test_refresh import SERVICE, commit

CALLER = "package shop.web;\nimport shop.core.One;\npublic class Caller {\n  private One one;\n  public void run() { one.find(\"x\"); }\n}\n"


@pytest.fixture(scope="module")
def session(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("shared")
    for name, files in (("a", {"One": SERVICE % "One", "Caller": CALLER}), ("b", {"Three": SERVICE % "Three"}), ("none", {})):
        folder = root / "w" / name
        (folder / "src").mkdir(parents=True)
        git(root / "w", "init", "-q", str(folder))
        for t, text in files.items():
            (folder / "src" / f"{t}.java").write_text(text)
        if files:
            commit(folder)
            git(folder, "symbolic-ref", "refs/remotes/origin/HEAD", "refs/remotes/origin/main")
    return EvidenceSession(spark, str(root / "store"), str(root / "w"))


def test_a_refresh_writes_its_repository_only(spark, session):
    first = session.call("refresh")["snapshot_id"]
    folder, store = Path(session.root) / "a", Path(session.store.root)
    (folder / "src" / "One.java").write_text(SERVICE % "Uno")
    commit(folder)
    second = session.call("refresh")["snapshot_id"]
    entry = session.store.entry()
    for table in ("files", "symbols", "edges", "diagnostics", "bound_relations", "bound_incoming"):
        assert entry["tables"][table] == [{"of": first, "without": ["a"]}, {"of": second, "without": []}]
    column = {"files": "repository_id", "symbols": "repository_id", "bound_relations": "repository"}
    for table, name in column.items():
        assert {r[0] for r in spark.read.parquet(str(store / second / table)).select(name).collect()} <= {"a"}
    # What is read is what a whole reading gives.
    found = session.store.read()
    assert {(r["repository_id"], r["path"]) for r in found.files.collect()} == {("a", "src/One.java"), ("a", "src/Caller.java"), ("b", "src/Three.java")}
    whole, stored = G.load_graph(found), G.stored_graph(found.symbols, session.store.derived())
    rows = lambda df, columns: sorted(map(repr, df.select(*columns).collect()))
    for name in ("relations", "bound", "diagnostics", "contracts", "links"):
        mine = getattr(whole, name)
        assert rows(getattr(stored, name), mine.columns) == rows(mine, mine.columns), name
    assert rows(stored.incoming, whole.relations.columns) == rows(whole.relations.filter("target_id is not null"), whole.relations.columns)
    queries = S.queries_frame(spark, ["find", "Uno", "return a", "package shop.core"])
    index = S.Indexed(session.store.index, entry["index"], found.files)
    direct, through = (S.ranked_search(found, queries, limit=50, stored=s)[0].orderBy("query_no", "rank_no").collect() for s in (None, index))
    assert [r.asDict() for r in through] == [r.asDict() for r in direct] and len(direct) > 8
    assert len(entry["index"]) == 2 and session.call("find_business_context", {"text": "shop.core.Uno"})["evidence"][0]["name"] == "shop.core.Uno"
    # The older folder stays as long as a piece of it counts, whatever snapshots are kept.
    assert session.store.read(first).symbols.filter("name = 'shop.core.One'").count() == 1
    assert (store / first).is_dir()


def test_many_pieces_are_written_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshots, "MOST_PIECES", 2)
    store = SnapshotStore(spark, str(tmp_path / "s"))
    files = lambda *rows: {"files": spark.createDataFrame([(r, p, p, c) for r, p, c in rows], "repository_id string, path string, content_hash string, content string")}
    store.write(files(("a", "x", "1"), ("b", "y", "1"), ("c", "z", "1")))
    for n in range(2, 5):
        store.write(files(("a", "x", str(n))), over=store.entry(), repositories=["a"])
        held = sorted((r["repository_id"], r["content"]) for r in store.read().files.collect())
        assert held == [("a", str(n)), ("b", "1"), ("c", "1")] and len(store.entry()["tables"]["files"]) <= 2
    named = {p["of"] for s in store._manifest()["snapshots"] for t in s["tables"].values() for p in t} | {s["id"] for s in store._manifest()["snapshots"]}
    assert {p.name for p in (tmp_path / "s").glob("snapshot-*")} == named


WRITER = """
import sys, fcntl
sys.path.insert(0, {repo!r})
from lodeweave.plans.snapshots import SnapshotStore
store = SnapshotStore.__new__(SnapshotStore)
import threading
store.root, store._lock = {root!r}, threading.Lock()
for _ in range(40):
    with store._alone():
        manifest = store._manifest()
        store._replace(manifest | {{"revision": manifest["revision"] + 1}})
"""


def test_writers_of_several_processes(spark, tmp_path):
    """No revision is lost; a folder that another process is writing is left alone."""
    store = SnapshotStore(spark, str(tmp_path / "s"))
    code = WRITER.format(repo=str(Path(__file__).parent.parent), root=store.root)
    running = [subprocess.Popen([sys.executable, "-c", code]) for _ in range(3)]
    assert [p.wait(120) for p in running] == [0, 0, 0] and store.revision == 120
    hold = "import fcntl,sys; f = open(sys.argv[1], 'w'); fcntl.flock(f, fcntl.LOCK_EX); print('held', flush=True); sys.stdin.read()"
    (tmp_path / "s" / "snapshot-050").mkdir()
    with subprocess.Popen([sys.executable, "-c", hold, str(tmp_path / "s" / "snapshot-050" / ".writing")], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as other:
        other.stdout.readline()
        store.clean()
        assert (tmp_path / "s" / "snapshot-050").exists()
        other.stdin.close()
    store.clean()
    assert not (tmp_path / "s" / "snapshot-050").exists()


def test_changes_by_path(spark, session, tmp_path):
    repositories = session._repositories()
    paths = lambda change: {(r["repository_id"], r["path"]) for r in changed_files(spark, repositories, change).collect()}
    assert paths("b/src/Three.java") == paths("b\\src\\Three.java") == paths("src/Three.java") == {("b", "src/Three.java")}
    written = tmp_path / "written"
    for change in (f"--output={written}", "-O/dev/null", "HEAD..HEAD", "a/src/Three.java", "nothing", "no/such/path", "--help..x"):
        with pytest.raises(ValueError):
            paths(change)
    assert not written.exists()
    with pytest.raises(ValueError):
        session.call("analyze_change", {"range": f"--output={written}"})


def test_settings_end_at_line_feeds():
    text = "a.b=1\x0c2 x\r\nc.d=3\u0085\n"
    assert [(key, line) for key, _, line in settings(text)] == [("a.b", 1), ("c.d", 2)]


def test_walks_on_packed_lists(spark):
    """A stored graph's lists give the walks of the graph itself, at hubs and where contracts lead calls elsewhere."""
    nodes = [("r", "a", f"N.n{i}", "m", i, i, "") for i in range(230)] + [("r", "w", "W", "class", 1, 1, ""), ("r", "w", "W.run", "m", 1, 1, "")]
    nodes += [("geo", "p", "P", "class", 1, 9, ""), ("geo", "p", "P.find", "m", 1, 9, ""), ("geo", "p", "P.other", "m", 1, 9, ""), ("r", "i", "api.I.find", "m", 1, 1, "")]
    links = [("r", "a", "N.n0", f"N.n{i}", "calls", i, None) for i in range(1, 230)] + [("r", "a", f"N.n{i}", "N.n1", "calls", i, None) for i in range(2, 230)]
    links += [("r", "w", "W.run", "api.I.find", "calls", 2, None), ("r", "w", "W.run", "N.n3", "calls", 1, None), ("r", "a", "N.n5", "W.run", "calls", 1, None), ("geo", "p", "P.find", "P.other", "uses", 3, None)]
    made = [contract("dubbo", "consumer", "api.I", "W", "r", path="w"), contract("dubbo", "provider", "api.I", "P", "geo", path="p")]
    found = evidence(spark, symbols=symbols(spark, nodes), edges=edges(spark, links), contracts=spark.createDataFrame(made, CONTRACTS))
    whole = G.load_graph(found)
    stored = G.stored_graph(found.symbols, {t: stage(df, t) for t, df in G.graph_tables(found, whole.bound, whole.bound).items()})
    assert stored.lists["outgoing_lists"].filter(F.size("edges") == 201).count() == 1 and "added_incoming" in stored.lists
    for target, reverse in (("N.n0", False), ("W.run", False), ("N.n5", False), ("N.n1", True), ("P.find", True), ("api.I.find", True), ("P.other", True)):
        start = G.one_start(whole, target)[0]
        for depth, limit in ((3, 200), (6, 7)):
            a, b = (G.walk(g, start, depth, limit, reverse) for g in (whole, stored))
            told = lambda w: [[(e["source"], e["target"], e["kind"], e["reason"]) for e in p] for p in w.paths]
            assert told(a) == told(b) and a.coverage() == b.coverage(), target
    assert [e["target"] for p in G.trace(stored, "W.run")["paths"] for e in p if e["reason"] == "exact_dubbo_contract"] == ["P.find"]


def test_older_stores_are_read_on(spark, tmp_path):
    """A store of version 10 keeps its snapshots, reports, rules and revision, and is refreshed from where it is."""
    store = SnapshotStore(spark, str(tmp_path / "s"))
    texts = {"One.java": SERVICE % "One", "Two.java": SERVICE % "Two"}
    rows = lambda held: stage(spark.createDataFrame([("r", p, str(hash(c)), c) for p, c in held.items()], "repository_id string, path string, content_hash string, content string"), "files")
    repositories = spark.createDataFrame([("r", "main", "c1", "baseline_known", "")], "repository_id string, baseline_branch string, baseline_commit string, baseline_state string, indexed_at string")
    first = refresh.advance(store, rows(texts), ["r"], repositories)
    store.add_feedback({"report_id": "x", "subject_kind": "repository", "subject_key": "r", "decision": "confirm"})
    manifest = json.loads((tmp_path / "s" / "manifest.json").read_text())
    plain = [{"id": s["id"], "baseline": s["baseline"], "derived": ["relations"]} for s in manifest["snapshots"]]
    (tmp_path / "s" / "manifest.json").write_text(json.dumps(manifest | {"schema": 10, "snapshots": plain}))
    again = SnapshotStore(spark, str(tmp_path / "s"))
    assert again.active == first and again.revision == 1 and again.feedback().count() == 1
    assert {r["path"] for r in again.read().files.collect()} == set(texts) and again.derived() == {} and again.entry()["index"] == []
    second = refresh.advance(again, rows(texts | {"Two.java": SERVICE % "Other"}), ["r"], repositories)
    assert again.read(first).files.count() == 2 and {"bound_relations", "outgoing_lists"} <= set(again.derived(second))
    assert json.loads((tmp_path / "s" / "manifest.json").read_text())["schema"] == snapshots.SCHEMA_VERSION and again.revision == 1
    found = S.ranked_search(again.read(), S.queries_frame(spark, ["shop.core.Other"]), stored=S.Indexed(again.index, again.entry()["index"], again.read().files))[0]
    assert {r["file"] for r in found.collect()} == {"Two.java"}
