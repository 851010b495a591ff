"""Refresh by content hash, requests on one snapshot, freshness, JSON-RPC."""

import io
import json
import threading

import pytest

from lodeweave import api, rpc
from lodeweave.api import EvidenceSession
from lodeweave.operators import extract
from lodeweave.operators.context import budgeted, flow_steps
from lodeweave.operators.extract import extract_text
from lodeweave.plans.snapshots import SnapshotStore
from tests.test_engine import git

SERVICE = "package shop.core;\n@Service public class %s {\n  public String find(String a) { return a; }\n}\n"


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    """A workspace of two repositories and a session over it."""
    root = tmp_path_factory.mktemp("shop")
    for name, types in (("a", ["One", "Two"]), ("b", ["Three"])):
        folder = root / "w" / name
        (folder / "src").mkdir(parents=True)
        git(root / "w", "init", "-q", str(folder))
        for t in types:
            (folder / "src" / f"{t}.java").write_text(SERVICE % t)
        (folder / "run.bin").write_bytes(b"\x00\xff")
        commit(folder)
        git(folder, "symbolic-ref", "refs/remotes/origin/HEAD", "refs/remotes/origin/main")
    return root, EvidenceSession(spark, str(root / "store"), str(root / "w"))


def commit(folder):
    git(folder, "add", "-A")
    git(folder, "commit", "-qm", "next")
    git(folder, "update-ref", "refs/remotes/origin/main", "HEAD")


def names(session, snapshot=None):
    return {r["name"] for r in session.store.read(snapshot).symbols.collect()}


def test_refresh_extracts_what_changed(shop, monkeypatch):
    root, session = shop
    first = session.call("refresh")["snapshot_id"]
    assert {"shop.core.One", "shop.core.Two.find", "shop.core.Three"} <= names(session)
    asked = []
    whole = extract.extract_files
    monkeypatch.setattr(api, "extract_files", lambda files, folder: asked.extend(r["path"] for r in files.select("path").collect()) or whole(files, folder))
    folder = root / "w" / "a"
    (folder / "src" / "One.java").unlink()
    (folder / "src" / "Two.java").write_text(SERVICE % "Second")
    commit(folder)
    second = session.call("refresh")["snapshot_id"]
    assert asked == ["src/Two.java"] and second != first
    assert names(session) == {"shop.core.Second", "shop.core.Second.find", "shop.core.Three", "shop.core.Three.find"}
    assert {r["path"] for r in session.store.read().files.collect()} == {"src/Two.java", "src/Three.java"}
    assert session.call("refresh")["snapshot_id"] == second and asked == ["src/Two.java"]
    status = {r["repository_id"]: r["file_count"] for r in session.call("workspace_status")["repositories"]}
    assert status == {"a": 1, "b": 1}
    # A pinned request is told by its own snapshot.
    pinned = session.call("find_business_context", {"text": "One", "snapshot_id": first, "limit": 5})
    assert pinned["snapshot_id"] == first and pinned["evidence"][0]["name"] == "shop.core.One"


def test_freshness(shop):
    root, session = shop
    session.call("refresh")
    before = session.store.active
    folder = root / "w" / "b"
    (folder / "src" / "Four.java").write_text(SERVICE % "Four")
    commit(folder)
    held, refresh = threading.Event(), session._refresh
    session._refresh = lambda: held.wait(60) and refresh()
    try:
        session.wait = 0.2
        assert session.call("workspace_status")["freshness"] == "refreshing"
        late = session.call("workspace_status", {"freshness": "latest"})
        assert (late["freshness"], late["snapshot_id"]) == ("stale", before) and "b@" in late["refresh_target"]
        held.set()
        session.wait = 120
        latest = session.call("workspace_status", {"freshness": "latest"})
        assert latest["freshness"] == "up_to_date" and latest["snapshot_id"] != before and "shop.core.Four" in names(session)
        assert session.call("workspace_status")["freshness"] == "up_to_date"
    finally:
        held.set()
        session._refresh = refresh


def test_json_rpc(shop):
    _, session = shop
    session.call("refresh")
    asked = [
        {"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"},
        {"id": 3, "method": "tools/call", "params": {"name": "trace_code_path", "arguments": {"text": "shop.core.Three.find"}}},
        {"id": 4, "method": "tools/call", "params": {"name": "nothing"}}, {"id": 5, "method": "other"},
        {"id": 6, "method": "tools/call", "params": {"name": "find_business_context", "arguments": {"text": " "}}},
    ]
    out = io.StringIO()
    rpc.serve(session, [json.dumps(m) for m in asked], out)
    told = {m["id"]: m for m in map(json.loads, out.getvalue().splitlines())}
    assert sorted(told) == [1, 2, 3, 4, 5, 6] and all(m["jsonrpc"] == "2.0" for m in told.values())
    assert len(told[2]["result"]["tools"]) == 13
    content = json.loads(told[3]["result"]["content"][0]["text"])
    assert content["start"]["name"] == "shop.core.Three.find" and content["snapshot_id"] == session.store.active
    assert all(told[i]["error"]["code"] == -32602 for i in (4, 5, 6))


def test_change_by_path_commit_and_range(shop):
    root, session = shop
    session.call("refresh")
    folder = root / "w" / "b"
    (folder / "src" / "Four.java").write_text(SERVICE % "Fourth")
    (folder / "docs").mkdir(exist_ok=True)
    (folder / "docs" / "read me.md").write_text("x")
    commit(folder)
    session.call("refresh")
    paths = lambda revision: {f["path"] for f in session.call("analyze_change", {"range": revision})["files"]}
    assert paths("src/Three.java") == {"src/Three.java"}
    assert "docs/read me.md" in paths("HEAD~1..HEAD") and paths("HEAD~1..HEAD") >= {"src/Four.java"}
    with pytest.raises(ValueError):
        paths("no-such-revision")
    with pytest.raises(ValueError):
        session.call("find_business_context", {"text": "x", "repository": "nowhere"})


def test_refreshes_are_one(spark, tmp_path):
    """All that ask while a refresh runs get that one; folders that no manifest names go when a store opens."""
    store = SnapshotStore(spark, str(tmp_path / "s"))
    began, go, ran = threading.Event(), threading.Event(), []

    def job():
        ran.append(1)
        began.set()
        go.wait(60)
        return "done"

    first = store.start(job)
    began.wait(60)
    second = store.start(job)
    go.set()
    assert first is second and first.result(60) == "done" and ran == [1]
    with pytest.raises(RuntimeError):
        store.refresh(lambda: (_ for _ in ()).throw(RuntimeError("no")))
    assert store.refresh(lambda: "again") == "again"
    store.write({})
    (tmp_path / "s" / "snapshot-099" / "files").mkdir(parents=True)
    SnapshotStore(spark, str(tmp_path / "s"))
    assert not (tmp_path / "s" / "snapshot-099").exists() and (tmp_path / "s" / "snapshot-001").exists()


def test_flows_across_repositories(spark):
    """A hop into another repository is a crossing; steps have the stage of what they lead to."""
    symbols = spark.createDataFrame([("u1", "controller_method"), ("u2", "service_method")], "uid string, kind string")
    hops = [(1, 1, "b.find", "contract_http", "a", "b", "u2"), (1, 2, "t_orders", "queries_table", "b", None, None)]
    paths = spark.createDataFrame(hops, "path_no int, hop_no int, target string, kind string, repository string, target_repository string, target_id string")
    got = flow_steps(paths, symbols, {"name": "a.list", "kind": "controller_method"}).orderBy("step_no").collect()
    assert [(r["step_no"], r["name"], r["stage"], r["crosses"]) for r in got] == [
        (0, "a.list", "entry", False), (1, "b.find", "cross_service", True), (2, "t_orders", "table", False),
    ]


def test_budget_order(spark):
    """Callers, then callees, then related ones; in each by place."""
    rows = [(c, "r", f, 1, "calls", "t", "s", i) for i, (c, f) in enumerate([("related", "a"), ("callees", "b"), ("callers", "z"), ("callees", "a")])]
    near = spark.createDataFrame(rows, "category string, repository string, file string, line int, kind string, target string, source string, edge_no long")
    assert [(r["category"], r["file"]) for r in budgeted(near, 3).collect()] == [("callers", "z"), ("callees", "a"), ("callees", "b")]


def test_older_schema_is_made_anew(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    store.write({})
    manifest = json.loads((tmp_path / "s" / "manifest.json").read_text())
    (tmp_path / "s" / "manifest.json").write_text(json.dumps(manifest | {"schema": 1, "revision": 3}))
    again = SnapshotStore(spark, str(tmp_path / "s"))
    assert again.active is None and again.revision == 3 and again.next_id() == "snapshot-002"
    (tmp_path / "s" / "manifest.json").write_text(json.dumps(manifest | {"schema": 99}))
    with pytest.raises(ValueError):
        SnapshotStore(spark, str(tmp_path / "s"))


def test_command_line(spark, tmp_path, capsys):
    SnapshotStore(spark, str(tmp_path / "s")).write({})
    assert api.main([str(tmp_path / "s"), "workspace_status"]) == 0
    told = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert told["snapshot_id"] == "snapshot-001" and told["repositories"] == []


def test_config_contracts():
    text = "Spring:\n  Application:\n    name: 'shop' # mine\n  kafka:\n    bootstrapServers: a:1, b:2\nother: ${X}\nrocketmq.nameServer=n:9876\n"
    found = extract_text("conf/app.yml", text)
    assert [(c["kind"], c["role"], c["target"], c["service"], c["broker"], c["symbol"], c["line"]) for c in found.contracts] == [
        ("service", "provider", "shop", "shop", "", "config:conf/app.yml", 3),
        ("broker", "provider", "kafka", "", "kafka:a:1,b:2", "config:conf/app.yml", 5),
        ("broker", "provider", "rocketmq", "", "rocketmq:n:9876", "config:conf/app.yml", 7),
    ]
    assert {(d["reason"], d["line"]) for d in found.diagnostics} == {("dynamic_config", 6), ("dynamic_marker", 1)}


def test_mapper_statements():
    text = '<mapper namespace="m.M">\n<select resultType="x" id="one">select * from\n  `users` u\n  join roles</select>\n<update id="open">update t set a = 1'
    found = extract_text("m.xml", text)
    assert [(e["kind"], e["source"], e["target"], e["line"]) for e in found.edges] == [
        ("maps_statement", "m.M", "m.M.one", 2), ("queries_table", "m.M.one", "users", 2), ("queries_table", "m.M.one", "roles", 4), ("maps_statement", "m.M", "m.M.open", 5),
    ]


JOBS = """package app;
@DubboService
@FeignClient(name = "stock", url = "http://x")
@ConfigurationProperties(prefix = "app.jobs")
public class Jobs extends Base implements Api<String> {
  private RocketMQTemplate bus;
  @Scheduled(cron = "0 * * * *")
  public void nightly() { bus.syncSend("done:tag", 1); }
  @KafkaListener(topics = "orders")
  public void on(String m) { Class.forName("x"); }
  @KafkaListener(topics = {"a", "b"})
  public void both(String m) { }
}
"""


def test_java_relations():
    found = extract_text("Jobs.java", JOBS)
    kinds = {(e["kind"], e["source"], e["target"], e["line"]) for e in found.edges}
    assert kinds == {
        ("dubbo_service", "app.Jobs", "dubbo:Jobs", 5), ("feign_client", "app.Jobs", "feign:stock", 3), ("uses_config", "app.Jobs", "config:app.jobs", 4),
        ("implements", "app.Jobs", "Base", 5), ("implements", "app.Jobs", "Api", 5), ("uses", "app.Jobs", "RocketMQTemplate", 6), ("scheduled_job", "app.Jobs", "schedule:Jobs#nightly", 7),
        ("publishes_topic", "app.Jobs", "mq:done:tag", 8), ("calls", "app.Jobs.nightly", "app.RocketMQTemplate.syncSend", 8), ("consumes_topic", "app.Jobs", "mq:orders", 9),
    }
    assert {(c["kind"], c["role"], c["target"]) for c in found.contracts} == {
        ("dubbo", "provider", "app.Api"), ("mq", "consumer", "orders"), ("mq", "consumer", "a"), ("mq", "consumer", "b"),
    }
    assert {"dynamic_behaviour", "unsafe_feign_metadata", "rocketmq_tag"} <= {d["reason"] for d in found.diagnostics}
