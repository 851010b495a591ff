"""Golden cases of search, graph, contracts, extraction, snapshots and the API."""

import random
import subprocess

import pytest

from lodeweave.api import EvidenceSession
from lodeweave.functions import identifiers as fn
from lodeweave.operators import graph as G
from lodeweave.operators import ranking
from lodeweave.operators import search as S
from lodeweave.operators.extract import extract_text
from lodeweave.plans import analysis as A
from lodeweave.plans.snapshots import SnapshotStore
from lodeweave.schemas import CONTRACTS, DIAGNOSTICS, EDGES, FILES, SYMBOLS, evidence
from lodeweave.sources import inputs, workspace
from pyspark.sql import functions as F


def symbols(spark, rows):
    """rows: (repository, path, name, kind, line, end_line, signature)"""
    return spark.createDataFrame([(r, p, n, k, l, "", s, e) for r, p, n, k, l, e, s in rows], SYMBOLS)


def edges(spark, rows):
    """rows: (repository, path, source, target, kind, line, arity)"""
    return spark.createDataFrame([(r, p, s, t, k, l, "certain", "", a) for r, p, s, t, k, l, a in rows], EDGES)


def files(spark, rows):
    return spark.createDataFrame([(r, p, "", c) for r, p, c in rows], FILES)


def search(spark, found, text, **options):
    top, coverage = S.ranked_search(found, S.queries_frame(spark, [text]), **options)
    return top.orderBy("rank_no").collect(), coverage.first()


def test_names(spark):
    row = spark.range(1).select(
        fn.identifier_terms(F.lit("saveHTTPServer_fooBar9")).alias("terms"),
        fn.signature_arity(F.lit("A.f(Map<K,V>,int)")).alias("two"),
        fn.signature_arity(F.lit("A.f()")).alias("none"),
        fn.signature_arity(F.lit("A")).alias("no"),
        fn.keywords(F.lit("订单服务 a_b/c 支付")).alias("words"),
        fn.match_line(F.lit("a\nB\nc"), F.lit("b")).alias("line"),
        fn.join_http_path(F.lit("/a/"), F.lit("b")).alias("path"),
        fn.without_user_info(F.lit("https://u:p@host/x@y")).alias("url"),
    ).first()
    assert row["terms"] == ["save", "httpserver", "foo", "bar9"]
    assert (row["two"], row["none"], row["no"], row["line"]) == (2, 0, -1, 2)
    assert row["words"] == ["a_b/c", "订单服", "单服务", "支付"]
    assert (row["path"], row["url"]) == ("/a/b", "https://host/x@y")


def test_exact_beats_many_broad_candidates(spark):
    rows = [("r", "a.java", f"helperSave{i:04d}Thing", "class", i, i, "") for i in range(1001)] + [("r", "z.java", "SaveThing", "class", 1, 1, "")]
    top, coverage = search(spark, evidence(spark, symbols=symbols(spark, rows)), "save_thing", limit=1)
    assert [r["name"] for r in top] == ["SaveThing"]
    assert top[0]["score"] == 900 and "symbol candidates truncated" in coverage["reasons"] and coverage["truncated"]


def test_sources_fuse_and_percent_is_literal(spark):
    found = evidence(spark, files=files(spark, [("r", "a.txt", "x\nhello 100% world"), ("r", "b.txt", "other")]))
    top, _ = search(spark, found, "hello")
    assert len(top) == 1 and top[0]["match_sources"] == ["file_fts", "file_substring"] and top[0]["line"] == 2
    top, _ = search(spark, found, "%")
    assert [r["file"] for r in top] == ["a.txt"]


def test_search_arguments(spark):
    found = evidence(spark, files=files(spark, [("r", "a", "b")]))
    for limit in (0, 1001):
        with pytest.raises(ValueError):
            search(spark, found, "b", limit=limit)
    with pytest.raises(ValueError):
        search(spark, found, "b", repository="none")


def graph_of(spark, nodes, links, **more):
    return G.load_graph(evidence(spark, symbols=symbols(spark, nodes), edges=edges(spark, links), **more))


def test_overloads_and_repositories(spark):
    nodes = [
        ("r", "a", "A.run", "m", 1, 5, "A.run()"), ("r", "b", "B.go", "m", 1, 5, "B.go(int)"), ("r", "b", "B.go", "m", 6, 9, "B.go(int,int)"),
        ("r", "c", "C.do", "m", 1, 5, "C.do(int)"), ("r", "c", "C.do", "m", 6, 9, "C.do(long)"), ("other", "d", "D.far", "m", 1, 2, "D.far()"),
    ]
    links = [("r", "a", "A.run", "B.go", "calls", 2, 1), ("r", "a", "A.run", "C.do", "calls", 3, 1), ("r", "a", "A.run", "D.far", "calls", 4, 0)]
    told = {r["target"]: r["reason"] for r in graph_of(spark, nodes, links).relations.collect()}
    assert told == {"B.go": "", "C.do": "ambiguous_target", "D.far": "unresolved_target"}


def test_branches_cycles_and_depth(spark):
    nodes = [("r", "a", f"N.n{i}", "m", i, i, "") for i in range(22)]
    told = [(spark.createDataFrame([("r", "a", "odd", 1, "unresolved")], DIAGNOSTICS))][0]
    graph = graph_of(spark, nodes, [("r", "a", "N.n0", f"N.n{i}", "calls", i, None) for i in range(1, 22)], diagnostics=told)
    found = G.trace(graph, "N.n0", limit=20)
    assert len(found["paths"]) == 20 and found["coverage"]["truncated"] and found["coverage"]["diagnostics"] == 1
    assert {"path_limit", "parser_diagnostics"} <= set(found["coverage"]["reasons"])
    graph = graph_of(spark, nodes[:2], [("r", "a", "N.n0", "N.n1", "calls", 1, None), ("r", "a", "N.n1", "N.n0", "calls", 2, None)])
    assert "depth_limit" in G.trace(graph, "N.n0", max_depth=1)["coverage"]["reasons"]
    assert "cycle_detected" in G.trace(graph, "N.n0", max_depth=6)["coverage"]["reasons"]
    assert G.trace(graph, "nobody")["coverage"]["reasons"] == ["symbol_not_found"]
    with pytest.raises(ValueError):
        G.trace(graph, "N.n0", max_depth=33)


def plain_walk(adjacency, start, depth, limit):
    paths = []

    def visit(node, path, seen):
        if len(paths) > limit:
            return
        following = adjacency.get(node, [])
        if not following or len(path) >= depth:
            paths.append(path)
            return
        for n in following:
            if n in seen:
                paths.append([*path, n])
            else:
                visit(n, [*path, n], seen | {n})

    visit(start, [], {start})
    return [p for p in paths[:limit] if p]


def test_walk_equals_plain_depth_first_search(spark):
    rng = random.Random(5)
    for _ in range(3):
        pairs = sorted({(rng.randrange(7), rng.randrange(7)) for _ in range(14)})
        nodes = [("r", "a", f"N.n{i}", "m", i, i, "") for i in range(7)]
        graph = graph_of(spark, nodes, [("r", "a", f"N.n{a}", f"N.n{b}", "calls", b, None) for a, b in pairs])
        adjacency = {}
        for a, b in pairs:
            adjacency.setdefault(f"N.n{a}", []).append(f"N.n{b}")
        for depth, limit in ((2, 5), (5, 7)):
            found = G.trace(graph, "N.n0", max_depth=depth, limit=limit)
            assert [[e["target"] for e in p] for p in found["paths"]] == plain_walk(adjacency, "N.n0", depth, limit)


def contract(kind, role, key, symbol, repository, service="", broker="", path="a"):
    return (repository, path, kind, role, service, key, symbol, "", 1, "certain", "", broker)


def test_contracts(spark):
    nodes = [("c", "a", "C.call", "m", 1, 2, ""), ("p", "a", "P.serve", "m", 1, 2, ""), ("q", "a", "Q.serve", "m", 1, 2, "")]
    rows = [contract("http", "consumer", "GET:/x", "C.call", "c", "svc"), contract("http", "provider", "GET:/x", "P.serve", "p", "svc"), contract("http", "provider", "GET:/x", "Q.serve", "q", "else")]
    links = lambda rows: G.load_graph(evidence(spark, symbols=symbols(spark, nodes), contracts=spark.createDataFrame(rows, CONTRACTS)))
    graph = links(rows)
    assert [r["status"] for r in graph.links.collect()] == ["matched"]
    assert [r["target"] for r in graph.relations.collect()] == ["P.serve"]
    graph = links([*rows, contract("http", "provider", "GET:/x", "Q.serve", "q", "svc", path="b")])
    assert [r["reason"] for r in graph.links.collect()] == ["multiple_providers"]
    mq = [contract("mq", "consumer", "t", "C.call", "c", broker="kafka:one:9"), contract("mq", "provider", "t", "P.serve", "p", broker="kafka:one:9")]
    assert [(r["source"], r["target"]) for r in links(mq).relations.collect()] == [("P.serve", "C.call")]
    mq[1] = contract("mq", "provider", "t", "P.serve", "p", broker="kafka:two:9")
    assert [r["reason"] for r in links(mq).links.collect()] == ["no_verified_provider"]


JAVA = """package shop.web;
import shop.core.OrderService;
import org.springframework.kafka.core.KafkaTemplate;
/* class Fake {} */
@RestController
@RequestMapping("/orders")
public class OrderController implements Api {
  private final OrderService orders;
  private KafkaTemplate<String, String> bus;
  @DubboReference private shop.api.StockService stock;
  @Value("${shop.limit:5}") int limit;
  @GetMapping({"/list", "/all"})
  public List<String> list(@RequestParam(name = "a,b") String id, final int... n) {
    bus.send("orders", "x{");
    return orders.find(id, n.length);
  }
  void shadowed(Other orders) { orders.find("x"); }
  @PostMapping(Paths.SAVE) public void save() { helper.run(); }
}
"""


def test_java():
    found = extract_text("src/A.java", JAVA)
    assert found.symbols[0]["name"] == "shop.web.OrderController" and found.symbols[0]["kind"] == "controller"
    signatures = {s["signature"] for s in found.symbols if s["kind"] == "controller_method"}
    assert "OrderController.list(java.lang.String,int[])" in signatures
    kinds = {(e["kind"], e["target"]) for e in found.edges}
    assert {("route", "/orders/list"), ("route", "/orders/all"), ("calls", "shop.core.OrderService.find"), ("publishes_topic", "mq:orders"), ("uses_config", "config:shop.limit"), ("implements", "Api"), ("dubbo_reference", "dubbo:StockService"), ("imports", "shop.core.OrderService")} <= kinds
    assert [e["target_arity"] for e in found.edges if e["kind"] == "calls"] == [2, 2]
    assert {(c["kind"], c["role"], c["target"]) for c in found.contracts} == {
        ("http", "provider", "GET:/orders/list"), ("http", "provider", "GET:/orders/all"), ("dubbo", "consumer", "shop.api.StockService"), ("mq", "provider", "orders"),
    }
    assert {"shadowed_field_call", "dynamic_http_path_of_method", "unbound_receiver"} <= {d["reason"] for d in found.diagnostics}


def test_other_sources():
    pom = extract_text("pom.xml", "<artifactId>a</artifactId><artifactId> b </artifactId>")
    assert [(e["source"], e["target"]) for e in pom.edges] == [("maven:a", "maven:b")]
    assert [d["reason"] for d in extract_text("m.xml", "<mapper/>").diagnostics] == ["mapper_without_namespace"]
    yml = extract_text("app.yml", "spring:\n  application:\n    name: shop\n  kafka:\n    bootstrap-servers: ${K}\n/orders:\n")
    assert [c["service"] for c in yml.contracts] == ["shop"] and {d["reason"] for d in yml.diagnostics} == {"dynamic_config", "dynamic_marker"}
    assert ("api_contract", "http:ANY:/orders") in {(e["kind"], e["target"]) for e in yml.edges}
    feign = extract_text("F.java", '@FeignClient(name = "stock", path = "/s") interface F { @GetMapping("/x") String x(); }')
    assert [(c["service"], c["target"]) for c in feign.contracts] == [("stock", "GET:/s/x")]
    assert [d["reason"] for d in extract_text("F.java", '@FeignClient(name = "s", url = "http://x") interface F { @GetMapping("/x") String x(); }').diagnostics] == ["unsafe_feign_metadata"]


def test_inputs(spark, tmp_path):
    page = tmp_path / "a.html"
    page.write_text('<h1>Pay order</h1><form action="/api/pay"><input name="amount"></form>')
    data = tmp_path / "a.json"
    data.write_text('{"screen": {"route": "/home", "title": "Pay now"}}')
    picture = tmp_path / "a.png"
    picture.write_bytes(b"x")
    facts, told = inputs.parse_inputs(spark, "see /x/y\nline", [str(page), str(data), str(picture)])
    found = {(r["kind"], r["value"]) for r in facts.collect()}
    assert {("field", "amount"), ("api_path", "/api/pay"), ("business_term", "Pay order"), ("field", "title"), ("api_path", "/home"), ("api_path", "/x/y"), ("business_term", "line")} <= found
    assert ("field", "route") not in found and len(told) == 1
    with pytest.raises(ValueError):
        inputs.document_facts("a.docx", _zip())


def _zip():
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr("other.xml", "<a/>")
    return out.getvalue()


def test_snapshots(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    first = store.write({"files": files(spark, [("r", "a", "one")])})
    old = store.read(first)
    store.write({"files": files(spark, [("r", "a", "two")])})
    assert old.files.first()["content"] == "one" and store.read().files.first()["content"] == "two"
    store.write({})
    with pytest.raises(ValueError):
        store.read(first)
    for decision in ("confirm", "reject"):
        store.add_feedback({"report_id": "x", "subject_kind": "repository", "subject_key": "r", "decision": decision})
    assert [A.rules_at(store.feedback(), n).count() for n in (0, 1, 2)] == [0, 1, 2]


def git(folder, *args):
    subprocess.run(["git", "-C", str(folder), "-c", "user.email=a@b", "-c", "user.name=n", *args], check=True, capture_output=True)


def test_workspace_to_report(spark, tmp_path):
    folder = tmp_path / "w" / "shop"
    (folder / "src").mkdir(parents=True)
    git(tmp_path / "w", "init", "-q", str(folder))
    (folder / "src" / "OrderController.java").write_text(JAVA)
    (folder / "src" / "OrderService.java").write_text("package shop.core;\n@Service public class OrderService {\n  public String find(String a, int b) { return a; }\n}\n")
    git(folder, "add", ".")
    git(folder, "commit", "-qm", "one")
    git(folder, "remote", "add", "origin", "https://u:secret@example.com/x.git")
    git(folder, "update-ref", "refs/remotes/origin/main", "HEAD")
    git(folder, "symbolic-ref", "refs/remotes/origin/HEAD", "refs/remotes/origin/main")
    (folder / "src" / "OrderService.java").write_text("changed, not committed")
    row = workspace.discover(spark, str(tmp_path / "w")).first()
    assert row["remote_url"] == "https://example.com/x.git" and row["baseline_branch"] == "main"
    session = EvidenceSession(spark, str(tmp_path / "store"), str(tmp_path / "w"))
    session.call("refresh")
    assert session.call("refresh")["snapshot_id"] == "snapshot-001"
    found = session.call("find_business_context", {"text": "OrderService", "limit": 5})
    assert found["evidence"][0]["name"] == "shop.core.OrderService"
    traced = session.call("trace_code_path", {"target": "/orders/list"})
    assert [e["target"] for e in traced["paths"][-1]][-1] in ("shop.core.OrderService.find", "/orders/list")
    assert session.call("analyze_change_impact", {"target": "OrderService.find"})["relations"][0]["source"] == "shop.web.OrderController.list"
    assert session.call("get_symbol_context", {"target": "OrderController.list"})["counts"]["callees"] == 2
    assert session.call("list_contracts")["coverage"]["matched"] == 4
    assert session.call("analyze_change", {"range": "HEAD"})["evidence"]
    told = session.call("analyze_inputs", {"text": "change OrderController list"})
    assert session.call("get_analysis_report", {"report_id": told["report_id"]})["report"]["keywords"]
    assert session.call("record_analysis_feedback", {"report_id": told["report_id"], "subject_kind": "repository", "subject_key": "shop", "decision": "confirm"})["revision"] == 1
    for bad in ({"target": " "}, {"target": "x", "limit": 0}, {"target": "x", "view": "all"}, {"target": "x", "repository": "none"}):
        with pytest.raises(ValueError):
            session.call("get_symbol_context", bad)


def test_feedback_stream(spark, tmp_path):
    import json

    from lodeweave.streaming.feedback import keep_rules

    (tmp_path / "in").mkdir()
    rows = [{"revision": i, "id": str(i), "subject_kind": "repository", "subject_key": "r", "decision": "confirm", "note": f"n{i}"} for i in (1, 2)]
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, rows)))
    keep_rules(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    assert [r["note"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["n2"]


def test_merged_coverage_has_all_reasons(spark):
    """A part without reasons loses none of the others; the first part that has a reason places it."""
    rows = [(3, True, False, 1, 0, 1, 2, ["c", "a"]), (1, True, True, 0, 1, 1, 2, ["b", "a", "b"]), (2, True, False, 0, 0, 1, 2, None), (4, True, False, 0, 0, 1, 2, [])]
    parts = spark.createDataFrame(rows, "at long, complete boolean, truncated boolean, unresolved long, diagnostics long, returned long, matched long, reasons array<string>")
    got = ranking.merge_coverage(parts, "at").collect()
    assert [tuple(r) for r in got] == [(True, True, 1, 1, 4, 8, ["b", "a", "c"])]
    assert ranking.merge_coverage(parts.limit(0), "at").first()["reasons"] == []
