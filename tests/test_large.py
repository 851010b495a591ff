"""What shows only on larger tables: answers beyond a limit, and work that has to be spread over tasks."""

import time

from pyspark.sql import functions as F

from lodeweave import staging
from lodeweave.functions import identifiers as fn
from lodeweave.operators import contracts as C
from lodeweave.operators import graph as G
from lodeweave.operators import search as S
from lodeweave.operators.ranking import top_per_key
from lodeweave.operators.text_index import TextIndex, triples
from lodeweave.other_queries import _java_sources
from lodeweave.schemas import EDGES, SYMBOLS, evidence
from lodeweave.staging import stage

SF = "/root/testdata/sf0.001"


def test_coverage_tells_of_contracts_beyond_the_limit(spark):
    contracts = spark.createDataFrame(
        [(n, f"c{n}", "shop", f"f{n}", 1, "http", "consumer", "s", "GET:/x", f"a.C{n}") for n in range(5)],
        "contract_no long, contract_id string, repository_id string, path string, line int, kind string, role string, service string, contract_key string, symbol string",
    )
    links = spark.createDataFrame([(f"c{n}", "unresolved", "no_verified_provider") for n in range(5)], "contract_id string, status string, reason string")
    none = spark.createDataFrame([], "repository string, file string, line int, reason string, confidence string")
    told = C.contract_report(contracts, links, none, None, "", 2)
    assert told["contracts"].count() == 2 and told["links"].count() == 2
    row = told["coverage"].first()
    assert (row["unresolved"], row["returned"], row["matched"]) == (5, 2, 5)


def test_sources_of_a_small_table_are_many_tasks(spark):
    rows = _java_sources(spark, SF).rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    assert len(rows) >= spark.sparkContext.defaultParallelism and max(rows) < sum(rows)


def test_binding_stores_requests_not_relations(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(G, "stage", lambda df, label: stored.append(df.count()) or stage(df, label))
    symbols = spark.createDataFrame([("r", "f", n, "class", at, f"u{at}", "", at + 5) for at, n in ((1, "a.A"), (10, "a.B"), (20, "a.B"), (30, "a.C"))], SYMBOLS)
    edges = spark.createDataFrame([("r", "f", source, "a.C", "calls", line, "certain", "", None) for source in ("a.A", "a.B") for line in range(1, 31)], EDGES)
    rows = G.resolve_relations(symbols, edges).collect()
    assert max(stored) <= 3
    # Of two symbols of one name the one counts whose lines a relation lies in.
    ends = {10: "u10", 15: "u10", 16: None, 20: "u20", 25: "u20", 26: None}
    assert {r["line"]: r["source_id"] for r in rows if r["source"] == "a.B" and r["line"] in ends} == ends
    assert {(r["source_id"], r["target_id"]) for r in rows if r["source"] == "a.A"} == {("u1", "u30")} and len(rows) == 60


def test_a_term_of_many_files_is_one_row_a_block(spark, tmp_path):
    files = spark.range(600).selectExpr("'r' as repository_id", "'f' || id as path", "'the thing ' || id as content").coalesce(1)
    symbols = files.selectExpr("repository_id", "path", "'u' || path as uid", "'pkg.Thing.' || path as name")
    index = TextIndex(spark, str(tmp_path / "index"), fanout=2)
    state = index.add([], files.filter("path <> 'f7'"), symbols.filter("path <> 'f7'"))
    blocks = index.table(state, "files").select("block").distinct().count()
    assert index.table(state, "terms").filter("term = 'thing'").count() == blocks > 1
    # Merging fills the blocks, and what is dead goes.
    state = index.add(state, files.filter("path = 'f7'"), symbols.filter("path = 'f7'"), files.filter("path in ('f7', 'f8')"))
    assert len(state) == 1 and index.totals(state)[0] == 599 and index.table(state, "files").select("block").distinct().count() == 1
    assert index.table(state, "terms").filter("term = 'thing'").selectExpr("size(nos)").first()[0] == 599
    # f7, f70 to f79: the names with these triples, after f8 has gone.
    assert index.having(state, {0: triples(b"pkg"), 1: triples(b"g.f7")}, "symbol_grams").groupBy("query_no").count().collect() in ([(0, 599), (1, 11)], [(1, 11), (0, 599)])


def test_relations_are_scored_after_they_are_cut(spark):
    queries = S.queries_frame(spark, ["part", "Part.P1", "", "none", "part.p3 a.B"])
    edges = spark.range(500).selectExpr("'r' as repository_id", "'f' as path", "'a.B' as source", "'part.p' || id as target", "'calls' as kind", "cast(id as int) as line", "'certain' as confidence")
    whole = S.edge_candidates(edges, queries)
    assert {r["query_no"]: r["count"] for r in whole.groupBy("query_no").count().collect()} == {0: 500, 1: 111, 4: 111}
    order = ["tier", "repository", "file", "line", "name", "source"]
    first = top_per_key(whole, ["query_no"], [F.col(c) for c in order], 7).drop("rank_no")
    cut = S.edge_candidates(edges, queries, 7)
    assert sorted(map(repr, cut.collect())) == sorted(map(repr, first.collect())) and cut.count() == 21
    plan = cut._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index(str(fn.EDGE_SCORES[1])) < plan.index("row_number")


def test_relations_are_joined_without_sorting(spark):
    symbols = spark.createDataFrame([("r", "f", n, "class", 1, f"u{n}", "", 5) for n in ("a.A", "a.B")], SYMBOLS)
    edges = spark.createDataFrame([("r", "f", "a.A", "B", "calls", 2, "certain", "", None)], EDGES)
    found = G.resolve_relations(symbols, edges)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ShuffledHashJoin") == 2 and "SortMergeJoin" not in plan
    assert [(r["source_id"], r["target_id"]) for r in found.collect()] == [("ua.A", "ua.B")]


def _tangle(spark):
    """Names of one, two and three parts, some of several symbols, in two repositories; relations that ask for them in all ways."""
    names = ["A", "a.A", "a.B", "b.a.B", "a.b.C", "x.b.C", "D", "d.D", "a.m", "b.m"]
    held = [(r, f"f{n % 3}", name, ("class", "mapper_statement")[n % 4 == 3], 1 + 10 * (n % 2), f"{r}{n}", ("", "(int)", "(int, int)")[n % 3], 8 + 10 * (n % 2)) for r in "rs" for n, name in enumerate([*names, "a.B", "a.m"])]
    asked = [*names, "B", "C", "m", "b.C", "a.B", "none", "b/x.m"]
    kinds = ["calls", "uses", "implements", "queries_table", "route", "imports"]
    links = [("rs"[n % 2], f"f{n % 3}", names[n * 7 % 10], asked[n * 5 % 17], kinds[n % 6], n % 20, "certain", ("", "", "(int)")[n % 3], (None, 1, 2)[n // 3 % 3]) for n in range(240)]
    return evidence(spark, symbols=spark.createDataFrame(held, SYMBOLS), edges=spark.createDataFrame(links, EDGES))


def test_relations_bound_when_asked_for_are_those_of_the_whole_graph(spark):
    found = _tangle(spark)
    whole, lazy = G.load_graph(found), G.open_graph(found)
    rows = lambda df: sorted(map(repr, df.select(*G._RELATION).collect()))
    assert whole.relations.filter("target_id is not null").count() > 20 and whole.diagnostics.count() > 20
    for nodes in (["r0"], ["r3", "s3", "s1"], ["r2", "r10"]):
        assert rows(lazy.touching(nodes)) == rows(whole.touching(nodes))
        assert rows(lazy.touching(nodes, ("target_id",))) == rows(whole.touching(nodes, ("target_id",)))
    places = spark.createDataFrame([("r", "f0"), ("s", "f2")], "repository string, file string")
    told = ["repository", "file", "line", "reason", "confidence"]
    assert sorted(map(repr, lazy.diagnostics_in(places).select(*told).collect())) == sorted(map(repr, whole.diagnostics_in(places).select(*told).collect()))
    for ask in (lambda g: G.trace(g, "a.A", "r", 3, 9), lambda g: G.impact(g, "d.D", "s", 2, 9)):
        assert repr(ask(lazy)) == repr(ask(whole))


def test_a_question_binds_only_what_it_asks_for(spark, monkeypatch):
    symbols = spark.range(300).selectExpr("'r' as repository_id", "'f' || id % 40 as path", "'a.S' || id as name", "'class' as kind", "1 as line", "'u' || id as uid", "'' as signature", "9 as end_line")
    edges = spark.range(300).selectExpr("'r' as repository_id", "'f' || id % 40 as path", "'a.S' || id as source", "'S' || (id + 1) as target", "'calls' as kind", "2 as line", "'certain' as confidence")
    bound = []
    resolved = G._resolved
    monkeypatch.setattr(G, "_resolved", lambda rows, symbols: bound.append(rows.count()) or resolved(rows, symbols))
    told = G.trace(G.open_graph(evidence(spark, symbols=symbols, edges=edges)), "a.S7", max_depth=3)
    assert [[e["target_id"] for e in path] for path in told["paths"]] == [["u8", "u9", "u10"]]
    assert sum(bound) < 60


def test_symbols_are_counted_only_where_their_names_are_asked_for(spark):
    symbols = spark.createDataFrame([("r", "f", n, "class", 1, f"u{n}", "", 5) for n in ("a.A", "a.B", "a.B", "b.C")] + [("r", "g", "c.C", "class", 1, "uc.C", "", 5)], SYMBOLS)
    requests = stage(spark.createDataFrame([("r", n, "", -9) for n in ("a.B", "A", "C", "none")], "repository_id string, asked string, signature string, arity int"), "requests")
    few = {r["asked"]: (r["n"], r["one"] and r["one"]["uid"]) for r in G._answers(requests, symbols, "uid").collect()}
    # A symbol that is there twice counts once.
    assert few == {"a.B": (1, "ua.B"), "A": (1, "ua.A"), "C": (2, None)}
    plan = G._answers(requests, symbols, "uid")._jdf.queryExecution().optimizedPlan().toString()
    assert "Inner" in plan and plan.index("Aggregate") < plan.index("Inner")


def test_many_requests_are_answered_like_few(spark, monkeypatch):
    found = _tangle(spark)
    few = sorted(map(repr, G.resolve_relations(found.symbols, found.edges).select(*G._RELATION).collect()))
    monkeypatch.setattr(G, "FEW_REQUESTS", 0)
    assert sorted(map(repr, G.resolve_relations(found.symbols, found.edges).select(*G._RELATION).collect())) == few


def test_lists_are_made_where_relations_were_bound(spark, monkeypatch):
    """Relations are neither staged nor sent once more before they are packed."""
    plans, stored = [], []
    in_passes = G.stage_in_passes
    monkeypatch.setattr(G, "stage_in_passes", lambda rows, make, by, label: plans.append(make(rows)._jdf.queryExecution().executedPlan().toString()) or in_passes(rows, make, by, label))
    monkeypatch.setattr(G, "stage", lambda df, label: stored.append(df.count()) or stage(df, label))
    symbols = spark.createDataFrame([("r", "f", f"a.S{n}", "class", n, f"u{n}", "", n) for n in range(3)], SYMBOLS)
    edges = spark.createDataFrame([("r", "f", source, f"S{n % 3}", "calls", n, "certain", "", None) for n in range(30) for source in ("a.S0", "S0")], EDGES)
    made = G.packed_graph(evidence(spark, symbols=symbols, edges=edges)).lists["outgoing_lists"]
    plan = plans[0][: plans[0].index("ShuffledHashJoin")]
    assert "Window [" in plan and "Exchange" not in plan and max(stored) <= 5
    # A list for either name of the source.
    assert [(r["node"], len(r["edges"])) for r in made.collect()] == [("u0", 30), ("u0", 30)]


def test_walks_on_lists_of_several_names(spark):
    found = _tangle(spark)
    whole, lists = G.load_graph(found), G.packed_graph(found)
    several = [r["node"] for r in lists.lists["outgoing_lists"].groupBy("node").count().filter("count > 1").orderBy("node").collect()]
    for start in several[:2]:
        a, b = (G.walk(g, {"uid": start}, 3, 9) for g in (whole, lists))
        told = lambda w: [[[e[c] for c in ("place", *G._RELATION)] for e in path] for path in w.paths]
        assert a.paths and told(a) == told(b) and a.coverage() == b.coverage()


def test_relations_are_bound_share_by_share(spark, monkeypatch):
    found = _tangle(spark)
    rows = lambda df: sorted(map(repr, df.select(*G._RELATION).collect()))
    lists = lambda: sorted(map(repr, G.packed_graph(found).lists["outgoing_lists"].collect()))
    wanted, packed = rows(G.resolve_relations(found.symbols, found.edges)), lists()
    old = evidence(spark, symbols=found.symbols.filter("path <> 'f1'"), edges=found.edges.filter("path <> 'f1'"))
    states = spark.createDataFrame([(r, f"f{n}", "added" if n == 1 else "unchanged") for r in "rs" for n in range(3)], "repository_id string, path string, state string")
    monkeypatch.setattr(staging, "ROWS_A_PASS", 50)
    written, write = [], staging._write
    monkeypatch.setattr(staging, "_write", lambda df, folder: written.append(df.count()) or write(df, folder))
    before = G.stored_relations(old.symbols, old.edges)
    assert rows(before) == rows(G.resolve_relations(old.symbols, old.edges))
    assert rows(G.stored_relations(found.symbols, found.edges)) == wanted == rows(G.rebind_relations(before, states, old.symbols, found.symbols, found.edges))
    # 134 relations that are walked at first, 200 in the end; a share is none, or all, of those that are equal.
    assert len([n for n in written if n]) > 10 and max(written) < 150
    assert len(packed) > 10 and lists() == packed


def test_rebinding_stages_names_and_answers_only(spark, monkeypatch):
    """Relations are staged once, as the result, also if a change reaches all of them."""
    symbols = spark.createDataFrame([("r", f"f{n[-1]}", n, "class", at, f"u{at}", "", at + 5) for at, n in ((1, "a.A"), (10, "a.B"), (20, "a.C"))], SYMBOLS)
    edges = spark.createDataFrame([("r", "fA", "a.A", target, "calls", line, "certain", "", None) for target in ("a.B", "C", "none") for line in range(1, 31)], EDGES)
    old = symbols.filter("name <> 'a.B'").unionByName(spark.createDataFrame([("r", "fC", "b.C", "class", 30, "u30", "", 35)], SYMBOLS))
    before = G.resolve_relations(old, edges)
    states = spark.createDataFrame([("r", "fB", "added"), ("r", "fC", "changed")], "repository_id string, path string, state string")
    stored = []
    monkeypatch.setattr(G, "stage", lambda df, label: stored.append(df.count()) or stage(df, label))
    got = G.rebind_relations(before, states, old, symbols, edges)
    assert max(stored) <= 8
    whole = G.resolve_relations(symbols, edges)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, whole.select(*got.columns).collect()))
    assert {(r["target"], r["target_id"], r["reason"]) for r in got.collect()} == {("a.B", "u10", ""), ("C", "u20", ""), ("none", None, "unresolved_target")}


def test_shuffles_of_staged_tables_are_not_kept(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: {n for n in (str(files.getAllFiles().apply(i)) for i in range(files.getAllFiles().size())) if "shuffle_" in n}
    before = held()
    made = stage(spark.range(5000).groupBy((F.col("id") % 700).alias("k")).count(), "counts")
    assert made.count() == 700
    for _ in range(50):
        mine = {n for n in held() - before if n.endswith(".data")}
        # Only that of the count just made may be there still.
        if len(mine) <= 1:
            break
        time.sleep(0.2)
    assert len(mine) <= 1
