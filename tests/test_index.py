"""The stored index and the rebinding of relations against doing everything again."""

import random

import pytest
from pyspark.sql import functions as F

from lodeweave.operators import graph as G
from lodeweave.operators import search as S
from lodeweave.operators.index import compare_files
from lodeweave.operators.text_index import TextIndex
from lodeweave.schemas import EDGES, SYMBOLS, evidence

WORDS = ["alpha", "Beta", "gamma", "Éclair", "x", "naïve", "delta_9", "foo.bar", "日本語", "İstanbul"]


def some_files(rng, names):
    return {(f"r{rng.randrange(2)}", n): " ".join(rng.choice(WORDS) for _ in range(rng.randrange(30))) for n in names}


def frame(spark, files):
    return spark.createDataFrame([(r, p, c) for (r, p), c in files.items()], "repository_id string, path string, content string")


def named(spark, files):
    rows = [(r, p, f"u{r}{p}", f"pkg.{p.title()}.{c.split()[0] if c else 'none'}") for (r, p), c in files.items()]
    return spark.createDataFrame(rows, "repository_id string, path string, uid string, name string")


def test_index_after_changes(spark, tmp_path):
    """Through adding, changing, removing and merging the index answers as a scan of the files there are."""
    rng = random.Random(2)
    index, state, files = TextIndex(spark, str(tmp_path / "index"), fanout=2), [], some_files(rng, [f"f{i}" for i in range(25)])
    state = index.add(state, frame(spark, files), named(spark, files))
    states = [(state, dict(files))]
    for step in range(3):
        keys = sorted(files)
        gone, changed = keys[step : step + 3], keys[10 + step : 13 + step]
        files = {k: v for k, v in files.items() if k not in gone}
        new = {k: " ".join(rng.choice(WORDS) for _ in range(9)) for k in changed} | some_files(rng, [f"n{step}"])
        files |= new
        state = index.add(state, frame(spark, new), named(spark, new), spark.createDataFrame([*gone, *new], "repository_id string, path string"))
        states.append((state, dict(files)))
    queries = S.queries_frame(spark, ["alpha beta", "ECLAIR", "ta g", "x", "%", "naïve", "pkg.F1", "İstanbul"])
    for state, held in states[1:3] + states[-1:]:
        all_files = frame(spark, held)
        scan, stored, asked = S.scan_files(all_files, queries), S.Indexed(index, state, all_files), S.asked_terms(queries)
        assert index.totals(state) == (len(held), scan.rows.agg(F.sum("length")).first()[0])
        shown = lambda df, *c: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select("query_no", "repository_id", "path", *c).collect())
        assert shown(S.indexed_ranks(stored, asked), "rank") == shown(S.full_text_ranks(scan), "rank")
        assert shown(S.indexed_ranks(stored, asked, "r1"), "rank") == shown(S.full_text_ranks(scan, "r1"), "rank")
        literal = S.substring_candidates(scan).select("query_no", F.col("repository").alias("repository_id"), F.col("file").alias("path"), "line")
        assert shown(S.indexed_texts(stored, asked), "line") == shown(literal, "line")
        symbols = evidence(spark, symbols=named(spark, held)).symbols
        ids = lambda df: sorted((r["query_no"], r["id"], r["score"]) for r in df.collect())
        assert ids(S.indexed_symbols(stored, symbols, queries)) == ids(S.symbol_candidates(symbols, queries))
    # Old segments go with the last state that names them; the last state still answers.
    index.drop_others([states[-1][0]])
    assert {p.name for p in (tmp_path / "index").iterdir()} == index.names(states[-1][0])
    assert S.indexed_ranks(S.Indexed(index, states[-1][0], frame(spark, files)), S.asked_terms(queries)).count() > 0


def test_empty_index(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "index"))
    none = spark.createDataFrame([], "repository_id string, path string, content string")
    for state in ([], index.add([], none)):
        stored, asked = S.Indexed(index, state, none), S.asked_terms(S.queries_frame(spark, ["alpha", "x"]))
        assert S.indexed_ranks(stored, asked).count() == 0 and S.indexed_texts(stored, asked).count() == 0


def test_a_change_adds_one_segment(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "index"))
    state = index.add([], frame(spark, {("r", "a"): "one two", ("r", "b"): "two three"}))
    before = {p for p in (tmp_path / "index").rglob("*.parquet")}
    again = index.add(state, frame(spark, {("r", "b"): "four"}), gone=spark.createDataFrame([("r", "b")], "repository_id string, path string"))
    assert again[:1] == state and len(again) == 2 and before <= set((tmp_path / "index").rglob("*.parquet"))
    assert [r["path"] for r in index.postings(again, ["two"]).collect()] == ["a"]
    # A word of the repository and one of the path, and those of the text.
    assert index.totals(again) == (2, 4 + 3)


def random_code(rng, files):
    """Symbols and relations of some files; names clash within and across files."""
    symbols, edges = [], []
    for path in files:
        for k in range(rng.randrange(4)):
            name = rng.choice(["a.B", "a.B.run", "c.B.run", "run", "x.y.Z.go", "Z.go", "q.M"])
            kind = rng.choice(["class", "method", "mapper_statement"])
            symbols.append(("r" + path[-1], path, name, kind, 10 * k + 1, None, rng.choice(["", "(int a)", "()"]), 10 * k + 8))
        for k in range(rng.randrange(5)):
            edges.append(("r" + path[-1], path, rng.choice(["a.B.run", "run", "q.M"]), rng.choice(["B.run", "run", "y.Z.go", "a.B", "Z.go", "none"]), rng.choice(["calls", "uses", "queries_table", "imports"]), 10 * k + 2, "certain", rng.choice(["", "", "()"]), rng.choice([None, None, 0, 1])))
    return symbols, edges


@pytest.mark.parametrize("seed", [1, 2])
def test_rebinding_equals_binding(spark, seed):
    rng = random.Random(seed)
    files = [f"f{i}{i % 2}" for i in range(12)]
    code = {f: random_code(rng, [f]) for f in files}
    made = lambda code: evidence(spark, symbols=spark.createDataFrame([s for c in code.values() for s in c[0]], SYMBOLS), edges=spark.createDataFrame([e for c in code.values() for e in c[1]], EDGES))
    hashes = lambda code: spark.createDataFrame([("r" + f[-1], f, repr(c)) for f, c in code.items()], "repository_id string, path string, content_hash string")
    old = made(code)
    bound = G.resolve_relations(old.symbols, old.edges)
    then = {f: c for f, c in code.items() if f != files[0]}
    for f in (files[1], files[2]):
        then[f] = random_code(rng, [f])
    then[files[3]] = ([s for s in code[files[3]][0]][1:], code[files[3]][1])
    then["new0"] = random_code(rng, ["new0"])
    new = made(then)
    got = G.rebind_relations(bound, compare_files(hashes(code), hashes(then)), old.symbols, new.symbols, new.edges)
    rows = lambda df: sorted(map(repr, df.collect()))
    whole = G.resolve_relations(new.symbols, new.edges)
    assert rows(got) == rows(whole.select(*got.columns)) and whole.count() > 10


def test_nothing_stays_cached(spark):
    """Engine queries keep what they need in the shared folder, so a long session holds no blocks of theirs."""
    from lodeweave import queries as engine
    from tests.conftest import SF

    held = lambda: spark.sparkContext._jsc.getPersistentRDDs().size()
    before = held()
    for name in ("trace_route", "search_ranked", "req_evidence", "index_search_fts"):
        engine.queries()[name](spark, SF).count()
    assert held() == before
