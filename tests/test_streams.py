"""Files as a stream of snapshots; extraction from SQL."""

from pyspark.sql import functions as F

from lodeweave.functions.sql import FOUND, register
from lodeweave.operators import graph as G
from lodeweave.operators.extract import extract_files
from lodeweave.plans.snapshots import SnapshotStore
from lodeweave.streaming.files import dropped_files, follow_files, take_batch
from tests.test_refresh import SERVICE


def test_dropped_files_become_snapshots(spark, tmp_path):
    drop, store = tmp_path / "drop", SnapshotStore(spark, str(tmp_path / "store"))
    for repository, name in (("a", "One"), ("b", "Two")):
        (drop / repository / "src").mkdir(parents=True)
        (drop / repository / "src" / f"{name}.java").write_text(SERVICE % name)
    (drop / "a" / "skipped.bin").write_bytes(b"\x00")
    run = lambda: follow_files(spark, str(drop), store, str(tmp_path / "checkpoint")).awaitTermination(300)
    assert run() and store.mark("files") == 0
    first = store.active
    assert {r["name"] for r in store.read().symbols.collect()} == {"shop.core.One", "shop.core.One.find", "shop.core.Two", "shop.core.Two.find"}
    # A batch that is done again, as after a crash before the checkpoint's commit, adds nothing.
    again = spark.createDataFrame([("a", "src/One.java", "other")], "repository_id string, path string, content string").withColumn("modified", F.current_timestamp())
    assert take_batch(store, "files", again, 0) == first and store.active == first
    assert run() and store.active == first
    (drop / "a" / "src" / "Three.java").write_text(SERVICE % "Three")
    assert run() and store.mark("files") == 1 and store.active != first
    found = store.read()
    assert {(r["repository_id"], r["path"]) for r in found.files.collect()} == {("a", "src/One.java"), ("a", "src/Three.java"), ("b", "src/Two.java")}
    assert {r["repository_id"] for r in found.repositories.collect()} == {"a", "b"}
    assert store.entry()["tables"]["files"][0] == {"of": first, "without": ["a"]}
    assert G.trace(G.stored_graph(found.symbols, store.derived()), "shop.core.Three.find")["start"]["path"] == "src/Three.java"
    assert dropped_files(spark, str(drop)).isStreaming


def test_extraction_from_sql(spark):
    rows = [("r", "A.java", SERVICE % "A"), ("r", "pom.xml", "<project><artifactId>x</artifactId></project>"), ("r", "app.yml", "spring:\n  application:\n    name: a\n"), ("r", None, None), ("r", "e.java", "")]
    files = spark.createDataFrame(rows, "repository_id string, path string, content string")
    files.createOrReplaceTempView("given_files")
    register(spark)
    found = spark.sql("select path, e.* from given_files, lateral extract_evidence(path, content) e")
    assert found.columns == ["path", *[c.split()[0] for c in FOUND.split(", ")]]
    for name, table in (("symbol", "symbols"), ("edge", "edges"), ("diagnostic", "diagnostics")):
        whole = extract_files(files)[table]
        columns = [c for c in whole.columns if c in found.columns]
        told = lambda df: sorted(map(repr, df.select(*columns).collect()))
        assert told(found.filter(F.col("table") == name)) == told(whole), name
    assert found.filter("`table` = 'symbol'").count() > 1
