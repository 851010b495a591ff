"""From one snapshot to the next: what changed is extracted, bound and indexed, the rest is named."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import index as I
from ..operators.extract import extract_files
from ..schemas import Evidence, evidence
from ..staging import stage, working_path
from .snapshots import SnapshotStore


def advance(
    store: SnapshotStore, files: DataFrame, moved: list[str], repositories: DataFrame, baseline: str = "", marks: dict | None = None, extract=extract_files
) -> str:
    """A snapshot in which the repositories `moved` have these files (a stored table); of all others everything stays.

    Only files with another hash are extracted. What is written are the rows of the repositories that moved, their
    relations as far as a change reaches them, and a segment of the text index. marks: see SnapshotStore.write().
    """
    spark = store.spark
    active = store.entry() if store.active else None
    old = store.read(active["id"]) if active else evidence(spark)

    def of(column: str) -> Column:
        return F.coalesce(F.col(column).isin(*moved), F.lit(False))

    def mine(df: DataFrame, column: str = "repository_id") -> DataFrame:
        return df.filter(of(column))

    compared = stage(I.compare_files(mine(old.files), files), "compared")
    fresh = files.join(compared.filter("state in ('added', 'changed')"), ["repository_id", "path"], "left_semi")
    found = evidence(spark, files=fresh, **extract(fresh, working_path(spark, "rows")))
    tables = {t: I.replace_evidence(mine(getattr(old, t)), getattr(found, t), compared) for t in ("files", "symbols", "edges", "contracts", "diagnostics")}
    tables["repositories"] = repositories

    def graph(whole: Evidence) -> dict[str, DataFrame]:
        if not active or "bound_relations" not in active["tables"]:
            bound = G.stored_relations(whole.symbols, whole.edges)
            return G.graph_tables(whole, bound, bound)
        before = store.derived(active["id"])["bound_relations"]
        bound = G.rebind_relations(mine(before, "repository"), compared, mine(old.symbols), mine(whole.symbols), mine(whole.edges))
        return G.graph_tables(whole, bound, before.filter(~of("repository")).unionByName(bound), moved)

    def index(whole: Evidence) -> list[dict]:
        if not active or not active["index"]:
            return store.index.add([], whole.files, whole.symbols)
        changed = compared.filter("state <> 'unchanged'")
        return store.index.add(active["index"], fresh, whole.symbols.join(changed, ["repository_id", "path"], "left_semi"), changed.filter("state <> 'added'"))

    return store.write(tables, baseline, graph, active, moved if active else None, index, marks)
