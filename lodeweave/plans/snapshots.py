"""Immutable snapshots that share what did not change, and a manifest that is replaced in one step.

A snapshot names, for each table, the pieces it is made of: folders that it or an earlier snapshot wrote, and the
repositories whose rows in them no longer count. A refresh writes the rows of the repositories that moved and names
the rest. A folder goes when no kept snapshot names it any more; tables of very many pieces are written whole again.
"""

from __future__ import annotations

import fcntl
import json
import os
import re
import shutil
import threading
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import Future
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.text_index import TextIndex
from ..schemas import FEEDBACK, REPORTS, SCHEMA_VERSION, TABLES, Evidence

KEPT = 2
MOST_PIECES = 8
HEADROOM = 128 << 20
#: Tables whose rows belong to one repository, and the column that names it; all others are written whole.
BY_REPOSITORY = {t: "repository_id" for t in TABLES if t != "repositories"} | {"bound_relations": "repository", "bound_incoming": "repository", "graph_diagnostics": "repository"} | {
    "outgoing_lists": "repository", "incoming_lists": "repository"
}


def _one_piece_each(manifest: dict) -> dict:
    """To version 12: a snapshot of version 10 or 11 is one piece a table; its graph and its index are made again when needed."""
    entries = [
        {"id": s["id"], "baseline": s["baseline"], "tables": s.get("tables", {t: [{"of": s["id"], "without": []}] for t in TABLES}), "derived": [], "index": s.get("index", [])}
        for s in manifest["snapshots"]
    ]
    for entry in entries:
        entry["tables"] = {t: pieces for t, pieces in entry["tables"].items() if t in TABLES}
    return manifest | {"schema": 12, "snapshots": entries}


def _index_anew(manifest: dict) -> dict:
    """To version 13: the text index is made again by the next refresh, in blocks; until then files are scanned."""
    return manifest | {"schema": 13, "snapshots": [s | {"index": []} for s in manifest["snapshots"]]}


def _graph_anew(manifest: dict) -> dict:
    """To version 14: relations keep the signatures of their sources, lists what their node doesn't tell; the graph is made again when needed."""
    entries = [s | {"tables": {t: pieces for t, pieces in s["tables"].items() if t in TABLES}, "derived": []} for s in manifest["snapshots"]]
    return manifest | {"schema": 14, "snapshots": entries}


#: By the version that they begin with. They change what the manifest says, not what is stored, each time it is read
#: until the next commit writes it; reports, feedback and its revision are the same in all versions.
MIGRATIONS: dict[int, Callable[[dict], dict]] = {10: _one_piece_each, 11: _one_piece_each, 12: _index_anew, 13: _graph_anew}


class SnapshotStore:
    """Snapshots, reports and feedback below a folder of the driver's file system (a mounted share on a cluster)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self._lock = threading.Lock()
        self._refreshing: Future | None = None
        self._mine: str | None = None
        os.makedirs(root, exist_ok=True)
        self.index = TextIndex(spark, os.path.join(root, "index"))
        self.clean()

    @contextmanager
    def _alone(self) -> Iterator[None]:
        """One writer of the manifest at a time, among threads and among processes; a dead one's lock goes with it."""
        with self._lock, open(os.path.join(self.root, ".lock"), "w") as held:
            fcntl.flock(held, fcntl.LOCK_EX)
            yield

    def _manifest(self) -> dict:
        path = os.path.join(self.root, "manifest.json")
        if not os.path.exists(path):
            return {"schema": SCHEMA_VERSION, "snapshots": [], "active": None, "revision": 0}
        with open(path) as opened:
            manifest = json.load(opened)
        if manifest["schema"] > SCHEMA_VERSION:
            raise ValueError(f"schema {manifest['schema']} is newer than {SCHEMA_VERSION}")
        while manifest["schema"] in MIGRATIONS:
            manifest = MIGRATIONS[manifest["schema"]](manifest)
        if manifest["schema"] < SCHEMA_VERSION:
            # Older snapshots are not read; the next refresh makes one anew. Reports and feedback stay as they are.
            manifest |= {"schema": SCHEMA_VERSION, "snapshots": [], "active": None, "last": self._last(manifest)}
        return manifest

    @staticmethod
    def _last(manifest: dict) -> int:
        return max([manifest.get("last", 0), *[int(s["id"].rpartition("-")[2]) for s in manifest["snapshots"]]])

    def _replace(self, manifest: dict) -> None:
        path = os.path.join(self.root, f".manifest-{uuid.uuid4().hex}")
        with open(path, "w") as opened:
            json.dump(manifest, opened)
            opened.flush()
            os.fsync(opened.fileno())
        os.replace(path, os.path.join(self.root, "manifest.json"))

    def clean(self) -> None:
        """Removes folders and segments that no manifest names: what an interrupted refresh left."""
        if self._others_write():
            return
        snapshots = self._manifest()["snapshots"]
        known = {s["id"] for s in snapshots} | {p["of"] for s in snapshots for pieces in s["tables"].values() for p in pieces}
        for name in os.listdir(self.root):
            if re.fullmatch(r"snapshot-\d+", name) and name not in known:
                shutil.rmtree(os.path.join(self.root, name), ignore_errors=True)
        self.index.drop_others([s["index"] for s in snapshots])

    @property
    def active(self) -> str | None:
        return self._manifest()["active"]

    def next_id(self) -> str:
        return f"snapshot-{self._last(self._manifest()) + 1:03d}"

    def _others_write(self) -> bool:
        """Whether another process is writing a snapshot: then nothing is cleared until a later one ends."""
        for name in os.listdir(self.root):
            mark = os.path.join(self.root, name, ".writing")
            if name != self._mine and os.path.exists(mark):
                with open(mark) as opened:
                    try:
                        fcntl.flock(opened, fcntl.LOCK_EX | fcntl.LOCK_NB)
                    except BlockingIOError:
                        return True
        return False

    @contextmanager
    def _claimed(self) -> Iterator[str]:
        """A new snapshot's folder, marked as being written; of several processes each gets its own."""
        number = self._last(self._manifest()) + 1
        while True:
            name = f"snapshot-{number:03d}"
            try:
                os.mkdir(os.path.join(self.root, name))
                break
            except FileExistsError:
                number += 1
        with open(os.path.join(self.root, name, ".writing"), "w") as mark:
            fcntl.flock(mark, fcntl.LOCK_EX)
            self._mine = name
            try:
                yield name
            finally:
                self._mine = None

    def _size(self, folder: str) -> int:
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names)

    def write(
        self, tables: dict[str, DataFrame], baseline: str = "", derive: Callable[[Evidence], dict[str, DataFrame]] | None = None,
        over: dict | None = None, repositories: list[str] | None = None, index: Callable[[Evidence], list[dict]] | None = None,
        marks: dict | None = None,
    ) -> str:
        """A new snapshot from its tables, and those derived from them; readers see the one before until it is whole.

        over, repositories: an entry() whose rows of all other repositories are taken over; tables and derive() then give
        only rows of these repositories in the tables of BY_REPOSITORY. index: gives the state of the text index.
        marks: numbers by name that are committed with the snapshot, see mark().
        """
        size = sum(self._size(os.path.join(self.root, d)) for d in {p["of"] for pieces in over["tables"].values() for p in pieces}) if over else 0
        if shutil.disk_usage(self.root).free < 2 * size + HEADROOM:
            raise OSError("not enough free space for a snapshot")
        with self._claimed() as name:
            entry = {"id": name, "baseline": baseline, "tables": {}, "derived": [], "index": []}
            for table, schema in TABLES.items():
                df = tables.get(table)
                entry["tables"][table] = self._pieces(name, table, self.spark.createDataFrame([], schema) if df is None else df, over, repositories)
            derived = derive(self._evidence(entry)) if derive else {}
            for table, df in derived.items():
                entry["tables"][table] = self._pieces(name, table, df, over, repositories)
            entry["derived"] = sorted(derived)
            if index:
                entry["index"] = index(self._evidence(entry))
            for table in entry["tables"]:
                if not os.path.exists(os.path.join(self.root, name, table, "_SUCCESS")):
                    raise OSError(f"snapshot is not whole: {table}")
            with self._alone():
                manifest = self._manifest()
                manifest["snapshots"] = [*manifest["snapshots"], entry][-KEPT:]
                manifest |= {"active": name, "last": max(self._last(manifest), int(name.rpartition("-")[2])), "marks": manifest.get("marks", {}) | (marks or {})}
                self._replace(manifest)
                self.clean()
        return name

    def _pieces(self, name: str, table: str, df: DataFrame, over: dict | None, repositories: list[str] | None) -> list[dict]:
        """Writes the new rows of a table; the pieces that make it up, the new one last."""
        held, column = (over or {"tables": {}})["tables"].get(table, []), BY_REPOSITORY.get(table)
        if column is None or repositories is None:
            held = []
        held = [p | {"without": sorted({*p["without"], *repositories})} for p in held]
        if len(held) + 1 > MOST_PIECES:
            df, held = self._union(table, held).unionByName(df), []
        df.write.mode("overwrite").parquet(os.path.join(self.root, name, table))
        return [*held, {"of": name, "without": []}]

    def _union(self, table: str, pieces: list[dict]) -> DataFrame:
        out = None
        for piece in pieces:
            path = os.path.join(self.root, piece["of"], table)
            rows = self.spark.read.schema(TABLES[table]).parquet(path) if table in TABLES else self.spark.read.parquet(path)
            if piece["without"]:
                rows = rows.filter(~F.coalesce(F.col(BY_REPOSITORY[table]).isin(*piece["without"]), F.lit(False)))
            out = rows if out is None else out.unionByName(rows)
        return out

    def _evidence(self, entry: dict) -> Evidence:
        return Evidence(**{t: self._union(t, entry["tables"][t]) for t in TABLES})

    def entry(self, snapshot_id: str | None = None) -> dict:
        """What the manifest says of a snapshot, or of the active one; one that is gone is an error, never a newer one."""
        manifest = self._manifest()
        name = snapshot_id or manifest["active"]
        if name is None:
            raise ValueError("there is no snapshot yet")
        found = next((s for s in manifest["snapshots"] if s["id"] == name), None)
        if found is None:
            raise ValueError(f"snapshot is not kept any more: {name}")
        return found

    def mark(self, name: str) -> int:
        """The number that was last committed under a name, -1 if none was."""
        return self._manifest().get("marks", {}).get(name, -1)

    def read(self, snapshot_id: str | None = None) -> Evidence:
        return self._evidence(self.entry(snapshot_id))

    def derived(self, snapshot_id: str | None = None) -> dict[str, DataFrame]:
        found = self.entry(snapshot_id)
        return {t: self._union(t, found["tables"][t]) for t in found["derived"]}

    def start(self, job: Callable[[], str]) -> Future:
        """Runs job() in a thread, once for all that ask while it runs."""
        with self._lock:
            if self._refreshing is None:
                self._refreshing = running = Future()
                threading.Thread(target=self._run, args=(job, running), daemon=True).start()
            return self._refreshing

    def _run(self, job: Callable[[], str], running: Future) -> None:
        try:
            found, problem = job(), None
        except BaseException as raised:
            found, problem = None, raised
        with self._lock:
            self._refreshing = None
        if problem is None:
            running.set_result(found)
        else:
            running.set_exception(problem)

    def refresh(self, job: Callable[[], str]) -> str:
        return self.start(job).result()

    # reports and feedback are logs that only grow

    def _log(self, name: str, schema: str) -> DataFrame:
        path = os.path.join(self.root, name)
        return self.spark.read.schema(schema).parquet(path) if os.path.exists(path) else self.spark.createDataFrame([], schema)

    def save_report(self, record: dict) -> None:
        self.spark.createDataFrame([tuple(record[c.split()[0]] for c in REPORTS.split(", "))], REPORTS).write.mode("append").parquet(os.path.join(self.root, "reports"))

    def reports(self) -> DataFrame:
        return self._log("reports", REPORTS)

    def add_feedback(self, row: dict) -> int:
        """Appends feedback under the next revision. The row counts from the moment the manifest names its revision."""
        with self._alone():
            manifest = self._manifest()
            revision = manifest["revision"] + 1
            full = {"revision": revision, "id": str(uuid.uuid4()), "note": "", "created_at": ""} | row
            self.spark.createDataFrame([tuple(full[c.split()[0]] for c in FEEDBACK.split(", "))], FEEDBACK).write.mode("append").parquet(os.path.join(self.root, "feedback"))
            self._replace(manifest | {"revision": revision})
        return revision

    def feedback(self) -> DataFrame:
        return self._log("feedback", FEEDBACK).filter(f"revision <= {self._manifest()['revision']}")

    @property
    def revision(self) -> int:
        return self._manifest()["revision"]
