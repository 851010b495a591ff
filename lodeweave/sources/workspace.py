"""Repositories of a workspace, their baselines and files, from local Git data."""

from __future__ import annotations

import os
import subprocess
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identifiers as fn

# Folders that are never looked into.
SKIPPED = {".git", "target", "node_modules", "vendor", ".idea"}
BASELINE_KNOWN, BASELINE_UNKNOWN = "baseline_known", "baseline_unknown"
REPOSITORY = "path string, repository_id string, remote_url string, baseline_branch string, baseline_commit string, baseline_state string"
FILE_BATCH = 500


def _git(folder: str, *args: str) -> str | None:
    done = subprocess.run(["git", "-C", folder, *args], capture_output=True, text=True)
    return done.stdout.strip() if done.returncode == 0 else None


def _repositories(root: str) -> Iterator[str]:
    for folder, inner, _ in os.walk(root):
        if os.path.isdir(os.path.join(folder, ".git")):
            yield folder
        inner[:] = sorted(d for d in inner if d not in SKIPPED)


def discover(spark: SparkSession, root: str) -> DataFrame:
    """One row per repository below root, by path. A missing remote head is a state, not an error."""
    rows = []
    for folder in sorted(_repositories(root)):
        head = _git(folder, "symbolic-ref", "--quiet", "refs/remotes/origin/HEAD")
        commit = _git(folder, "rev-parse", "--verify", "--quiet", head) if head else None
        branch = (head or "").removeprefix("refs/remotes/origin/") if commit else ""
        name = os.path.relpath(folder, root).replace(os.sep, "/")
        rows.append((folder, name if name != "." else os.path.basename(folder), _git(folder, "config", "--get", "remote.origin.url") or "", branch, commit or "", BASELINE_KNOWN if commit else BASELINE_UNKNOWN))
    return spark.createDataFrame(rows, REPOSITORY).withColumn("remote_url", fn.without_user_info(F.col("remote_url")))


_ARCHIVED = "repository_id string, path string, content string"


def archived_files(repositories: DataFrame) -> DataFrame:
    """(repository_id, path, content_hash, content) of the indexed files at the repositories' commits.

    One archive stream a repository, read where the task runs, so the workspace has to be mounted there; a task never
    holds more than FILE_BATCH files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for repository, folder, commit in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                held: list[tuple[str, str, str]] = []
                for path, content in _archive(folder, commit):
                    held.append((repository, path, content.decode("utf-8", "replace")))
                    if len(held) == FILE_BATCH:
                        yield _batch(held)
                        held = []
                yield _batch(held)

    named = repositories.filter("baseline_commit <> ''").select("repository_id", "path", "baseline_commit")
    spread = named.repartition(max(1, min(named.count(), named.sparkSession.sparkContext.defaultParallelism)), "repository_id")
    return spread.mapInArrow(run, _ARCHIVED).select("repository_id", "path", F.sha2("content", 256).alias("content_hash"), "content")


def _batch(rows: list[tuple[str, str, str]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["repository_id", "path", "content"])


def _indexed(path: str) -> bool:
    return path.lower().endswith((*("." + s for s in fn.SUPPORTED), "pom.xml"))


def _archive(folder: str, commit: str) -> Iterator[tuple[str, bytes]]:
    """Path and bytes of each indexed regular file of a commit, from one archive stream; never the working tree."""
    with subprocess.Popen(["git", "-C", folder, "archive", "--format=tar", commit], stdout=subprocess.PIPE) as git:
        with tarfile.open(fileobj=git.stdout, mode="r|") as archive:
            for member in archive:
                if member.isfile() and _indexed(member.name):
                    yield member.name, archive.extractfile(member).read()
    if git.returncode:
        raise ValueError(f"no such commit in {folder}: {commit}")


def exported_files(spark: SparkSession, root: str, repository_id: str) -> DataFrame:
    """Files of an exported tree, read in parallel by Spark."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.lit(root.rstrip("/") + "/")
    path = F.substring_index(F.col("path"), base, -1)
    rows = rows.select(F.lit(repository_id).alias("repository_id"), path.alias("path"), F.decode("content", "UTF-8").alias("content"))
    return rows.filter(fn.is_supported(F.col("path"))).withColumn("content_hash", F.sha2("content", 256))


def _listed(repository, revision: str) -> list[str] | None:
    """Paths that a revision or a range touches in a repository; None if it doesn't know it."""
    how = ("diff", "--name-only", "-z") if ".." in revision else ("show", "--name-only", "--format=", "-z")
    listed = _git(repository["path"], *how, "--end-of-options", revision, "--")
    return None if listed is None else [p for p in listed.split("\0") if p]


def _at_baseline(repository, path: str) -> list[str]:
    """The path, with the repository's name in front or not, if the baseline has it."""
    name = repository["repository_id"]
    for prefix in (f"{name}/", f"{name.rpartition('/')[2]}/", ""):
        inner = path.removeprefix(prefix)
        if path.startswith(prefix) and _git(repository["path"], "cat-file", "-e", f"{repository['baseline_commit']}:{inner}") is not None:
            return [inner]
    return []


def changed_files(spark: SparkSession, repositories: DataFrame, revision: str) -> DataFrame:
    """(repository_id, path) that a path, a commit or a range a..b names in the repositories' baselines.

    What has a slash (or backslash) and no two dots is a path and nothing else; a name without any is a revision first.
    Repositories without a baseline are not asked; a change that no repository knows, or that is empty, is an error.
    """
    if revision.startswith("-"):
        raise ValueError(f"not a change: {revision}")
    path = revision.replace("\\", "/")
    rows = []
    for r in repositories.filter("baseline_commit <> ''").select("path", "repository_id", "baseline_commit").collect():
        if ".." not in revision and "/" in path:
            found = _at_baseline(r, path)
        else:
            found = _listed(r, revision)
            if found is None:
                found = [] if ".." in revision else _at_baseline(r, path)
        rows += [(r["repository_id"], p) for p in found]
    if not rows:
        raise ValueError(f"unknown change: {revision}")
    return spark.createDataFrame(rows, "repository_id string, path string").distinct()
