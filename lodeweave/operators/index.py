"""Incremental refresh: what is new, changed or gone between two states of the files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compare_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """(repository_id, path, state) of all files: added, changed, removed or unchanged, by content hash."""
    a = old.select("repository_id", "path", F.col("content_hash").alias("old_hash"))
    b = new.select("repository_id", "path", F.col("content_hash").alias("new_hash"))
    both = a.join(b, ["repository_id", "path"], "full")
    state = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "removed").when(F.col("old_hash") != F.col("new_hash"), "changed").otherwise("unchanged")
    return both.select("repository_id", "path", state.alias("state"))


def replace_evidence(old: DataFrame, fresh: DataFrame, states: DataFrame) -> DataFrame:
    """An evidence table without the rows of files that are not as they were, with those extracted again."""
    touched = states.filter("state <> 'unchanged'").select("repository_id", "path")
    return old.join(touched, ["repository_id", "path"], "left_anti").unionByName(fresh)


def refresh_totals(states: DataFrame) -> DataFrame:
    return states.groupBy("repository_id").agg(
        F.count_if(F.col("state") != "removed").alias("indexed_files"),
        F.count_if(F.col("state").isin("added", "changed")).alias("changed_files"),
        F.count_if(F.col("state") == "removed").alias("removed_files"),
    )


def repository_states(found: DataFrame, indexed: DataFrame) -> DataFrame:
    """(repository_id, state): baseline_unknown, stale (another commit, or never indexed) or up_to_date."""
    mine = found.select("repository_id", "baseline_commit", "baseline_state")
    theirs = indexed.select("repository_id", F.col("baseline_commit").alias("indexed_commit"))
    state = (
        F.when(F.col("baseline_state") == "baseline_unknown", "baseline_unknown")
        .when(F.col("baseline_commit").eqNullSafe(F.col("indexed_commit")), "up_to_date")
        .otherwise("stale")
    )
    return mine.join(theirs, "repository_id", "left").select("repository_id", state.alias("state"))


def workspace_status(repositories: DataFrame, files: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Repositories with their numbers of files and diagnostics, zero where there are none."""
    n_files = files.groupBy("repository_id").agg(F.count(F.lit(1)).alias("file_count"))
    told = diagnostics.groupBy("repository_id").agg(F.count(F.lit(1)).alias("diagnostic_count"))
    joined = repositories.join(n_files, "repository_id", "left").join(told, "repository_id", "left")
    return joined.fillna(0, ["file_count", "diagnostic_count"])


def baseline_text(repositories: DataFrame) -> DataFrame:
    """One row: repository@commit of all with a commit, sorted, with commas between."""
    named = F.concat_ws("@", "repository_id", "baseline_commit")
    return repositories.filter("baseline_commit <> ''").agg(F.array_join(F.array_sort(F.collect_list(named)), ",").alias("baseline"))
