"""Files that are dropped into a folder become snapshots, each batch exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import identifiers as fn
from ..operators.ranking import first_of_key
from ..plans.refresh import advance
from ..plans.snapshots import SnapshotStore
from ..schemas import evidence
from ..staging import stage

_BINARY = "path string, modificationTime timestamp, length long, content binary"


def dropped_files(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of (repository_id, path, content, modified): FOLDER/repository/path/in/it; only kinds that are indexed."""
    rows = spark.readStream.format("binaryFile").schema(_BINARY).option("recursiveFileLookup", "true").load(folder)
    inner = F.substring_index(F.col("path"), folder.rstrip("/") + "/", -1)
    rows = rows.select(inner.alias("inner"), F.decode("content", "UTF-8").alias("content"), F.col("modificationTime").alias("modified"))
    split = rows.select(F.substring_index("inner", "/", 1).alias("repository_id"), F.regexp_replace("inner", "^[^/]*/", "").alias("path"), "content", "modified")
    return split.filter(fn.is_supported(F.col("path")))


def take_batch(store: SnapshotStore, stream: str, rows: DataFrame, batch: int) -> str | None:
    """The snapshot with a batch's files in place of those they replace; None if the store has this batch of the stream already.

    The batch's number is committed with the snapshot, in one step: a batch that is done again adds nothing.
    """
    if store.mark(stream) >= batch:
        return store.active
    came = first_of_key(rows.withColumn("order", -F.unix_micros("modified")).drop("modified"), ["repository_id", "path"], ["order", "content"]).drop("order")
    came = stage(came.withColumn("content_hash", F.sha2("content", 256)), "came")
    moved = [r[0] for r in came.select("repository_id").distinct().collect()]  # repositories, not files
    if not moved:
        return store.active
    old = store.read() if store.active else evidence(store.spark)
    kept = old.files.filter(F.col("repository_id").isin(*moved)).join(came, ["repository_id", "path"], "left_anti")
    files = stage(kept.unionByName(came), "files")
    known = old.repositories
    new = came.select("repository_id").distinct().join(known, "repository_id", "left_anti")
    new = new.select("repository_id", F.lit("").alias("baseline_branch"), F.lit("").alias("baseline_commit"), F.lit("baseline_unknown").alias("baseline_state"), F.lit("").alias("indexed_at"))
    baseline = store.entry()["baseline"] if store.active else ""
    return store.refresh(lambda: advance(store, files, moved, known.unionByName(new), baseline, {stream: batch}))


def follow_files(spark: SparkSession, folder: str, store: SnapshotStore, checkpoint: str, stream: str = "files", most: int = 10_000) -> StreamingQuery:
    """Takes what lies in the folder, `most` files a batch, and ends; a later call goes on where this one ended."""
    rows = dropped_files(spark, folder).writeStream.option("checkpointLocation", checkpoint)
    return rows.foreachBatch(lambda df, batch: take_batch(store, stream, df, batch) and None).trigger(availableNow=True).start()
