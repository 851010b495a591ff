"""Exact dedup with a sharded cuckoo-filter index of live digests.

The digest of a text is SHA-256 over the text with every run of white space
made one space. Digests are dealt to shards by their leading bits, and each
shard has a cuckoo filter (16-bit fingerprints, four to a bucket). What is stored
(digest, document, content) lies in tables bucketed by digest. A batch is first
reduced to one row a digest, so a group of copies of any size costs one key.
Filter misses are new for certain; hits are verified by merging with the stored
buckets and comparing the content itself. Batches come in any order: where one
brings a smaller document for a live digest, the old entry is deleted from the
index and the new one inserted. New digests are inserted; a shard whose filter
overflows is rebuilt at twice the size from its stored keys.

Shards are the unit of memory: their number follows the expected number of
keys, so that a task never holds more than about SHARD_KEYS of them.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, given_id, one_space, row_id, write_bucketed

SHARD_KEYS = 1 << 17
LEAST_SHARDS = 64
SLOTS = 4
MAX_KICKS = 200
LOAD = 0.9
BATCHES = 3

_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class CuckooFilter:
    """16-bit fingerprints in 2**bits buckets of four; partial-key hashing, array-at-a-time."""

    def __init__(self, bits: int, table: np.ndarray | None = None):
        self.bits = bits
        self.mask = np.uint64((1 << bits) - 1)
        self.table = np.zeros((1 << bits, SLOTS), dtype=np.uint16) if table is None else table

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        buckets = max(2, int(keys / (SLOTS * LOAD)) + 1)
        return cls(int(np.ceil(np.log2(buckets))))

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        table = np.frombuffer(data, dtype=np.uint16).reshape(-1, SLOTS).copy()
        return cls(int(np.log2(len(table))), table)

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mixed = _mix(keys)
        prints = (mixed >> np.uint64(48)).astype(np.uint16)
        prints[prints == 0] = 1
        first = mixed & self.mask
        return prints, first, self._other(first, prints)

    def _other(self, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        return bucket ^ (_mix(prints.astype(np.uint64)) & self.mask)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        prints, first, second = self._places(keys)
        return (self.table[first] == prints[:, None]).any(1) | (self.table[second] == prints[:, None]).any(1)

    def insert(self, keys: np.ndarray) -> bool:
        """False if some keys found no slot; the filter is then of no more use."""
        prints, bucket, _ = self._places(keys)
        rng = np.random.default_rng(len(keys))
        for turn in range(MAX_KICKS):
            prints, bucket = self._settle(prints, bucket)
            if not len(prints):
                return True
            if turn == 0:
                bucket = self._other(bucket, prints)
                continue
            # One evicted print a bucket and turn; the evicted ones look for their other bucket.
            _, pick = np.unique(bucket, return_index=True)
            slots = rng.integers(0, SLOTS, len(pick))
            evicted = self.table[bucket[pick], slots].copy()
            self.table[bucket[pick], slots] = prints[pick]
            moved = prints.copy()
            moved[pick] = evicted
            bucket = self._other(bucket, moved) if len(pick) == len(bucket) else np.where(
                np.isin(np.arange(len(bucket)), pick), self._other(bucket, moved), bucket
            )
            prints = moved
        return False

    def _settle(self, prints: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Puts what fits into free slots of `bucket`; returns the rest."""
        order = np.argsort(bucket, kind="stable")
        prints, bucket = prints[order], bucket[order]
        starts = np.r_[True, bucket[1:] != bucket[:-1]]
        place = np.arange(len(bucket)) - np.maximum.accumulate(np.where(starts, np.arange(len(bucket)), 0))
        free = self.table[bucket] == 0
        fits = place < free.sum(1)
        wanted = np.cumsum(free, axis=1) == (place + 1)[:, None]
        slot = np.argmax(wanted & free, axis=1)
        self.table[bucket[fits], slot[fits]] = prints[fits]
        return prints[~fits], bucket[~fits]

    def delete(self, keys: np.ndarray) -> None:
        for value, one, two in zip(*self._places(keys)):
            for bucket in (one, two):
                at = np.flatnonzero(self.table[bucket] == value)
                if len(at):
                    self.table[bucket, at[0]] = 0
                    break


def _keys(digests: pd.Series) -> np.ndarray:
    """The second eight bytes of each digest; the first ones choose the shard."""
    return np.frombuffer(b"".join(d[8:16] for d in digests), dtype=np.uint64).copy()


def digest_of(text_col: str):
    return F.unhex(F.sha2(one_space(F.coalesce(F.col(text_col), F.lit(""))), 256))


_FILTERS = "shard int, n_keys long, data binary"
_STORED = "shard int, digest binary, doc long"


class CuckooIndex:
    """Live digests with the document that stands for each, and its content."""

    def __init__(self, spark: SparkSession, space: Workspace, expected_keys: int, first_sizing: int = 256):
        self.spark, self.space = spark, space
        self.shards = max(LEAST_SHARDS, -(-expected_keys // SHARD_KEYS))
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.first_sizing = first_sizing
        self.version = 0
        self.filters = spark.createDataFrame([], _FILTERS)
        self.prefix = f"exact_index_{uuid.uuid4().hex[:12]}"
        self.tables: list[str] = []
        self.dead = spark.createDataFrame([], "digest binary, doc long, run int")

    def with_shard(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("shard", F.pmod(F.xxhash64(F.substring("digest", 1, 8)), F.lit(self.shards)).cast("int"))

    def _save_filters(self, filters: DataFrame) -> None:
        self.version += 1
        self.filters = self.space.stage(filters, f"filters-{self.version}")
        self.space.drop(f"filters-{self.version - 1}")

    def _entries(self) -> DataFrame:
        """(digest, doc, run) of the live digests; run is the table that an entry came with."""
        rows = self.spark.createDataFrame([], "digest binary, doc long, run int")
        for run, name in enumerate(self.tables):
            rows = rows.unionByName(self.spark.table(name).select("digest", "doc", F.lit(run).alias("run")))
        return rows.join(self.dead, ["digest", "doc", "run"], "left_anti")

    def stored(self) -> DataFrame:
        """(digest, doc) of the live digests."""
        return self._entries().drop("run")

    def drop(self) -> None:
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.tables = []
        self.space.drop(f"filters-{self.version}")

    def probe(self, rows: DataFrame) -> DataFrame:
        """rows (shard, digest, doc) with `maybe`: whether the filter of the shard holds the digest."""

        def look(batch: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
            if batch.empty:
                return batch.assign(maybe=pd.Series(dtype=bool))
            hit = np.zeros(len(batch), dtype=bool)
            if len(filters):
                hit = CuckooFilter.from_bytes(filters["data"].iloc[0]).contains(_keys(batch["digest"]))
            return batch.assign(maybe=hit)

        return rows.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInPandas(look, _STORED + ", maybe boolean")

    def _verified(self, hits: DataFrame, contents: DataFrame) -> DataFrame:
        """(digest, doc, old_doc) of the hits whose content is that of the live entry."""
        with_content = contents.join(hits.select("digest", "doc"), ["digest", "doc"], "left_semi").groupBy("digest", "doc").agg(F.any_value("content").alias("content"))
        out = self.spark.createDataFrame([], "digest binary, doc long, old_doc long, run int")
        for run, name in enumerate(self.tables):
            bucket = self.spark.table(name).select("digest", F.col("doc").alias("old_doc"), F.col("content").alias("old_content"))
            met = with_content.join(bucket.hint("merge"), "digest").filter("content = old_content")
            out = out.unionByName(met.select("digest", "doc", "old_doc", F.lit(run).alias("run")))
        dead = self.dead.withColumnRenamed("doc", "old_doc")
        return out.join(dead, ["digest", "old_doc", "run"], "left_anti").select("digest", "doc", "old_doc")

    def insert(self, contents: DataFrame) -> None:
        """contents (digest, doc, content): texts that are not live yet are added; of equal ones the smallest doc stands for all."""
        rows = self.with_shard(contents.groupBy("digest").agg(F.min("doc").alias("doc"))).select("shard", "digest", "doc")
        probed = self.space.stage(self.probe(rows), "probed")
        hits = probed.filter("maybe").drop("maybe")
        verified = self.space.stage(self._verified(hits, contents), "verified")
        false_hits = hits.join(verified, "digest", "left_anti")
        smaller = verified.filter("doc < old_doc")
        if not smaller.isEmpty():
            self.delete(smaller.select("digest", F.col("old_doc").alias("doc")))
        fresh = probed.filter("not maybe").drop("maybe").unionByName(false_hits)
        fresh = fresh.unionByName(self.with_shard(smaller.select("digest", "doc")).select("shard", "digest", "doc"))
        fresh = self.space.stage(fresh, "fresh")
        sizing = self.first_sizing

        def fill(keys: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
            new = keys["digest"]
            had = int(filters["n_keys"].iloc[0]) if len(filters) else 0
            table = CuckooFilter.from_bytes(filters["data"].iloc[0]) if len(filters) else CuckooFilter.sized(sizing)
            whole = not len(new) or table.insert(_keys(new))
            shard = int((keys if len(keys) else filters)["shard"].iloc[0])
            return pd.DataFrame({"shard": [shard], "n_keys": [had + len(new)], "data": [table.to_bytes() if whole else None]})

        filled = fresh.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInPandas(fill, _FILTERS)
        filled = self.space.stage(filled, "filled")
        name = f"{self.prefix}_{len(self.tables)}"
        kept = contents.join(fresh.select("digest", "doc"), ["digest", "doc"], "left_semi")
        kept = kept.groupBy("digest").agg(F.any_value("doc").alias("doc"), F.any_value("content").alias("content"))
        write_bucketed(kept, name, self.buckets, ["digest"])
        self.tables.append(name)
        overflowed = filled.filter("data is null").select("shard")
        self._save_filters(filled.filter("data is not null").unionByName(self._rebuild(overflowed)))
        self.space.drop("probed", "verified", "fresh", "filled")

    def _rebuild(self, overflowed: DataFrame) -> DataFrame:
        """Filters of twice the keys' number for the shards named, from their stored keys."""

        def build(keys: pd.DataFrame) -> pd.DataFrame:
            size = 2 * len(keys)
            table = CuckooFilter.sized(size)
            while not table.insert(_keys(keys["digest"])):
                size *= 2
                table = CuckooFilter.sized(size)
            return pd.DataFrame({"shard": [int(keys["shard"].iloc[0])], "n_keys": [len(keys)], "data": [table.to_bytes()]})

        # At most one row a shard: as many as there are filters, whose number is fixed by the index.
        kept = self.with_shard(self.stored()).select("shard", "digest").join(F.broadcast(overflowed), "shard", "left_semi")
        return kept.groupBy("shard").applyInPandas(build, _FILTERS)

    def delete(self, rows: DataFrame) -> None:
        """rows (digest, doc): takes live entries out of the filters; their stored rows are dead. Others are left alone."""
        gone = self._entries().join(rows.select("digest", "doc").distinct(), ["digest", "doc"], "left_semi")
        gone = self.space.stage(self.with_shard(gone), f"gone-{self.version}")

        def clear(digests: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
            if filters.empty:
                return filters
            table = CuckooFilter.from_bytes(filters["data"].iloc[0])
            if len(digests):
                table.delete(_keys(digests["digest"]))
            return pd.DataFrame(
                {"shard": filters["shard"], "n_keys": filters["n_keys"] - len(digests), "data": [table.to_bytes()]}
            )

        self._save_filters(gone.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInPandas(clear, _FILTERS))
        self.dead = self.dead.unionByName(gone.select("digest", "doc", "run"))


def _groups(docs: DataFrame, id_col: str, text_col: str, batches: int) -> DataFrame:
    """(doc, digest, group_size, keep_id) per row; doc and keep_id are NO_ID where there is none."""
    spark = docs.sparkSession
    space = Workspace(spark, "exact-dedup")
    content = one_space(F.coalesce(F.col(text_col), F.lit("")))
    contents = docs.select(row_id(id_col).alias("doc"), F.unhex(F.sha2(content, 256)).alias("digest"), content.alias("content"))
    # Batches by a hash of the id: of equal size, and in no order of the ids.
    contents = contents.withColumn("batch", F.pmod(F.xxhash64("doc"), F.lit(batches)).cast("int"))
    contents = space.stage(contents, "contents", ["batch"])
    total = contents.count()
    index = CuckooIndex(spark, space, total)
    for batch in range(batches):
        index.insert(contents.filter(F.col("batch") == batch).drop("batch"))
    sizes = contents.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
    groups = space.stage(sizes.join(index.stored().withColumnRenamed("doc", "keep_id"), "digest"), "groups")
    index.drop()
    digests = space.stage(contents.select("doc", "digest"), "digests")
    space.drop("contents", *[f"gone-{version}" for version in range(index.version)])
    # Groups of over 1/1000 of the rows are fewer than 1000: these few are broadcast and no task gets a hot group.
    hot = groups.filter(F.col("group_size") * 1000 > total)
    rest = groups.filter(F.col("group_size") * 1000 <= total)
    marked = digests.join(F.broadcast(hot), "digest", "left")
    columns = ["doc", "digest", "group_size", "keep_id"]
    large = marked.filter("keep_id is not null").select(*columns)
    small = marked.filter("keep_id is null").select("doc", "digest").join(rest, "digest").select(*columns)
    return large.unionByName(small)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """One row per row of docs: doc, keep_id, group_size, kept, digest.

    Null text counts as empty. A null id counts as the last one and comes back
    as null. Rows with one id and one text are copies like any others; `kept` is
    true for all rows of the id that stays, so repeated rows are told by group_size.
    Columns of other names are not looked at.
    """
    found = _groups(docs, id_col, text_col, batches).withColumn("kept", F.col("doc") == F.col("keep_id"))
    return found.select(given_id("doc").alias("doc"), "digest", "group_size", given_id("keep_id").alias("keep_id"), "kept")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the copies: of equal texts one row stays, of the smallest id; of repeated rows of that id any one.

    A null id counts as the last one, so of texts without any id one row stays too. All columns, whatever their names, pass through.
    """
    kept = _groups(docs, id_col, text_col, BATCHES).filter("doc = keep_id")
    kept = kept.groupBy("doc", "digest").agg((F.count(F.lit(1)) > 1).alias("repeated"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, row_id(id_col).alias("doc"), digest_of(text_col).alias("digest")).join(kept, ["doc", "digest"])
    once = rows.filter("not repeated").select("row")
    # Partial aggregates leave one row a text in each task, so a text that very many rows repeat is no large group.
    one = rows.filter("repeated").groupBy("digest").agg(F.any_value("row").alias("row")).select("row")
    return once.unionByName(one).select("row.*")
