"""Shared helpers: working folders, white space, ids and text normalisation."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The white space of every contract, [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
# A row without an id counts as the last document.
NO_ID = (1 << 63) - 1


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lodeweave-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are what later steps read, so the shuffles that made them go from the executors' disks at once."""
    before = spark.conf.get(_FREE_SHUFFLES)
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREE_SHUFFLES, before)


def write_bucketed(rows: DataFrame, name: str, buckets: int, keys: list[str]) -> None:
    """A table dealt into buckets by the keys and sorted in each, so that joins on them merge without a shuffle."""
    writer = rows.repartition(buckets, *keys).sortWithinPartitions(*keys).write.bucketBy(buckets, *keys).sortBy(*keys)
    with freed_shuffles(rows.sparkSession):
        writer.format("parquet").saveAsTable(name)


_scopes: ContextVar[tuple[list[Workspace], ...]] = ContextVar("scopes", default=())


@contextmanager
def scratch() -> Iterator[None]:
    """Deletes the working tables of all operators called inside, once the caller has written what it wants of them."""
    opened: list[Workspace] = []
    token = _scopes.set((*_scopes.get(), opened))
    try:
        yield
    finally:
        _scopes.reset(token)
        for space in opened:
            space.close()


class Workspace:
    """Tables of one run in the shared folder. Each stage() cuts the lineage and survives lost executors.

    They go with drop(), close() or the scratch() around; what is left goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
        self._path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self._files = self._path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._files.mkdirs(self._path)
        self._files.deleteOnExit(self._path)
        for opened in _scopes.get()[-1:]:
            opened.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def stage(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        writer = df.write.mode("overwrite").option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        with freed_shuffles(self.spark):
            writer.parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            self._files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name)), True)

    def close(self) -> None:
        self._files.delete(self._path, True)


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """mapInArrow that returns what memory Arrow holds at the end: Python workers live on between tasks of different operators."""

    def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(freed, schema)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; lower() is the quick way where every code point is one byte."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def strip_spaces(text: Column) -> Column:
    return F.trim(text, F.lit(SPACES))


def one_space(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")


def hash_pair(value: Column, name: str = "h") -> list[Column]:
    """Two differently seeded 64-bit hashes: a 128-bit key that joins as two longs."""
    return [F.xxhash64(value).alias(f"{name}1"), F.xxhash64(F.lit("second seed"), value).alias(f"{name}2")]


def row_id(name: str) -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID))


def given_id(name: str) -> Column:
    """The id as it came: null again where there was none."""
    return F.when(F.col(name) != NO_ID, F.col(name))


def unused(name: str, df: DataFrame) -> str:
    """The name, with as many underscores behind it as tell it from the columns of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df with a number for each row; numbers are kept by writing them, so stage() the result before it is used twice."""
    return df.withColumn(name, F.monotonically_increasing_id())


def id_bounds(df: DataFrame, id_col: str, parts: int) -> list[int]:
    """Ids that cut the rows into about equal ranges; reads the id column only."""
    if parts < 2:
        return []
    shares = [i / parts for i in range(1, parts)]
    cuts = df.select(F.percentile_approx(id_col, shares, 10_000)).first()[0]
    return sorted(set(cuts or []))


def _part(at: Column) -> Column:
    return F.shiftright(at, 33)


def _within(at: Column) -> Column:
    return at.bitwiseAND(F.lit((1 << 33) - 1))


def ordered(space: Workspace, rows: DataFrame, order: list[Column], label: str) -> DataFrame:
    """rows sorted over all their parts, with `_at`: the part (its upper bits) and the place there from 0.

    The order is made by ranges, from a sample of rows: stage() what is dear to compute before.
    """
    in_parts = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return space.stage(in_parts.withColumn("_at", F.monotonically_increasing_id()), label)


def totals_before(rows: DataFrame, amount: Column) -> DataFrame:
    """(_part, _before, _own) of ordered() rows: what all parts before have of the amount, and what the part has. One row a part."""
    own = rows.groupBy(_part(F.col("_at")).alias("_part")).agg(F.sum(amount).alias("_own"))
    before = F.sum("_own").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    return own.withColumn("_before", F.coalesce(before, F.lit(0)).cast("long"))


def placed(space: Workspace, rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with their places 1, 2, ... in the order over all of them; equal rows in any order, no two with one place."""
    sorted_rows = ordered(space, rows, order, f"by_{name}")
    parts = totals_before(sorted_rows, F.lit(1)).select("_part", "_before")
    met = sorted_rows.withColumn("_part", _part(F.col("_at"))).join(F.broadcast(parts), "_part")
    return met.withColumn(name, F.col("_before") + _within(F.col("_at")) + 1).drop("_part", "_before", "_at")


def running(rows: DataFrame, amounts: dict[str, Column]) -> DataFrame:
    """ordered() rows with sums of the amounts, by name, from the first row of all to each of them; a part's rows are summed by one task."""
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.withColumn("_part", _part(F.col("_at")))
    for name, amount in amounts.items():
        before = totals_before(rows, amount).select("_part", "_before")
        out = out.withColumn(name, F.sum(amount).over(inside)).join(F.broadcast(before), "_part")
        out = out.withColumn(name, (F.col(name) + F.col("_before")).cast("long")).drop("_before")
    return out.drop("_part", "_at")


def batch_of(id_col: str, bounds: list[int]) -> Column:
    batch = F.lit(0)
    for cut in bounds:
        batch = batch + (F.col(id_col) > cut).cast("int")
    return batch


FILTER_BITS = 23


def likely_in(rows: DataFrame, wanted: DataFrame, key: list[str]) -> DataFrame:
    """rows that may have a key of wanted: all of these and few others, told by a bitmap of hashed keys.

    The bitmap has 2**FILTER_BITS bits at every size, so it can be broadcast; with very many keys it only keeps more rows.
    """
    spot = F.pmod(F.xxhash64(*key), F.lit(1 << FILTER_BITS))
    bucket, bit = F.shiftright(spot, 15), F.pmod(spot, F.lit(1 << 15))
    bits = wanted.select(bucket.alias("_bucket"), bit.alias("_bit")).groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    met = rows.withColumns({"_bucket": bucket, "_bit": bit}).join(F.broadcast(bits), "_bucket")
    byte = F.conv(F.hex(F.substring("_bits", (F.shiftright("_bit", 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return met.filter(F.getbit(byte, F.pmod("_bit", F.lit(8)).cast("int")) == 1).select(*rows.columns)


def told_apart(rows: DataFrame, wanted: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows that may have a key of wanted, as likely_in() tells them, and all others: these need no shuffle to meet wanted."""
    number = F.pmod(F.xxhash64(*key), F.lit(1 << FILTER_BITS))
    spot = {"_bucket": F.shiftright(number, 15), "_bit": F.pmod(number, F.lit(1 << 15))}
    bits = wanted.select(*[c.alias(n) for n, c in spot.items()]).groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    met = rows.withColumns(spot).join(F.broadcast(bits), "_bucket", "left")  # 2**FILTER_BITS bits at most
    byte = F.conv(F.hex(F.substring("_bits", (F.shiftright("_bit", 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    has = F.coalesce(F.getbit(byte, F.pmod("_bit", F.lit(8)).cast("int")) == 1, F.lit(False))
    return met.filter(has).select(*rows.columns), met.filter(~has).select(*rows.columns)


def pack(values: np.ndarray) -> bytes:
    """An array's byte planes, compressed; the length comes back from the size."""
    width = values.dtype.itemsize
    planes = values.view(np.uint8).reshape(-1, width).T.tobytes() if len(values) else b""
    return zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(data: bytes, dtype) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(dtype).ravel()
