"""Line dedup over levelled sorted runs of line hashes; built-in expressions only.

The index is a set of runs: tables of (hash, first document), bucketed by the
hash and sorted inside each bucket, so that a batch joins them by merging. A
batch of documents reduces its lines to one row a hash (with map-side
combining, so that a line of every document stays cheap), anti-joins each run,
and what is new becomes a run of level 0. As soon as a level has `fanout` runs
they are merged into one of the next level, which bounds the number of merge
joins of a batch by fanout * log(batches).

Defined results: null or empty text is one empty line; a null id counts as one
last document; repeated rows of an id are one document and each gets the same
result; other columns, whatever their names, pass through dedup_lines().
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, ascii_lower, batch_of, hash_pair, id_bounds, row_id, strip_spaces, told_apart, write_bucketed

MIN_KEY_CHARS = 10
BATCHES = 4
FANOUT = 3


class LineRuns:
    """Runs by level. Batches have to come in the order in which documents take precedence."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, fanout: int = FANOUT):
        self.spark = spark
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.fanout = max(2, fanout)
        self.levels: list[list[str]] = [[]]
        self.prefix = f"line_run_{uuid.uuid4().hex[:12]}"
        self.made = 0

    def _write(self, rows: DataFrame) -> str:
        self.made += 1
        name = f"{self.prefix}_{self.made}"
        write_bucketed(rows, name, self.buckets, ["h1", "h2"])
        return name

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def firsts(self) -> DataFrame:
        """Every hash with its first document."""
        frames = [self.spark.table(name) for name in self.runs()]
        out = frames[0]
        for frame in frames[1:]:
            out = out.unionByName(frame)
        return out

    def add(self, lines: DataFrame) -> None:
        """Adds the hashes (h1, h2, doc) that no earlier batch had."""
        fresh = lines.groupBy("h1", "h2").agg(F.min("doc").alias("doc"))
        for name in self.runs():
            run = self.spark.table(name).select("h1", "h2").hint("merge")
            fresh = fresh.join(run, ["h1", "h2"], "left_anti")
        self.levels[0].append(self._write(fresh))
        self._compact()

    def _compact(self) -> None:
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= self.fanout:
                old = self.levels[level]
                merged = self.spark.table(old[0])
                for name in old[1:]:
                    merged = merged.unionByName(self.spark.table(name))
                name = self._write(merged)
                self.levels[level] = []
                if level + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[level + 1].append(name)
                for gone in old:
                    self.spark.sql(f"DROP TABLE IF EXISTS {gone}")
            level += 1

    def drop(self) -> None:
        for name in self.runs():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.levels = [[]]


def _lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(row_id(id_col).alias("doc"), F.xxhash64(text).alias("version"), F.split(text, "\n").alias("parts"))
    rows = rows.select("doc", "version", F.posexplode("parts").alias("pos", "line"))
    rows = rows.select("doc", "version", "pos", strip_spaces(F.col("line")).alias("line"))
    rows = rows.select("doc", "version", "pos", F.when(F.char_length("line") >= min_chars, ascii_lower(F.col("line"))).alias("line"))
    pair = [F.when(F.col("line").isNotNull(), h).alias(f"h{i}") for i, h in enumerate(hash_pair(F.col("line")), 1)]
    return rows.select("doc", "version", "pos", *pair)


def dropped_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_KEY_CHARS,
    batches: int = BATCHES,
    fanout: int = FANOUT,
) -> DataFrame:
    """(doc, version, gone array<boolean> by line) of the documents that lose a line."""
    spark = docs.sparkSession
    space = Workspace(spark, "line-dedup")
    bounds = id_bounds(docs, id_col, batches)
    lines = _lines(docs, id_col, text_col, min_chars).withColumn("batch", batch_of("doc", bounds))
    lines = space.stage(lines, "lines", ["batch"])
    index = LineRuns(spark, fanout=fanout)
    for batch in range(len(bounds) + 1):
        index.add(lines.filter(F.col("batch") == batch).filter("h1 is not null").select("h1", "h2", "doc"))
    # The document is part of the key: no line, however common, makes a large partition.
    first = index.firsts().withColumn("stays", F.lit(True))
    marked = lines.join(first, ["h1", "h2", "doc"], "left").select(
        "doc", "version", F.struct("pos", (F.col("h1").isNotNull() & F.col("stays").isNull()).alias("gone")).alias("mark")
    )
    marks = marked.groupBy("doc", "version").agg(
        F.max("mark.gone").alias("any_gone"), F.sort_array(F.collect_set("mark")).alias("marks")
    )
    marks = marks.filter("any_gone").select("doc", "version", F.col("marks.gone").alias("gone"))
    marks = space.stage(marks, "marks")
    index.drop()
    space.drop("lines")
    return marks


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_KEY_CHARS,
    batches: int = BATCHES,
    fanout: int = FANOUT,
    lines_col: str = "n_lines",
    dropped_col: str = "n_dropped",
) -> DataFrame:
    """docs with the kept lines as text, the number of lines before and of those dropped.

    A line's key is the line stripped of [\\x20\\x09-\\x0D], A-Z lower-cased. A key
    of min_chars code points or more stays in the document with the smallest id.
    """
    marks = dropped_lines(docs, id_col, text_col, min_chars, batches, fanout)
    text = F.coalesce(F.col(text_col), F.lit(""))
    inner = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        row_id(id_col).alias("doc"),
        F.xxhash64(text).alias("version"),
    )
    # Texts that lose no line are not shuffled.
    able, whole = told_apart(inner, marks, ["doc", "version"])
    joined = able.join(marks, ["doc", "version"], "left").select("row", "gone")
    joined = joined.unionByName(whole.select("row", F.lit(None).cast(marks.schema["gone"].dataType).alias("gone")))
    text = F.coalesce(F.col(f"row.`{text_col}`"), F.lit(""))
    parts = F.split(text, "\n")
    paired = F.zip_with(parts, "gone", lambda line, gone: F.struct(line.alias("line"), gone.alias("gone")))
    kept = F.transform(F.filter(paired, lambda x: ~x.gone), lambda x: x.line)
    new_text = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(kept, "\n"))
    dropped = F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size(F.filter("gone", lambda x: x)))
    others = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in (text_col, lines_col, dropped_col)]
    return joined.select(
        *others,
        new_text.alias(text_col),
        F.size(parts).cast("long").alias(lines_col),
        dropped.cast("long").alias(dropped_col),
    )
