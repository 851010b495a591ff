"""Importance resampling towards a target distribution over hashed word runs.

Each task reads Arrow buffers with the byte automaton of words.py and counts the
hash buckets of its word runs; the counts of all tasks are added up by bucket, a
bucket's gain is the logarithm of how much likelier the target is to have it, and
a document's weight is the mean gain of its runs. Adding Gumbel noise that hangs on
the id alone turns the highest scores into a weighted draw without replacement;
they are placed by a range sort, so no task sees more than its range.

Defined results: a null or empty text has no words and weight 0; a null id can't
be drawn, its score and rank are null; repeated rows are rows of their own, equal
ones in any order; without any documents nothing is returned; columns that are not
kept are not read; kept ones named like those made (MADE) give way to them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, map_arrow, placed
from .words import Words, run_hashes, slices

BUCKETS = 10_000
SEED = 2024
MIN_WORDS = 20
MADE = ("n_words", "n_features", "weight", "score", "rank")


def bucket_counts(texts: DataFrame, text_col: str = "text", most_words: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many word runs of all texts fall into each; buckets without any are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, dtype=np.int64)
        for whole in batches:
            for batch in slices(whole, 0):
                for _, hashes in run_hashes(Words(batch.column(0)), most_words):
                    held += np.bincount(hashes % np.uint32(buckets), minlength=buckets)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(held[some], pa.int64())], names=["bucket", "n"])

    each = map_arrow(texts.select(F.coalesce(text_col, F.lit("")).alias("text")), run, "bucket int, n long")
    return each.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", most_words: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """1000 times the logarithm of each bucket's share in the target over that in docs, both smoothed by one, floored.

    The array has `buckets` entries, a parameter, whatever the size of the tables.
    """
    have, want = (
        {r["bucket"]: r["n"] for r in bucket_counts(x, text_col, most_words, buckets).collect()}  # at most `buckets` rows
        for x in (docs, target)
    )
    s_all, t_all = sum(have.values()) + buckets, sum(want.values()) + buckets
    ratios = (float(want.get(b, 0) + 1) * s_all / (float(have.get(b, 0) + 1) * t_all) for b in range(buckets))
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], dtype=np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, text_col: str = "text", most_words: int = 1) -> DataFrame:
    """The other columns with n_words, n_features and weight: the floored mean gain of all word runs of the text."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)
    kept = [c for c in docs.columns if c != text_col and c not in MADE]
    names = [*kept, *MADE[:3]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for whole in batches:
            for batch in slices(whole, len(kept)):
                words = Words(batch.column(len(kept)))
                n, total = np.zeros(words.rows, np.int64), np.zeros(words.rows, np.int64)
                for row, hashes in run_hashes(words, most_words):
                    n += np.bincount(row, minlength=words.rows)
                    # Gains are whole and below 10**5, so sums of up to 10**10 runs are exact in doubles.
                    total += np.bincount(row, table[hashes % np.uint32(len(table))], minlength=words.rows).astype(np.int64)
                made = [words.counts(), n, total // np.maximum(n, 1)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *[pa.array(x, pa.int64()) for x in made]], names=names)

    schema = T.StructType([*[docs.schema[c] for c in kept], *[T.StructField(c, T.LongType()) for c in MADE[:3]]])
    return map_arrow(docs.select(*[f"`{c}`" for c in kept], F.coalesce(f"`{text_col}`", F.lit("")).alias("text")), run, schema)


def noise(id_: Column, seed: int = SEED) -> Column:
    """1000 times a standard Gumbel number that the id fixes, floored."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), id_.cast("string")), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None,
    most_words: int = 1, buckets: int = BUCKETS, min_words: int = MIN_WORDS, seed: int = SEED,
) -> DataFrame:
    """Every document with MADE; rank is 1, 2, ... for the `percent` highest scores of those with min_words or more, else null.

    keep: columns to carry (the id if not given); the ranking shuffles them.
    """
    space = Workspace(docs.sparkSession, "importance")
    carried = [c for c in dict.fromkeys([id_col, *(keep or [])]) if c not in MADE]
    inside = [f"k{i}" for i in range(len(carried))]
    source = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(carried, inside)], F.col(f"`{text_col}`").alias("text"))
    scored = weigh(source, gains(source, target.select(F.col(f"`{text_col}`").alias("text")), "text", most_words, buckets), "text", most_words)
    scored = space.stage(scored.withColumn("score", F.col("weight") + noise(F.col("k0"), seed)), "scored")
    able = (F.col("n_words") >= min_words) & F.col("k0").isNotNull()
    in_draw = scored.filter(able)
    drawn = percent * in_draw.count() // 100
    ranked = placed(space, in_draw, [F.col("score").desc(), F.col("k0").asc()], "rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return ranked.unionByName(scored.filter(~able).withColumn("rank", F.lit(None).cast("long"))).toDF(*carried, *MADE)
