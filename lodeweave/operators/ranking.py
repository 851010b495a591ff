"""Top rows per key without one large task, and coverage records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 64


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int, rank_col: str = "rank_no") -> DataFrame:
    """The first k rows of each key with their rank. Two rounds: a key's rows are cut down in SALTS parts first."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`").cast("string") for c, t in df.dtypes if not t.startswith(("array", "map", "struct"))]), F.lit(SALTS)))
    first = Window.partitionBy(*keys, "_salt").orderBy(*order)
    part = salted.withColumn("_part", F.row_number().over(first)).filter(F.col("_part") <= k).select(*columns)
    last = Window.partitionBy(*keys).orderBy(*order)
    return part.withColumn(rank_col, F.row_number().over(last)).filter(F.col(rank_col) <= k)


def first_of_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key, the first by order: a minimum of structs, so each key is combined on the map side."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    struct = F.struct(*[F.col(f"`{c}`") for c in [*order, *rest]])
    picked = df.groupBy(*keys).agg(F.min(struct).alias("_row"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"_row.`{c}`").alias(c) for c in df.columns])


def merge_coverage(parts: DataFrame, order: str) -> DataFrame:
    """One record of many: complete only if all are, truncated if one is, sums, and reasons in first order once."""
    sums = ("unresolved", "diagnostics", "returned", "matched")
    each = parts.select(F.col(order).alias("_order"), F.col("reasons").alias("_reasons"), "complete", "truncated", *sums, F.posexplode_outer("reasons").alias("_at", "reason"))
    flags = [F.bool_and("complete").alias("complete"), F.bool_or("truncated").alias("truncated")]
    # One row a reason, from partial aggregates: the list is as long as the reasons are many, not as the parts are.
    # A part's numbers count with its first row.
    by_reason = each.groupBy("reason").agg(
        *flags,
        *[F.sum(F.when(F.coalesce("_at", F.lit(0)) == 0, F.col(c))).alias(c) for c in sums],
        F.min(F.when(F.col("_at").isNotNull(), F.struct("_order", "_reasons", "_at"))).alias("first"),
    )
    listed = F.sort_array(F.collect_list(F.when(F.col("first").isNotNull(), F.struct("first", "reason"))))
    return by_reason.groupBy().agg(
        *flags,
        *[F.sum(c).cast("long").alias(c) for c in sums],
        F.transform(listed, lambda r: r.reason).alias("reasons"),
    )
