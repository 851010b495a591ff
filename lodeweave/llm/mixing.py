"""Mixes sources to target weights by weighted fair queueing; built-in expressions only.

A source's targets are its weight's share of all sizes, at most `epochs` times what
it has; what is over is shared again. Its documents are shuffled by a hash of the
id, and each gets a virtual finish time, the source's words up to its end divided
by the source's target; a document that is to come again has a finish time for each
epoch. All finish times are range-sorted, and the mix takes them from the front
until the budget, all words there are, is used. Running sums are made range by
range with the totals of the ranges before, so that a source with a third of all
rows is spread like any other.

Defined results: a null or empty text has size 0, and so has what is taken of it; a
null source is the last source; a null id comes after all other ids of its source,
told apart by size; repeated rows are documents of their own, equal ones in any order; a table
without words takes nothing; an empty one returns nothing. Other columns, whatever
their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, ordered, running, totals_before

WEIGHTS = (5, 2, 1)
EPOCHS = 3


def text_size(text: Column) -> Column:
    """How many runs of other than white space a text has; none without a text."""
    spaced = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    gaps = F.char_length(spaced) - F.char_length(F.replace(spaced, F.lit(" "), F.lit("")))
    return F.when(spaced == "", 0).otherwise(gaps + 1).cast("long")


def shuffled_by(id_: Column) -> Column:
    """60 bits of a digest of the id; a null id comes last."""
    digest = F.md5(F.concat(F.lit("mix:"), id_.cast("string")))
    return F.coalesce(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit((1 << 63) - 1))


def source_targets(space: Workspace, sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> tuple[DataFrame, int]:
    """(source, place, source_size, start, target) of the sources in the order of their names, null last, and the budget.

    start: the words of all sources before. Sources whose target would be above epochs times their size stop there,
    and the rest is shared anew by weight, until none is above.
    """
    sums = space.stage(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sums")
    named = running(ordered(space, sums, [F.col("source").asc_nulls_last()], "names"), {"place": F.lit(1), "upto": F.col("source_size")})
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    named = space.stage(named.withColumns({"weight": weight, "start": F.col("upto") - F.col("source_size")}), "sources")
    budget = named.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    rate, stopped = 0.0, -1
    while True:
        full = F.col("weight") * F.lit(rate) >= epochs * F.col("source_size")
        known = named.agg(
            F.count_if(full).alias("stopped"),
            F.coalesce(F.sum(F.when(full, F.col("source_size"))), F.lit(0)).alias("held"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("weights"),
        ).first()
        if known["stopped"] == stopped or not known["weights"]:
            break
        stopped = known["stopped"]
        rate = float(budget - epochs * known["held"]) / known["weights"]
    target = F.least(F.col("weight") * F.lit(rate), (epochs * F.col("source_size")).cast("double"))
    return space.stage(named.select("source", "place", "source_size", "start", target.alias("target")), "targets"), budget


def _cut(space: Workspace, turns: DataFrame, budget: int) -> tuple[float, int, int]:
    """The last of the turns (finish, place, reached, size), sorted over all, up to which they fit into the budget."""
    line = ordered(space, turns, [F.col("finish"), F.col("place"), F.col("reached")], "line")
    parts = totals_before(line, F.col("size")).filter(F.col("_before") <= budget)
    here = parts.agg(F.max_by(F.struct("_part", "_before"), "_part")).first()[0]
    if here is None:
        return (-1.0, 0, 0)
    # Only the range in which the budget ends is summed up turn by turn; all before it are taken.
    upto = F.sum("size").over(Window.orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    end = line.filter(F.shiftright("_at", 33) == here["_part"]).withColumn("upto", upto).filter(F.col("upto") + here["_before"] <= budget)
    last = end.agg(F.max(F.struct("finish", "place", "reached"))).first()[0]
    if last is None:
        last = line.filter(F.shiftright("_at", 33) < here["_part"]).agg(F.max(F.struct("finish", "place", "reached"))).first()[0]
    return tuple(last) if last else (-1.0, 0, 0)


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """(id, source, size, source_size, target, taken) of every document; target is that of its source."""
    space = Workspace(docs.sparkSession, "mix")
    source = F.col(f"`{source_col}`").cast("string").alias("source")
    sized = space.stage(docs.select(F.col(f"`{id_col}`").alias("id"), source, text_size(F.col(f"`{text_col}`")).alias("size")), "sized")
    targets, budget = source_targets(space, sized, weights, epochs)
    known = sized.withColumn("shuffle", shuffled_by(F.col("id"))).alias("a").join(targets.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")))
    known = known.select("id", "a.source", "size", "shuffle", "place", "source_size", "start", "target")
    queue = ordered(space, known, [F.col("place"), F.col("shuffle"), F.col("id").asc_nulls_last(), F.col("size")], "queue")
    queue = running(queue, {"upto": F.col("size")}).withColumn("upto", F.col("upto") - F.col("start"))
    queue = space.stage(queue.drop("shuffle", "start"), "finish")
    reached = [F.lit(e) * F.col("source_size") + F.col("upto") for e in range(epochs)]
    turn = lambda r: F.struct((r / F.col("target")).alias("finish"), F.col("place"), r.alias("reached"))
    turns = queue.filter("size > 0").select("size", F.inline(F.array(*map(turn, reached))))
    finish, place, upto = _cut(space, turns, budget)
    last = F.struct(F.lit(float(finish)).alias("finish"), F.lit(place).cast("long").alias("place"), F.lit(upto).cast("long").alias("reached"))
    times = sum(((turn(r) <= last).cast("long") for r in reached), F.lit(0).cast("long"))
    taken = F.when(F.col("size") > 0, F.col("size") * times).otherwise(0)
    return queue.select("id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))
