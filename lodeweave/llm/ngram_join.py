"""N-gram Jaccard join with adaptive multi-match prefixes.

Documents with equal shingle sets are one representative (by a 128-bit key), so
groups of copies cost one row. The shingles of all documents are counted in a
sketch of fixed size; it orders them by rarity, which keeps passages that many
documents share out of the prefixes. Any total order gives exact results.

Each representative picks l, the number of shared prefix tokens it asks for: its
prefix is lengthened by l - 1 tokens where that lowers its estimated cost (the
tokens that are kept and compared, and verifications, at most the postings of
the longer prefix / l). Candidates meet in the plain prefix, as any pair that
shares l tokens of the longer one does; a pair has to share min(l, l') tokens of
the prefixes of that length, has to pass the length and positional bounds, and
is then verified on the whole sets.

The links are needed for components only, so pairs inside a component are not
looked for: in each posting list all first pair up with a leader, the member
whose prefix tokens are shared most (the original of a group of near copies).
Components of these links are made, and then only pairs of different components
are looked for, exactly, with nothing left out. No list of all pairs of a group
ever exists.

Defined results: null and empty texts have no shingles and no links; repeated
rows of an id come back as often; rows of one id with different texts are linked
each by its own text; a row without an id is linked like any other, comes back
without one, and its component is the smallest id there, null if there is none.
Columns of other names are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, given_id, likely_in, map_arrow, numbered, pack, row_id, unpack
from .components import components, edges_of
from .shingles import mix, set_key, shingle_set

SKETCH_BITS = 24
SKETCH_CHUNK = 16
MOST_MATCHES = 4
#: The cost of a verification, in tokens of a prefix that are kept and compared.
VERIFY_COST = 20.0


def _sketch(docs: DataFrame, k: int) -> tuple[np.ndarray, float]:
    """Magnitudes (ceil of log2 of count + 1) of all documents' shingles in 2**SKETCH_BITS cells, and the mean count.

    Its size doesn't depend on the data; where cells are crowded, the order only gets less sharp.
    """
    size, chunk = 1 << SKETCH_BITS, 1 << SKETCH_CHUNK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(size, dtype=np.int32)
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                np.add.at(cells, (mix(shingle_set(text, k)) & np.uint64(size - 1)).astype(np.int64), 1)
        for i in range(size // chunk):
            part = cells[i * chunk : (i + 1) * chunk]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([pack(part)], pa.binary())], names=["part", "cells"])

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(chunk, dtype=np.int64)
        for cells in group["cells"].to_pylist():
            total += unpack(cells, np.int32)
        magnitude = np.ceil(np.log2(total + 1)).astype(np.uint8)
        return pa.table([group["part"][:1], pa.array([int(total.sum())], pa.int64()), pa.array([magnitude.tobytes()], pa.binary())], names=["part", "total", "cells"])

    counted = map_arrow(docs.select("text"), run, "part int, cells binary").groupBy("part").applyInArrow(add, "part int, total long, cells binary")
    magnitudes, total = np.zeros(size, dtype=np.uint8), 0
    for part, count, cells in counted.collect():
        magnitudes[part * chunk : (part + 1) * chunk] = np.frombuffer(bytes(cells), np.uint8)
        total += count
    return magnitudes, total / size


class Order:
    """Tokens of a set from rare to common: the magnitude of the cell's count, then the hash."""

    def __init__(self, magnitudes: np.ndarray, load: float):
        self.magnitudes, self.load = magnitudes, load

    def tokens(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted tokens (the magnitude in the leading bits) and the estimated length of their posting lists."""
        mixed = mix(values)
        level = self.magnitudes[(mixed & np.uint64(len(self.magnitudes) - 1)).astype(np.int64)]
        tokens = np.sort(level.astype(np.uint64) << np.uint64(57) | mixed >> np.uint64(7))
        level = (tokens >> np.uint64(57)).astype(np.int64)
        return tokens, np.maximum(1.0, 2.0**level - 1 - self.load)


def matches_asked(costs: np.ndarray, base: int, most: int = MOST_MATCHES) -> int:
    """The l of least cost; costs are those of a set's tokens in order, base the length of the plain prefix."""
    best, found = None, 1
    for l in range(1, most + 1):
        if base + l - 1 > len(costs):
            break
        cost = base + l - 1 + VERIFY_COST * costs[: base + l - 1].sum() / l
        if best is None or cost < best:
            best, found = cost, l
    return found


_SETS = "doc long, version long, n int, key1 long, key2 long, asked int, base int, prefix array<long>"


def _prefixes(docs: DataFrame, order, k: int, num: int, den: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = order.value
        for batch in batches:
            rows = []
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                values = shingle_set(text, k)
                n = len(values)
                base = n - -(-num * n // den) + 1 if n else 0
                tokens, costs = rank.tokens(values)
                asked = matches_asked(costs, base) if n else 1
                rows.append((n, *set_key(values), asked, base, tokens[: base + asked - 1].astype(np.int64) if n else []))
            columns = list(zip(*rows)) or [[]] * 6
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64())]
            arrays = [pa.array(c, type=t) for c, t in zip(columns, types)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *arrays], names=["doc", "version", "n", "key1", "key2", "asked", "base", "prefix"])

    return map_arrow(docs.select("doc", "version", "text"), run, _SETS)


def _full_sets(texts: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, k).astype(np.int64) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["rep", "shingles"])

    return map_arrow(texts, run, "rep long, shingles array<long>")


class _Join:
    """Representatives (rep, a number) stand for the rows of equal sets; a row's text is found by its id and its version."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, k: int, num: int, den: int):
        self.k, self.num, self.den = k, num, den
        self.space = Workspace(docs.sparkSession, "ngram-join")
        text = F.coalesce(F.col(text_col), F.lit(""))
        self.docs = docs.select(row_id(id_col).alias("doc"), F.xxhash64(text).alias("version"), text.alias("text"))

    def need(self, n: str, m: str):
        """The least overlap of two sets of these sizes that are similar enough."""
        return F.ceil((F.col(n) + F.col(m)) * self.num / (self.num + self.den))

    def run(self) -> DataFrame:
        space = self.space
        order = self.docs.sparkSession.sparkContext.broadcast(Order(*_sketch(self.docs, self.k)))
        sets = space.stage(_prefixes(self.docs, order, self.k, self.num, self.den), "sets")
        order.unpersist()
        # Equal keys are equal sets with equal prefixes: any row of a key gives them, and partial aggregates keep hot groups small.
        reps = sets.filter("n > 0").groupBy("key1", "key2").agg(
            F.min(F.struct("doc", "version")).alias("first"), *[F.any_value(c).alias(c) for c in ("n", "asked", "base", "prefix")]
        )
        reps = reps.select("key1", "key2", "first.doc", "first.version", "n", "asked", "base", "prefix")
        self.reps = space.stage(numbered(reps, "rep"), "reps")
        # What the end needs of the rows, without their prefixes.
        rows = space.stage(sets.select("doc", "version", "n", "key1", "key2"), "rows")
        space.drop("sets")
        self.postings = self._postings()
        stars = self._links(self._star_pairs(), "stars")
        inside = components(stars, space, "inside")
        rest = self._links(self._cross_pairs(inside), "rest")
        space.drop("postings", "cross")
        linked = components(edges_of(inside).unionByName(rest), space, "linked")
        placed = self.reps.select("key1", "key2", "rep", "doc").join(linked, F.col("rep") == F.col("node"), "left")
        placed = placed.select("key1", "key2", "doc", F.coalesce("component", "rep").alias("component"))
        placed = space.stage(placed, "placed")
        space.drop("reps", "stars-links", "rest-links", "inside", "linked")
        first = placed.groupBy("component").agg(F.min("doc").alias("component_id"))
        classes = space.stage(placed.join(first, "component").select("key1", "key2", "component_id"), "classes")
        space.drop("placed")
        out = rows.join(classes, ["key1", "key2"], "left")
        out = out.select("doc", "version", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc").alias("component_id"))
        return out.withColumns({"doc": given_id("doc"), "component_id": given_id("component_id")})

    def _postings(self) -> DataFrame:
        """Rows (token, at, rep, n) of tokens with two representatives or more, with the leader of the list."""
        space = self.space
        flat = self.reps.select("rep", "n", F.posexplode(F.slice("prefix", F.lit(1), F.col("base"))).alias("at", "token"))
        lists = flat.groupBy("token").agg(F.count(F.lit(1)).alias("size"), F.min("n").alias("least_n"))
        lists = space.stage(lists.filter("size > 1"), "lists")
        shared = flat.join(lists, "token")
        # A partner has at least the size of the smallest member: rows that can't reach any overlap go.
        shared = shared.filter((F.col("n") - F.col("at")) >= self.need("n", "least_n")).drop("least_n")
        shared = space.stage(shared, "shared")
        space.drop("lists")
        weights = shared.groupBy("rep").agg(F.sum(F.log2("size")).alias("weight"))
        weighed = space.stage(shared.join(weights, "rep"), "weighed")
        space.drop("shared")
        leaders = weighed.groupBy("token").agg(
            F.min(F.struct(-F.col("weight"), F.col("rep"), F.col("n"), F.col("at"))).alias("leader")
        )
        leaders = leaders.select("token", F.col("leader.rep").alias("leader"), F.col("leader.n").alias("leader_n"), F.col("leader.at").alias("leader_at"))
        out = space.stage(weighed.select("token", "at", "rep", "n").join(leaders, "token"), "postings")
        space.drop("weighed")
        return out

    def _near(self, n: str, at: str, m: str, there: str):
        """Length and positional bounds at the first token that two sets share."""
        least = F.least(F.col(n), F.col(m)) * self.den >= F.greatest(F.col(n), F.col(m)) * self.num
        reach = F.least(F.col(n) - F.col(at), F.col(m) - F.col(there)) >= self.need(n, m)
        return least & reach

    def _star_pairs(self) -> DataFrame:
        pairs = self.postings.filter(F.col("rep") != F.col("leader")).filter(self._near("n", "at", "leader_n", "leader_at"))
        return pairs.select(F.col("rep").alias("a"), F.col("leader").alias("b")).distinct()

    def _cross_pairs(self, inside: DataFrame) -> DataFrame:
        """Pairs of a list that are in different components; those with the leader have been tried."""
        inside = inside.select(F.col("node").alias("rep"), "component")
        rows = self.postings.join(inside, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        lead = inside.select(F.col("rep").alias("leader"), F.col("component").alias("main"))
        rows = rows.join(lead, "leader", "left").withColumn("main", F.coalesce("main", "leader"))
        rows = self.space.stage(rows.select("token", "at", "rep", "n", "leader", "component", "main"), "cross")
        others = rows.filter("component <> main").select("token", *[F.col(c).alias(f"o_{c}") for c in ("at", "rep", "n", "component")])
        everyone = rows.filter("rep <> leader")
        met = others.join(everyone, "token").filter(
            (F.col("component") != F.col("o_component"))
            & ((F.col("component") == F.col("main")) | (F.col("o_rep") < F.col("rep")))
            & self._near("n", "at", "o_n", "o_at")
        )
        return met.select(F.col("o_rep").alias("a"), F.col("rep").alias("b")).distinct()

    def _links(self, pairs: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b) that are similar: enough shared prefix tokens, then the exact overlap."""
        space = self.space
        facts = self.reps.select("rep", "n", "asked", "base", "prefix")
        for side in ("a", "b"):
            own = facts.select(F.col("rep").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in ("n", "asked", "base", "prefix")])
            pairs = pairs.join(own, side)
        asked = F.least("a_asked", "b_asked")
        shared = F.size(
            F.array_intersect(
                F.slice("a_prefix", F.lit(1), F.col("a_base") + asked - 1), F.slice("b_prefix", F.lit(1), F.col("b_base") + asked - 1)
            )
        )
        pairs = space.stage(pairs.filter(shared >= asked).select("a", "b", "a_n", "b_n"), f"{name}-pairs")
        wanted = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).distinct()
        wanted = space.stage(self.reps.select("rep", "doc", "version").join(wanted, "rep"), f"{name}-wanted")
        texts = likely_in(self.docs, wanted, ["doc", "version"]).join(wanted, ["doc", "version"]).groupBy("rep").agg(F.any_value("text").alias("text"))
        sets = space.stage(_full_sets(texts, self.k), f"{name}-sets")
        for side in ("a", "b"):
            pairs = pairs.join(sets.select(F.col("rep").alias(side), F.col("shingles").alias(f"{side}_set")), side)
        both = F.size(F.array_intersect("a_set", "b_set"))
        similar = both * self.den >= (F.col("a_n") + F.col("b_n") - both) * self.num
        links = space.stage(pairs.filter(similar).select("a", "b"), f"{name}-links")
        space.drop(f"{name}-sets", f"{name}-pairs", f"{name}-wanted")
        return links


def similar_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100
) -> DataFrame:
    """One row per row of docs: doc, version (xxhash64 of its text), n_shingles, component_id (the smallest id linked to it, its own included).

    Documents are linked when den * intersection >= num * union of their sets of k-word shingles.
    """
    return _Join(docs, id_col, text_col, k, num, den).run()
