"""Substring dedup: paragraphs of documents that repeat, alike or nearly alike.

A paragraph is a line of MIN_WORDS words or more. Paragraphs of equal sets of
5-word shingles are one (by a 128-bit key), so a passage that a third of all
documents has costs one row. MinHash values are banded: with BANDS bands of ROWS
values, two paragraphs of similarity 0.8 meet in a band with probability
1 - (1 - 0.8**ROWS)**BANDS, 0.998 here, and of 0.9 with 0.99999. Those that meet
are verified by the exact Jaccard similarity of their sets.

As only components are needed, the members of a band's bucket first pair up with
one leader. Where a bucket then still has members of several components, these
collide in pairs too many to be listed (copies that are alike, but less than
0.8): they are paired only where they also share one of their rarest shingles,
which all pairs of similarity 0.8 do (a prefix filter), and all those pairs are
verified. The paragraph of the smallest (document, place) in a component stays,
the others go.

A passage may also lie inside a longer line, or run over several short ones. So
repeated_passages() cuts windows of WINDOW words out of the whole text, across
lines, at anchors: words whose 5-word shingle hashes lowest in some REACH words
in a row. The same passage has the same anchors wherever it stands, so two texts
that share WINDOW + REACH + 3 words or more in a row (44) share a window, for
certain. Equal windows are joined exactly, and those of a document that an
earlier one has are merged into spans.

Defined results: null and empty texts have no paragraphs and no passages; a row
without an id counts as the last document and comes back without one; repeated
rows of an id have the same paragraphs once; paragraphs of rows of one id with
different texts are kept apart, for passages such rows are one document; places
are lines or words of the text, from 0. Columns of other names are not looked at
by repeated_*(), and pass through dedup_paragraphs().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, given_id, likely_in, map_arrow, numbered, row_id
from .components import components, edges_of
from .shingles import hashes_of, mix, shingle_hashes, word_hashes

MIN_WORDS = 20
SHINGLE = 5
NUM, DEN = 80, 100
BANDS, ROWS = 12, 4
#: Words of a window, and shingles in a row of which one is an anchor; a power of two.
WINDOW, REACH = 25, 16
#: Words that a task holds at a time, beyond the document that it has begun.
_BLOCK = 1 << 16

_rng = np.random.default_rng(2024)
_A = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def set_starts(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each owner, and where each owner's begin; owners come in order."""
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    fresh = np.ones(len(values), dtype=bool)
    fresh[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[fresh], owner[fresh]
    begins = np.ones(len(values), dtype=bool)
    begins[1:] = owner[1:] != owner[:-1]
    return values, np.flatnonzero(begins)


def band_keys(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A row of BANDS keys for each set; sets lie end to end."""
    keys = np.zeros((len(starts), BANDS), dtype=np.uint64)
    for band in range(BANDS):
        key = np.full(len(starts), band, dtype=np.uint64)
        for row in range(ROWS):
            j = band * ROWS + row
            key = mix(key ^ np.minimum.reduceat(flat * _A[j] + _B[j], starts))
        keys[:, band] = key
    return keys


class _Block:
    """The words of some documents end to end, with the ends of their lines and of themselves."""

    def __init__(self):
        self.words: list[bytes] = []
        self.rows: list[tuple[int, int]] = []
        self.doc_ends: list[int] = []
        self.line_ends: list[int] = []
        self.places: list[tuple[int, int]] = []  # row and number of each line

    def add(self, row: tuple[int, int], text: bytes) -> None:
        number = len(self.rows)
        for place, line in enumerate(text.lower().split(b"\n")):
            self.words += line.split()
            self.line_ends.append(len(self.words))
            self.places.append((number, place))
        self.rows.append(row)
        self.doc_ends.append(len(self.words))

    def hashes(self) -> np.ndarray:
        return hashes_of(self.words)


_FOUND = "kind int, doc long, version long, place int, words int, n int, key1 long, key2 long, bands array<long>"
_PARAGRAPH, _PASSAGE = 0, 1


def _found(kind: int, rows: np.ndarray, block: _Block, place: np.ndarray, words: np.ndarray, n: np.ndarray, key1: np.ndarray, key2: np.ndarray, bands) -> pa.RecordBatch:
    ids = np.array(block.rows, dtype=np.int64).reshape(-1, 2)[rows]
    columns = [pa.array(np.full(len(rows), kind, np.int32)), pa.array(ids[:, 0]), pa.array(ids[:, 1])]
    columns += [pa.array(x.astype(np.int32)) for x in (place, words, n)]
    columns += [pa.array(x.view(np.int64)) for x in (key1, key2)]
    columns.append(bands if bands is not None else pa.nulls(len(rows), pa.list_(pa.int64())))
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _FOUND.split(", ")])


def _block_paragraphs(block: _Block, hashes: np.ndarray, shingles: np.ndarray, least: int, k: int) -> Iterator[pa.RecordBatch]:
    ends = np.array(block.line_ends, dtype=np.int64)
    sizes = np.diff(ends, prepend=0)
    lines = np.flatnonzero(sizes >= max(least, k))
    if not len(lines):
        return
    counts = sizes[lines] - k + 1
    begins = np.cumsum(counts) - counts
    at = np.repeat((ends - sizes)[lines] - begins, counts) + np.arange(int(counts.sum()))
    values, starts = set_starts(shingles[at], np.repeat(np.arange(len(lines)), counts))
    n = np.diff(np.append(starts, len(values)))
    key1 = np.add.reduceat(mix(values), starts)
    key2 = np.add.reduceat(mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)), starts) + n.astype(np.uint64)
    bands = band_keys(values, starts).view(np.int64)
    listed = pa.ListArray.from_arrays(pa.array(np.arange(len(lines) + 1, dtype=np.int32) * BANDS), pa.array(bands.ravel()))
    places = np.array(block.places, dtype=np.int64)[lines]
    yield _found(_PARAGRAPH, places[:, 0], block, places[:, 1], sizes[lines], n, key1, key2, listed)


def _block_windows(block: _Block, hashes: np.ndarray, shingles: np.ndarray, size: int, k: int) -> Iterator[pa.RecordBatch]:
    ends = np.array(block.doc_ends, dtype=np.int64)
    sizes = np.diff(ends, prepend=0)
    rows = np.repeat(np.arange(len(ends)), sizes)[: len(shingles)]
    left = ends[rows] - np.arange(len(shingles))  # words up to the document's end
    # No anchor reaches over the end of a document.
    starts = anchors(np.where(left >= k, shingles, np.uint64(0xFFFFFFFFFFFFFFFF)))
    starts = starts[left[starts] >= size]
    if len(starts):
        rows = rows[starts]
        place = starts - (ends - sizes)[rows]
        width = np.full(len(starts), size)
        key = np.full(len(starts), size, dtype=np.uint64)
        for j in range(size):
            key = mix(key + hashes[starts + j] * _A[j % len(_A)])
        yield _found(_PASSAGE, rows, block, place, width, width, key, key, None)


def _scan(docs: DataFrame, least: int | None, size: int | None, k: int) -> DataFrame:
    """Paragraphs of `least` words with their bands, and windows of `size` words, of docs (doc, version, text); None: none."""

    def told(block: _Block) -> Iterator[pa.RecordBatch]:
        hashes = block.hashes()
        if len(hashes) >= k:
            shingles = shingle_hashes(hashes, k)
            if least is not None:
                yield from _block_paragraphs(block, hashes, shingles, least, k)
            if size is not None:
                yield from _block_windows(block, hashes, shingles, size, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block()
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            for i, row in enumerate(zip(*[batch.column(i).to_pylist() for i in (0, 1)])):
                block.add(row, texts[i].as_py())
                if len(block.words) >= _BLOCK:
                    yield from told(block)
                    block = _Block()
        yield from told(block)

    return map_arrow(docs, run, _FOUND)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, version, text); a row's text is found again by its id and its version."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(row_id(id_col).alias("doc"), F.xxhash64(text).alias("version"), text.alias("text"))


#: Of how many 64-bit words the parities of a set are.
_PARITY_WORDS = 4


def _parities(values: np.ndarray) -> np.ndarray:
    """Of each of 256 classes of hashes whether the set has an odd number, as four longs."""
    odd = np.bincount((values >> np.uint64(20)).astype(np.int64) % (64 * _PARITY_WORDS), minlength=64 * _PARITY_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


class _Repeats:
    """Representatives (rep, a number) stand for the paragraphs of equal sets."""

    def __init__(self, texts: DataFrame, found: DataFrame, k: int, num: int, den: int):
        """texts (doc, version, text) and the paragraphs _scan() found in them."""
        self.docs, self.found, self.k, self.num, self.den = texts, found, k, num, den
        self.space = Workspace(texts.sparkSession, "substring-dedup")

    def run(self) -> DataFrame:
        """(doc, version, place, words, first, cluster_size); first is (doc, version, place) of the one that stays."""
        space, found = self.space, self.found
        # One row a key: its first occurrence, from partial minima.
        where = F.struct("doc", "version", "place")
        reps = found.groupBy("key1", "key2").agg(F.min(where).alias("first"), F.any_value("n").alias("n"), F.any_value("bands").alias("bands"))
        reps = space.stage(numbered(reps.select("key1", "key2", "first.*", "n", "bands"), "rep"), "reps")
        rows = space.stage(found.select("doc", "version", "place", "words", "key1", "key2").distinct(), "rows")
        buckets = reps.select("rep", F.explode("bands").alias("band"))
        sizes = buckets.groupBy("band").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        shared = space.stage(buckets.join(sizes, "band"), "shared")
        # The leader of a bucket is the one that meets most others in its buckets: the common part of a group, or its original.
        weights = shared.groupBy("rep").agg(F.sum(F.log2("size")).alias("weight"))
        leaders = shared.join(weights, "rep").groupBy("band").agg(F.min(F.struct(-F.col("weight"), F.col("rep"))).alias("leader"))
        leaders = leaders.select("band", F.col("leader.rep").alias("leader"))
        members = space.stage(shared.select("rep", "band").join(leaders, "band"), "members")
        space.drop("shared")
        stars = members.filter("rep <> leader").select(F.col("rep").alias("a"), F.col("leader").alias("b")).distinct()
        stars = self._verified(stars, self._sets(stars.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), reps, "stars"), "stars")
        inside = components(stars, space, "inside")
        placed = members.join(inside.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        placed = space.stage(placed.select("band", "rep", "component"), "placed")
        mixed = placed.groupBy("band").agg(F.min("component").alias("one"), F.max("component").alias("other")).filter("one <> other").select("band")
        open_reps = space.stage(placed.join(mixed, "band", "left_semi").select("rep", "component").distinct(), "open")
        space.drop("members", "placed")
        sets = self._sets(open_reps.select("rep"), reps, "rest")
        rest = self._verified(self._sharing(sets, open_reps), sets, "rest")
        space.drop("open")
        linked = components(edges_of(inside).unionByName(rest), space, "linked")
        named = reps.select("rep", "key1", "key2").join(linked.withColumnRenamed("node", "rep"), "rep", "left")
        named = space.stage(named.select("key1", "key2", F.coalesce("component", "rep").alias("cluster")), "named")
        space.drop("reps", "inside", "linked", "stars-links", "rest-links")
        placed = space.stage(rows.join(named, ["key1", "key2"]).drop("key1", "key2"), "occurrences")
        space.drop("rows", "named")
        clusters = placed.groupBy("cluster").agg(F.count(F.lit(1)).alias("cluster_size"), F.min(where).alias("first"))
        return placed.join(clusters.filter("cluster_size > 1"), "cluster").drop("cluster")

    def _sets(self, wanted: DataFrame, reps: DataFrame, name: str) -> DataFrame:
        """(rep, shingles) of the representatives wanted, read again from the texts."""
        space, k = self.space, self.k
        places = reps.select("rep", "doc", "version", "place").join(wanted, "rep")
        places = places.groupBy("doc", "version").agg(F.collect_list(F.struct("place", "rep")).alias("wanted"))
        places = space.stage(places, f"{name}-places")
        texts = likely_in(self.docs, places, ["doc", "version"]).groupBy("doc", "version").agg(F.any_value("text").alias("text"))
        texts = texts.join(places, ["doc", "version"]).select("text", "wanted")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                reps, sets, bits = [], [], []
                for text, wanted in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist()):
                    lines = text.split(b"\n")
                    for w in wanted:
                        reps.append(w["rep"])
                        one = np.unique(shingle_hashes(word_hashes(lines[w["place"]]), k))
                        sets.append(one.view(np.int64))
                        bits.append(_parities(one))
                kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((reps, sets, bits), kinds)], names=["rep", "shingles", "bits"])

        sets = space.stage(map_arrow(texts, run, "rep long, shingles array<long>, bits array<long>"), f"{name}-sets")
        space.drop(f"{name}-places")
        return sets

    def _sharing(self, sets: DataFrame, open_reps: DataFrame) -> DataFrame:
        """Pairs (a, b) of different components that share one of their rarest shingles, as many as similarity asks for."""
        tokens = sets.select("rep", F.size("shingles").alias("n"), F.explode("shingles").alias("token"))
        seen = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("seen")).filter("seen > 1")
        # A shingle that only one of them has comes first in its order, and pairs with none.
        shared = tokens.join(seen, "token").groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("seen", "token"))).alias("shared"))
        left = F.floor(F.col("n") * (self.den - self.num) / self.den) + 1 - (F.col("n") - F.size("shared"))
        prefix = F.slice("shared", F.lit(1), F.greatest(left, F.lit(0)).cast("int"))
        rows = shared.select("rep", "n", (F.col("n") - F.size("shared")).alias("own"), F.posexplode(prefix).alias("at", "t"))
        rows = rows.select("rep", "n", (F.col("own") + F.col("at")).alias("at"), F.col("t.token").alias("token"))
        rows = self.space.stage(rows.join(open_reps, "rep").join(sets.select("rep", "bits"), "rep"), "prefixes")
        # The largest component of a list is not paired with itself.
        sizes = rows.groupBy("token", "component").agg(F.count(F.lit(1)).alias("size"))
        main = sizes.groupBy("token").agg(F.max(F.struct("size", "component")).alias("m"), F.count(F.lit(1)).alias("several")).filter("several > 1")
        rows = rows.join(main.select("token", F.col("m.component").alias("main")), "token")
        others = rows.filter("component <> main").select("token", *[F.col(c).alias(f"o_{c}") for c in ("rep", "n", "at", "component", "bits")])
        # Sets differ in as many shingles at least as their parities differ in bits: most pairs end here, before any set is read.
        apart = sum((F.bit_count(F.get("bits", F.lit(i)).bitwiseXOR(F.get("o_bits", F.lit(i)))) for i in range(_PARITY_WORDS)), F.lit(0))
        need = F.ceil((F.col("n") + F.col("o_n")) * self.num / (self.num + self.den))
        met = others.join(rows, "token").filter(
            (F.col("component") != F.col("o_component"))
            & ((F.col("component") == F.col("main")) | (F.col("o_rep") < F.col("rep")))
            & (F.least("n", "o_n") * self.den >= F.greatest("n", "o_n") * self.num)
            & (F.least(F.col("n") - F.col("at"), F.col("o_n") - F.col("o_at")) >= need)
            & (apart * (self.den + self.num) <= (F.col("n") + F.col("o_n")) * (self.den - self.num))
        )
        return met.select(F.col("o_rep").alias("a"), F.col("rep").alias("b")).distinct()

    def _verified(self, pairs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
        """The pairs whose sets are similar enough."""
        for side in ("a", "b"):
            pairs = pairs.join(sets.select(F.col("rep").alias(side), F.col("shingles").alias(f"{side}_set")), side)
        both = F.size(F.array_intersect("a_set", "b_set"))
        similar = both * self.den >= (F.size("a_set") + F.size("b_set") - both) * self.num
        links = self.space.stage(pairs.filter(similar).select("a", "b"), f"{name}-links")
        self.space.drop(f"{name}-sets", "prefixes")
        return links


def _told(found: DataFrame) -> DataFrame:
    return found.select(
        given_id("doc").alias("doc"),
        "place",
        F.col("words").cast("long").alias("words"),
        given_id("first.doc").alias("keep_doc"),
        F.col("first.place").alias("keep_place"),
        "cluster_size",
        (F.struct("doc", "version", "place") != F.col("first")).alias("removed"),
    )


def _repeats(docs: DataFrame, id_col: str, text_col: str, least: int, k: int, num: int, den: int) -> DataFrame:
    texts = _texts(docs, id_col, text_col)
    found = Workspace(docs.sparkSession, "paragraphs").stage(_scan(texts, least, None, k), "found")
    return _Repeats(texts, found, k, num, den).run()


def repeated_paragraphs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least: int = MIN_WORDS,
    k: int = SHINGLE,
    num: int = NUM,
    den: int = DEN,
) -> DataFrame:
    """One row per paragraph that another one repeats: doc, place (line number), words, keep_doc, keep_place,
    cluster_size, removed. In each cluster the first paragraph is not removed."""
    return _told(_repeats(docs, id_col, text_col, least, k, num, den))


def repeated_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """repeated_paragraphs() and repeated_passages(), from one reading of the texts."""
    texts = _texts(docs, id_col, text_col)
    space = Workspace(docs.sparkSession, "repeats")
    found = space.stage(_scan(texts, MIN_WORDS, WINDOW, SHINGLE), "found", ["kind"])
    spans = _spanned(found.filter(F.col("kind") == _PASSAGE), WINDOW)
    lines = _told(_Repeats(texts, found.filter(F.col("kind") == _PARAGRAPH), SHINGLE, NUM, DEN).run())
    space.drop("found")
    return lines, spans


def dedup_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", removed_col: str = "n_removed", **options) -> DataFrame:
    """docs without the removed paragraphs, with their number."""
    settings = {"least": MIN_WORDS, "k": SHINGLE, "num": NUM, "den": DEN} | options
    found = _repeats(docs, id_col, text_col, **settings)
    gone = found.filter(F.struct("doc", "version", "place") != F.col("first"))
    gone = gone.groupBy("doc", "version").agg(F.collect_set("place").alias("gone"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    version = F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("version")
    inner = docs.select(row, row_id(id_col).alias("doc"), version).join(gone, ["doc", "version"], "left")
    lines = F.split(F.coalesce(F.col(f"row.`{text_col}`"), F.lit("")), "\n")
    kept = F.filter(lines, lambda line, i: ~F.array_contains("gone", i))
    others = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in (text_col, removed_col)]
    text = F.when(F.col("gone").isNull(), F.col(f"row.`{text_col}`")).otherwise(F.array_join(kept, "\n"))
    return inner.select(*others, text.alias(text_col), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias(removed_col))


# --- passages inside and across lines ------------------------------------------


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each `width` values in a row; width is a power of two."""
    step = 1
    while step < width:
        values = pick(values[:-step], values[step:])
        step *= 2
    return values


def anchors(shingles: np.ndarray, reach: int = REACH) -> np.ndarray:
    """Places that hash lowest among some `reach` in a row; of equal ones side by side the first."""
    if len(shingles) < reach:
        return np.zeros(0, dtype=np.int64)
    least = _sliding(shingles, reach, np.minimum)
    edge = np.zeros(reach - 1, dtype=np.uint64)
    lowest = _sliding(np.concatenate([edge, least, edge]), reach, np.maximum) == shingles
    lowest[1:] &= shingles[1:] != shingles[:-1]
    return np.flatnonzero(lowest)


def _spans(places: list[dict], size: int) -> list[tuple[int, int, int]]:
    """(start, stop, smallest keep) of overlapping or touching windows."""
    spans: list[list[int]] = []
    for place in sorted(places, key=lambda p: p["start"]):
        if spans and place["start"] <= spans[-1][1]:
            spans[-1][1:] = [place["start"] + size, min(spans[-1][2], place["keep"])]
        else:
            spans.append([place["start"], place["start"] + size, place["keep"]])
    return [tuple(s) for s in spans]


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """One row per span of words that an earlier document has: doc, start, stop (words, half-open), keep_doc.

    Windows are cut at anchors, so a span may begin and end up to REACH words inside the passage.
    """
    found = Workspace(docs.sparkSession, "passages").stage(_scan(_texts(docs, id_col, text_col), None, size, SHINGLE), "found")
    return _spanned(found, size)


def _spanned(found: DataFrame, size: int) -> DataFrame:
    space = Workspace(found.sparkSession, "passages")
    found = found.select("doc", "version", F.col("place").alias("start"), F.col("key1").alias("window"))
    # A window that very many texts have is reduced to one row before it is shuffled.
    first = found.groupBy("window").agg(F.min("doc").alias("keep"), F.max("doc").alias("last")).filter("keep <> last").select("window", "keep")
    first = space.stage(first, "firsts")
    repeats = found.join(first, "window").filter("doc <> keep").select("doc", "version", F.struct("start", "keep").alias("place"))
    placed = repeats.groupBy("doc", "version").agg(F.collect_set("place").alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(doc, *span) for doc, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for span in _spans(places, size)]
            columns = list(zip(*rows)) or [[]] * 4
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc", "start", "stop", "keep_doc"])

    out = space.stage(map_arrow(placed.select("doc", "places"), run, "doc long, start int, stop int, keep_doc long"), "spans")
    space.drop("firsts")
    return out.withColumns({"doc": given_id("doc"), "keep_doc": given_id("keep_doc")})
