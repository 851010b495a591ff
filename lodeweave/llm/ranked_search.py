"""Ranked lexical search over stored shards, with MaxScore in each.

An index is a table of shards, each a group of documents with an inverted index of
its own: the terms, their postings (document in the shard, occurrences) sorted by
term, and the documents' lengths, packed. Items are searched in blocks of a bounded
size: a block's terms go to all tasks with their weights, and each task takes its
shards one by one. In a shard a term's upper bound is the most that it gives to any
document there. The lists of an item are taken by falling bounds: as long as the
bounds of those left can make a result, a list is essential and brings in documents;
the others are probed only for documents that their bounds can still lift into the
task's best k. What tasks found is cut to the best k of all by item.

Defined results: a null or empty text has no terms, counts for no total and is never
found; a null id comes after all others of equal score; repeated rows are documents of
their own; each row of the items is an item of its own, whatever its id, and without
known terms has no results; long texts are indexed whole. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import Workspace, ascii_lower, given_id, map_arrow, pack, row_id, unpack
from .words import Words, slices

SHARD_BYTES = 8 << 20
BLOCK_TERMS = 200_000
TOP = 10
_SHARD = "n_docs long, n_terms long, terms binary, df binary, docs binary, tf binary, ids binary, lengths binary"


def _shard(ids: np.ndarray, texts: pa.Array) -> list[list]:
    words = Words(texts)
    lengths = words.counts().astype(np.int64)
    coded = words.strings().dictionary_encode()
    vocabulary = coded.dictionary.cast(pa.large_binary()).to_pylist()
    keys = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * words.rows + words.row
    posts, tf = np.unique(keys, return_counts=True)
    term, doc = np.divmod(posts, max(words.rows, 1))
    df = np.bincount(term, minlength=len(vocabulary))
    values = [int((lengths > 0).sum()), int(lengths.sum()), b"\n".join(vocabulary)]
    return [[v] for v in (*values, *[pack(x.astype(np.int32)) for x in (df, doc, tf)], pack(ids), pack(lengths))]


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Shards of the documents with about shard_bytes of text each; a longer text is a shard of its own. Write it to keep it."""
    schema = StructType.fromDDL(_SHARD)
    names = schema.fieldNames()
    arrow = [pa.int64(), pa.int64(), *[pa.binary()] * 6]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def made() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            row = _shard(table.column(0).to_numpy(), table.column(1).cast(pa.large_string()).combine_chunks())
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, arrow)], names=names)

        for whole in batches:
            for batch in slices(whole, 1, shard_bytes // 2):
                more = pc.sum(pc.binary_length(batch.column(1))).as_py() or 0
                if held and size + more > shard_bytes:
                    yield made()
                    held, size = [], 0
                held.append(batch)
                size += more
        if held:
            yield made()

    return map_arrow(docs.select(row_id(f"`{id_col}`").alias("id"), F.coalesce(f"`{text_col}`", F.lit("")).alias("text")), run, schema)


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, item_id, terms): each row of the items with a number and its distinct terms."""
    # The terms of the contract.
    found = F.regexp_extract_all(ascii_lower(F.coalesce(f"`{text_col}`", F.lit(""))), F.lit(r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"), 1)
    return items.select(F.monotonically_increasing_id().alias("item"), F.col(f"`{id_col}`").alias("item_id"), F.array_distinct(found).alias("terms"))


@dataclass(frozen=True)
class Block:
    """Items that are searched together: their terms with weights, and of each item its terms' places and weights."""

    terms: list[str]
    weights: np.ndarray
    items: list[tuple[int, np.ndarray]]


def _document_frequency(index: DataFrame, terms: list[str]) -> np.ndarray:
    shared = index.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array([t.encode() for t in shared.value], pa.binary())
        total = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for terms_, df in zip(*(c.to_pylist() for c in batch.columns)):
                at = _places(wanted, terms_)
                total[at >= 0] += unpack(df, np.int32)[at[at >= 0]]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], names=["term", "df"])

    each = map_arrow(index.select("terms", "df"), run, "term int, df long")
    out = np.zeros(len(terms), np.int64)
    for r in each.groupBy("term").agg(F.sum("df").alias("df")).collect():  # at most one row a term of the block
        out[r["term"]] = r["df"]
    return out


def _places(wanted: pa.Array, terms: bytes) -> np.ndarray:
    """Where each wanted term is in the shard's list, -1 if nowhere."""
    if not terms:
        return np.full(len(wanted), -1)
    return pc.fill_null(pc.index_in(wanted, pa.array(terms.split(b"\n"), pa.binary())), -1).to_numpy(zero_copy_only=False)


def _kth(scores: np.ndarray, k: int) -> int:
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0


def max_score(lists: list[tuple[int, np.ndarray, np.ndarray]], n_docs: int, floor: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of a shard that can be among the best k, with their whole scores; lists are (bound, documents, gains).

    floor: what a document needs at least to count (equal scores count).
    """
    lists = sorted(lists, key=lambda x: -x[0])
    rest = np.cumsum([x[0] for x in lists][::-1])[::-1].tolist() + [0]
    sums = np.zeros(n_docs, np.int64)
    at = 0
    while at < len(lists) and rest[at] >= floor:
        _, docs, gained = lists[at]
        sums[docs] += gained
        at += 1
        if at < len(lists):
            floor = max(floor, _kth(sums, k))
    found = np.flatnonzero(sums >= max(1, floor - rest[at]))
    scores = sums[found]
    for i in range(at, len(lists)):
        floor = max(floor, _kth(scores, k))
        able = scores + rest[i] >= floor
        found, scores = found[able], scores[able]
        _, docs, gained = lists[i]
        place = np.minimum(np.searchsorted(docs, found), len(docs) - 1)
        scores = scores + np.where(docs[place] == found, gained[place], 0)
    able = scores >= max(1, floor)
    return found[able], scores[able]


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _search_block(index: DataFrame, block: Block, n_docs: int, n_terms: int, k: int) -> DataFrame:
    shared = index.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        wanted = pa.array([t.encode() for t in asked.terms], pa.binary())
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                terms, *packed = (batch.column(c)[row].as_py() for c in range(6))
                at = _places(wanted, terms)
                df, docs, tf = (unpack(x, np.int32) for x in packed[:3])
                ids, lengths = (unpack(x, np.int64) for x in packed[3:])
                first = np.concatenate([[0], np.cumsum(df.astype(np.int64))])
                slow = 10 + 90 * lengths * n_docs // n_terms
                lists = {}
                for t in np.flatnonzero((at >= 0) & (asked.weights > 0)).tolist():
                    part = slice(first[at[t]], first[at[t] + 1])
                    times = tf[part].astype(np.int64)
                    gained = asked.weights[t] * (1_000_000_000 * times // (1000 * times + 8 * slow[docs[part]]))
                    lists[t] = (int(gained.max()), docs[part], gained)
                for item, mine in asked.items:
                    own = [lists[t] for t in mine.tolist() if t in lists]
                    if own:
                        held = best.get(item)
                        floor = int(held[1][-1]) if held is not None and len(held[1]) == k else 0
                        found, scores = max_score(own, len(ids), floor, k)
                        if len(found):
                            found = ids[found]
                            if held is not None:
                                found, scores = np.concatenate([held[0], found]), np.concatenate([held[1], scores])
                            best[item] = _best(found, scores, k)
        for item, (found, scores) in best.items():
            columns = [pa.array(np.full(len(found), item), pa.int64()), pa.array(found, pa.int64()), pa.array(scores, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["item", "doc", "score"])

    return map_arrow(index.select("terms", "df", "docs", "tf", "ids", "lengths"), run, "item long, doc long, score long")


def _weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    """floor(1000 ln((2N+2)/(2df+1))) of terms that a document has, else 0."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) if d else 0 for d in df], np.int64)


def search(index: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "item_id", text_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item, item_id, rank, doc, score) of each item's k best documents, over all shards of a stored index."""
    space = Workspace(index.sparkSession, "search")
    asked = space.stage(item_terms(items, id_col, text_col), "items")
    n_docs, n_terms = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    blocks = -(-(asked.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0] or 1) // block_terms)
    found = None
    for number in range(blocks if n_docs else 0):
        mine = asked.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == number).select("item", "terms").collect()
        terms = sorted({t for r in mine for t in r["terms"]})
        place = {t: i for i, t in enumerate(terms)}
        weights = _weights(_document_frequency(index, terms), n_docs)
        block = Block(terms, weights, [(r["item"], np.array([place[t] for t in r["terms"]], np.int64)) for r in mine])
        part = space.stage(_search_block(index, block, n_docs, n_terms, k), f"found{number}")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = index.sparkSession.createDataFrame([], "item long, doc long, score long")
    placed = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc")))
    top = found.withColumn("rank", placed).filter(F.col("rank") <= k)
    return top.join(asked.select("item", "item_id"), "item").select("item", "item_id", "rank", given_id("doc").alias("doc"), "score")


def search_documents(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """search() over documents (doc_id, text) that have no stored index yet."""
    index = Workspace(docs.sparkSession, "lexical").stage(build_index(docs), "shards")
    return search(index, items, k)
