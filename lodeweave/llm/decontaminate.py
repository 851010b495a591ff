"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

A window is `window` consecutive words of an item (all of them, in a shorter
item). As a set of word shingles it can only be contained in a document whose
shingles include each of the window's, so one token is a sufficient prefix: the
shingle that is rarest in the documents. Windows of an item that share their
rarest shingle share one entry. A document probes the entries with its own
shingles; an alignment has to pass the positional bounds (the window begins at
or after the document's first word) and the length bound (it ends within it),
and then the words of the whole window are compared.

The items are the stated query set: they are dealt into blocks of bounded size,
and a document meets one broadcast block after the other in a chain of narrow
steps, each adding to its spans and items. Long items are cut into segments that
overlap by a window less a word, so a block stays bounded whatever an item's
length. No document is ever shuffled.

Defined results: null and empty texts have no words and no hits; items without
words have no windows; repeated items count once by id; a null item id is never
reported, and its windows do not count; repeated rows of a document get the same
result each; empty tables give empty ones, or no hits; other columns pass
through, but those this makes (MADE) are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow

WINDOW = 13
SHINGLE = 3
BLOCK_BYTES = 8 << 20
SEGMENT_WORDS = 4096
#: A document is contaminated when one word in so many is hit.
HIT_SHARE = 20

_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_P = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def words_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased."""
    return text.translate(_WORDS).split()


def _codes(ids: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit code of each k-shingle; equal codes are only candidates."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    wide = ids.astype(np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out = (out + wide[j : j + n] + np.uint64(1)) * _P[j % 3]
        out ^= out >> np.uint64(29)
    return out


class ItemBlock:
    """Segments of items: their words as numbers, their shingles, and (once rarity is known) the prefix entries."""

    def __init__(self, items: list[tuple[str, bytes]], window: int, shingle: int):
        self.window, self.shingle = window, shingle
        self.vocabulary: dict[bytes, int] = {}
        self.segments: list[tuple[str, np.ndarray]] = []
        for item, text in items:
            words = words_of(text)
            numbers = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words], dtype=np.int64)
            step = SEGMENT_WORDS
            for at in range(0, max(1, len(words) - window + 1), step):
                part = numbers[at : at + step + window - 1]
                if len(part):
                    self.segments.append((item, part))
        self.sizes = sorted({min(shingle, window, len(words)) for _, words in self.segments})
        self.codes = {
            k: np.unique(np.concatenate([_codes(w, k) for _, w in self.segments if min(shingle, window, len(w)) == k]))
            for k in self.sizes
        }

    def number(self, words: list[bytes]) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(w, -1) for w in words], dtype=np.int64)

    def count(self, ids: np.ndarray, counts: dict[int, np.ndarray]) -> None:
        for k in self.sizes:
            at, found = _find(self.codes[k], _codes(ids, k))
            np.add.at(counts[k], at[found], 1)

    def index(self, counts: dict[int, np.ndarray]) -> None:
        """The prefix entries: code of a rarest shingle -> (segment, its place, first and last window start, size)."""
        self.entries: dict[int, tuple[np.ndarray, dict[int, list[tuple[int, int, int, int, int]]]]] = {}
        for k in self.sizes:
            by_code: dict[int, list[tuple[int, int, int, int, int]]] = {}
            for s, (_, words) in enumerate(self.segments):
                if min(self.shingle, self.window, len(words)) != k:
                    continue
                size = min(self.window, len(words))
                codes = _codes(words, k)
                rarity = list(zip(counts[k][np.searchsorted(self.codes[k], codes)].tolist(), codes.tolist()))
                last = None
                for start in range(len(words) - size + 1):
                    place = min(range(start, start + size - k + 1), key=rarity.__getitem__)
                    entries = by_code.setdefault(rarity[place][1], [])
                    if last == place:
                        seg, p, low, _, m = entries[-1]
                        entries[-1] = (seg, p, low, start, m)
                    else:
                        entries.append((s, place, start, start, size))
                    last = place
            self.entries[k] = (np.array(sorted(by_code), dtype=np.uint64), by_code)

    def hits(self, ids: np.ndarray, mask: np.ndarray, items: set[str]) -> None:
        """Marks the words of ids inside occurring windows and adds the items that have one."""
        n = len(ids)
        for k, (codes, by_code) in self.entries.items():
            mine = _codes(ids, k)
            _, found = _find(codes, mine)
            for i in np.flatnonzero(found).tolist():
                for s, place, low, high, size in by_code[int(mine[i])]:
                    item, words = self.segments[s]
                    start, stop = low, high
                    start = max(start, place - i)  # positional bound
                    stop = min(stop, place - i + n - size)  # length bound
                    if start > stop:
                        continue
                    shift = i - place
                    reach = stop + size
                    same = ids[start + shift : reach + shift] == words[start:reach]
                    run = np.convolve(same, np.ones(size, dtype=np.int64), "valid") == size
                    for w in (start + np.flatnonzero(run)).tolist():
                        mask[w + shift : w + shift + size] = True
                        items.add(item)


def _find(sorted_codes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(sorted_codes, codes), len(sorted_codes) - 1)
    return at, sorted_codes[at] == codes


def _bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def _rarity(docs: DataFrame, text_col: str, block: ItemBlock, shared) -> dict[int, np.ndarray]:
    """How often each shingle of the block occurs in all documents; as many rows as the block has shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        counts = {k: np.zeros(len(c), dtype=np.int64) for k, c in items.codes.items()}
        for batch in batches:
            for text in _bytes(batch.column(0)):
                items.count(items.number(words_of(text or b"")), counts)
        for k, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(at), pa.array(c[at])], names=["k", "at", "n"])

    counts = {k: np.zeros(len(c), dtype=np.int64) for k, c in block.codes.items()}
    rows = map_arrow(docs.select(text_col), run, "k long, at long, n long").groupBy("k", "at").agg(F.sum("n").alias("n"))
    for k, at, n in rows.collect():
        counts[k][at] = n
    return counts


def _blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    items = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("binary").alias("text"))
    items = items.filter("item is not null and text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    number = max(1, -(-total // block_bytes))
    for b in range(number):
        rows = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(number)) == b).collect()
        yield [(r[0], bytes(r[1])) for r in rows]


_FOUND = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("hit_spans", T.ArrayType(T.ArrayType(T.LongType()))),
    T.StructField("hit_items", T.ArrayType(T.StringType())),
]

MADE = [f.name for f in _FOUND]


def _spans(mask: np.ndarray) -> list[list[int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return edge.reshape(-1, 2).tolist()


def find_items(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    shingle: int = SHINGLE,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """docs with n_words, n_hit, hit_spans (half-open, in words) and hit_items (ids as sorted strings)."""
    kept = [c for c in docs.columns if c not in MADE]
    found = docs.select(*[f"`{c}`" for c in kept])
    schema = T.StructType([*[docs.schema[c] for c in kept], *_FOUND])
    at = kept.index(text_col)
    for number, rows in enumerate(_blocks(items, item_id_col, item_text_col, block_bytes)):
        block = ItemBlock(rows, window, shingle)
        first = docs.sparkSession.sparkContext.broadcast(block)
        block.index(_rarity(docs, f"`{text_col}`", block, first) if block.segments else {})
        first.unpersist()
        found = _step(found, schema, len(kept), at, docs.sparkSession.sparkContext.broadcast(block), number > 0)
    return found


def _step(found: DataFrame, schema: T.StructType, width: int, at: int, shared, again: bool) -> DataFrame:
    names = [f.name for f in schema]
    types = [pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            out: list[list] = [[], [], [], []]
            before = [batch.column(width + i).to_pylist() for i in (2, 3)] if again else None
            for r, text in enumerate(_bytes(batch.column(at))):
                words = words_of(text or b"")
                mask, items = np.zeros(len(words), dtype=bool), set()
                if before:
                    items.update(before[1][r])
                    for start, stop in before[0][r]:
                        mask[start:stop] = True
                if words and block.segments:
                    block.hits(block.number(words), mask, items)
                for column, value in zip(out, (len(words), int(mask.sum()), _spans(mask), sorted(items, key=str.encode))):
                    column.append(value)
            arrays = [pa.array(column, type=t) for column, t in zip(out, types)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *arrays], names=names)

    return map_arrow(found, run, schema)


def contaminated():
    return (F.col("n_hit") > 0) & (F.col("n_hit") * HIT_SHARE >= F.col("n_words"))
