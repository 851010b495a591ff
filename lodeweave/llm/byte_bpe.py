"""Byte-level BPE by corpus-level merge replay.

A task takes its documents in blocks. The distinct pieces (matches of the split
pattern) of a block lie end to end in one array of token ids, linked to their
neighbours. An inverted index holds, for each rank, the positions whose pair
makes the token of that rank. Ranks are taken in ascending order; all positions
of a rank are merged at once, and only the pairs of the touched neighbours are
looked up and entered anew. Then each document is put together from the ids of
its pieces. No words are shuffled: a dictionary of a whole corpus grows with
it, the pieces of a block don't.

A merge that makes a pair of lower rank than its own could have to come before
another merge of its own rank in the same piece; such pieces are replayed alone,
one merge at a time, which gives what the reference order gives.

Defined results: null text is empty and has no ids; repeated rows are encoded
like any others; other columns pass through.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_arrow

BLOCK_BYTES = 6 << 20
CACHED_PIECES = 250_000
NONE = np.int32(np.iinfo(np.int32).max)


class Ranks:
    """A rank file's tokens, and for each pair of them the rank of the two together."""

    def __init__(self, lines: list[bytes]):
        self.tokens: list[bytes] = []
        pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, filter(None, lines)))
        if [rank for rank, _ in pairs] != list(range(len(pairs))):
            raise ValueError("ranks have to run from 0 without a gap")
        self.tokens = [token for _, token in pairs]
        ranks = {token: rank for rank, token in pairs}
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        keys, made = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 20 | right)
                    made.append(rank)
        order = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
        self.keys = np.array(keys, dtype=np.int64)[order]
        self.made = np.array(made, dtype=np.int32)[order]
        self.made_of = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"made_of": None}

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank each pair makes, NONE where it makes none."""
        wanted = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.made[at], NONE)

    def one_piece(self, piece: bytes) -> list[int]:
        """Merge by merge: the lowest rank, the leftmost of it, from a heap of the pairs there are."""
        if self.made_of is None:
            self.made_of = dict(zip(self.keys.tolist(), self.made.tolist()))
        made_of = self.made_of
        ids = [int(self.of_byte[b]) for b in piece]
        n = len(ids)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        heap = []

        def enter(at: int) -> None:
            if at >= 0 and after[at] >= 0:
                rank = made_of.get(ids[at] << 20 | ids[after[at]])
                if rank is not None:
                    heapq.heappush(heap, (rank, at, ids[at], ids[after[at]]))

        for at in range(n):
            enter(at)
        while heap:
            rank, at, left, right = heapq.heappop(heap)
            then = after[at]
            if ids[at] != left or then < 0 or ids[then] != right:
                continue  # one of the two has been merged since
            ids[at], ids[then] = rank, -1
            after[at] = after[then]
            if after[at] >= 0:
                before[after[at]] = at
            enter(at)
            enter(before[at])
        return [i for i in ids if i >= 0]


def read_ranks(path: str) -> Ranks:
    with open(path, "rb") as lines:
        return Ranks(lines.read().split(b"\n"))


def replay(ranks: Ranks, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces end to end, and where each piece starts (one more entry than pieces)."""
    lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
    starts = np.concatenate([[0], np.cumsum(lengths)])
    ids = ranks.of_byte[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
    n = len(ids)
    after = np.arange(1, n + 1, dtype=np.int32)
    before = np.arange(-1, n - 1, dtype=np.int32)
    full = lengths > 0
    after[starts[1:][full] - 1] = -1
    before[starts[:-1][full]] = -1
    alive = np.ones(n, dtype=bool)
    made = np.full(n, NONE, dtype=np.int32)
    whole = np.flatnonzero(after >= 0)
    made[whole] = ranks.lookup(ids[whole], ids[whole + 1])
    odd: list[np.ndarray] = []
    index: dict[int, list[np.ndarray]] = {}
    queue: list[int] = []

    def enter(positions: np.ndarray) -> None:
        found = made[positions]
        positions, found = positions[found != NONE], found[found != NONE]
        if not len(found):
            return
        if len(found) == 1:
            cuts, order = [0, 1], positions
            firsts = found.tolist()
        else:
            by = np.argsort(found, kind="stable")
            order, sorted_ranks = positions[by], found[by]
            cuts = [0, *(np.flatnonzero(sorted_ranks[1:] != sorted_ranks[:-1]) + 1).tolist(), len(order)]
            firsts = sorted_ranks[cuts[:-1]].tolist()
        for i, rank in enumerate(firsts):
            part = order[cuts[i] : cuts[i + 1]]
            if rank in index:
                index[rank].append(part)
            else:
                index[rank] = [part]
                heapq.heappush(queue, rank)

    enter(whole)
    while queue:
        rank = heapq.heappop(queue)
        parts = index.pop(rank)
        left = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
        left = left[alive[left] & (made[left] == rank)]
        if not len(left):
            continue
        if len(left) > 1:
            # In a chain of overlapping pairs each second one goes, from the left.
            linked = np.concatenate([[False], after[left[:-1]] == left[1:]])
            if linked.any():
                place = np.arange(len(left))
                head = np.maximum.accumulate(np.where(linked, 0, place))
                left = left[(place - head) % 2 == 0]
        right = after[left]
        then = after[right]
        ids[left] = rank
        alive[right] = False
        made[right] = NONE
        after[left] = then
        has = then >= 0
        before[then[has]] = left[has]
        made[left] = NONE
        to = left[has]
        if len(to):
            made[to] = ranks.lookup(ids[to], ids[after[to]])
        ahead = before[left]
        ahead = ahead[ahead >= 0]
        if len(ahead):
            made[ahead] = ranks.lookup(ids[ahead], ids[after[ahead]])
            touched = np.unique(np.concatenate([to, ahead])) if len(to) else ahead
        else:
            touched = to
        if len(touched):
            early = made[touched] < rank
            if early.any():
                odd.append(touched[early])
            enter(touched)
    kept = np.flatnonzero(alive)
    out_starts = np.searchsorted(kept, starts)
    out = ids[kept]
    if odd:
        again = np.unique(np.searchsorted(starts, np.concatenate(odd), side="right") - 1)
        parts, last = [], 0
        sizes = np.diff(out_starts)
        for p in again.tolist():
            parts.append(out[last : out_starts[p]])
            one = np.array(ranks.one_piece(pieces[p]), dtype=np.int32)
            parts.append(one)
            sizes[p] = len(one)
            last = out_starts[p + 1]
        out = np.concatenate([*parts, out[last:]])
        out_starts = np.concatenate([[0], np.cumsum(sizes)])
    return out, out_starts


class Encoder:
    """Encodes texts block by block; keeps the ids of frequent chunks from block to block."""

    def __init__(self, ranks: Ranks, pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.known: dict[str, bytes] = {}

    def chunks(self, text: str) -> list[str]:
        """Parts of text that no piece spans: the pattern takes a space only at the head of a piece or into white space."""
        if "  " in text or text[:1] == " " or text[-1:] == " " or not text or _SPACE_BEFORE_SPACE.search(text):
            return _CUTS.split(text) if text else []
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]]

    def block(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        rows = [self.chunks(text) for text in texts]
        new = list(set().union(*rows).difference(self.known))
        if len(self.known) + len(new) > CACHED_PIECES:
            self.known.clear()
            new = list(set().union(*rows))
        pieces: dict[str, int] = {}
        parts = [[pieces.setdefault(p, len(pieces)) for p in self.pattern.findall(chunk)] for chunk in new]
        if new:
            ids, starts = replay(self.ranks, [p.encode() for p in pieces])
            flat, cuts = ids.astype("<u4").tobytes(), (starts * 4).tolist()
            for chunk, got in zip(new, parts):
                self.known[chunk] = b"".join([flat[cuts[p] : cuts[p + 1]] for p in got])
        known = self.known.__getitem__
        return [b"".join(map(known, row)) for row in rows]


# A cut goes before each space whose forerunner is no white space.
_WHITE = "\\x09-\\x0d\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_CUTS = re.compile(f"(?<=[^{_WHITE}])(?=\\x20)")
_SPACE_BEFORE_SPACE = re.compile(f"[{_WHITE}]\\x20")


def _blocks(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about BLOCK_BYTES of text each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    begin, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > BLOCK_BYTES:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += size
    if len(sizes):
        yield batch.slice(begin)


def _bytes_of(tokens: list[bytes], ids: bytes | None) -> bytes:
    return b"".join(map(tokens.__getitem__, np.frombuffer(ids or b"", "<u4").tolist()))


def encode(
    docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None
) -> DataFrame:
    """docs with `ids_col`: the ids as packed little-endian unsigned 32-bit integers (binary).

    decoded_col: also the bytes that these ids decode to, in the same pass (one Python worker a task).
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    made = [c for c in (ids_col, decoded_col) if c]
    kept = [c for c in docs.columns if c not in made]
    at = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value, pattern)
        tokens = shared.value.tokens
        for whole in batches:
            for batch in _blocks(whole, at):
                ids = encoder.block([x or "" for x in batch.column(at).to_pylist()])
                columns = [ids, [_bytes_of(tokens, x) for x in ids]][: len(made)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c, type=pa.binary()) for c in columns]], names=[*kept, *made])

    schema = T.StructType([*[docs.schema[c] for c in kept], *[T.StructField(c, T.BinaryType()) for c in made]])
    return map_arrow(docs.select(*[f"`{c}`" for c in kept]), run, schema)


def decode(rows: DataFrame, ranks_path: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """rows with `bytes_col`: the bytes of the packed ids; null ids are no ids."""
    shared = rows.sparkSession.sparkContext.broadcast(read_ranks(ranks_path).tokens)
    kept = [c for c in rows.columns if c != bytes_col]
    at = kept.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _blocks(whole, at):
                texts = [_bytes_of(shared.value, x) for x in batch.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, type=pa.binary())], names=[*kept, bytes_col])

    schema = T.StructType([*[rows.schema[c] for c in kept], T.StructField(bytes_col, T.BinaryType())])
    return map_arrow(rows.select(*[f"`{c}`" for c in kept]), run, schema)
