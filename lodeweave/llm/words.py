"""Words of Arrow columns, found by a byte automaton over the buffers: no Python object for a text or a word."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are taken at a time, at least one row.
SLICE_BYTES = 4 << 20
#: As soon as so few runs are left, each is finished by itself.
FEW_RUNS = 32

_BYTES = np.arange(256, dtype=np.uint8)
# The words of the contracts are all runs of [^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F].
IS_WORD = (_BYTES >= 0x80) | ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x41) & (_BYTES <= 0x5A)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A))
LOWERED = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)


def _crc_table() -> np.ndarray:
    """What a byte does to the reflected CRC-32 register (polynomial EDB88320)."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


CRC = _crc_table()
CRC_START = np.uint32(0xFFFFFFFF)


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of about `most` bytes of text each; a longer text is one by itself."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < len(ends):
        held = ends[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(ends, held + most, side="right")))
        yield batch.slice(begin, stop - begin)
        begin = stop


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and where each begins (one more entry than texts); null is empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if not len(texts) or data is None:
        return np.empty(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


class Words:
    """data: lower-cased bytes; of each word its start, its length and its row."""

    def __init__(self, texts: pa.Array):
        raw, bounds = flat(texts)
        self.rows = len(texts)
        self.data = LOWERED[raw]
        self.inside = IS_WORD[raw]
        edge = np.zeros(len(raw) + 1, dtype=bool)
        edge[bounds] = True
        joined = self.inside[1:] & self.inside[:-1] & ~edge[1:-1]
        self.starts = np.flatnonzero(self.inside & ~np.concatenate([[False], joined])[: len(raw)])
        self.lengths = np.flatnonzero(self.inside & ~np.concatenate([joined, [False]])[: len(raw)]) + 1 - self.starts
        self.row = np.searchsorted(bounds, self.starts, side="right") - 1

    def counts(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.rows)

    def strings(self) -> pa.Array:
        """The words as one Arrow array."""
        ends = np.concatenate([[0], np.cumsum(self.lengths)]).astype(np.int64)
        return pa.LargeStringArray.from_buffers(len(self.lengths), pa.py_buffer(ends), pa.py_buffer(self.data[self.inside]))


def advance(state: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC registers after the bytes of their runs: one byte of every run at a time, the longest runs first."""
    order = np.argsort(-lengths, kind="stable")
    at, long = starts[order], lengths[order]
    moved = state[order]
    # How many runs are longer than 0, 1, 2, ... bytes.
    longer = len(long) - np.cumsum(np.bincount(long, minlength=1)) if len(long) else np.zeros(1, np.int64)
    step = 0
    while longer[step] > FEW_RUNS:
        n = int(longer[step])
        head = moved[:n]
        moved[:n] = CRC[(head ^ data[at[:n] + step]) & np.uint32(0xFF)] ^ (head >> np.uint32(8))
        step += 1
    for i in range(int(longer[step])):
        rest = data[at[i] + step : at[i] + long[i]]
        moved[i] = zlib.crc32(rest, int(moved[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    out = np.empty_like(moved)
    out[order] = moved
    return out


def run_hashes(words: Words, most_words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of 1, 2, ... words of one row, joined by one space: the row of each and its unsigned CRC-32."""
    state = np.full(len(words.starts), CRC_START, dtype=np.uint32)
    first = np.arange(len(words.starts))
    for n in range(1, most_words + 1):
        last = first + n - 1
        whole = last < len(words.row)
        whole[whole] = words.row[first[whole]] == words.row[last[whole]]
        first, last, state = first[whole], last[whole], state[whole]
        if n > 1:
            state = CRC[(state ^ np.uint32(0x20)) & np.uint32(0xFF)] ^ (state >> np.uint32(8))
        state = advance(state, words.data, words.starts[last], words.lengths[last])
        yield words.row[first], state ^ CRC_START
