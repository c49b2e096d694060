"""Byte-level helpers for text columns inside Arrow batches.

Everything here works on the bytes that Arrow already holds: a column becomes one
uint8 array with row offsets, words become (start, length) pairs into it, and word
hashes are built eight bytes at a time for all words at once.  No Python object is
made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: ASCII white space that separates words: blank and \x09-\x0D.
WORD_BREAKS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_IS_BREAK = np.zeros(256, dtype=bool)
_IS_BREAK[list(WORD_BREAKS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [(1 << 64) - 1], dtype=np.uint64)

_M1 = np.uint64(0x9E3779B97F4A7C15)
_M2 = np.uint64(0xBF58476D1CE4E5B9)
_M3 = np.uint64(0x94D049BB133111EB)


def text_slices(batch: pa.RecordBatch, column: str, budget: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds at most ``budget`` bytes of ``column``, or one row."""
    at, rows = 0, batch.num_rows
    if rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    while at < rows:
        to = int(np.searchsorted(ends, ends[at] + budget, side="right")) - 1
        to = min(max(to, at + 1), rows)
        yield batch.slice(at, to - at)
        at = to


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty.  offsets has one more entry than rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    binary = column.cast(pa.large_binary())
    if binary.null_count:
        binary = binary.fill_null(b"")
    _, offs, data = binary.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[binary.offset : binary.offset + len(binary) + 1]
    if len(binary) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first, last = int(offsets[0]), int(offsets[-1])
    return raw[first:last], offsets - first


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M2
    x ^= x >> np.uint64(27)
    x *= _M3
    x ^= x >> np.uint64(31)
    return x


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, lengths, words per row boundary): words of all rows in order; bounds[i]:bounds[i+1] are those of row i."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~_IS_BREAK[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(len(data), dtype=bool)
    before[0] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty(len(data), dtype=bool)
    after[-1] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends - starts, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    loads = np.lib.stride_tricks.as_strided(padded.view(np.uint8)[:8].view(np.uint64), shape=(len(data) + 1,), strides=(1,))
    out = lengths.astype(np.uint64) * _M1
    step, left, at, live = 0, lengths, starts, None
    while True:
        value = loads[at] & _MASKS[np.minimum(left, 8)]
        if live is None:
            out = mix64(out ^ value)
        else:
            out[live] = mix64(out[live] ^ value)
        step += 8
        keep = np.flatnonzero(left > 8)
        if not len(keep):
            return out
        live = keep if live is None else live[keep]
        at, left = at[keep] + 8, left[keep] - 8


def chain(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Order-sensitive combination of two hashes."""
    return mix64(first * _M1 + second)
