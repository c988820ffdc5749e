"""Words and shingles of whole texts as numpy arrays of 64-bit hashes.

A word is a run of bytes other than space and 0x09-0x0D, with A-Z lower-cased. Its hash mixes in eight bytes at a time; that of a word
of more than LONG bytes is XXH3. A shingle's hash mixes those of its words. Memory is proportional to the longest text of a
chunk; chunks hold at least one text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

CHUNK_BYTES = 2 << 20
LONG = 64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Every ASCII sign other than letters and digits parts words, for comparisons that pass over punctuation.
PUNCTUATED = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_FACTORS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def hashed(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Hashes of the stretches of lower-cased bytes."""
    sizes = stops - starts
    padded = np.concatenate((_LOWER[data], np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data),), "<u8", padded, strides=(1,))  # the eight bytes from each place on
    out = mix(sizes.astype(np.uint64) * _FACTORS[0])
    now = np.arange(len(starts)) if not len(starts) or sizes.max() <= LONG else np.flatnonzero(sizes <= LONG)
    for at in range(0, LONG, 8):
        left = sizes[now] - at
        block = eight[starts[now] + at]
        part = left < 8
        block[part] &= (np.uint64(1) << (8 * left[part]).astype(np.uint64)) - np.uint64(1)
        out[now] = mix(out[now] ^ block)
        now = now[left > 8]
        if not len(now):
            break
    for w in np.flatnonzero(sizes > LONG):
        out[w] = xxhash.xxh3_64_intdigest(padded[starts[w] : stops[w]].tobytes())
    return out


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of pieces of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32, count=n + 1 + column.offset)[column.offset :].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def words(data: np.ndarray, offsets: np.ndarray, parts: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, first byte and end byte of all words (runs of bytes not in ``parts``), and each text's bounds in them."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~parts[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[edges] = inside[edges]
    ends = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[ends] = inside[ends]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = hashed(data, starts, stops)
    return hashes, starts, stops, np.searchsorted(starts, offsets)


def ngrams(hashes: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of k words inside a text, the index of each run's first word, and each text's bounds in them."""
    if len(hashes) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    m = len(hashes) - k + 1
    total = hashes[:m] * _FACTORS[0]
    for j in range(1, k):
        total += hashes[j : j + m] * _FACTORS[j]
    whole = np.ones(m, dtype=bool)
    for b in bounds[1:-1]:
        whole[max(0, b - k + 1) : min(b, m)] = False
    at = np.flatnonzero(whole)
    return mix(total[at] + np.uint64(k)), at, np.searchsorted(at, bounds)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Each text's sorted distinct k-word shingles, one after the other, and their bounds. A text with fewer words has
    its whole sequence as one; a text without words has none."""
    hashes, _, _, bounds = words(data, offsets)
    grams, _, at = ngrams(hashes, bounds, k)
    counts = np.diff(bounds)
    short = np.flatnonzero((counts > 0) & (counts < k))
    few = {}
    for d in short:
        own = hashes[bounds[d] : bounds[d + 1]]
        few[int(d)] = mix((own * _FACTORS[: len(own)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(1000 + len(own)))
    parts, sizes = [], np.zeros(len(bounds), np.int64)
    for d in range(len(bounds) - 1):
        own = few.get(d)
        if own is None:
            own = np.sort(grams[at[d] : at[d + 1]])
            if len(own) > 1:
                own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        parts.append(own)
        sizes[d + 1] = len(own)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.cumsum(sizes)


class Summary:
    """The frequent values of a stream (Misra and Gries, 1982): at most ``size`` of them, each counted short by at most one
    ``size``-th of the stream. Memory: twice ``size`` and a piece of values."""

    def __init__(self, size: int, piece: int = 1 << 20):
        self.size, self.piece = size, piece
        self.values, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.parts: list[np.ndarray] = []
        self.held = 0

    def add(self, values: np.ndarray) -> None:
        if len(values):
            self.parts.append(values)
            self.held += len(values)
        if self.held >= self.piece:
            self.fold()

    def fold(self) -> None:
        new, n = np.unique(np.concatenate(self.parts), return_counts=True)
        both, weights = np.concatenate((self.values, new)), np.concatenate((self.counts, n))
        order = np.argsort(both, kind="stable")
        both, weights = both[order], weights[order]
        first = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1])))
        self.values, self.counts = both[first], np.add.reduceat(weights, first)
        if len(self.values) > self.size:
            at = len(self.values) - self.size - 1
            self.counts = self.counts - np.partition(self.counts, at)[at]
            self.values, self.counts = self.values[self.counts > 0], self.counts[self.counts > 0]
        self.parts, self.held = [], 0

    def batches(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            self.fold()
        for at in range(0, len(self.values), 1 << 14):
            s = slice(at, at + (1 << 14))
            yield pa.RecordBatch.from_pydict({"token": pa.array(self.values[s].view(np.int64)), "n": pa.array(self.counts[s])})
