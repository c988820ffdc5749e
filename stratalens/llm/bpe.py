"""Byte-level BPE ids of whole texts with the tokenizers library, each different pre-token encoded once.

Texts are split into pre-tokens as the tokenizer's pattern does, on arrays of code points:
contractions, letters, digits and other signs with one leading space, and white space; strings of the tokenizer's added tokens
come first and stand alone. BPE never merges across pre-tokens, so a text's ids are those of its pre-tokens in order. The
library encodes the pre-tokens that the worker has not seen yet; the others come from a table of bounded size, which is read by a
hash and compares their signs. ``aligned`` tells whether a tokenizer file has that split; texts go to the library as a whole where it hasn't.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

OTHER, LETTER, DIGIT, SPACE = 0, 1, 2, 3
#: The split that this module reproduces.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Slots of a worker's table, and the ids and code points from which on it starts anew; longer pre-tokens are not kept.
SLOTS, POOL, POINTS, LONGEST = 1 << 21, 8_000_000, 16_000_000, 64
_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))


@lru_cache(maxsize=4)
def library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def aligned(path: str) -> bool:
    """Byte-level BPE without normaliser, prefix space or a pattern of its own, whose added tokens are plain strings: the split above is the tokenizer's."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    plain = all(not any(t.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized")) for t in spec.get("added_tokens") or [])
    whole = not any(spec.get(k) for k in ("normalizer", "truncation", "padding")) and not any(spec["model"].get(k) for k in ("ignore_merges", "dropout"))
    return plain and whole and spec["model"]["type"] == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)


def added_tokens(path: str) -> list[str]:
    with open(path, encoding="utf-8") as f:
        return [t["content"] for t in json.load(f).get("added_tokens") or [] if t["content"]]


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    import regex

    out = np.zeros(0x110000, dtype=np.uint8)
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, everything):
            a, b = m.span()
            out[ord(everything[a]) : ord(everything[b - 1]) + 1] = kind
    return out


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' code points and each text's bounds in them."""
    bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64))) if texts else np.zeros(1, np.int64)
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4"), bounds


def split(points: np.ndarray, bounds: np.ndarray, alone: list[tuple[int, int]] = ()) -> np.ndarray:
    """First code points of all pre-tokens, in order; none crosses a text's bounds. ``alone`` are stretches that stand alone."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[points]
    start = np.empty(n, dtype=bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    edge = np.zeros(n + 1, dtype=bool)
    edge[bounds] = True
    for a, b in alone:
        edge[a] = edge[b] = True
    start |= edge[:-1]
    space = kind == SPACE
    # the last sign of white space that something follows stands alone, or goes with what follows if it is a blank
    follows = np.zeros(n, dtype=bool)
    follows[:-1] = space[:-1] & ~space[1:] & ~edge[1:-1]
    last = np.flatnonzero(follows)
    start[last] = True
    blank = last[points[last] == 32]
    start[blank + 1] = False
    quotes = np.flatnonzero((points[:-1] == 39) & start[:-1] & start[1:] & (kind[1:] == LETTER)) if n > 1 else np.zeros(0, np.int64)
    for q in quotes:  # rare: a quote alone before a letter
        end = q + 1
        while end < n and end < q + 4 and kind[end] == LETTER and not (end > q + 1 and edge[end]):
            end += 1
        if edge[q + 1]:
            continue
        after = "".join(map(chr, points[q + 1 : end]))
        length = 1 if after[:1] in ("s", "t", "m", "d") else 2 if after[:2] in ("re", "ve", "ll") else 0
        if length:
            start[q + 1] = False
            if q + 1 + length < n:
                start[q + 1 + length] = True
    for a, b in alone:
        start[a + 1 : b] = False
    return np.flatnonzero(start)


class Encoder:
    def __init__(self, path: str):
        self.tokenizer = library(path)
        self.plain = not aligned(path)
        self.added = added_tokens(path)
        #: Added tokens, longest first: the library's search takes the leftmost, and of those the longest.
        self.search = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.powers = self.inverses = np.ones(1, dtype=np.uint64)
        self.reset()

    def reset(self) -> None:
        self.keys = np.zeros(SLOTS, dtype=np.uint64)
        self.at = np.zeros(SLOTS, dtype=np.int64)
        self.sizes = np.zeros(SLOTS, dtype=np.int64)
        self.where = np.zeros(SLOTS, dtype=np.int64)
        self.lengths = np.zeros(SLOTS, dtype=np.int64)
        self.pool = np.zeros(1 << 16, dtype=np.uint32)
        self.points = np.zeros(1 << 16, dtype=np.uint32)
        self.filled = self.drawn = 0

    def hashes(self, points: np.ndarray, starts: np.ndarray) -> np.ndarray:
        n = len(points)
        if len(self.powers) <= n:
            steps = np.full(n + 1, _STEP, dtype=np.uint64)
            steps[0] = 1
            self.powers = np.multiply.accumulate(steps)
            steps[1:] = _BACK
            self.inverses = np.multiply.accumulate(steps)
        x = points.astype(np.uint64)
        x += np.uint64(0x632BE59BD9B4E019)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x *= self.powers[:n]
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x)))
        stops = np.append(starts[1:], n)
        h = (sums[stops] - sums[starts]) * self.inverses[starts] + (stops - starts).astype(np.uint64)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xA0761D6478BD642F)
        h ^= h >> np.uint64(29)
        return h | np.uint64(1 << 63)  # never 0, which marks a free slot

    def encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Encode pre-tokens; returns where their ids lie."""
        at, sizes = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for b in range(0, len(texts), 4096):
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts[b : b + 4096], add_special_tokens=False)]
            lens = np.array([len(i) for i in ids], dtype=np.int64)
            flat = np.array([x for i in ids for x in i], dtype=np.uint32)
            while self.filled + len(flat) > len(self.pool):
                self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
            self.pool[self.filled : self.filled + len(flat)] = flat
            sizes[b : b + len(ids)] = lens
            at[b : b + len(ids)] = self.filled + np.cumsum(lens) - lens
            self.filled += len(flat)
        return at, sizes

    def keep(self, keys: np.ndarray, at: np.ndarray, sizes: np.ndarray, points: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        """Put pre-tokens with their code points into the table. Of those that share a slot one is kept, with its own values."""
        total = int(lengths.sum())
        while self.drawn + total > len(self.points):
            self.points = np.concatenate((self.points, np.zeros_like(self.points)))
        before = np.cumsum(lengths) - lengths
        self.points[self.drawn : self.drawn + total] = points[np.arange(total) + np.repeat(starts - before, lengths)]
        where = self.drawn + before
        self.drawn += total
        slots = (keys >> np.uint64(20)).astype(np.int64) & (SLOTS - 1)
        _, last = np.unique(slots[::-1], return_index=True)
        last = len(slots) - 1 - last
        s = slots[last]
        self.keys[s], self.at[s], self.sizes[s], self.where[s], self.lengths[s] = keys[last], at[last], sizes[last], where[last], lengths[last]

    def alone(self, texts: list[str], bounds: np.ndarray) -> list[tuple[int, int]]:
        """The stretches of added tokens in the joined texts."""
        if self.search is None:
            return []
        found = [i for i, t in enumerate(texts) if any(x in t for x in self.added)]
        return [(int(bounds[i]) + m.start(), int(bounds[i]) + m.end()) for i in found for m in self.search.finditer(texts[i])]

    def spans(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First code points and ids' places and counts of all pre-tokens, and each text's bounds in pre-tokens."""
        if self.filled > POOL or self.drawn > POINTS:
            self.reset()
        points, bounds = code_points(texts)
        starts = split(points, bounds, self.alone(texts, bounds))
        if not len(starts):
            return starts, starts, starts, np.searchsorted(starts, bounds)
        stops = np.append(starts[1:], len(points))
        lengths = stops - starts
        h = self.hashes(points, starts)
        slots = (h >> np.uint64(20)).astype(np.int64) & (SLOTS - 1)
        at, sizes = self.at[slots], self.sizes[slots]
        known = (self.keys[slots] == h) & (self.lengths[slots] == lengths)
        index = np.arange(len(points)) + np.repeat(np.where(known, self.where[slots], 0) - starts, lengths)
        known &= np.logical_and.reduceat(self.points[np.minimum(index, len(self.points) - 1)] == points, starts)
        miss = np.flatnonzero(~known)
        if len(miss):
            whole = "".join(texts)
            words = [whole[a:b] for a, b in zip(starts[miss].tolist(), stops[miss].tolist())]
            numbers: dict[str, int] = {}
            back = np.array([numbers.setdefault(w, len(numbers)) for w in words])
            _, first = np.unique(back, return_index=True)
            new_at, new_sizes = self.encoded(list(numbers))
            at[miss], sizes[miss] = new_at[back], new_sizes[back]
            short = lengths[miss[first]] <= LONGEST
            one = miss[first][short]
            self.keep(h[one], new_at[short], new_sizes[short], points, starts[one], lengths[one])
        return starts, at, sizes, np.searchsorted(starts, bounds)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if self.plain:
            return [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        _, at, sizes, bounds = self.spans(texts)
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        index = np.arange(total) + np.repeat(at - (ends - sizes), sizes)
        ids = self.pool[index]
        cuts = np.concatenate(([0], ends))[bounds]
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
