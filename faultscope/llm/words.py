"""Words of whole texts as 64-bit digests, batch by batch, without a Python object per word.

A word is a maximal run of bytes outside space and 0x09-0x0D. UTF-8 keeps those bytes for
themselves, so that splitting bytes and splitting characters give the same words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np

SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
_BASE, _LONG_WORD = 0x9E3779B97F4A7C15, 256
_POWERS: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values under which near values become unrelated ones."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        have = _POWERS[base] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


@dataclass
class Words:
    """``digests`` of all words of a batch of texts; those of text i are ``first[i]:first[i + 1]``.
    ``new_line``: whether a line break precedes the word, if asked for."""

    digests: np.ndarray
    first: np.ndarray
    new_line: np.ndarray | None = None

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def words_of(texts: list[bytes], lines: bool = False) -> Words:
    raw = np.frombuffer(b"\n".join([*texts, bytes(8)]), dtype=np.uint8)
    size = len(raw) - 8
    gap = SEPARATOR[raw[:size]]
    edges = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).view(np.int8)))
    starts, lengths = edges[0::2], edges[1::2] - edges[0::2]
    offsets = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)))
    first = np.searchsorted(starts, offsets)
    eight = np.ndarray((size + 1,), dtype="<u8", buffer=raw, strides=(1,))
    digests = mix(lengths.astype(np.uint64) + np.uint64(_BASE))
    at = np.flatnonzero(lengths)
    done = 0
    while len(at) and done < _LONG_WORD:
        left = np.minimum(lengths[at] - done, 8)
        digests[at] = mix(digests[at] ^ (eight[starts[at] + done] & _MASKS[left]))
        done += 8
        at = at[lengths[at] > done]
    for i in at:
        whole = raw[starts[i]:starts[i] + lengths[i]].tobytes()
        digests[i] = int.from_bytes(blake2b(whole, digest_size=8).digest(), "little")
    if not lines:
        return Words(digests, first)
    line = np.cumsum(raw[:size] == 0x0A, dtype=np.int64)[starts]
    return Words(digests, first, np.concatenate(([True], line[1:] != line[:-1]))[:len(line)])


def windows_of(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Digests of all ``width`` consecutive words of one text, and the index of each first word."""
    n = len(words.digests) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    total = np.zeros(len(words.digests) + 1, dtype=np.uint64)
    np.cumsum(words.digests * _powers(_BASE, len(words.digests)), out=total[1:])
    rolled = (total[width:] - total[:-width]) * _powers(pow(_BASE, -1, 1 << 64), n)
    ends = np.repeat(words.first[1:], words.counts())[:n]
    start = np.flatnonzero(np.arange(width, n + width) <= ends)
    return mix(rolled[start]), start


@dataclass
class PrefixDigests:
    """Digests of any stretch of a sequence, from sums over its beginnings. Unlike stretches may agree,
    above all on sequences made for it; where that matters the caller compares what agrees."""

    total: np.ndarray
    inverse: np.ndarray

    def of(self, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
        return (self.total[starts + lengths] - self.total[starts]) * self.inverse[starts]

    def windows(self, width: int) -> np.ndarray:
        n = max(0, len(self.total) - width)
        return (self.total[len(self.total) - n:] - self.total[:n]) * self.inverse[:n]


def prefix_digests(values: np.ndarray) -> PrefixDigests:
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * _powers(_BASE, len(values)), out=total[1:])
    return PrefixDigests(total, _powers(pow(_BASE, -1, 1 << 64), len(values) + 1))


def batches(sizes: list[int], most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts with about ``most`` bytes each; a longer text stands alone."""
    begin, held = 0, 0
    for i, size in enumerate(sizes):
        if i > begin and held + size > most:
            yield begin, i
            begin, held = i, 0
        held += size
    if begin < len(sizes):
        yield begin, len(sizes)
