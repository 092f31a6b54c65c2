"""Words and word hashes of Arrow text columns, vectorised over the UTF-8 bytes.

All separators of the two word rules are ASCII, so splitting bytes and splitting code points agree.
A word's hash is a polynomial over its bytes modulo 2**64, mixed with its length; equal words have
equal hashes, and different ones share a hash with a chance of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.Generator(np.random.PCG64(20240607))
_P = int(_RNG.integers(1, 2**63)) | 1
_Q = np.uint64(int(_RNG.integers(1, 2**63)) | 1)
_BYTES = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Bytes of words of the rule [^\x20\x09-\x0D]+ .
SPACED = np.ones(256, bool)
SPACED[[32, 9, 10, 11, 12, 13]] = False
#: Bytes of words of the rule [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ .
LETTERS = np.zeros(256, bool)
LETTERS[48:58] = LETTERS[97:123] = LETTERS[128:] = True

_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(1 << 20, n)
        for k, base in enumerate((_P, pow(_P, -1, 2**64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end, and the offsets of each; a null is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, places, data = texts.buffers()
    if places is None or len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(places, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    content = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return content, at - at[0]


def pieces(batch: pa.RecordBatch, texts: pa.Array, most: int = 1 << 19) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of a batch with about ``most`` bytes of text each, so that work arrays stay small.

    A text is never cut: one longer than ``most`` makes a slice of its own.
    """
    sizes = np.diff(raw(texts)[1])
    cuts, held = [0], 0
    for k, size in enumerate(sizes.tolist()):
        if held and held + size > most:
            cuts.append(k)
            held = 0
        held += size
    for a, b in zip(cuts, [*cuts[1:], len(texts)], strict=True):
        if b > a:
            yield batch.slice(a, b - a), texts.slice(a, b - a)


class Words:
    """Words of the texts: byte ranges, hashes, and first[i]:first[i+1] as the words of text i."""

    def __init__(self, texts: pa.Array, rule: np.ndarray = SPACED, lower: bool = True):
        self.data, self.at = raw(texts)
        if lower:
            self.data = _LOWER[self.data]
        self.inside = inside = rule[self.data]
        n = len(self.data)
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edges = self.at[1:-1]
        if n:
            first, last = edges[(edges < n)], edges[(edges > 0)] - 1
            begins[first] |= inside[first]
            ends[last] |= inside[last]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, self.at)
        self.hash = self._hashes(self.start, self.end, inside)

    def _hashes(self, start: np.ndarray, end: np.ndarray, inside: np.ndarray | None) -> np.ndarray:
        return spans_hash(self.data, start, end, inside)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1), self.counts)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes, first word and text of all runs of ``k`` words inside one text."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        owner = self.owner
        where = np.flatnonzero(owner[:n] == owner[k - 1 :])
        return run_hash(self.hash, where, k), where, owner[where]


def spans_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, inside: np.ndarray | None) -> np.ndarray:
    """Hashes of the byte ranges, which are sorted, disjoint and not empty; ``inside`` marks the bytes that count."""
    if not len(start):
        return np.zeros(0, np.uint64)
    powers, inverse = _powers(len(data) + 1)
    values = _BYTES[data] * powers[: len(data)]
    if inside is not None:
        values[~inside] = 0
    sums = np.add.reduceat(values, start)
    return mix(sums * inverse[start] + (end - start).astype(np.uint64) * _Q)


def run_hash(hashes: np.ndarray, where: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` hashes from each position on."""
    total = np.full(len(where), np.uint64(k), np.uint64)
    for j in range(k):
        total = total * _Q + hashes[where + j]
    return mix(total)
