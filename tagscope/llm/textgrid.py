"""Vectorised views of a block of texts: bytes, words, lines and hashes.

A block holds whole texts of about ``BLOCK_BYTES`` (a longer text is a block of
its own), so memory in a Python worker follows the longest text, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
U = np.uint64
_RNG = np.random.default_rng(20240117)
BYTE_HASH = _RNG.integers(1, 1 << 63, 256, dtype=U) | U(1)
_BASE = U(0x9E3779B97F4A7C15 | 1)
STEPS = _RNG.integers(1, 1 << 63, 16, dtype=U) | U(1)     # for n-grams of words or bytes
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True                      # fixed values: the blanks of the word rule
LETTER = np.zeros(256, bool)
LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_POWERS = [np.ones(1, U)]


def powers(n: int) -> np.ndarray:
    """The first n powers of the hash base, modulo 2^64."""
    if len(_POWERS[0]) < n:
        with np.errstate(over="ignore"):
            p = np.full(max(n, 4096), _BASE, U)
            p[0] = 1
            _POWERS[0] = np.multiply.accumulate(p)
    return _POWERS[0][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Finalise hashes so that all bits depend on all input bits."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def segment_hashes(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One hash per segment of byte values; segments begin at ``starts`` and
    together cover ``values``."""
    if not len(starts):
        return np.zeros(0, U)
    lengths = np.diff(np.append(starts, len(values)))
    at = np.arange(len(values)) - np.repeat(starts, lengths)
    h = np.add.reduceat(BYTE_HASH[values] * powers(int(lengths.max()))[at], starts)
    return mixed(h + lengths.astype(U))


class Block:
    """Texts as one byte array, each followed by one line end."""

    def __init__(self, texts: list[bytes]):
        self.n = len(texts)
        self.data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        size = np.fromiter(map(len, texts), np.int64, self.n) + 1
        self.stop = np.cumsum(size)          # of each text, its line end included
        self.start = self.stop - size
        self.size = size - 1
        self.word_byte = ~BLANK[self.data]
        edge = np.diff(self.word_byte.astype(np.int8), prepend=0)
        self.word_start = np.flatnonzero(edge == 1)
        self.word_stop = np.flatnonzero(edge == -1)
        self.n_words = self.count(self.word_start)
        self.word_doc = np.repeat(np.arange(self.n), self.n_words)
        self.first_word = np.cumsum(self.n_words) - self.n_words

    def count(self, positions: np.ndarray) -> np.ndarray:
        """How many of the sorted byte positions fall into each text."""
        return np.searchsorted(positions, self.stop) - np.searchsorted(positions, self.start)

    def count_where(self, mask: np.ndarray) -> np.ndarray:
        """Bytes of each text for which the mask holds."""
        return np.add.reduceat(mask, self.start, dtype=np.int64) if self.n else np.zeros(0, np.int64)

    def word_hashes(self, lower: bool = False, kept: np.ndarray | None = None) -> np.ndarray:
        """One hash per word; ``kept`` marks the byte values that count (a word
        without any hashes as empty)."""
        raw = self.data[self.word_byte]
        length = self.word_stop - self.word_start
        if kept is not None:
            counts = kept[raw]
            length = np.add.reduceat(counts, np.cumsum(length) - length, dtype=np.int64) if len(length) else length
            raw = raw[counts]
        out = np.zeros(len(length), U)
        some = length > 0
        starts = (np.cumsum(length) - length)[some]
        out[some] = segment_hashes(LOWER[raw] if lower else raw, starts)
        return out

    def word_chars(self) -> np.ndarray:
        """Code points in words, per text (bytes that continue none)."""
        return self.count_where(self.word_byte & ((self.data & 0xC0) != 0x80))

    def word_windows(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, first word) of every window of k words inside one text."""
        n = len(hashes) - k + 1
        if n <= 0:
            return np.zeros(0, U), np.zeros(0, np.int64)
        at = np.flatnonzero(self.word_doc[:n] == self.word_doc[k - 1:])
        h = np.zeros(len(at), U)
        for i in range(k):
            h += hashes[at + i] * STEPS[i]
        return mixed(h), at

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, text, holds a word) of every line; each text has one at least."""
        stop = np.flatnonzero(self.data == 10)
        start = np.append(0, stop[:-1] + 1) if len(stop) else stop
        hashes = segment_hashes(self.data, start)
        words = np.searchsorted(self.word_start, stop) - np.searchsorted(self.word_start, start)
        return hashes, np.searchsorted(self.stop, stop, side="right"), words > 0

    def repeats(self, hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """How often each hash occurs in its own text."""
        if not len(hashes):
            return np.zeros(0, np.int64)
        own = mixed(hashes + owner.astype(U) * STEPS[15])
        _, inverse, counts = np.unique(own, return_inverse=True, return_counts=True)
        return counts[inverse]


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, Block]]:
    """(first row, row after the last, block) over a string column; null: empty."""
    texts, lo, held = [], 0, 0
    for i, v in enumerate(column):
        raw = v.as_buffer().to_pybytes() if v.is_valid else b""
        if texts and held + len(raw) > limit:
            yield lo, i, Block(texts)
            texts, lo, held = [], i, 0
        texts.append(raw)
        held += len(raw) + 1
    if texts:
        yield lo, lo + len(texts), Block(texts)
