"""Whole texts as byte arrays inside a task: words, their hashes, and counts per document.

An Arrow column already holds all its texts in one buffer, so words are found and hashed for
many documents at once. Work goes in chunks of whole documents; a word's hash needs only its
own bytes, so long documents are hashed in stretches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 2_000_000
STRETCH = 1 << 19
STEP = 0x9E3779B97F4A7C15 | 1

BLANK = np.zeros(256, dtype=bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True


def _signs(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


#: Number of each byte; A-Z count as a-z.
FOLDED = _signs(20240)
FOLDED[65:91] = FOLDED[97:123]
#: The same with capitals of their own.
EXACT = _signs(20241)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of STEP and of its inverse, as far as asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            n = max(n, STRETCH * 2)
            def grow(base: int) -> np.ndarray:
                factors = np.full(n, base, dtype=np.uint64)
                factors[0] = 1
                return np.multiply.accumulate(factors)

            self.up, self.down = grow(STEP), grow(pow(STEP, -1, 1 << 64))
        return self.up, self.down


_POWERS = _Powers()


@dataclass
class Texts:
    """Some documents: their bytes, and where each begins and ends in them."""

    first: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def counts(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each document are marked."""
        at = np.flatnonzero(mask)
        return np.searchsorted(at, self.ends) - np.searchsorted(at, self.starts)


def texts(column: pa.Array, chunk: int = CHUNK) -> Iterator[Texts]:
    """The column in runs of whole documents of about ``chunk`` bytes; null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + chunk, side="right")) - 1)
        at = offsets[row : end + 1] - offsets[row]
        yield Texts(row, data[offsets[row] : offsets[end]], at[:-1], at[1:])
        row = end


@dataclass
class Words:
    """Words of some documents: first byte, end, folded hash; bounds[i] to bounds[i + 1] are document i's."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray


def words(part: Texts, kept: np.ndarray | None = None, cuts: np.ndarray | None = None, signs: np.ndarray = FOLDED) -> Words:
    """Runs of non-blank bytes and their hashes; ``cuts`` marks bytes that begin a run of their own.

    ``kept`` marks the byte values that count: the others keep their place in the word but not
    in its hash, so that "word," and "word" are the same; a word without a counted byte hashes to 0.
    """
    solid = ~BLANK[part.data]
    begins, closes = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    closes[:-1] &= ~solid[1:]
    inside = part.ends > part.starts
    if cuts is not None:
        begins |= cuts & solid
        closes[:-1] |= cuts[1:] & solid[:-1]
    begins[part.starts[inside]] = solid[part.starts[inside]]
    closes[part.ends[inside] - 1] = solid[part.ends[inside] - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    hashes = np.empty(len(starts), dtype=np.uint64)
    word = 0
    while word < len(starts):
        base = starts[word]
        last = max(word + 1, int(np.searchsorted(ends, base + STRETCH, side="right")))
        data = part.data[base : ends[last - 1]]
        up, down = _POWERS.upto(len(data) + 1)
        if kept is None:
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(signs[data] * up[: len(data)], dtype=np.uint64)))
            place = starts[word:last] - base
        else:
            counted = kept[data]
            order = np.concatenate(([0], np.cumsum(counted)))
            terms = np.where(counted, signs[data] * up[order[:-1]], np.uint64(0))
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)))
            place = order[starts[word:last] - base]
        hashes[word:last] = (sums[ends[word:last] - base] - sums[starts[word:last] - base]) * down[place]
        word = last
    return Words(starts, ends, mixed(hashes), np.concatenate((
        np.searchsorted(starts, part.starts), [len(starts)])))


def shingles(found: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``size`` words and each document's bounds in them.

    A document of fewer words has one shingle, its whole sequence; one without words has none.
    """
    n = np.diff(found.bounds)
    have = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    bounds = np.concatenate(([0], np.cumsum(have)))
    first = np.repeat(found.bounds[:-1] - bounds[:-1], have) + np.arange(bounds[-1])
    out = np.zeros(bounds[-1], dtype=np.uint64)
    last = np.repeat(found.bounds[1:], have)
    for j in range(size):
        at = first + j
        live = at < last
        term = np.zeros(len(out), dtype=np.uint64)
        term[live] = mixed(found.hashes[at[live]] + np.uint64((2 * j + 1) * STEP & 0xFFFFFFFFFFFFFFFF))
        out += term
    return mixed(out), bounds
