"""Vectorised hashes of the words and word or byte windows of whole texts.

Texts of an Arrow column are laid end to end in one byte array.  Prefix sums of
``value * base**position`` modulo 2**64, divided by ``base**start``, give the hash of any
window in constant time; a finaliser mixes its bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Odd multipliers of independent 64-bit hashes.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
#: Bytes of text hashed at once, few enough for arrays to stay in cache; one text at least, however long.
BLOCK_BYTES = 256 << 10

U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_BYTES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, size=256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class _Powers:
    """Powers of an odd base and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)
            for name, base in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, base, dtype=U)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


_POWERS = [_Powers(b) for b in BASES]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def text_blocks(texts: pa.Array, block_bytes: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, last row, bytes, offsets)`` of runs of texts; null counts as empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = int(np.searchsorted(at, at[lo] + (block_bytes or BLOCK_BYTES), side="right")) - 1
        hi = min(max(hi, lo + 1), len(texts))
        yield lo, hi, raw[at[lo]:at[hi]], at[lo:hi + 1] - at[lo]
        lo = hi


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased."""
    return _LOWER[data]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words (runs without ASCII white space), and per text the index of its first word, with the total."""
    inside = ~_SPACE[data]
    before = np.concatenate([[False], inside])[:len(inside)]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before[edges] = False
    after = np.concatenate([inside[1:], [False]])[:len(inside)]
    after[edges - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def prefix(values: np.ndarray, which: int = 0) -> np.ndarray:
    up, _ = _POWERS[which].get(len(values))
    out = np.zeros(len(values) + 1, dtype=U)
    np.cumsum(values * up, out=out[1:])
    return out


def spans(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of the values in each [start, end), the same wherever they stand."""
    _, down = _POWERS[which].get(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U) * U(0x2545F4914F6CDD1D))


def windows(sums: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """Hash of every ``width`` consecutive values, as ``spans`` gives it."""
    n = max(0, len(sums) - width)
    _, down = _POWERS[which].get(len(sums))
    found = sums[width:] - sums[:n]
    found *= down[:n]
    found += U((width * 0x2545F4914F6CDD1D) % (1 << 64))
    return mix(found)


def byte_prefix(data: np.ndarray, which: int = 0) -> np.ndarray:
    return prefix(_BYTES[data], which)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    return spans(byte_prefix(data, which), starts, ends, which)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, from minima of windows twice as wide at each pass."""
    if len(values) < width:
        return values[:0]
    have = 1
    while have < width:
        step = min(have, width - have)
        values = np.minimum(values[:-step], values[step:])
        have += step
    return values
