"""Vectorised work on the bytes of a batch of texts (runs inside tasks).

All functions work on the concatenated UTF-8 bytes of many texts at once. Words are hashed by
sums of random byte values times random factors of the places; any stretch by a polynomial modulo
the prime 2**61 - 1 (``Stretches``), read from prefix sums. ``Rolling``, modulo 2**64, is quicker, but different stretches
made for it can agree, so it only chooses places.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; a longer text is a piece of its own.
PIECE_BYTES = 2 << 20


def splitmix(n: int, seed: int) -> np.ndarray:
    """n pseudo-random 64-bit values from a seed."""
    with np.errstate(over="ignore"):
        z = (np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
        return mix(z)


def mix(z: np.ndarray) -> np.ndarray:
    """A bijective finaliser: spreads every input bit over all output bits."""
    with np.errstate(over="ignore"):
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def word_table() -> np.ndarray:
    """Byte map: lower-cases A-Z; bytes outside 0-9, a-z and 0x80-0xFF become 0."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    keep = np.zeros(256, bool)
    keep[48:58] = keep[97:123] = keep[65:91] = keep[128:] = True
    return np.where(keep, t, 0).astype(np.uint8)


def token_table(lower: bool = True) -> np.ndarray:
    """Byte map: lower-cases A-Z (if asked); space and 0x09-0x0D become 0, NUL stays a character as 1."""
    t = np.arange(256, dtype=np.uint8)
    t[0] = 1
    if lower:
        t[65:91] += 32
    t[9:14] = 0
    t[32] = 0
    return t


WORDS, TOKENS = word_table(), token_table()


def pieces(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with the bytes of their texts and the offsets; null counts as empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = pc.fill_null(batch.column(text), "").cast(pa.large_string())
        offsets = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
        raw = col.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
        lo = 0
        while lo < len(col):
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
            yield batch.slice(lo, hi - lo), data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            lo = hi


def spans(mapped: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of non-zero bytes, which end at the texts' ends; and each text's first run."""
    if not len(mapped):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    on = mapped != 0
    first, last = on.copy(), on.copy()
    first[1:] &= ~on[:-1]
    last[:-1] &= ~on[1:]
    full = np.flatnonzero(np.diff(offsets))
    first[offsets[full]] = on[offsets[full]]
    last[offsets[full + 1] - 1] = on[offsets[full + 1] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_factors: dict[int, np.ndarray] = {}


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """Hashes of the runs of bytes from starts to ends, which may not overlap: a random value of each byte times a random factor of its place, summed."""
    size = ends - starts
    if not len(size):
        return np.zeros(0, np.uint64)
    factors = _factors.get(seed)
    if factors is None or len(factors) < size.max():
        factors = splitmix(max(int(size.max()), 4096), seed + 31) | np.uint64(1)
        if len(factors) <= PIECE_BYTES:
            _factors[seed] = factors
    before = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(before, size)
    out = np.zeros(len(size), np.uint64)
    full = size > 0
    with np.errstate(over="ignore"):
        if full.any():
            out[full] = np.add.reduceat(splitmix(256, seed + 7)[data[place + np.repeat(starts, size)]] * factors[place], before[full])
        return mix(out + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


PRIME = (1 << 61) - 1
_P, _LOW = np.uint64(PRIME), np.uint64(0xFFFFFFFF)


def reduced(t: np.ndarray) -> np.ndarray:
    """Modulo the prime, of values below 2**64."""
    t = (t & _P) + (t >> np.uint64(61))
    return np.where(t >= _P, t - _P, t)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Modulo the prime, of values below it; from halves of 32 bits, as 2**61 counts as 1."""
    ah, al, bh, bl = a >> np.uint64(32), a & _LOW, b >> np.uint64(32), b & _LOW
    cross, low = ah * bl + al * bh, al * bl
    return reduced((ah * bh << np.uint64(3)) + (cross >> np.uint64(29)) + ((cross & np.uint64((1 << 29) - 1)) << np.uint64(32)) + (low & _P) + (low >> np.uint64(61)))


class Stretches:
    """Prefix sums from which the hash of any stretch of bytes is read; two different ones agree with a chance of their length in 2**61."""

    _powers: dict[int, np.ndarray] = {}

    def __init__(self, data: np.ndarray, seed: int = 2) -> None:
        self.base = int(splitmix(1, seed)[0]) % (PRIME - 1000) + 500
        n, limb = len(data), np.uint64((1 << 21) - 1)
        up, value = self.powers(self.base, n)[:n], data.astype(np.uint64) + np.uint64(1)
        total = np.zeros(n + 1, np.uint64)
        for shift in (0, 21, 42):  # limbs of the powers, whose sums stay below 2**61
            c = np.cumsum(value * (up >> np.uint64(shift) & limb))
            total[1:] += (c >> np.uint64(61 - shift)) + ((c & np.uint64((1 << (61 - shift)) - 1)) << np.uint64(shift))
        self.sums = reduced(total)
        self.down = self.powers(pow(self.base, -1, PRIME), n + 1)

    def powers(self, base: int, n: int) -> np.ndarray:
        got = self._powers.get(base)
        if got is None or len(got) < n:
            got = np.ones(1, np.uint64)
            while len(got) < n:
                got = np.concatenate([got, product(got, np.uint64(pow(base, len(got), PRIME)))])
            if n <= 4 * PIECE_BYTES:
                self._powers[base] = got
        return got

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        there = product(reduced(self.sums[ends] + (_P - self.sums[starts])), self.down[starts])
        with np.errstate(over="ignore"):
            return mix(there + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Rolling:
    """Prefix sums from which a quick hash of any stretch of bytes is read, to choose places by; equal hashes don't mean equal bytes."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, seed: int = 1) -> None:
        self.base = 2 * int(splitmix(1, seed)[0] >> np.uint64(1)) + 1
        self.up, self.down = self.powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(splitmix(256, seed + 7)[data] * self.up[: len(data)], out=self.sums[1:])

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        got = self._powers.get(self.base)
        if got is None or len(got[0]) < n:
            n = max(n, PIECE_BYTES + 1)
            got = tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, b % (1 << 64), np.uint64))]) for b in (self.base, pow(self.base, -1, 1 << 64)))
            if n <= 4 * PIECE_BYTES:
                self._powers[self.base] = got
        return got

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def grams(words: np.ndarray, first: np.ndarray, k: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words inside a text, and each text's first of them."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(len(first), np.int64)
    c = splitmix(k, seed) | np.uint64(1)
    with np.errstate(over="ignore"):
        h = words[:n] * c[0]
        for j in range(1, k):
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + words[j : n + j] * c[j]
        h = mix(h)
    per = np.maximum(np.diff(first) - k + 1, 0)
    inside = np.zeros(len(words) + 1, np.int64)
    full = per > 0
    np.add.at(inside, first[:-1][full], 1)
    np.add.at(inside, first[:-1][full] + per[full], -1)
    return h[np.cumsum(inside)[:n] > 0], np.concatenate([[0], np.cumsum(per)])


def signed(x: np.ndarray) -> np.ndarray:
    """The same bits as Spark's long."""
    return x.view(np.int64)
