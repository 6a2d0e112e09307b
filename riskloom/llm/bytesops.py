"""Numpy helpers over a run of documents laid end to end as UTF-8 bytes.

All functions take ``data`` (uint8, the documents concatenated) and ``ends``
(int64, the exclusive end of each document) and work on whole arrays, so a
task spends its time in numpy, not in a Python loop per word or byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64

#: True for the separators of words: space and 0x09..0x0D.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


#: Modulus of the fingerprints, a prime: no pair of words collides for every base, as some do modulo 2^64.
PRIME = (1 << 61) - 1
_P = U64(PRIME)


#: Numbers that are worked on at once, so that what is between stays in the cache.
STEP = 1 << 14


def _in_steps(n: int) -> Iterator[slice]:
    return (slice(a, min(a + STEP, n)) for a in range(0, n, STEP))


def _folded(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, for any x below 2^64."""
    x = (x & _P) + (x >> U64(61))
    return x - _P * (x >= _P)


def _shifted(x: np.ndarray, bits: int) -> np.ndarray:
    """x * 2^bits modulo the prime, for x below it: a rotation of 61 bits."""
    return ((x << U64(bits)) & _P) | (x >> U64(61 - bits))


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low = U64((1 << 31) - 1)
    a1, a0, b1, b0 = a >> U64(31), a & low, b >> U64(31), b & low
    mid = a1 * b0 + a0 * b1
    return _folded(U64(2) * (a1 * b1) + (mid >> U64(30)) + ((mid & U64((1 << 30) - 1)) << U64(31)) + a0 * b0)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the prime, by halves of 31 bits, for a and b below it."""
    out = np.empty(len(a), U64)
    for k in _in_steps(len(a)):
        out[k] = _times(a[k], b[k])
    return out


class Rolling:
    """Rabin-Karp fingerprints of any window from prefix sums, modulo 2^61 - 1.

    A prefix sum is kept as lanes, the bits of the terms cut into short fields
    that are summed apart: sums of a window never overflow, so a step costs no
    reduction and only the windows that are asked for are put together.
    """

    #: Bits of a lane's field for bytes: 9 bits by 21 hold windows of up to 2^34 bytes.
    FIELD = 21

    def __init__(self, seed: int):
        self.base = int(np.random.default_rng(seed).integers(1 << 32, PRIME))
        self.inverse = pow(self.base, -1, PRIME)
        self._up = self._down = np.ones(1, U64)

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._up) < n:
            m = 1 << max(16, (n - 1).bit_length())
            self._up, self._down = _geometric(self.base, m), _geometric(self.inverse, m)
        return self._up[:n], self._down[:n]

    def prefix(self, values: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """Lanes (bits they stand above, prefix sums one longer than values); values: uint8 or numbers below 2^64."""
        n, letters = len(values), values.dtype == np.uint8
        up = self._powers(n + 1)[0]
        lanes = [(k, np.zeros(n + 1, U64)) for k in (range(0, 63, self.FIELD) if letters else (0, 32))]
        field = U64((1 << (self.FIELD if letters else 32)) - 1)
        for k in _in_steps(n):
            v = values[k].astype(U64) + U64(1) if letters else _times(_folded(values[k]), up[k])
            for bits, sums in lanes:
                # the terms of a lane, summed on from where it stands
                term = v * (up[k] >> U64(bits) & field) if letters else v >> U64(bits) & field
                np.cumsum(term, out=sums[k.start + 1:k.stop + 1])
                sums[k.start + 1:k.stop + 1] += sums[k.start]
        return lanes

    @staticmethod
    def _sum(prefix: list[tuple[int, np.ndarray]], start: np.ndarray, end: np.ndarray) -> np.ndarray:
        total = None
        for k, sums in prefix:
            part = _folded(sums[end] - sums[start])
            part = _shifted(part, k) if k else part
            total = part if total is None else _folded(total + part)
        return total

    def spans(self, prefix: list[tuple[int, np.ndarray]], start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Mixed fingerprint of values[start:end] for arrays of starts and ends."""
        down = self._powers(len(prefix[0][1]))[1]
        out = np.empty(len(start), U64)
        for k in _in_steps(len(start)):
            out[k] = mix(_times(self._sum(prefix, start[k], end[k]), down[start[k]]))
        return out

    def without_one(self, values: np.ndarray) -> np.ndarray:
        """For each place, the fingerprint of all values but the one there."""
        n = len(values)
        prefix, at = self.prefix(values), np.arange(n)
        after = times(self._sum(prefix, at + 1, np.full(n, n)), np.full(n, self.inverse, U64))
        return mix(_folded(self._sum(prefix, np.zeros(n, np.int64), at) + after))


def _geometric(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo the prime, by doubling; n a power of two."""
    out = np.ones(n, U64)
    have = 1
    while have < n:
        out[have:2 * have] = times(out[:have], np.full(have, pow(base, have, PRIME), U64))
        have *= 2
    return out


class Wrapping:
    """Fingerprints modulo 2^64, for windows of fewer than 512 bytes; ``prefix`` and ``spans`` as ``Rolling``.

    Cheaper, and enough there: the strings that collide for every base (words
    of Thue and Morse, whose difference is divisible by a growing power of two)
    keep 11 differing bits at 511 bytes and collide from 1,024 bytes on.
    """

    WINDOW = 512

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.base = (int(rng.integers(1 << 62)) << 3 | 3) & (1 << 64) - 1
        self.inverse = pow(self.base, -1, 1 << 64)
        # odd differences of two bytes would not matter; even ones lose no more than the few bits that they share
        self.table = rng.integers(0, 1 << 64, 256, dtype=U64)
        self._up = self._down = np.ones(1, U64)

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._up) < n:
            m = 1 << max(16, (n - 1).bit_length())
            up, down = np.full(m, self.base, U64), np.full(m, self.inverse, U64)
            up[0] = down[0] = 1
            self._up, self._down = np.cumprod(up), np.cumprod(down)
        return self._up[:n], self._down[:n]

    def prefix(self, values: np.ndarray) -> np.ndarray:
        out, up = np.zeros(len(values) + 1, U64), self._powers(len(values) + 1)[0]
        for k in _in_steps(len(values)):
            np.cumsum(self.table[values[k]] * up[k], out=out[k.start + 1:k.stop + 1])
            out[k.start + 1:k.stop + 1] += out[k.start]
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        down = self._powers(len(prefix))[1]
        out = np.empty(len(start), U64)
        for k in _in_steps(len(start)):
            out[k] = mix((prefix[end[k]] - prefix[start[k]]) * down[start[k]])
        return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that every bit depends on all others."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x9E3779B97F4A7C15)
    x = x ^ (x >> U64(29))
    x = x * U64(0xBF58476D1CE4E5B9)
    return x ^ (x >> U64(32))


def columns(batch: pa.RecordBatch, name: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """(data, ends) of a binary Arrow column without nulls; no copy of the bytes."""
    col = batch.column(name)
    wide = pa.types.is_large_binary(col.type)
    _, offsets, values = col.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8)[off[0]:off[-1]] if values is not None and len(col) else np.zeros(0, np.uint8)
    return data, off[1:] - off[0]


def words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each document the number of words up to its end."""
    ink = ~IS_SPACE[data]
    before = np.empty(len(data) + 1, bool)
    before[0], before[1:] = False, ink
    after = np.empty(len(data) + 1, bool)
    after[:-1], after[-1] = ink, False
    inner = ends[(ends > 0) & (ends < len(data))]
    before[inner] = False  # a document's first byte begins a word
    starts = np.flatnonzero(ink & ~before[:-1])
    after[inner] = False
    stops = np.flatnonzero(ink & ~after[1:]) + 1
    return starts, stops, np.searchsorted(starts, ends)


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edge = np.diff(np.concatenate(([0], flags.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def cover(n: int, starts: np.ndarray, length: int | np.ndarray) -> np.ndarray:
    """Boolean array: which of n positions lie in some [start, start + length)."""
    depth = np.bincount(starts, minlength=n + 1)[:n + 1].astype(np.int32)
    depth -= np.bincount(np.minimum(starts + length, n), minlength=n + 1)[:n + 1].astype(np.int32)
    return np.cumsum(depth[:n]) > 0


def difference_cover(length: int) -> tuple[int, np.ndarray]:
    """(v, D): every residue modulo v is a difference of two elements of D.

    v = q^2 + q + 1 for the largest prime q with 3 v <= 2 length. D is a Singer
    set: the places where a third-order linear recurrence modulo q is zero.
    """
    primes = [q for q in range(2, 200) if all(q % d for d in range(2, int(q**0.5) + 1))]
    fit = [q for q in primes if 3 * (q * q + q + 1) <= 2 * length]
    if not fit:
        return 1, np.zeros(1, np.int64)
    q = fit[-1]
    v = q * q + q + 1
    for code in range(q, q**3):
        a, b, c = code // q // q, code // q % q, code % q
        s, found = (0, 0, 1), []
        for n in range(v):
            if s[0] == 0:
                found.append(n)
            s = (s[1], s[2], (a * s[2] + b * s[1] + c * s[0]) % q)
        if len(found) == q + 1 and len({(x - y) % v for x in found for y in found}) == v:
            return v, np.array(found, np.int64)
    raise AssertionError("a Singer set exists for every prime")
