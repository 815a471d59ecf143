"""Vectorised numpy kernels over many UTF-8 texts laid end to end."""

from __future__ import annotations

import hashlib

import numpy as np

_U = np.uint64
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63 - 1, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
#: ASCII white space: \x20 and \x09 to \x0D.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

_powers: dict[int, np.ndarray] = {}


def _pow(base: int, n: int) -> np.ndarray:
    """base**i mod 2**64 for i < n, kept and grown by doubling."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1024
        while size < n:
            size *= 2
        have = np.ones(size, _U)
        k, step = 1, base
        while k < size:
            have[k : 2 * k] = have[:k] * _U(step)
            step = step * step % (1 << 64)
            k *= 2
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


#: Spans above this many bytes are named by a digest: sums modulo 2**64 can agree for long words of few letters.
LONG = 24


class Prefix:
    """Prefix sums of a polynomial hash, for the hash of any span of a buffer in constant time."""

    def __init__(self, buf: np.ndarray, lower: bool = False):
        n = len(buf)
        self.buf, self.lower = buf, lower
        self.sums = np.zeros(n + 1, _U)
        np.cumsum((_BYTE_LOWER if lower else _BYTE)[buf] * _pow(_P, n), out=self.sums[1:])
        self.inv = _pow(_PINV, n + 1)

    def spans(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hashes of buf[a:b], equal for equal bytes wherever they stand; those of long spans come from a digest."""
        out = mix((self.sums[b] - self.sums[a]) * self.inv[a] + (b - a).astype(_U) * _U(0xD6E8FEB86659FD93))
        far = np.flatnonzero(b - a > LONG)
        for i, x, y in zip(far.tolist(), a[far].tolist(), b[far].tolist(), strict=True):
            part = _LOWER[self.buf[x:y]] if self.lower else self.buf[x:y]
            out[i] = int.from_bytes(hashlib.blake2b(part.tobytes(), digest_size=8).digest(), "little")
        return out


def spread(a: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places a, a + 1, ... of each span, end to end."""
    at = np.cumsum(size) - size
    return np.repeat(a - at, size) + np.arange(int(size.sum()))


def distinct_spans(buf: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one span of each different string, each span's number among them). Strings are compared byte by byte: hashes only
    propose what may be equal."""
    if not len(a):
        z = np.zeros(0, np.int64)
        return z, z
    _, pick, back = np.unique(Prefix(buf).spans(a, b), return_index=True, return_inverse=True)
    size, lead = b - a, pick[back]
    bad = size != size[lead]
    same = np.where(bad, 0, size)
    unlike = buf[spread(a, same)] != buf[spread(a[lead], same)]
    if unlike.any():
        bad[np.repeat(np.arange(len(a)), same)[unlike]] = True
    if bad.any():
        new: dict[bytes, int] = {}
        more = []
        for i in np.flatnonzero(bad).tolist():
            raw = buf[a[i] : b[i]].tobytes()
            if raw not in new:
                new[raw] = len(pick) + len(more)
                more.append(i)
            back[i] = new[raw]
        pick = np.append(pick, more)
    return pick, back


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+ of each text: starts, ends, and for each text its first word's number (len+1)."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    inside = ~SPACE[buf]
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:n]
    last = inside
    last = last.copy()
    last[:-1] &= ~inside[1:] | cut[1:n]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


def counts(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """How many flags are set within each text."""
    c = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=c[1:])
    return c[offs[1:]] - c[offs[:-1]]


def grams(h: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word windows of each text, from word hashes h; at: first word number of each text (len+1).
    Returns the hashes and, for each text, its first window's number (len+1)."""
    sizes = np.diff(at)
    full = np.maximum(sizes - n + 1, 0)
    begin = np.zeros(len(at), np.int64)
    np.cumsum(full, out=begin[1:])
    if len(h) < n:
        return np.zeros(0, _U), begin
    m = len(h) - n + 1
    g = h[:m].copy()
    for k in range(1, n):
        g *= _U(0xC2B2AE3D27D4EB4F)
        g += h[k : k + m]
    keep = np.repeat(at[:-1] - begin[:-1], full) + np.arange(begin[-1])
    return mix(g[keep]), begin


def sequences(h: np.ndarray, a: int, b: int) -> int:
    """One hash of the word sequence h[a:b]."""
    x = 0x1234567 + (b - a)
    for v in h[a:b].tolist():
        x = (x * 0xC2B2AE3D27D4EB4F + v) % (1 << 64)
    return int(mix(np.array([x], _U))[0])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w values (len - w + 1 of them), by doubling."""
    n, k = len(x), 1
    cur = x
    while k * 2 <= w:
        cur = np.minimum(cur[: len(cur) - k], cur[k:])
        k *= 2
    if k < w:
        m = n - w + 1
        cur = np.minimum(cur[:m], cur[w - k : w - k + m])
    return cur
