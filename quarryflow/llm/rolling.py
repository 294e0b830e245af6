"""Vectorised hashes of words and word windows over many texts at once (numpy only).

A word's hash sums its letters times a fixed random factor for each place, which
no regular word defeats. Over word hashes a polynomial prefix sum modulo 2^64
gives the hash of any stretch in two look-ups; a finaliser then spreads the bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np

U = np.uint64
WORD_BASE = 0xD6E8FEB86659FD93
MOST = U(2**64 - 1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 18)
        steps = [np.full(size, b, U) for b in (base, pow(base, -1, 2**64))]
        for s in steps:
            s[0] = 1
        have = tuple(np.multiply.accumulate(s) for s in steps)
        if size <= 1 << 22:
            _powers[base] = have
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def stretch_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hashes of values[start:end] for each pair; equal stretches hash alike wherever they are."""
    up, down = powers(base, len(values) + 1)
    sums = np.concatenate((np.zeros(1, U), np.cumsum(values * up[: len(values)], dtype=U)))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U))


def place_factors(n: int) -> np.ndarray:
    """Odd 64-bit factors of the first n places of a word."""
    at = np.arange(1, n + 1, dtype=U)
    return mix(at * U(0x9E3779B97F4A7C15)) | U(1)


def word_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each stretch of code points, the stretches side by side in order."""
    n = ends - starts
    factors = place_factors(int(n.max(initial=0)))
    upto = np.cumsum(n)
    at = np.arange(upto[-1] if len(n) else 0) - np.repeat(upto - n, n)
    values = points[at + np.repeat(starts, n)].astype(U) + U(1)
    sums = np.concatenate((np.zeros(1, U), np.cumsum(values * factors[at], dtype=U)))
    return mix(sums[upto] - sums[upto - n] + n.astype(U))


def in_portions(texts: Sequence[str], most: int = 200_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` characters, a longer text alone."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield at, i
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


class Words:
    """The words of some texts, side by side: `doc` numbers each word's text, `hash` its letters."""

    def __init__(self, texts: Sequence[str], fold: Callable[[np.ndarray], np.ndarray] | None = None):
        points = np.frombuffer((" ".join(texts) + " ").encode("utf-32-le"), np.uint32)
        points = fold(points) if fold else points
        space = (points == 32) | ((points >= 9) & (points <= 13))
        edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).astype(np.int8)))
        self.starts, self.ends = edge[::2], edge[1::2]
        self.points = points
        first = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.first = first
        self.doc = np.searchsorted(first, self.starts, "right") - 1
        self.hash = word_hashes(points, self.starts, self.ends)
        self.doc_from = np.searchsorted(self.doc, np.arange(len(texts) + 1))

    def windows(self, k: int, base: int = WORD_BASE) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the k words from each word on, and whether they lie in one text."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.empty(0, U), np.empty(0, bool)
        at = np.arange(n)
        return stretch_hashes(self.hash, at, at + k, base), self.doc[:n] == self.doc[k - 1 :]


def sliding(x: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """op (minimum or maximum) over each `width` neighbours, in log steps."""
    have, out = 1, x
    while have * 2 <= width:
        out = op(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return op(out[:-rest], out[rest:]) if rest else out


def winnowed(hashes: np.ndarray, valid: np.ndarray, window_ok: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which hashes are the least of some window of `width`, and each window's least.

    window_ok says for each window start whether it counts. All ties are chosen,
    so equal windows choose the same places.
    """
    h = np.where(valid, hashes, MOST)
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(len(h), bool), np.empty(0, U)
    least = sliding(h, width, np.minimum)
    counted = np.where(window_ok[:n], least, U(0))
    pad = np.zeros(width - 1, U)
    most = sliding(np.concatenate((pad, counted, pad)), width, np.maximum)
    return valid & (most == h), least
