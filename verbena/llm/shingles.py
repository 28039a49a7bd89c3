"""Sets of word shingles as sorted 64-bit hashes, many texts at a time in numpy."""

from __future__ import annotations

import numpy as np

U = np.uint64
_MUL, _STEP, _SHORT = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_powers_held = np.ones(1, U)


def _powers(n: int) -> np.ndarray:
    """At least n powers of the multiplier."""
    global _powers_held
    while len(_powers_held) < n:
        step = _powers_held[-1:] * _MUL
        _powers_held = np.concatenate([_powers_held, _powers_held * step])
    return _powers_held


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, number of words of every text): A-Z lower-cased, words parted by ASCII white space only."""
    raw = "\n".join(texts).encode("utf-8", "surrogatepass")
    b = np.frombuffer(raw, np.uint8)
    b = b + ((b >= 65) & (b <= 90)).astype(np.uint8) * np.uint8(32)
    space = (b == 32) | ((b >= 9) & (b <= 13))
    inside = np.concatenate([[False], ~space, [False]])
    starts = np.flatnonzero(inside[1:] & ~inside[:-1])
    ends = np.flatnonzero(~inside[1:] & inside[:-1])
    lengths = [len(t) if t.isascii() else len(t.encode("utf-8", "surrogatepass")) for t in texts]
    stops = np.cumsum(np.array(lengths, np.int64) + 1) - 1
    counts = np.diff(np.concatenate([[0], np.searchsorted(starts, stops, "right")]))
    if not len(starts):
        return np.zeros(0, U), counts
    size = ends - starts
    keep = b[~space].astype(U) + U(1)
    first = np.cumsum(size) - size
    offset = np.arange(len(keep)) - np.repeat(first, size)
    h = np.add.reduceat(keep * _powers(int(size.max()))[offset], first)
    return mix(h + size.astype(U) * _STEP), counts


def shingle_sets(texts: list[str], k: int) -> list[np.ndarray]:
    """Per text its sorted distinct k-word shingles; with fewer words the whole sequence as one; without words none."""
    with np.errstate(over="ignore"):
        words, counts = word_hashes(texts)
        rolled = np.zeros(max(0, len(words) - k + 1), U)
        factor = U(1)
        for j in range(k):
            if len(rolled):
                rolled += words[j : j + len(rolled)] * factor
            factor *= _STEP
        rolled = mix(rolled)
        out, at = [], 0
        for n in counts.tolist():
            if n >= k:
                s = np.sort(rolled[at : at + n - k + 1])
                out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
            elif n:
                h, factor = U(n) * _SHORT, U(1)
                for w in words[at : at + n]:
                    h, factor = h + w * factor, factor * _STEP
                out.append(mix(np.array([h], U)))
            else:
                out.append(np.zeros(0, U))
            at += n
        return out
