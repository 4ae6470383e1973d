"""Words of many texts at once, as 64-bit hashes, with array operations.

A word's hash is a polynomial over its bytes modulo 2**64, read off one
running sum over the whole buffer, then mixed. Words are maximal runs of
anything but ASCII white space, A-Z lower-cased where asked for.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_SEEDS = np.random.Generator(np.random.PCG64(271_828))
_VALUES = _SEEDS.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_LOWER = _VALUES.copy()
_LOWER[65:91] = _VALUES[97:123]
_BASE = 0xD1342543DE82EF95  # odd, hence invertible modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_KINDS = np.arange(256, dtype=np.uint8)
_KINDS[48:58], _KINDS[65:91], _KINDS[97:123], _KINDS[128:] = 57, 85, 97, 97
_PLUS = np.uint64(0x9E6C63D0876A9A47)

_powers = {_BASE: np.ones(1, np.uint64), _INVERSE: np.ones(1, np.uint64)}


def powers(base: int, n: int) -> np.ndarray:
    have = _powers[base]
    while len(have) < n:
        step = np.uint64(pow(base, len(have), 1 << 64))
        have = np.concatenate([have, have * step])
    _powers[base] = have if len(have) <= 1 << 24 else _powers[base]
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of values[start:end]."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(_BASE, len(values)), out=sums[1:])
    out = (sums[ends] - sums[starts]) * powers(_INVERSE, len(values) + 1)[starts]
    return mix(out ^ (ends - starts).astype(np.uint64))


@dataclass
class Words:
    docs: int
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray  # the text that a word belongs to, ascending
    bytes: np.ndarray

    def hashes(self, lower: bool = True) -> np.ndarray:
        return span_hashes((_LOWER if lower else _VALUES)[self.bytes], self.starts, self.ends)

    def shapes(self) -> np.ndarray:
        """Hashes of the words' shapes: runs of one kind of character count
        as one or as several."""
        b = self.bytes
        kinds = _KINDS[b]
        same = np.zeros(len(b), bool)
        same[1:] = (kinds[1:] == kinds[:-1]) & ~_SPACE[b[1:]]
        second = same.copy()
        second[1:] &= ~same[:-1]
        keep = ~same | second
        at = np.zeros(len(b) + 1, np.int64)
        np.cumsum(keep, out=at[1:])
        values = np.where(second[keep], _PLUS, _VALUES[kinds[keep]])
        return span_hashes(values, at[self.starts], at[self.ends])


def split(texts: list[bytes]) -> Words:
    blob = b"\n".join(texts)
    b = np.frombuffer(blob, np.uint8)
    if not len(b):
        none = np.zeros(0, np.int64)
        return Words(len(texts), none, none, none, b)
    inside = ~_SPACE[b]
    edge = np.diff(inside.view(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    firsts = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    return Words(len(texts), starts, ends, np.searchsorted(firsts, starts, side="right") - 1, b)


def ngrams(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each run of n words inside a text."""
    if len(hashes) < n:
        return hashes[:0], doc[:0]
    m = len(hashes) - n + 1
    out = hashes[:m].copy()
    for i in range(1, n):
        out = mix(out) + hashes[i : i + m]
    whole = doc[:m] == doc[n - 1 :]
    return mix(out[whole]), doc[:m][whole]


def shingles(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text), distinct and sorted by text and hash, of the n-word
    shingles; a shorter text's only shingle is its whole sequence."""
    w = split(texts)
    h = w.hashes()
    if n == 1:
        g, d = mix(h), w.doc
    else:
        g, d = ngrams(h, w.doc, n)
        count = np.bincount(w.doc, minlength=w.docs)
        for k in range(1, n):
            few = np.flatnonzero(count == k)
            if len(few):
                pick = np.isin(w.doc, few)
                gk, dk = ngrams(h[pick], w.doc[pick], k) if k > 1 else (mix(h[pick]), w.doc[pick])
                g, d = np.concatenate([g, gk + np.uint64(k)]), np.concatenate([d, dk])
    order = np.lexsort((g, d))
    g, d = g[order], d[order]
    if len(g):
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
        g, d = g[new], d[new]
    return g, d
