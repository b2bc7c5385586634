"""Sets of word shingles as sorted arrays of 64-bit hashes, computed a buffer of bytes at a time.

Hashes are polynomials over 2**64 that are mixed afterwards: texts that do not try to collide have equal hashes
with a chance of about n**2 / 2**64; a text made for it could make them collide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that are hashed at once; about 40 bytes of memory each. A longer text is hashed in pieces.
BUFFER = 1 << 20

_POWERS: list[np.ndarray] = []


def _powers() -> list[np.ndarray]:
    """Powers of the base and of its inverse, for a buffer; 16 MB that are made once."""
    if not _POWERS:
        for base in (_BASE, _INV):
            p = np.full(BUFFER + 2, base, dtype=np.uint64)
            p[0] = 1
            _POWERS.append(np.multiply.accumulate(p))
    return _POWERS


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * _MIX1
    h ^= h >> np.uint64(33)
    h *= _MIX2
    return h ^ (h >> np.uint64(33))


def _spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The polynomial, start and end of every run of non-blanks in at most BUFFER + 1 bytes."""
    up, down = _powers()
    total = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=total[1:])
    blank = np.concatenate(([True], _SPACE[buf], [True]))
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    start, stop = edge[0::2], edge[1::2]
    return (total[stop] - total[start]) * down[start], start, stop


def _long_words(data: bytes) -> np.ndarray:
    """The word hashes of one long text, a buffer at a time; a word over several buffers is put together."""
    out, carry, length = [], np.uint64(0), 0
    for at in range(0, len(data), BUFFER):
        piece = np.frombuffer(data, dtype=np.uint8, count=min(BUFFER, len(data) - at), offset=at)
        h, start, stop = _spans(piece)
        if length:
            if len(h) and start[0] == 0:
                h[:1] = carry + h[:1] * np.uint64(pow(int(_BASE), length, 1 << 64))
            else:
                out.append(np.array([carry], dtype=np.uint64))
        before, length = length, 0
        if len(h) and stop[-1] == len(piece):
            carry, length = h[-1], int(stop[-1] - start[-1]) + (before if start[-1] == 0 else 0)
            h = h[:-1]
        out.append(h)
    if length:
        out.append(np.array([carry], dtype=np.uint64))
    return mix(np.concatenate(out))


def buffers(data: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts that fit into a buffer together; a longer text is alone."""
    at = 0
    while at < len(data):
        size, end = 0, at
        while end < len(data) and (end == at or size + len(data[end]) + 1 <= BUFFER):
            size += len(data[end]) + 1
            end += 1
        yield at, end
        at = end


def word_hashes(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word (run of non-blanks, A-Z lower-cased) of texts that are one of `buffers`, and where each text's words begin."""
    data = [d.lower() for d in data]
    if len(data) == 1 and len(data[0]) >= BUFFER:
        words = _long_words(data[0])
        return words, np.array([0, len(words)])
    h, start, _ = _spans(np.frombuffer(b" ".join([*data, b""]), dtype=np.uint8))
    ends = np.cumsum([len(d) + 1 for d in data])
    return mix(h), np.concatenate(([0], np.searchsorted(start, ends)))


def shingle_sets(data: list[bytes], width: int) -> Iterator[np.ndarray]:
    """For each UTF-8 text its set of *width*-word shingles; a shorter text's whole sequence is one; no words, an empty set."""
    for at, end in buffers(data):
        words, first = word_hashes(data[at:end])
        if len(words) >= width:
            every = np.zeros(len(words) - width + 1, dtype=np.uint64)
            for i in range(width):
                every = every * _BASE + words[i : len(words) - width + 1 + i]
            every = mix(every)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= width:
                yield np.unique(every[a : b - width + 1])
            elif b > a:
                h = np.uint64(b - a)
                with np.errstate(over="ignore"):
                    for w in words[a:b]:
                        h = h * _BASE + w
                yield mix(np.array([h], dtype=np.uint64))
            else:
                yield np.zeros(0, dtype=np.uint64)


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """The matrix of intersection sizes, by products of incidence matrices a slice of shared shingles at a time."""
    n = len(sets)
    if n == 2:
        a, b = sets if len(sets[0]) <= len(sets[1]) else sets[::-1]
        at = np.searchsorted(b, a)
        at[at == len(b)] = 0
        both = int((b[at] == a).sum()) if len(b) and len(a) else 0
        return np.array([[len(sets[0]), both], [both, len(sets[1])]], dtype=np.int64)
    out = np.zeros((n, n), dtype=np.float64)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    new = np.concatenate(([True], every[1:] != every[:-1]))
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    column, owner = column[shared], owner[shared]
    if len(column):
        column = np.cumsum(np.concatenate(([0], column[1:] != column[:-1])))
        step = 4096
        cuts = np.searchsorted(column, np.arange(0, int(column[-1]) + 1 + step, step))
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            m = np.zeros((n, step), dtype=np.float32)
            m[owner[a:b], column[a:b] - k * step] = 1
            out += m @ m.T
    return np.rint(out).astype(np.int64)


class Against:
    """Intersection sizes of sets with a few fixed ones, by one search in the union of those."""

    def __init__(self, fixed: list[np.ndarray]) -> None:
        self.sizes = np.array([len(s) for s in fixed], dtype=np.int64)
        self.union = np.unique(np.concatenate(fixed)) if fixed else np.zeros(0, np.uint64)
        self.has = np.zeros((len(self.union), len(fixed)), dtype=np.int32)
        for k, s in enumerate(fixed):
            self.has[np.searchsorted(self.union, s), k] = 1

    def both(self, s: np.ndarray) -> np.ndarray:
        if not len(self.union) or not len(s):
            return np.zeros(len(self.sizes), dtype=np.int64)
        at = np.searchsorted(self.union, s)
        at[at == len(self.union)] = 0
        return self.has[at[self.union[at] == s]].sum(axis=0, dtype=np.int64)
