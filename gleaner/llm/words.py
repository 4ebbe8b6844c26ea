"""Word hashes of whole texts, computed with numpy inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes between words: blanks, or all of ASCII that is neither letter nor digit.
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True
MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}
#: Bytes that are hashed at once; small enough for a core's cache.
PIECE = 1 << 17


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, PIECE + 1)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            _POWERS[name] = np.multiply.accumulate(factors)
    return _POWERS["up"], _POWERS["down"]


def _pieces(data: bytes, between: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Cuts between words, so that memory stays bounded however long a text is."""
    start = 0
    while start < len(data):
        end = min(len(data), start + PIECE)
        while end < len(data) and not between[data[end]]:
            end += 1
        yield start, data[start:end]
        start = end


def hash_words(data: bytes, between: np.ndarray = BLANKS, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, and first bytes, of the runs of bytes without ``between``, A-Z taken as a-z.

    With ``prefixes``, the first so many bytes of each longer run are hashed too, each length in its own way; the result
    is then sorted by first byte.
    """
    found = []
    for offset, piece in _pieces(data.lower(), between):
        raw = np.frombuffer(piece, np.uint8)
        inside = np.concatenate(([False], ~between[raw], [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edges[::2], edges[1::2]
        up, down = _powers(len(raw) + 1)
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=total[1:])
        hashes, first = [mix((total[end] - total[start]) * down[start])], [start]
        for k in prefixes:
            a = start[end - start > k]
            hashes.append(mix((total[a + k] - total[a]) * down[a] ^ np.uint64(k << 56)))
            first.append(a)
        h, at = np.concatenate(hashes), np.concatenate(first) + offset
        if prefixes:
            by = np.argsort(at, kind="stable")
            h, at = h[by], at[by]
        found.append((h, at))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def hash_texts(texts: list[str | None], between: np.ndarray = BLANKS, prefixes: tuple[int, ...] = ()) -> Iterator[tuple[int, np.ndarray]]:
    """``(index, hashes)`` of ``hash_words`` for each text; short texts share one pass of numpy."""
    waiting: list[tuple[int, bytes]] = []
    size = 0
    for i, text in enumerate(texts):
        data = (text or "").encode("utf-8", "replace")
        waiting.append((i, data))
        size += len(data) + 1
        if size >= PIECE:
            yield from _together(waiting, between, prefixes)
            waiting, size = [], 0
    yield from _together(waiting, between, prefixes)


def _together(waiting: list[tuple[int, bytes]], between: np.ndarray, prefixes: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray]]:
    hashes, start = hash_words(b"\n".join(x for _, x in waiting), between, prefixes)
    ends = np.cumsum([len(x) + 1 for _, x in waiting])
    cuts = np.searchsorted(start, ends)
    low = 0
    for (i, _), high in zip(waiting, cuts, strict=True):
        yield i, hashes[low:high]
        low = high


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of ``size`` consecutive words; the whole sequence if it is shorter; none without words."""
    if len(words) == 0:
        return words
    n = max(1, len(words) - size + 1)
    width = min(size, len(words))
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = mix(out * _BASE + words[k : k + n])
    return np.unique(out)


class Lookup:
    """Places of hashes in a sorted array; a table of their upper bits passes over most of what is not in it."""

    BITS = 18

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        self.gate = np.zeros(1 << self.BITS, bool)
        self.gate[keys >> np.uint64(64 - self.BITS)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(positions in hashes, places in keys)`` of those that are there."""
        some = np.flatnonzero(self.gate[hashes >> np.uint64(64 - self.BITS)])
        if not len(some):
            return some, some
        at = np.minimum(np.searchsorted(self.keys, hashes[some]), len(self.keys) - 1)
        same = self.keys[at] == hashes[some]
        return some[same], at[same]
