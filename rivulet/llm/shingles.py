"""Word hashes of many texts at once, and sets of word shingles, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

from .common import GOLD, mix64

#: Texts are hashed in segments of about this many bytes, cut at white space.
SEGMENT = 1 << 20
_SEED = 0x5EED
_BASE = 0xD6E8FEB86659FD93
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A random value per byte.
_BYTE = mix64((np.arange(256, dtype=np.uint64) + np.uint64(1)) * GOLD)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class WordHasher:
    """64-bit hashes of the white-space separated words of a buffer.

    A word's hash is a polynomial of random byte values, from one running sum over the
    segment and the base's inverse powers, so no loop over words is needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            self.up, self.down = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)

    def words(self, buf: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Hash and start offset of each word."""
        return self.words_and_prefixes(buf, ())[:2]

    def words_and_prefixes(self, buf: bytes, sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Also the hash of each word's first so many bytes; 0 for shorter words."""
        data = np.frombuffer(buf, dtype=np.uint8)
        hashes, starts, at = [], [], 0
        heads: list[list[np.ndarray]] = [[] for _ in sizes]
        while at < len(data):
            stop = min(at + SEGMENT, len(data))
            while stop < len(data) and not _SPACE[data[stop]]:
                stop += 1
            part = data[at:stop]
            blank = _SPACE[part]
            inside = ~blank
            edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
            begin, end = edge[inside[edge]], edge[blank[edge]]
            if inside[0]:
                begin = np.concatenate([[0], begin])
            if inside[-1]:
                end = np.concatenate([end, [len(part)]])
            self._grow(len(part) + 1)
            total = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum(_BYTE[part] * self.up[: len(part)], out=total[1:])
            hashes.append(mix64((total[end] - total[begin]) * self.down[begin] + (end - begin).astype(np.uint64) * GOLD))
            starts.append(begin + at)
            for k, out in zip(sizes, heads, strict=True):
                stop_at = np.minimum(begin + k, len(part))
                h = mix64((total[stop_at] - total[begin]) * self.down[begin] + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64)))
                out.append(np.where(end - begin >= k, h, np.uint64(0)))
            at = stop
        if not hashes:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), [np.zeros(0, dtype=np.uint64) for _ in sizes]
        return np.concatenate(hashes), np.concatenate(starts), [np.concatenate(x) for x in heads]


class Vocabulary(dict):
    """Words to numbers in order of first sight, and a 64-bit hash of each (not a polynomial of
    its bytes, which two long words can be made to share)."""

    #: More words than these are forgotten between groups of texts.
    MOST = 1 << 18

    def __init__(self) -> None:
        super().__init__()
        self.hashes: list[int] = []
        self.array = np.zeros(0, dtype=np.uint64)

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.hashes)
        self.hashes.append(xxhash.xxh3_64_intdigest(word, _SEED))
        return n

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))

    def of(self, numbers: np.ndarray) -> np.ndarray:
        """The hashes of words."""
        if len(self.array) < len(self.hashes):
            self.array = np.concatenate([self.array, np.array(self.hashes[len(self.array) :], dtype=np.uint64)])
        return self.array[numbers]

    def forget(self) -> bool:
        if full := len(self) > self.MOST:
            self.clear()
            self.hashes.clear()
            self.array = self.array[:0]
        return full


def words_of(text: bytes | None) -> list[bytes]:
    """What white space separates, A-Z lower-cased."""
    return text.lower().split() if text else []


def _rolled(h: np.ndarray, width: int, start: int = 0) -> np.ndarray:
    """A hash of each `width` neighbouring word hashes."""
    n = max(len(h) - width + 1, 0)
    acc = np.full(n, start, dtype=np.uint64)
    for k in range(width if n else 0):
        acc = (acc + h[k : n + k]) * np.uint64(0x2545F4914F6CDD1D)
        acc ^= acc >> np.uint64(29)
    return mix64(acc)


def shingle_sets(texts: list[np.ndarray], vocabulary: Vocabulary, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts as word numbers: the distinct shingle hashes of each in order, where each text's
    begin, and how many shingles it has (equal hashes are compared by their words).

    A text with fewer words than `width` has its whole sequence as one shingle."""
    count = np.array([len(t) for t in texts], dtype=np.int64)
    flat = np.concatenate(texts) if texts else np.zeros(0, dtype=np.int64)
    first = np.cumsum(count) - count
    h = vocabulary.of(flat)
    n = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    bounds = np.concatenate([[0], np.cumsum(n)])
    at = np.repeat(first, n) + np.arange(bounds[-1]) - np.repeat(bounds[:-1], n)
    out, full = np.zeros(len(at), dtype=np.uint64), np.repeat(count >= width, n)
    out[full] = _rolled(h, width)[at[full]]
    for d in np.flatnonzero((count > 0) & (count < width)):
        out[bounds[d]] = _rolled(h[first[d] : first[d] + count[d]], int(count[d]), int(count[d]))[0]
    order = np.arange(len(out))
    for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if e - s > 1:
            order[s:e] = s + np.argsort(out[s:e])
    out, at = out[order], at[order]
    new = np.ones(len(out), dtype=bool)
    new[1:] = out[1:] != out[:-1]
    new[bounds[:-1][n > 0]] = True
    old = np.flatnonzero(~new)
    differ = np.zeros(len(old), dtype=bool)
    for k in range(width):
        differ |= flat[at[old - 1] + k] != flat[at[old] + k]
    total = np.concatenate([[0], np.cumsum(new)])[bounds]
    size = np.diff(total)
    for d in np.unique(np.searchsorted(bounds, old[differ], side="right") - 1):
        size[d] = len(ShingleSet(texts[d], vocabulary, width).exact())
    return out[new], total, size


class ShingleSet:
    """The distinct shingles of one text: their hashes in order, and where each first stands."""

    def __init__(self, words: np.ndarray, vocabulary: Vocabulary, width: int) -> None:
        self.words, self.width = words, min(width, len(words)) or 1
        n = len(words) - self.width + 1 if len(words) else 0
        acc = _rolled(vocabulary.of(words), self.width, len(words) if len(words) < width else 0)
        order = np.argsort(acc, kind="stable")
        acc = acc[order]
        new = np.ones(n, dtype=bool)
        new[1:] = acc[1:] != acc[:-1]
        old = np.flatnonzero(~new)
        #: Different shingles with one hash, which the set of hashes can't tell apart.
        self.clash = bool(len(old)) and not self._same(order[old - 1], self, order[old])
        self.hashes, self.at = acc[new], order[new]
        self.size = len(self.exact()) if self.clash else len(self.hashes)

    def _same(self, mine: np.ndarray, other: ShingleSet, theirs: np.ndarray) -> bool:
        """Whether the words of the shingles are the same, one by one."""
        return all(np.array_equal(self.words[mine + k], other.words[theirs + k]) for k in range(self.width))

    def exact(self) -> set[tuple]:
        return set(zip(*(self.words[k : len(self.words) - self.width + 1 + k].tolist() for k in range(self.width)), strict=True))

    def shared(self, other: ShingleSet) -> int:
        """The size of the intersection.  Shingles with equal hashes are compared by their words;
        where that fails anywhere, the sets of word tuples are intersected."""
        if self.width != other.width or not self.size or not other.size:
            return 0
        small, large = (self, other) if len(self.hashes) <= len(other.hashes) else (other, self)
        at = np.minimum(np.searchsorted(large.hashes, small.hashes), len(large.hashes) - 1)
        hit = np.flatnonzero(large.hashes[at] == small.hashes)
        if self.clash or other.clash or not small._same(small.at[hit], large, large.at[at[hit]]):
            return len(self.exact() & other.exact())
        return len(hit)

    def linked(self, other: ShingleSet, percent: int) -> bool:
        low, high = sorted((self.size, other.size))
        if not low or 100 * low < percent * high:
            return False
        both = self.shared(other)
        return 100 * both >= percent * (low + high - both)
