"""Deep-shallow suffix sorting (Manzini and Ferragina 2004), many groups at a time in numpy.

Suffixes are compared by their first `limit` bytes.  To the shallow depth a multikey
quicksort splits each group three ways around a pivot of eight bytes.  Groups that still
share the shallow prefix go to blind tries: the group's first suffix is a path of the trie,
every other one is compared with it once, and hangs off it where the first byte differs;
those that hang off at the same place with the same byte are a trie of their own, which
the next round treats alike.  No more rounds are needed than bytes compared."""

from __future__ import annotations

import numpy as np

SHALLOW = 16


class Text:
    """A byte buffer that can be read eight bytes at a time from any place."""

    def __init__(self, data: bytes) -> None:
        data = data + bytes(16)
        self.words = np.ndarray((len(data) - 7,), ">u8", data, 0, (1,))

    def at(self, places: np.ndarray, depth: np.ndarray, limit: int) -> np.ndarray:
        """The eight bytes behind `depth`, those from `limit` on as zeros."""
        w = self.words[places + depth].astype(np.uint64)
        over = np.clip(depth + 8 - limit, 0, 8).astype(np.uint64)
        if over.any():
            w = np.where(over < 8, (w >> (over * np.uint64(8) % np.uint64(64))) << (over * np.uint64(8) % np.uint64(64)), np.uint64(0))
        return w


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the run of equal keys that each element is in, and whether it has company."""
    new = np.ones(len(keys[0]), dtype=bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    run = np.cumsum(new) - 1
    return run, np.bincount(run)[run] > 1


def _first_byte(x: np.ndarray) -> np.ndarray:
    """Index (0 to 7) of the first byte that isn't zero."""
    out = np.zeros(len(x), dtype=np.int64)
    for bits in (32, 16, 8):
        high = x >> np.uint64(64 - bits)
        none = high == 0
        out += np.where(none, bits // 8, 0)
        x = np.where(none, x << np.uint64(bits), x)
    return out


def deep_shallow(text: Text, starts: np.ndarray, bucket: np.ndarray, limit: int, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes (by bucket, then bytes, then index), and for each place in that
    order a class number that equal ones share: same bucket, same first `limit` bytes."""
    perm = np.argsort(bucket, kind="stable")
    cls = np.zeros(len(perm), dtype=np.int64)
    if not len(perm):
        return perm, cls
    cls, many = _runs(bucket[perm])
    count = cls[-1] + 1
    depth = np.zeros(len(perm), dtype=np.int64)
    shallow = min(shallow, limit)

    def split(pos: np.ndarray, key: np.ndarray, deeper: np.ndarray) -> np.ndarray:
        """Reorder the places `pos` (whole groups) by key, make new groups; places of groups
        that still need work."""
        nonlocal count
        group, _ = _runs(cls[pos])
        order = np.lexsort((key, group))
        perm[pos], depth[pos] = perm[pos][order], deeper[order]
        run, many = _runs(group, key[order])
        cls[pos] = run + count
        count += run[-1] + 1
        return pos[many]

    deep = []
    pos = np.flatnonzero(many)
    while len(pos):
        key = text.at(starts[perm[pos]], depth[pos], limit)
        first = np.flatnonzero(np.concatenate([[True], cls[pos[1:]] != cls[pos[:-1]]]))
        size = np.diff(np.concatenate([first, [len(pos)]]))
        pivot = np.repeat(key[first + size // 2], size)
        side = (key > pivot).astype(np.int8) - (key < pivot)
        pos = split(pos, side, depth[pos] + 8 * (side == 0))
        ready = depth[pos] >= shallow
        deep.append(pos[ready])
        pos = pos[~ready]
    pos = np.sort(np.concatenate(deep)) if deep else pos
    pos = pos[depth[pos] < limit]
    while len(pos):
        first = np.flatnonzero(np.concatenate([[True], cls[pos[1:]] != cls[pos[:-1]]]))
        size = np.diff(np.concatenate([first, [len(pos)]]))
        mine = starts[perm[pos]]
        leaf = np.repeat(mine[first], size)
        common = depth[pos].copy()
        sign = np.zeros(len(pos), dtype=np.int64)
        byte = np.zeros(len(pos), dtype=np.int64)
        going = np.flatnonzero(mine != leaf)
        common[mine == leaf] = limit
        while len(going):
            a, b = (text.at(x[going], common[going], limit) for x in (mine, leaf))
            diff = a ^ b
            other = diff != 0
            at = _first_byte(diff[other])
            w = going[other]
            common[w] += at
            byte[w] = (a[other] >> ((np.uint64(7) - at.astype(np.uint64)) * np.uint64(8)) & np.uint64(255)).astype(np.int64)
            sign[w] = np.where(a[other] > b[other], 1, -1)
            going = going[~other]
            common[going] = np.minimum(common[going] + 8, limit)
            going = going[common[going] < limit]
        key = np.where(sign > 0, (2 * limit - common) * 256 + byte, np.where(sign < 0, common * 256 + byte, limit * 256))
        pos = split(pos, key, np.where(sign == 0, limit, common + 1))
        pos = pos[depth[pos] < limit]
    return perm, cls
