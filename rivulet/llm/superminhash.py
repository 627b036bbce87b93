"""SuperMinHash signatures (Ertl 2017) of many sets at once.

Each element walks its own random permutation of the m slots; at step j it offers the value
j + r (r uniform in [0, 1)) to the j-th slot of its permutation, and a slot keeps the least
offer.  Ranks of one element are correlated across slots, which lowers the variance below
that of independent minima, and a set stops as soon as no slot is above j."""

from __future__ import annotations

import numpy as np

from .common import GOLD, mix64

#: Elements whose permutations are held at a time.
CHUNK = 1 << 15


def _draw(h: np.ndarray, j: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        z = mix64(h + np.uint64(j + 1) * GOLD)
    low = z & np.uint64(0xFFFFFFFF)
    k = ((low * np.uint64(m - j)) >> np.uint64(32)).astype(np.int64) + j
    return k, (z >> np.uint64(32)) | (np.uint64(j) << np.uint64(32))


def signatures(hashes: np.ndarray, bounds: np.ndarray, m: int) -> np.ndarray:
    """Signature (uint64: step and 32 random bits) of each set hashes[bounds[i]:bounds[i+1]];
    an empty set has all slots at the greatest value."""
    n = len(bounds) - 1
    sig = np.full((n, m), np.iinfo(np.uint64).max, dtype=np.uint64)
    sizes = np.diff(bounds)
    owner = np.repeat(np.arange(n), sizes)
    flat = sig.reshape(-1)
    if len(hashes):
        k, v = _draw(hashes, 0, m)
        np.minimum.at(flat, owner * m + k, v)
    one = np.uint64(1 << 32)
    open_ = np.flatnonzero((sizes > 0) & (sig.max(axis=1) >= one))
    at = 0
    small = np.uint8 if m <= 256 else np.uint16 if m <= 65536 else np.uint32
    while at < len(open_):
        stop = max(at + 1, at + int(np.searchsorted(np.cumsum(sizes[open_[at:]]), CHUNK, side="right")))
        sets = open_[at:stop]
        at = stop
        index = np.concatenate([np.arange(bounds[s], bounds[s + 1]) for s in sets])
        h, own = hashes[index], owner[index]
        perm = np.tile(np.arange(m, dtype=small), (len(h), 1))
        rows = np.arange(len(h))
        k, _ = _draw(h, 0, m)
        perm[rows, k], perm[rows, 0] = 0, k
        for j in range(1, m):
            k, v = _draw(h, j, m)
            slot = perm[rows, k]
            perm[rows, k] = perm[rows, j]
            perm[rows, j] = slot
            np.minimum.at(flat, own * m + slot, v)
            if j % 4 == 3 or j + 1 == m:
                alive = sig[sets].max(axis=1) >= np.uint64(j + 1) << np.uint64(32)
                if not alive.any():
                    break
                if not alive.all():
                    live = np.isin(own, sets[alive])
                    h, own, perm, sets = h[live], own[live], perm[live], sets[alive]
                    rows = np.arange(len(h))
    return sig


def bands(sig: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit hash of each band of `rows` slots."""
    n, m = sig.shape
    part = sig.reshape(n, m // rows, rows)
    acc = np.broadcast_to(np.arange(m // rows, dtype=np.uint64) * GOLD, part.shape[:2]).copy()
    for k in range(rows):
        acc = mix64(acc * np.uint64(0x2545F4914F6CDD1D) + part[:, :, k])
    return acc
