"""Statistics of many texts at once, from their UTF-8 bytes, in numpy."""

from __future__ import annotations

import numpy as np

from .shingles import _SPACE, WordHasher

_ALL = np.arange(256)


def _table(chars: bytes | list[int]) -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[list(chars)] = True
    return t


#: Byte classes; a byte from 0x80 to 0xBF continues a code point.
CLASSES = {
    "space": _SPACE,
    "point": ~((_ALL >= 0x80) & (_ALL < 0xC0)),
    "upper": (_ALL >= 0x41) & (_ALL <= 0x5A),
    "lower": (_ALL >= 0x61) & (_ALL <= 0x7A),
    "digit": (_ALL >= 0x30) & (_ALL <= 0x39),
    "symbol": _table(b"#*$%&|<>"),
    "exclaim": _table(b"!?"),
    "stop": _table(b".,;:"),
    "high": _ALL >= 0xC0,
    "line": _table(b"\n"),
    "mark": _table(b"@_=+~^/\\{}[]`\"()'-"),
}


def repeated_words(words: list[bytes], width: int) -> np.ndarray:
    """Which words are inside a window of `width` words that occurs twice or more."""
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=len(words))
    n = len(ids) - width + 1
    window = ids[:n]
    for k in range(1, width):  # equal windows keep equal numbers, below the number of windows
        window = np.unique(window * len(numbers) + ids[k : n + k], return_inverse=True)[1].reshape(-1)
    hit = np.bincount(window)[window] > 1
    cover = np.zeros(len(ids), dtype=bool)
    for k in range(width):
        cover[k : n + k] |= hit
    return cover


class Counts:
    """Byte-class counts, words and repeated units of each text of a group."""

    def __init__(self, texts: list[bytes | None], hasher: WordHasher) -> None:
        self.texts = [t or b"" for t in texts]
        lens = np.array([len(t) for t in self.texts], dtype=np.int64)
        self.n_bytes = lens
        buf = b"\n".join(self.texts) + b"\n"
        self.data = np.frombuffer(buf, dtype=np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum(lens + 1)])
        self.words, self.starts = hasher.words(buf)
        self.first = np.searchsorted(self.starts, self.offsets)
        self.n_words = np.diff(self.first)
        self.of: dict[str, np.ndarray] = {}
        for name, cls in CLASSES.items():
            total = np.concatenate([[0], np.cumsum(cls[self.data], dtype=np.int64)])
            # a text's own bytes, without the line end that follows it
            self.of[name] = total[self.offsets[1:] - 1] - total[self.offsets[:-1]]
        self.word_chars = self.of["point"] - self.of["space"]

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.texts)), self.n_words)

    def dup_lines(self) -> np.ndarray:
        """Lines with a word that equal an earlier line of the same text."""
        out = np.zeros(len(self.texts), dtype=np.int64)
        for d, text in enumerate(self.texts):
            lines = [x for x in text.split(b"\n") if x.strip(b"\x20\x09\x0a\x0b\x0c\x0d")]
            out[d] = len(lines) - len(set(lines))
        return out

    def repeat_words(self, width: int = 3) -> np.ndarray:
        """Words in `width`-word windows that occur twice or more in the text.  Hashes tell the
        texts that may have such windows; in those the words themselves are compared."""
        out = np.zeros(len(self.texts), dtype=np.int64)
        if len(self.words) < width:
            return out
        acc = np.zeros(len(self.words) - width + 1, dtype=np.uint64)
        for k in range(width):
            acc = (acc + self.words[k : len(acc) + k]) * np.uint64(0x2545F4914F6CDD1D)
            acc ^= acc >> np.uint64(29)
        for d in np.flatnonzero(self.n_words > width):
            h = np.sort(acc[self.first[d] : self.first[d + 1] - width + 1])
            if (h[1:] == h[:-1]).any():
                out[d] = np.count_nonzero(repeated_words(self.texts[d].split(), width))
        return out

    def mean_of_words(self, flag: np.ndarray) -> np.ndarray:
        """Sum of a per-word value over each text."""
        total = np.concatenate([[0], np.cumsum(flag, dtype=np.float64)])
        return total[self.first[1:]] - total[self.first[:-1]]

    def word_flag(self, cls: str) -> np.ndarray:
        """Whether each word has a byte of the class."""
        if not len(self.words):
            return np.zeros(0, dtype=bool)
        total = np.concatenate([[0], np.cumsum(CLASSES[cls][self.data], dtype=np.int32)])
        ends = np.concatenate([self.starts[1:], [len(self.data)]])
        return total[ends] > total[self.starts]
