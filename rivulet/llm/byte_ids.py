"""Token ids of whole texts from the tokenizers library, for byte-level vocabularies.

The vocabulary's pattern never joins a character with white space behind it, so a text may be cut
in front of any white space that follows something else, and the parts encoded apart.  Parts are
encoded once, many to a text for the library, and looked up afterwards; those that begin with one
space (the usual ones) are kept without it."""

from __future__ import annotations

import json
import os
import re

import numpy as np
from tokenizers import Tokenizer

from .bpe import byte_symbols

#: Parts whose ids are kept by a worker process.
CACHE = 900_000
#: What is kept of them when there are too many: those of up to so many characters.
SHORT = 10
#: Parts that are encoded as one text.
JOINED = 256
_SIGNS = ",.;:!?"
_TWO_SPACES = re.compile(r"\s\s")
_CUT = re.compile(r"(?<=\S)(?=\s)")
_SPACE = re.compile(r"\s")


class ByteCoder:
    """encode(texts): the ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        form = spec["pre_tokenizer"] or {}
        if form.get("type") != "ByteLevel" or form.get("add_prefix_space") or not form.get("use_regex") or spec["normalizer"]:
            raise ValueError("a byte-level vocabulary without normaliser and prefix space is needed")
        self.special = [t["content"] for t in spec["added_tokens"]]
        vocab = self.tokenizer.get_vocab()
        signs = byte_symbols()
        self.spaced = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.spaced[[i for t, i in vocab.items() if t.startswith(signs[32])]] = True
        self.newline = vocab[signs[10]]
        self.words: dict[str, bytes] = {}  # without the space in front; those of a new line with it
        self.parts: dict[str, bytes] = {}  # as they are
        self.signs = {s: self._one(s) for s in _SIGNS}

    def _many(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _one(self, text: str) -> bytes:
        return self._many([text])[0].tobytes() if text else b""

    def _joined(self, parts: list[str], front: str, first) -> list[bytes]:
        """Ids of parts that hold no white space but one sign in front; `first` finds its tokens."""
        out: list[bytes] = []
        for at in range(0, len(parts), JOINED):
            block = parts[at : at + JOINED]
            ids = self._many(["".join([front + p for p in block])])[0]
            starts = np.flatnonzero(first(ids))
            if len(starts) == len(block):
                raw, cut = ids.tobytes(), [*(starts * 4).tolist(), len(ids) * 4]
                out += [raw[s:e] for s, e in zip(cut[:-1], cut[1:], strict=True)]
            else:
                out += [self._one(front + p) for p in block]
        return out

    def _learn(self, new: set[str]) -> None:
        """Ids of words that aren't known yet."""
        if len(self.words) + len(new) > CACHE:
            self.words = {w: v for w, v in self.words.items() if len(w) <= SHORT}
            if len(self.words) + len(new) > CACHE:
                self.words.clear()
        plain, two, lines, odd = [w for w in new if w.isalpha()], [], [], []
        for w in new.difference(plain):
            if w[-1:] in self.signs and w[:-1].isalpha() and w.isascii():
                two.append(w)  # a word and a sign behind it are two tokens' worth for the pattern
            elif not w or _SPACE.search(w, w[0] == "\n"):
                odd.append(w)
            else:
                (lines if w[0] == "\n" else plain).append(w)
        plain += {x for x in {w[:-1] for w in two} if x not in self.words and x not in new}
        self.words.update(zip(plain, self._joined(plain, " ", lambda ids: self.spaced[ids]), strict=True))
        self.words.update((w, self.words[w[:-1]] + self.signs[w[-1]]) for w in two)
        self.words.update(zip(lines, self._joined(lines, "", lambda ids: ids == self.newline), strict=True))
        self.words.update((w, self._one(w if w[:1] == "\n" else " " + w)) for w in odd)

    def _part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            if len(self.parts) > CACHE // 8:
                self.parts.clear()
            found = self.parts[part] = self._one(part)
        return found

    def _words(self, text: str) -> tuple[str, list[str], list[int]]:
        """The first part as it is, the others (those of one space or new line as words), and where of
        these the ones are that aren't words."""
        if not _TWO_SPACES.search(text):
            first, *words = text.replace("\n", " \n").split(" ")
            return first, words, []
        first, *parts = _CUT.split(text)
        whole = []
        for k, p in enumerate(parts):
            if len(p) < 2 or p[1].isspace() or p[0] not in " \n":
                whole.append(k)
            elif p[0] == " ":
                parts[k] = p[1:]
        return first, parts, whole

    def encode(self, texts: list[str | None]) -> list[bytes]:
        rows: list[tuple[bytes, list[str], list[bytes | None]]] = []
        new: set[str] = set()
        for text in texts:
            if not text or any(s in text for s in self.special):
                rows.append((self._one(text or ""), [], []))
                continue
            first, words, whole = self._words(text)
            ids = list(map(self.words.get, words))
            for k in whole:
                ids[k] = self._part(words[k])
            if None in ids:
                new.update([w for w, i in zip(words, ids, strict=True) if i is None])
            rows.append((self._part(first), words, ids))
        if new:
            self._learn(new)
        out, get = [], self.words.__getitem__
        for first, words, ids in rows:
            if None in ids:
                ids = [get(w) if i is None else i for w, i in zip(words, ids, strict=True)]
            out.append(first + b"".join(ids))
        return out
