"""Normalising and splitting texts as the tokenizer file asks, before any merging.

The file's steps: its special tokens are cut out of the raw text; the rest gets NFC, white
space folded, lower case; then words, single digits, contractions and runs of other
characters are the pieces.  Texts of Latin letters take a path of compiled patterns that is
exact there (below U+0250, and U+2010 to U+2027, NFC changes nothing and case folding is
character by character); any other text goes through the file's own normaliser and splitter."""

from __future__ import annotations

import json
import re

import regex
from tokenizers import Tokenizer

_LATIN = re.compile("[^\x00-ɏ‐-‧]")
_SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
_ASCII = re.compile(rf"{_SHORT}|[a-z]+|[0-9]|[^\t\n\x0b\x0c\r a-z0-9]+")
_WIDE = regex.compile(rf"{_SHORT}|\p{{L}}+|\p{{N}}|[^\t\n\x0b\x0c\r \x85\xa0\p{{L}}\p{{N}}]+")


def is_latin(text: str) -> bool:
    """Whether the text takes the exact path."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
        return True
    except UnicodeEncodeError:
        return not _LATIN.search(text)


class Splitter:
    """pieces(text): what is encoded word by word; special tokens are pieces of their own."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        self.special = {t["content"]: t["id"] for t in self.spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def plain(self, text: str) -> list[str]:
        if text.isascii():
            return _ASCII.findall(text.lower())
        if is_latin(text):
            return _WIDE.findall(text.lower())
        norm = self.tokenizer.normalizer.normalize_str(text)
        return [norm[s:e] for _, (s, e) in self.tokenizer.pre_tokenizer.pre_tokenize_str(norm)]

    def pieces(self, text: str) -> list[str]:
        if "<" not in text or not self.cut:
            return self.plain(text)
        out: list[str] = []
        for k, part in enumerate(self.cut.split(text)):
            if k % 2:
                out.append(part)
            elif part:
                out += self.plain(part)
        return out
