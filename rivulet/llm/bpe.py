"""Byte-pair encoding and decoding by batched merge rounds in numpy.

The distinct words of a batch lie in one flat array of symbols.  In each round all adjacent
pairs are looked up at once by binary search over the sorted pair keys; every word merges
its lowest-ranked pair, wherever the word has it, from left to right; words without a known
pair are done.  Merging all places at once equals merging one by one as long as no pair with
the new symbol ranks lower; for merges where one does, only the first place is taken."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import groups, per_process, table
from .word_pieces import Splitter

#: Words whose encodings are kept between batches of a task.
CACHE = 400_000
NONE = np.int64(1) << 40


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself
    where printable, else the next free code point from 256 on."""
    shown = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class Merges:
    """Arrays of a BPE model with word ends."""

    def __init__(self, spec: dict) -> None:
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.tokens = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        signs = byte_symbols()
        self.inner = np.array([vocab[c] for c in signs], dtype=np.int64)
        self.last = np.array([vocab[c + end] for c in signs], dtype=np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        key = (left << 32) | right
        order = np.argsort(key, kind="stable")
        self.keys, self.rank, self.made = key[order], order.astype(np.int64), made
        soonest = np.full(max(vocab.values()) + 1, NONE)
        np.minimum.at(soonest, left, np.arange(len(left)))
        np.minimum.at(soonest, right, np.arange(len(left)))
        self.safe = soonest[made] > np.arange(len(made))

    def encode(self, words: list[bytes]) -> list[np.ndarray]:
        """Token ids of each word; an empty word has none."""
        out: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(words)
        lens = np.array([len(w) for w in words], dtype=np.int64)
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        sym = self.inner[data]
        ends = np.cumsum(lens)
        full = lens > 0
        sym[ends[full] - 1] = self.last[data[ends[full] - 1]]
        ids, lens = np.flatnonzero(full), lens[full]
        while len(ids):
            start = np.cumsum(lens) - lens
            word = np.repeat(np.arange(len(ids)), lens)
            rank = np.full(len(sym), NONE)
            if len(sym) > 1:
                key = (sym[:-1] << 32) | sym[1:]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = (self.keys[at] == key) & (word[:-1] == word[1:])
                rank[:-1][hit] = self.rank[at[hit]]
            low = np.minimum.reduceat(rank, start)
            going = low < NONE
            for w in np.flatnonzero(~going):
                out[ids[w]] = sym[start[w] : start[w] + lens[w]]
            if not going.any():
                break
            keep = going[word]
            sym, rank, word = sym[keep], rank[keep], (np.cumsum(going) - 1)[word[keep]]
            ids, low = ids[going], low[going]
            pick = rank == low[word]
            at = np.flatnonzero(pick)
            # of overlapping places (a a a) every second one, from the left
            fresh = np.ones(len(at), dtype=bool)
            fresh[1:] = (at[1:] != at[:-1] + 1) | (word[at[1:]] != word[at[:-1]])
            head = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            take = (np.arange(len(at)) - head) % 2 == 0
            first = np.ones(len(at), dtype=bool)
            first[1:] = word[at[1:]] != word[at[:-1]]
            take &= first | self.safe[low[word[at]]]
            at = at[take]
            sym[at] = self.made[low[word[at]]]
            stay = np.ones(len(sym), dtype=bool)
            stay[at + 1] = False
            sym, word = sym[stay], word[stay]
            lens = np.bincount(word, minlength=len(ids))
        return out


class Decoder:
    """Ids to text.  The file names no decoder, so a text is its tokens with a blank between
    them; ids outside the vocabulary give nothing.  restored() gives the bytes that the tokens
    stand for, with a blank for each word end."""

    def __init__(self, spec: dict) -> None:
        tokens = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.table = np.array([tokens.get(i) for i in range(max(tokens) + 1)], dtype=object)
        self.end = spec["model"]["end_of_word_suffix"] or ""
        self.special = {t["content"] for t in spec["added_tokens"]}
        self.byte = {c: b for b, c in enumerate(byte_symbols())}

    def tokens(self, ids: np.ndarray) -> list[str]:
        ids = np.asarray(ids, dtype=np.int64)
        known = self.table[ids[(ids >= 0) & (ids < len(self.table))]]
        return [t for t in known.tolist() if t is not None]

    def decode(self, ids: np.ndarray) -> str:
        return " ".join(self.tokens(ids))

    def restored(self, ids: np.ndarray) -> str:
        out = bytearray()
        for t in self.tokens(ids):
            if t in self.special:
                out += t.encode()
                continue
            word = self.end and t.endswith(self.end)
            out += bytes(self.byte[c] for c in (t.removesuffix(self.end) if word else t)) + (b" " if word else b"")
        return out.decode(errors="replace")


class Coder:
    """Texts to ids and back, word by word, with a bounded cache."""

    def __init__(self, path: str) -> None:
        self.split = Splitter(path)
        self.merges = Merges(self.split.spec)
        self.decode = Decoder(self.split.spec).decode
        self.ids: dict[str, str] = {}
        self.shown: dict[str, str] = {}

    def forget(self) -> None:
        self.ids.clear()
        self.shown.clear()

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.ids]
        if len(self.ids) + len(new) > CACHE:
            self.forget()
            new = list(words)
        special = self.split.special
        plain = [w for w in new if w not in special]
        coded = self.merges.encode([w.encode() for w in plain])
        for w, ids in zip(plain, coded, strict=True):
            self.ids[w] = " ".join(map(str, ids.tolist()))
            self.shown[w] = self.decode(ids)
        for w in new:
            if w in special:
                self.ids[w], self.shown[w] = str(special[w]), w

    def texts(self, texts: list[str | None]) -> Iterator[tuple[str, str]]:
        """For each text its decimal ids and what they decode to.  Words are decoded one by one
        and joined, which equals decoding all ids, as a blank stands between any two tokens."""
        words = [self.split.pieces(t) if t else [] for t in texts]
        self.learn(set().union(*words))
        ids, shown = self.ids.__getitem__, self.shown.__getitem__
        for w in words:
            yield " ".join(map(ids, w)), " ".join(map(shown, w))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", out: str = "digests") -> DataFrame:
    """Encode every whole text and decode it again; one row per row of `docs`.

    out="digests": doc_id, n_tokens, ids_sha256, decoded_sha256.  out="ids": doc_id, n_tokens,
    ids array<int>, decoded.  `path` is the tokenizer file, readable on every executor.  Null
    and empty texts have no tokens.  Other columns aren't read."""
    path = path or tokenizer_path()
    digests = out == "digests"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the tables are made once a worker; the words of a task go with it, as workers live on
        coder = per_process(("Coder", path), lambda: Coder(path))
        coder.forget()
        for batch in groups(batches):
            rows = list(coder.texts(batch.column(1).to_pylist()))
            n = pa.array([i.count(" ") + 1 if i else 0 for i, _ in rows], pa.int64())
            if digests:
                cols = [pa.array([hashlib.sha256(x.encode()).hexdigest() for x in col], pa.string()) for col in zip(*rows, strict=True)]
            else:
                cols = [pa.array([np.array(i.split(), dtype=np.int32) for i, _ in rows], pa.list_(pa.int32())), pa.array([d for _, d in rows], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), n, *cols], names=names)
        coder.forget()

    names = ["doc_id", "n_tokens", *(["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"])]
    kinds = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, f"doc_id long, n_tokens long, {kinds}")


def decode_documents(rows: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids", restore: bool = False) -> DataFrame:
    """doc_id, decoded for each row: the tokens' text, or with `restore` the text they stand
    for (lower case, words parted by blanks).  Null ids give null, no ids the empty text."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = per_process(("Decoder", path), lambda: Decoder(Splitter(path).spec))
        one = decoder.restored if restore else decoder.decode
        for batch in batches:
            out = [one(np.asarray(x.values)) if x.is_valid else None for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "decoded"])

    picked = rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return picked.mapInArrow(run, "doc_id long, decoded string")


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))
