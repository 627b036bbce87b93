"""Token ids as Arrow IPC files with fixed-size-list batches.

Documents are dealt by ranges of doc_id and sorted; each range becomes a shard of two files
in a shared folder.  `*.seq.arrow` has the shard's ids packed into sequences of `length`
(uint16 where the vocabulary allows, else uint32) with a mask (false for the filling behind
the last id), ROWS sequences to a batch, so that sequence i is row i % ROWS of batch
i // ROWS and is read through a memory map without a copy.  `*.doc.arrow` has doc_id, the
offset of its first id in the shard and the number of its ids.  Tasks write under names of
their own and report them in the manifest, so files of lost or repeated attempts are never
read."""

from __future__ import annotations

import gc
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from .bpe import tokenizer_path
from .common import groups, materialise, per_process, shuffle_partitions, table, work_dir
from .word_pieces import Splitter, is_latin

LENGTH, ROWS = 2048, 64
#: Bytes of texts that are encoded at a time; what is done once a group weighs more here than elsewhere.
GROUP_BYTES = 4 << 20
#: Words whose ids are kept by a worker process.
CACHE = 600_000
#: What is kept of them when there are too many: words of up to so many characters.
SHORT = 10
#: New pieces that are encoded as one text.
JOINED = 128
_SIGNS = ".,:;!?|"
#: What str.split takes for white space and the tokenizer doesn't, and special tokens' brackets.
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "<|")
MANIFEST = "path string, first_id long, n_docs long, n_tokens long"


class LibraryCoder:
    """Ids of whole texts from the tokenizers library.

    White space always parts pieces, so what lies between is encoded once and looked up
    afterwards.  New pieces go to the library many to a text; each piece ends with the one
    token of it that bears the vocabulary's word end, which tells them apart again.  Texts
    outside the splitter's exact Latin path are encoded whole."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.split = Splitter(path)
        vocab = self.split.tokenizer.get_vocab()
        self.kind = np.dtype("<u2") if len(vocab) <= 1 << 16 else np.dtype("<u4")
        end = self.split.spec["model"]["end_of_word_suffix"]
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(end) or t in self.split.special]] = True
        # for pieces that are normalised and split already
        self.joined = Tokenizer.from_file(path)
        self.joined.normalizer = normalizers.Sequence([])
        self.joined.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.known: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=self.kind) for e in self.split.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: set[str]) -> None:
        # not a set difference, which would walk all that is known
        new = {w for w in words if w not in self.known}
        if len(self.known) + len(new) > CACHE:
            # short words come again, long ones rarely
            self.known = {w: v for w, v in self.known.items() if len(w) <= SHORT}
            self.pieces = {w: v for w, v in self.pieces.items() if len(w) <= SHORT}
            if len(self.known) + len(words) > CACHE:
                self.known.clear()
                self.pieces.clear()
            new = {w for w in words if w not in self.known}
        # most are one run of letters, or that and one sign behind it
        one = [w for w in new if w.isalpha()]
        two = [w for w in new if w[:-1].isalpha() and w[-1] in _SIGNS]
        more = new.difference(one, two)
        parts = {w: self.split.pieces(w) for w in more}
        fresh = set().union(one, [w[:-1] for w in two], _SIGNS if two else (), *parts.values())
        fresh = [p for p in fresh if p not in self.pieces]
        for at in range(0, len(fresh), JOINED):
            block = fresh[at : at + JOINED]
            ids = np.array(self.joined.encode_batch_fast([" ".join(block)], add_special_tokens=False)[0].ids, dtype=self.kind)
            stop = (np.flatnonzero(self.ends[ids]) + 1) * self.kind.itemsize
            if len(stop) != len(block):
                raise ValueError("the vocabulary doesn't end every word with a token of its own kind")
            raw = ids.tobytes()
            stop = stop.tolist()
            self.pieces.update(zip(block, [raw[s:e] for s, e in zip([0, *stop[:-1]], stop, strict=True)], strict=True))
        get = self.pieces.__getitem__
        self.known.update(zip(one, map(get, one), strict=True))
        self.known.update((w, get(w[:-1]) + get(w[-1])) for w in two)
        self.known.update((w, b"".join(map(get, ps))) for w, ps in parts.items())

    def encode(self, texts: list[str | None]) -> list[bytes]:
        whole = [i for i, t in enumerate(texts) if t and (any(c in t for c in _ODD) or not is_latin(t))]
        words = [t.lower().split() if t else [] for t in texts]
        for i in whole:
            words[i] = []
        self._learn(set().union(*words))
        get = self.known.__getitem__
        out = [b"".join(map(get, w)) for w in words]
        for i, ids in zip(whole, self._ids([texts[i] for i in whole]), strict=True):
            out[i] = ids.tobytes()
        return out


def filesystem(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri)


class ShardWriter:
    def __init__(self, uri: str, kind: np.dtype, length: int) -> None:
        self.fs, self.path = filesystem(uri)
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.length, self.kind = length, kind
        self.seq_schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.doc_schema = pa.schema([("doc_id", pa.int64()), ("offset", pa.int64()), ("n_tokens", pa.int64())])
        self.files = [self.fs.open_output_stream(f"{self.path}.{k}.arrow") for k in ("seq", "doc")]
        self.seq, self.doc = (pa.ipc.new_file(f, s) for f, s in zip(self.files, (self.seq_schema, self.doc_schema), strict=True))
        self.rest, self.total = b"", 0

    def add(self, doc_ids: list[int | None], tokens: list[bytes]) -> None:
        size = np.array([len(t) // self.kind.itemsize for t in tokens], dtype=np.int64)
        offset = self.total + np.cumsum(size) - size
        self.doc.write_batch(pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array(offset), pa.array(size)], schema=self.doc_schema))
        self.total += int(size.sum())
        self.rest += b"".join(tokens)
        step = self.length * ROWS * self.kind.itemsize
        done = len(self.rest) // step * step
        for at in range(0, done, step):
            self._write(np.frombuffer(self.rest, dtype=self.kind, count=self.length * ROWS, offset=at))
        self.rest = self.rest[done:]

    def _write(self, ids: np.ndarray) -> None:
        full = -(-len(ids) // self.length) * self.length
        mask = np.arange(full) < len(ids)
        ids = np.concatenate([ids, np.zeros(full - len(ids), dtype=self.kind)])
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.seq.write_batch(pa.record_batch(lists, schema=self.seq_schema))

    def close(self) -> None:
        if self.rest:
            self._write(np.frombuffer(self.rest, dtype=self.kind))
        for x in (self.seq, self.doc, *self.files):
            x.close()


class Shard:
    """Random access to a shard: sequence(i), mask(i), tokens(offset, n), documents()."""

    def __init__(self, uri: str) -> None:
        fs, path = filesystem(uri)
        local = isinstance(fs, pa.fs.LocalFileSystem)
        self.seq, self.doc = (pa.ipc.open_file(pa.memory_map(f"{path}.{k}.arrow") if local else fs.open_input_file(f"{path}.{k}.arrow")) for k in ("seq", "doc"))
        self.length = self.seq.schema.field("ids").type.list_size
        self.last: tuple[int, np.ndarray] = (-1, np.zeros(0))

    def _flat(self, k: int) -> np.ndarray:
        """All ids of batch k, without a copy."""
        if self.last[0] != k:
            self.last = (k, self.seq.get_batch(k).column(0).flatten().to_numpy(zero_copy_only=True))
        return self.last[1]

    def sequence(self, i: int) -> np.ndarray:
        ids = self.seq.get_batch(i // ROWS).column(0)
        return ids.slice(i % ROWS, 1).flatten().to_numpy(zero_copy_only=True)

    def mask(self, i: int) -> np.ndarray:
        return self.seq.get_batch(i // ROWS).column(1).slice(i % ROWS, 1).flatten().to_numpy(zero_copy_only=False)

    def tokens(self, offset: int, n: int) -> Iterator[np.ndarray]:
        """The ids from `offset` on, in pieces that lie in one batch each."""
        step = self.length * ROWS
        while n > 0:
            at = offset % step
            ids = self._flat(offset // step)[at : at + n]
            yield ids
            offset, n = offset + len(ids), n - len(ids)

    def documents(self) -> Iterator[pa.RecordBatch]:
        for k in range(self.doc.num_record_batches):
            yield self.doc.get_batch(k)


def write_token_files(docs: DataFrame, folder: str, path: str | None = None, end_id: int = 1, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, append `end_id`, write shards to `folder` (a URI that every
    executor can write to) in ascending doc_id order.  Returns the manifest, one row a shard:
    path, first_id, n_docs, n_tokens.

    Null and empty texts have the end id only; rows without an id come first; rows that share
    an id follow one another in the order of their texts.  No rows give no shards."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = per_process(("LibraryCoder", path), lambda: LibraryCoder(path))
        end = np.array([end_id], dtype=coder.kind).tobytes()
        writer, first, n_docs, uri = None, None, 0, ""
        gc.disable()  # nothing here makes cycles, and the caches are long to walk
        try:
            for batch in groups(batches, limit=GROUP_BYTES):
                ids = batch.column(0).to_pylist()
                if writer is None:
                    uri, first = f"{folder}/{uuid.uuid4().hex}", ids[0]
                    writer = ShardWriter(uri, coder.kind, length)
                writer.add(ids, [t + end for t in coder.encode(batch.column(1).to_pylist())])
                n_docs += len(ids)
        finally:
            gc.enable()
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([first], pa.int64()), pa.array([n_docs], pa.int64()), pa.array([writer.total], pa.int64())], names=["path", "first_id", "n_docs", "n_tokens"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    dealt = picked.repartitionByRange(shuffle_partitions(docs.sparkSession), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return materialise(dealt.mapInArrow(run, MANIFEST), "manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as
    little-endian unsigned 32-bit integers), from the files that the manifest names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for path, start in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                shard = Shard(path)
                for docs in shard.documents():
                    offset, n = docs.column(1).to_numpy(), docs.column(2).to_numpy()
                    crc = np.zeros(len(n), dtype=np.int64)
                    for k in range(len(n)):
                        c = 0
                        for part in shard.tokens(int(offset[k]), int(n[k])):
                            c = zlib.crc32(part.astype("<u4").tobytes(), c)
                        crc[k] = c
                    yield pa.RecordBatch.from_arrays([docs.column(0), pa.array(offset + start), docs.column(2), pa.array(crc)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    before = Window.orderBy(F.col("first_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    starts = manifest.select("path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long").alias("start"))
    parts = shuffle_partitions(manifest.sparkSession)
    return starts.repartition(parts, "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_token_files(spark, sf_dir: str) -> DataFrame:
    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), work_dir(spark, "tokens")))
