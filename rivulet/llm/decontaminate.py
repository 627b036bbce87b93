"""Benchmark decontamination with suffix arrays of the training texts.

Each group of documents is a shard.  Its words are numbered and all suffixes of its word
sequence are sorted, each to the end of its document: the shard's suffix array.  Every suffix
of every benchmark item is looked up in it by binary search, a word deeper at a time, so that
at each depth the range of shard suffixes is known that begin with the same words.  The depth
at which a document's suffix was last in a range is its longest verbatim match with the
benchmark; the ranges at the depth of a window give all of the window's occurrences.

The benchmark is written in blocks of bounded size to the shared folder, from where tasks read
one block at a time; the driver sees the blocks' names alone.  A shard's suffix array is built
once and serves all blocks, so documents are read once."""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import groups, per_process, table, utf8, work_dir

DEPTH = 10
#: About as many bytes of benchmark text are in a block.
BLOCK_BYTES = 4 << 20
#: Most bytes of documents in a shard (or one document).
SHARD_BYTES = 2 << 20
#: How many times as large shards get with so many blocks.
LARGER = 4
#: Blocks that a worker keeps.
KEPT = 2
#: What separates words, and A-Z to a-z.
_GAPS = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_FOLD = bytes.maketrans(_GAPS + bytes(range(0x41, 0x5B)), b" " * len(_GAPS) + bytes(range(0x61, 0x7B)))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def _spread(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    n = high - low
    return np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())


class Queries:
    """A block of benchmark items: its words numbered, with -1 behind each item, and for each
    suffix its item and the size of the window that begins there (0 for none)."""

    def __init__(self, items: list[tuple[str, bytes | None]], depth: int = DEPTH) -> None:
        self.names = [name for name, _ in items]
        numbers: dict[bytes, int] = {}
        parts, owner, size = [], [], []
        for i, (_, text) in enumerate(items):
            words = words_of(text)
            n = len(words)
            parts += [np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=n), np.full(1, -1)]
            windows = np.full(n + 1, min(depth, n), dtype=np.int64)
            windows[max(n - depth + 1, 1) if n else 0 :] = 0
            owner.append(np.full(n + 1, i))
            size.append(windows)
        empty = [np.zeros(0, dtype=np.int64)]
        self.words = list(numbers)
        self.ids, self.item, self.size = (np.concatenate(x or empty) for x in (parts, owner, size))
        self.starts = np.flatnonzero(self.ids >= 0)


class Shard:
    """The suffix array of some texts.  Each text ends with a separator of its own, below all
    words, so suffixes of different texts differ and none matches beyond its text."""

    def __init__(self, texts: list[bytes | None]) -> None:
        self.numbers: dict[bytes, int] = {}
        first = len(texts)
        parts, self.n_words = [], np.zeros(len(texts), dtype=np.int64)
        for d, text in enumerate(texts):
            words = words_of(text)
            self.n_words[d] = len(words)
            parts += [np.fromiter((self.numbers.setdefault(w, first + len(self.numbers)) for w in words), dtype=np.int64, count=len(words)), np.full(1, d)]
        self.ids = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
        self.base = np.cumsum(self.n_words + 1) - (self.n_words + 1)
        self.order = self._sorted()
        self.heads = self.ids[self.order]

    def _sorted(self) -> np.ndarray:
        """Sorted by the first few words, then by twice as many where suffixes are still equal,
        until none are (prefix doubling)."""
        ids, n = self.ids, len(self.ids)
        top = len(self.n_words) + len(self.numbers) + 1
        depth = 3 if top < 2_000_000 else 2
        padded = np.concatenate([ids, np.zeros(depth, dtype=np.int64)])
        key = ids
        for k in range(1, depth):
            key = key * top + padded[k : n + k]
        order = np.argsort(key, kind="stable")
        places, key, rank = np.arange(n), key[order], np.zeros(n, dtype=np.int64)
        while len(places):
            new = np.ones(len(places), dtype=bool)
            new[1:] = key[1:] != key[:-1]
            head = np.maximum.accumulate(np.where(new, np.arange(len(places)), 0))
            rank[order[places]] = places[head]
            open_ = np.bincount(head, minlength=len(places))[head] > 1
            places = places[open_]
            # a suffix that has company has no separator in its first words, so one follows them
            suffix = order[places]
            key = rank[suffix] * (n + 1) + rank[np.minimum(suffix + depth, n - 1)]
            by = np.argsort(key, kind="stable")
            order[places], key = suffix[by], key[by]
            depth *= 2
        return order

    def deeper(self, low: np.ndarray, high: np.ndarray, word: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """The part of each range whose suffixes have the word at the depth."""

        def bound(low: np.ndarray, high: np.ndarray, after: bool) -> np.ndarray:
            low, high = low.copy(), high.copy()
            while len(open_ := np.flatnonzero(low < high)):
                mid = (low[open_] + high[open_]) // 2
                at = self.ids[self.order[mid] + depth]
                right = at <= word[open_] if after else at < word[open_]
                low[open_] = np.where(right, mid + 1, low[open_])
                high[open_] = np.where(right, high[open_], mid)
            return low

        first = bound(low, high, False)
        return first, bound(first, high, True)


class Found:
    """What is found of the benchmark in a shard, block after block."""

    def __init__(self, shard: Shard) -> None:
        self.shard = shard
        #: Of each place, the words from it on that are verbatim in an item.
        self.match = np.zeros(len(shard.ids), dtype=np.int64)
        self.edges = np.zeros(len(shard.ids) + 1, dtype=np.int64)
        self.items: list[set[str]] = [set() for _ in shard.n_words]

    def add(self, q: Queries) -> None:
        s = self.shard
        get = s.numbers.get
        number = np.append(np.fromiter((get(w, -1) for w in q.words), dtype=np.int64, count=len(q.words)), -1)
        word = number[q.ids]
        at = q.starts[word[q.starts] >= 0]
        low, high = np.searchsorted(s.heads, word[at]), np.searchsorted(s.heads, word[at], side="right")
        depth, ranges = 1, {}
        while len(at):
            # ranges of one depth are equal or apart
            _, one = np.unique(low, return_index=True)
            places = s.order[_spread(low[one], high[one])]
            self.match[places] = np.maximum(self.match[places], depth)
            window = q.size[at] == depth
            if window.any():
                self._occurrences(q, at[window], low[window], high[window], depth)
            follow = word[at + depth]
            go = follow >= 0
            at, low, high, follow = at[go], low[go], high[go], follow[go]
            # equal ranges that go on alike are narrowed once
            key, back = np.unique(low * (len(s.ids) + len(s.numbers) + 1) + follow, return_index=True, return_inverse=True)[1:]
            a, b = s.deeper(low[key], high[key], follow[key], depth)
            low, high = a[back.reshape(-1)], b[back.reshape(-1)]
            go = low < high
            at, low, high = at[go], low[go], high[go]
            depth += 1

    def _occurrences(self, q: Queries, at: np.ndarray, low: np.ndarray, high: np.ndarray, size: int) -> None:
        s = self.shard
        starts, one, of = np.unique(low, return_index=True, return_inverse=True)
        ends = high[one]
        places = s.order[_spread(starts, ends)]
        np.add.at(self.edges, places, 1)
        np.add.at(self.edges, places + size, -1)
        # the texts of each range, and its items
        text = np.searchsorted(s.base, places, side="right") - 1
        pairs = np.unique(np.repeat(np.arange(len(starts)), ends - starts) * len(s.n_words) + text)
        known = np.unique(of.reshape(-1) * len(q.names) + q.item[at])
        edge = np.searchsorted(known, np.arange(len(starts) + 1) * len(q.names))
        names = [{q.names[i] for i in (known[a:b] % len(q.names)).tolist()} for a, b in zip(edge[:-1], edge[1:], strict=True)]
        for r, d in zip((pairs // len(s.n_words)).tolist(), (pairs % len(s.n_words)).tolist(), strict=True):
            self.items[d] |= names[r]

    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, begin and end (in words of the text) of the merged occurrences."""
        hit = np.concatenate([[False], np.cumsum(self.edges[:-1]) > 0, [False]])
        begin, end = np.flatnonzero(hit[1:] & ~hit[:-1]), np.flatnonzero(hit[:-1] & ~hit[1:])
        text = np.searchsorted(self.shard.base, begin, side="right") - 1
        return text, begin - self.shard.base[text], end - self.shard.base[text]

    def longest(self) -> tuple[np.ndarray, np.ndarray]:
        """The longest match of each text, and the first place that has it (-1 for none)."""
        n, base = self.shard.n_words, self.shard.base
        if not len(n):
            return n, n
        most = np.maximum.reduceat(self.match, base)
        owner = np.repeat(np.arange(len(n)), n + 1)
        best = np.flatnonzero((self.match == most[owner]) & (self.match > 0))
        where = np.full(len(n), -1, dtype=np.int64)
        where[owner[best[::-1]]] = best[::-1] - base[owner[best[::-1]]]
        return most, where


def read_block(uri: str, depth: int) -> Queries:
    """A block as its worker has it, or from the shared folder."""
    kept: OrderedDict = per_process(("benchmark blocks",), OrderedDict)
    if (uri, depth) not in kept:
        fs, path = pa.fs.FileSystem.from_uri(uri)
        rows = pa.parquet.read_table(path, filesystem=fs, columns=["item_id", "text"])
        kept[uri, depth] = Queries(list(zip(rows.column("item_id").to_pylist(), rows.column("text").to_pylist(), strict=True)), depth)
    kept.move_to_end((uri, depth))
    while len(kept) > KEPT:
        kept.popitem(last=False)
    return kept[uri, depth]


def blocks(benchmark: DataFrame, limit: int = BLOCK_BYTES) -> list[str]:
    """Write the benchmark in files of about `limit` bytes of text; their names."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").cast("binary").alias("text")).where("item_id is not null").distinct()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    spark = benchmark.sparkSession
    path = work_dir(spark, "benchmark")
    rows.repartition(max(1, -(-size // limit)), "item_id", "text").write.parquet(path)
    return sorted(spark.read.schema(rows.schema).parquet(path).inputFiles())


def _shards(batches: Iterator[pa.RecordBatch], files: list[str]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Shards and the blocks in the order in which to search each: back and forth, so that the last ones of a shard
    are at hand for the next.  Where there are several blocks shards are larger, since each block is parsed for each."""
    for k, batch in enumerate(groups(batches, "text", SHARD_BYTES * max(1, min(len(files), LARGER)))):
        yield batch, files[::-1] if k % 2 else files


def _searched(texts: list[bytes | None], files: list[str], depth: int) -> Found:
    """What is found doesn't depend on the order of the blocks."""
    found = Found(Shard(texts))
    for uri in files:
        found.add(read_block(uri, depth))
    return found


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, limit: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest_match, longest_at,
    items, spans for every row of `docs`.

    Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z lower-cased.
    A window is `depth` consecutive words of an item, or all words of a shorter item; n_hit
    counts the words inside an occurrence of any window, and spans are the merged places of all
    occurrences, (begin, end) in words from 0, end exclusive, in order.  longest_match is the
    largest number of consecutive words of the document that stand so in one item, of whatever
    size, and longest_at the first word of the first such place (null for none).  Null and empty
    texts have no words; items without words have no window, items without an id are left out,
    and items that share an id count once.  Other columns aren't read."""
    files = blocks(benchmark, limit)
    span = pa.struct([("begin", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, order in _shards(batches, files):
            found = _searched(utf8(batch.column(1)), order, depth)
            text, begin, end = found.spans()
            n = len(found.items)
            n_hit = np.bincount(text, weights=end - begin, minlength=n).astype(np.int64)
            edge = np.searchsorted(text, np.arange(n + 1)).astype(np.int32)
            spans = pa.ListArray.from_arrays(pa.array(edge), pa.StructArray.from_arrays([pa.array(begin), pa.array(end)], fields=list(span)))
            items = [sorted(x) for x in found.items]
            most, where = found.longest()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(found.shard.n_words), pa.array(n_hit), pa.array([len(x) for x in items], pa.int64()),
                    pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()), pa.array(n_hit > 0), pa.array(most), pa.array(where, mask=where < 0),
                    pa.array(items, pa.list_(pa.string())), spans,
                ],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_match", "longest_at", "items", "spans"],
            )

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(
        run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_match long, longest_at long, items array<string>, spans array<struct<begin: long, end: long>>"
    )


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    places = F.array_join(F.transform("spans", lambda x: F.concat(x["begin"], F.lit("-"), x["end"])), ",")
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_match", places.alias("hit_spans"))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows in whose text no benchmark window occurs, each judged by its own text alone."""
    files = blocks(benchmark)
    schema = docs.schema
    at = schema.fieldNames().index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, order in _shards(batches, files):
            found = _searched(utf8(batch.column(at)), order, DEPTH)
            clean = np.ones(batch.num_rows, dtype=bool)
            clean[found.spans()[0]] = False
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(run, schema)


#: The same in DuckDB: windows joined by equality; the longest match below the window's size is
#: the greatest k with a common run of k words, above it a run of windows along one diagonal.
_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_FOLDED = f"translate(coalesce(text, ''), '{_AZ}', '{_AZ.lower()}')"
ORACLE = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_FOLDED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all({_FOLDED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
bj AS (SELECT item_id, ws, least(len(ws), 10) AS k, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS j FROM b WHERE len(ws) > 0),
bw AS (SELECT DISTINCT item_id, k, list_slice(ws, j, j + k - 1) AS win FROM bj),
bw1 AS (SELECT DISTINCT unnest(ws) AS w FROM b),
dp AS MATERIALIZED (SELECT doc_id, ws, i FROM (SELECT doc_id, ws, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM d) WHERE w IN (SELECT w FROM bw1)),
di AS (SELECT doc_id, ws, k, i FROM dp, (SELECT DISTINCT k FROM bw) WHERE i + k - 1 <= len(ws)),
hit AS (SELECT di.doc_id, di.i, di.k, bw.item_id FROM di JOIN bw ON di.k = bw.k AND list_slice(di.ws, di.i, di.i + di.k - 1) = bw.win),
pos AS (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM hit),
spn AS (SELECT doc_id, min(p) - 1 AS b, max(p) AS e FROM (SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS run FROM pos) GROUP BY doc_id, run),
hits AS (SELECT doc_id, CAST(sum(e - b) AS BIGINT) AS n_hit, string_agg(b || '-' || e, ',' ORDER BY b) AS hit_spans FROM spn GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id),
ks AS (SELECT unnest(range(1, 10)) AS k),
bg AS (SELECT DISTINCT k, list_slice(ws, j, j + k - 1) AS g FROM (SELECT k, ws, unnest(range(1, len(ws) - k + 2)) AS j FROM b, ks WHERE len(ws) >= k)),
dg AS (SELECT doc_id, k, list_slice(ws, i, i + k - 1) AS g FROM dp, ks WHERE i + k - 1 <= len(ws)),
below AS (SELECT doc_id, max(dg.k) AS n FROM dg JOIN bg ON dg.k = bg.k AND dg.g = bg.g GROUP BY doc_id),
dt AS (SELECT doc_id, i, list_slice(ws, i, i + 9) AS g FROM dp WHERE i + 9 <= len(ws)),
bt AS (SELECT item_id, j, list_slice(ws, j, j + 9) AS g FROM (SELECT item_id, ws, unnest(range(1, len(ws) - 8)) AS j FROM b WHERE len(ws) >= 10)),
dia AS (SELECT doc_id, item_id, i - j AS diag, i - row_number() OVER (PARTITION BY doc_id, item_id, i - j ORDER BY i) AS run FROM dt JOIN bt ON dt.g = bt.g),
above AS (SELECT doc_id, max(n) AS n FROM (SELECT doc_id, count(*) + 9 AS n FROM dia GROUP BY doc_id, item_id, diag, run) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated,
  coalesce(above.n, below.n, 0) AS longest_match, coalesce(hit_spans, '') AS hit_spans
FROM d LEFT JOIN hits ON d.doc_id = hits.doc_id LEFT JOIN its ON d.doc_id = its.doc_id LEFT JOIN below ON d.doc_id = below.doc_id LEFT JOIN above ON d.doc_id = above.doc_id
"""
