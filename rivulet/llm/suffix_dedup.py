"""Removal of long byte strings that occur earlier in the corpus.

A byte goes if a string of SPAN bytes that covers it also starts earlier (smaller doc_id, or
same document, earlier start).  Every such string has an anchor: the leftmost of its
ANCHOR-byte substrings with the least hash, which depends on the string alone, so equal
strings share anchor and place.  Neighbouring strings mostly share theirs, which makes one
segment of up to 2 * SPAN - ANCHOR bytes.

1. Whole copies of a text (equal length and md5) stand for nothing new and are left out.
2. Anchors' hashes are counted over the corpus; a document keeps those that occur twice.
3. Segments with such anchors are dealt by the anchor's hash; deep_shallow sorts those of a map
   task first and equal ones become one, so what a third of all documents hold is sent once a group of texts.
   Segments of hot anchors are dealt by what stands behind or before the anchor as well.
4. Each task takes its anchors in blocks.  deep_shallow sorts the segments, of which equal ones
   become one, then all strings of the rest; of equal ones the earliest stays.
5. Removed spans are gathered per document.

Texts are dealt by doc_id once, and that exchange serves steps 2, 3 and 5."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT, groups, join_spread, mix64, shuffle_partitions, table, utf8
from .suffix_sort import Text, deep_shallow

SPAN, ANCHOR = 100, 32
#: Bytes of texts that are cut into segments at a time.
GROUP_BYTES = 4 << 20
#: Bytes of segments that are sorted at a time.
BLOCK_BYTES = 4 << 20
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint32)


class Segments:
    """Runs of strings with one anchor: text number, first start, last start, anchor, hash."""

    def __init__(self, texts: list[bytes], span: int = SPAN, anchor: int = ANCHOR) -> None:
        lens = np.array([len(t) for t in texts], dtype=np.int64)
        data = b"".join(texts)
        base = np.cumsum(lens) - lens
        n = len(data) - span + 1
        empty = np.zeros(0, dtype=np.int64)
        self.data, self.base = data, base
        self.text = self.low = self.high = self.place = empty
        self.hash = np.zeros(0, dtype=np.uint64)
        if n <= 0:
            return
        h, width, factor = _BYTE[np.frombuffer(data, dtype=np.uint8)], 1, 0x01000193
        whole, done = None, 0
        while width <= anchor:  # hashes of the powers of two that make up `anchor`
            if anchor & width:
                whole = h if whole is None else whole[: len(whole) - width] * np.uint32(factor) + h[done : done + len(whole) - width]
                done += width
            h = h[:-width] * np.uint32(factor) + h[width:]
            factor, width = factor * factor % (1 << 32), 2 * width
        whole ^= whole >> np.uint32(15)
        whole *= np.uint32(0x85EBCA6B)
        whole ^= whole >> np.uint32(13)
        # the least hash, leftmost first, of each window of strings
        least = (whole.astype(np.uint64) << np.uint64(32)) | np.arange(len(whole), dtype=np.uint64)
        room, width = span - anchor + 1, 1
        while 2 * width <= room:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if room > width:
            least = np.minimum(least[: len(least) - (room - width)], least[room - width :])
        at = (least[:n] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        owner = np.repeat(np.arange(len(texts)), lens)[:n]
        ok = np.arange(n) + span <= (base + lens)[owner]
        new = np.ones(n, dtype=bool)
        new[1:] = (at[1:] != at[:-1]) | ~ok[:-1]
        first = np.flatnonzero(new & ok)
        if not len(first):
            return
        end = np.ones(n, dtype=bool)
        end[:-1] = new[1:] | ~ok[1:]
        last = np.flatnonzero(end & ok)
        self.text, self.low, self.high, self.place = owner[first], first, last, at[first]
        words = np.ndarray((len(data) + 1,), "<u8", data + bytes(8), 0, (1,))
        k = np.full(len(first), anchor, dtype=np.uint64)
        for off in range(0, anchor, 8):
            w = words[self.place + off].astype(np.uint64)
            if anchor - off < 8:
                w &= np.uint64((1 << 8 * (anchor - off)) - 1)
            k = mix64(k * np.uint64(0x2545F4914F6CDD1D) + w)
        self.hash = k


    def split(self, keep: np.ndarray, hot: np.ndarray) -> np.ndarray:
        """Replaces the segments marked hot, whose anchor very many share: strings with at most
        half of their other bytes before the anchor go by the bytes behind it, the others by those
        before it, so that equal strings still share a hash.  Gives `keep` for the new segments."""
        if not hot.any():
            return keep
        half = (SPAN - ANCHOR) // 2
        cols = {k: [getattr(self, k)[~hot]] for k in ("text", "low", "high", "place", "hash")}
        for i in np.flatnonzero(hot).tolist():
            at, h = int(self.place[i]), int(self.hash[i])
            behind = (max(int(self.low[i]), at - half), int(self.high[i]), self.data[at + ANCHOR : at + ANCHOR + half], 1)
            before = (int(self.low[i]), min(int(self.high[i]), at - half - 1), self.data[max(at - half, 0) : at], 2)
            for low, high, part, side in (behind, before):
                if low <= high:
                    values = (self.text[i], low, high, at, np.uint64(xxhash.xxh3_64_intdigest(part, h ^ side)))
                    for k, v in zip(cols, values, strict=True):
                        cols[k].append(np.array([v], dtype=getattr(self, k).dtype))
        kept = np.concatenate([keep[~hot], np.ones(len(cols["low"]) - 1, dtype=bool)])
        order = np.argsort(np.concatenate(cols["low"]), kind="stable")
        for k, v in cols.items():
            setattr(self, k, np.concatenate(v)[order])
        return kept[order]


def pieces(texts: list[bytes | None]) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Lists of (row, offset, bytes) of bounded size; a long text is cut so that every string
    lies in one piece."""
    rows, offs, parts, size = [], [], [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(len(t or b"") - SPAN + 1, 0), GROUP_BYTES):
            part = t[at : at + GROUP_BYTES + SPAN - 1]
            if rows and size + len(part) > GROUP_BYTES:
                yield rows, offs, parts
                rows, offs, parts, size = [], [], [], 0
            rows.append(i)
            offs.append(at)
            parts.append(part)
            size += len(part)
    if rows:
        yield rows, offs, parts


def merge_spans(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unions of overlapping or touching spans."""
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    cut = np.ones(len(begin), dtype=bool)
    cut[1:] = begin[1:] > end[:-1]
    return begin[cut], end[np.concatenate([np.flatnonzero(cut)[1:] - 1, [len(end) - 1]])] if len(end) else end


def _span_rows(owner: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """merge_spans for each owner."""
    if not len(owner):
        return owner.astype(np.int64), begin, end
    out = ([], [], [])
    order = np.argsort(owner, kind="stable")
    owner, begin, end = owner[order], begin[order], end[order]
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    for s, e in zip(first, [*first[1:], len(owner)], strict=True):
        b, f = merge_spans(begin[s:e], end[s:e])
        for arr, v in zip(out, (np.full(len(b), owner[s]), b, f), strict=True):
            arr.append(v)
    return tuple(np.concatenate(x) for x in out)


def first_equals(text: Text, starts: np.ndarray, sizes: np.ndarray, alike: np.ndarray) -> np.ndarray:
    """For each segment the first one of the same bytes, size and `alike` (itself if there is none before)."""
    one = np.arange(len(starts))
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        perm, cls = deep_shallow(text, starts[rows], alike[rows], int(size))
        new = np.concatenate([[True], cls[1:] != cls[:-1]])
        first = np.maximum.accumulate(np.where(new, np.arange(len(perm)), 0))
        one[rows[perm]] = rows[perm[first]]
    return one


def repeated_strings(hashes: np.ndarray, offs: np.ndarray, segs: list[bytes], doc: np.ndarray, low: np.ndarray) -> tuple[list[tuple[int, int, int]], np.ndarray]:
    """Segments come in order of hash, then place in the corpus (doc, low); `offs` is the
    anchor's place in each.  Gives (segment, first, last start of strings that occur earlier),
    and which segments have a string that doesn't.  Of segments at one place, which repeated
    rows give, the others count for nothing."""
    gone, keep = [], np.ones(len(segs), dtype=bool)
    sizes = np.array([len(x) for x in segs], dtype=np.int64)
    ends = np.cumsum(sizes)
    text = Text(b"".join(segs))
    alike = np.cumsum(np.concatenate([[0], hashes[1:] != hashes[:-1]])) * SPAN + offs
    one = first_equals(text, ends - sizes, sizes, alike)  # whole segments first: equal ones are equal in all their strings
    i = np.flatnonzero(one != np.arange(len(one)))
    keep[i] = False
    i = i[(doc[i] != doc[one[i]]) | (low[i] != low[one[i]])]
    gone += [(k, 0, n - SPAN) for k, n in zip(i.tolist(), sizes[i].tolist(), strict=True)]
    left = np.flatnonzero(keep)
    h = hashes[left]
    company = np.zeros(len(left), dtype=bool)
    company[1:] = h[1:] == h[:-1]
    company[:-1] |= company[1:]
    left, h = left[company], h[company]
    if not len(left):
        return gone, keep
    lens = np.array([len(segs[i]) for i in left], dtype=np.int64)
    base = np.cumsum(lens) - lens
    n = lens - SPAN + 1
    owner = np.repeat(np.arange(len(left)), n)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    group = np.cumsum(np.concatenate([[0], h[1:] != h[:-1]]))
    bucket = group[owner] * SPAN + (offs[left][owner] - inside)
    perm, cls = deep_shallow(Text(b"".join(segs[i] for i in left)), base[owner] + inside, bucket, SPAN)
    later = np.zeros(len(owner), dtype=bool)
    later[perm[1:]] = cls[1:] == cls[:-1]
    runs = np.flatnonzero(later & ~np.concatenate([[False], later[:-1] & (owner[1:] == owner[:-1])]))
    ends = np.flatnonzero(later & ~np.concatenate([later[1:] & (owner[1:] == owner[:-1]), [False]]))
    for s, e in zip(runs, ends, strict=True):
        gone.append((int(left[owner[s]]), int(inside[s]), int(inside[e])))
    fresh = np.bincount(owner[~later], minlength=len(left)) > 0
    keep[left[~fresh]] = False
    return gone, keep


def _own(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows that stand for occurrences: with an id, long enough, no copy of another."""
    size = pa.compute.fill_null(pa.compute.binary_length(batch.column(2)), 0)
    keep = pa.compute.and_(pa.compute.greater_equal(size, SPAN), pa.compute.invert(batch.column(3)))
    return batch.filter(pa.compute.and_(keep, batch.column(0).is_valid()))


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, doc_id), twice at most for each document."""
    for batch in map(_own, groups(batches, "text", GROUP_BYTES)):
        ids = batch.column(0).to_numpy()
        for rows, _, parts in pieces(utf8(batch.column(2))):
            s = Segments(parts)
            pair = np.stack([s.hash, np.asarray(rows)[s.text].astype(np.uint64)], axis=1)
            order = np.lexsort((pair[:, 0], pair[:, 1]))
            pair = pair[order]
            same = np.zeros(len(pair), dtype=bool)
            same[1:] = (pair[1:] == pair[:-1]).all(axis=1)
            third = same.copy()
            third[1:] &= same[:-1]
            pair = pair[~third]
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0].view(np.int64)), pa.array(ids[pair[:, 1].astype(np.int64)])], names=["h", "doc_id"])


SEGMENT = "h long, doc_id long, t long, low long, off int, seg binary"


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments whose anchors are repeated, and (seg null, off the length) spans that repeat an
    earlier one of the same group of texts."""
    for batch in map(_own, groups(batches, "text", GROUP_BYTES)):
        batch = batch.filter(batch.column(4).is_valid())
        ids, ts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        known = [np.sort(np.asarray(x.values).astype(np.int64).view(np.uint64)) for x in batch.column(4)]
        hot = [{h % (1 << 64) for h in x} for x in batch.column(5).to_pylist()]
        for rows, offs, parts in pieces(utf8(batch.column(2))):
            s = Segments(parts)
            rows, offs = np.asarray(rows), np.asarray(offs)
            keep = np.zeros(len(s.text), dtype=bool)
            edge = np.searchsorted(s.text, np.arange(len(parts) + 1))
            for k in range(len(parts)):
                lo, hi = edge[k], edge[k + 1]
                ours = known[rows[k]]
                at = np.minimum(np.searchsorted(ours, s.hash[lo:hi]), len(ours) - 1)
                keep[lo:hi] = ours[at] == s.hash[lo:hi]
            if any(hot):
                keep = s.split(keep, np.array([keep[i] and int(s.hash[i]) in hot[rows[s.text[i]]] for i in range(len(keep))], dtype=bool))
            pick = np.flatnonzero(keep)
            row = rows[s.text[pick]]
            low = s.low[pick] - s.base[s.text[pick]] + offs[s.text[pick]]
            order = np.lexsort((low, ts[row], ids[row]))
            pick, row, low = pick[order], row[order], low[order]
            begin, size = s.low[pick], (s.high - s.low)[pick] + SPAN
            alike = np.unique(s.hash[pick], return_inverse=True)[1].reshape(-1) * SPAN + (s.place - s.low)[pick]
            one = first_equals(Text(s.data), begin, size, alike)
            first = one == np.arange(len(pick))
            twin = ~first & (low == low[one]) & (ids[row] == ids[row[one]]) & (ts[row] == ts[row[one]])  # of repeated rows
            cut = [s.data[a:b] for a, b in zip(begin[first].tolist(), (begin + size)[first].tolist(), strict=True)]
            later = ~first & ~twin
            dup_row, begin, end = _span_rows(row[later], low[later], low[later] + (s.high - s.low)[pick[later]] + SPAN)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([s.hash[pick[first]].view(np.int64), mix64(ids[dup_row].astype(np.uint64)).view(np.int64)])),
                    pa.array(np.concatenate([ids[row[first]], ids[dup_row]])),
                    pa.array(np.concatenate([ts[row[first]], ts[dup_row]])),
                    pa.array(np.concatenate([low[first], begin])),
                    pa.array(np.concatenate([(s.place - s.low)[pick[first]], end - begin]).astype(np.int32)),
                    pa.array(cut + [None] * len(dup_row), pa.binary()),
                ],
                names=["h", "doc_id", "t", "low", "off", "seg"],
            )


SPANS = "doc_id long, t long, begin long, end long"


def _sorted_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans to remove, from segments in order of hash and place in the corpus."""

    def spans(doc, t, begin, end):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc, t, begin, end)], names=["doc_id", "t", "begin", "end"])

    def flush(rows: dict, last: bool) -> Iterator[pa.RecordBatch]:
        """Sort the complete groups of `rows`, or all; what stays is left in `rows`."""
        h = rows["h"]
        if not len(h):
            return
        stop = len(h) if last else int(np.searchsorted(h, h[-1]))
        single = stop == 0
        stop = stop or len(h)  # one anchor fills the block: its first strings are carried on
        gone, keep = repeated_strings(h[:stop], rows["off"][:stop], rows["seg"][:stop], rows["doc"], rows["low"])
        if gone:
            i, a, b = (np.array(x, dtype=np.int64) for x in zip(*gone, strict=True))
            key, begin, end = _span_rows(rows["doc"][i], rows["low"][i] + a, rows["low"][i] + b + SPAN)
            at = np.searchsorted(rows["doc"][i], key, sorter=np.argsort(rows["doc"][i], kind="stable"))
            number = np.argsort(rows["doc"][i], kind="stable")[at]
            yield spans(rows["doc_id"][i][number], rows["t"][i][number], begin, end)
        pick = np.concatenate([np.flatnonzero(keep) if single else np.zeros(0, dtype=np.int64), np.arange(stop, len(h))]).astype(np.int64)
        segs = rows["seg"]
        for k in rows:
            rows[k] = [segs[i] for i in pick] if k == "seg" else rows[k][pick]

    rows: dict = {k: np.zeros(0, dtype=np.int64) for k in ("h", "doc_id", "t", "low", "off", "doc")} | {"seg": []}
    size, limit = 0, BLOCK_BYTES
    for batch in batches:
        for at in range(0, batch.num_rows, 8192):
            part = batch.slice(at, 8192)
            ready = part.filter(part.column(5).is_null())
            if ready.num_rows:
                low, n = ready.column(3).to_numpy(), ready.column(4).to_numpy()
                yield spans(ready.column(1), ready.column(2), low, low + n)
            part = part.filter(part.column(5).is_valid())
            for k, c in (("h", 0), ("doc_id", 1), ("t", 2), ("low", 3), ("off", 4)):
                rows[k] = np.concatenate([rows[k], part.column(c).to_numpy(zero_copy_only=False).astype(np.int64)])
            segs = part.column(5).to_pylist()
            rows["seg"] += segs
            size += sum(map(len, segs))
            if size >= limit:
                rows["doc"] = np.unique(np.stack([rows["doc_id"], rows["t"]], axis=1), axis=0, return_inverse=True)[1].reshape(-1)
                yield from flush(rows, False)
                size = sum(map(len, rows["seg"]))
                limit = max(BLOCK_BYTES, 2 * size)
    rows["doc"] = np.unique(np.stack([rows["doc_id"], rows["t"]], axis=1), axis=0, return_inverse=True)[1].reshape(-1)
    yield from flush(rows, True)


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = True) -> DataFrame:
    """For each row of `docs`: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (digest) or
    kept (binary, the remaining bytes).

    Null texts count as empty; texts shorter than SPAN keep all.  Rows without an id are kept
    whole and stand for no occurrence; rows that share id and text are one document, rows that
    share only the id are told apart by their texts' hashes.  Other columns aren't read."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    base = base.select("doc_id", F.xxhash64("text").alias("t"), "text")
    usable = base.where((F.octet_length("text") >= SPAN) & F.col("doc_id").isNotNull())
    keyed = usable.select("doc_id", "t", F.md5(F.col("text").cast("binary")).alias("m"), F.octet_length("text").alias("n"))
    # one row a text, however many copies it has; a document that isn't its text's first is a copy
    first = keyed.groupBy("m", "n").agg(F.min(F.struct("doc_id", "t")).alias("p")).groupBy("p.doc_id").agg(F.collect_set("p.t").alias("firsts"))
    is_copy = (F.octet_length("text") >= SPAN) & F.col("doc_id").isNotNull() & ~F.coalesce(F.array_contains("firsts", F.col("t")), F.lit(False))
    dealt = base.join(first.hint("merge"), "doc_id", "left").select("doc_id", "t", "text", F.coalesce(is_copy, F.lit(False)).alias("copy"))
    # rows are sorted out in the map functions and joins are outer ones: a filter here would be
    # pushed below the exchange of texts and make another one of it
    anchors = dealt.mapInArrow(_anchors, "h long, doc_id long")
    twice = anchors.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # an anchor begins at a byte of its own, and there is about one in (SPAN - ANCHOR) / 2 bytes
    size = usable.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    share = size * 2 // ((SPAN - ANCHOR) * HOT * shuffle_partitions(docs.sparkSession))
    found = join_spread(anchors, twice, ["h"], "n", ["doc_id"], share=share)
    known = found.groupBy("doc_id").agg(F.collect_set("h").alias("known"), F.collect_set(F.when(F.col("hot"), F.col("h"))).alias("hot"))
    segs = dealt.join(known.hint("merge"), "doc_id", "left").select("doc_id", "t", "text", "copy", "known", "hot").mapInArrow(_segments, SEGMENT)
    parts = shuffle_partitions(docs.sparkSession)
    spans = segs.repartition(parts, "h").sortWithinPartitions("h", "doc_id", "t", "low").mapInArrow(_sorted_blocks, SPANS)
    gone = spans.groupBy("doc_id").agg(F.collect_list(F.struct("t", "begin", "end")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups(batches, "text", GROUP_BYTES):
            out = []
            for text, t, copy, found in zip(utf8(batch.column(2)), batch.column(1).to_pylist(), batch.column(3).to_pylist(), batch.column(4), strict=True):
                text = text or b""
                if copy:
                    out.append((len(text), len(text), 1, b""))
                    continue
                if not found.is_valid:
                    out.append((len(text), 0, 0, text))
                    continue
                mine, begin, end = (np.asarray(x) for x in found.values.flatten())
                begin, end = merge_spans(begin[mine == t], end[mine == t])
                edges = [0, *np.stack([begin, end], axis=1).reshape(-1).tolist(), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((len(text), len(text) - len(kept), len(begin), kept))
            n, removed, n_spans, kept = zip(*out, strict=True)
            last = pa.array([hashlib.sha256(k).hexdigest() for k in kept]) if digest else pa.array(kept, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n, removed, n_spans)), last], names=["doc_id", "n_bytes", "n_removed", "n_spans", name])

    name = "kept_sha256" if digest else "kept"
    whole = dealt.join(gone.hint("merge"), "doc_id", "left").select("doc_id", "t", "text", "copy", "spans")
    return whole.mapInArrow(cut, f"doc_id long, n_bytes long, n_removed long, n_spans long, {name} {'string' if digest else 'binary'}")


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


#: The same in DuckDB: every string of 100 bytes, ranked among its equals.
ORACLE = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
s AS (SELECT doc_id, unnest(range(1, n - 98)) AS i, unnest(list_transform(range(1, n - 98), lambda i: array_slice(b, i, i + 99))) AS win FROM d WHERE n >= 100),
g AS (SELECT doc_id, i FROM s QUALIFY row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1),
m AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS fresh FROM g),
k AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS span FROM m),
x AS (SELECT doc_id, span, min(i) AS lo, max(i) + 99 AS hi FROM k GROUP BY doc_id, span),
y AS (SELECT x.doc_id, d.b, d.n, lo, hi, coalesce(lag(hi) OVER (PARTITION BY x.doc_id ORDER BY lo), 0) AS before, lead(lo) OVER (PARTITION BY x.doc_id ORDER BY lo) IS NULL AS is_last FROM x JOIN d ON d.doc_id = x.doc_id),
z AS (SELECT doc_id, sum(hi - lo + 1) AS n_removed, count(*) AS n_spans,
  string_agg(hex(array_slice(b, before + 1, lo - 1)) || CASE WHEN is_last THEN hex(array_slice(b, hi + 1, n)) ELSE '' END, '' ORDER BY lo) AS kept FROM y GROUP BY doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(coalesce(unhex(kept), b)) AS kept_sha256 FROM d LEFT JOIN z ON z.doc_id = d.doc_id
"""
