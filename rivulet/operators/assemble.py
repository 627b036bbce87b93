"""From protocol records to committed transactions (OP-SRC-2..4, OP-WIN-2..4)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialise
from .ordered import numbered


def surviving(log: DataFrame) -> DataFrame:
    """Changes of committed transactions that no savepoint rollback removed.

    A rollback at `abort` removes everything its transaction appended from the subtransaction's
    first surviving change on; if none survives it does nothing.  Rollbacks are applied in stream
    order, so the numbers of transactions that have one are folded one by one, and their rows meet
    the result in a join; all other transactions take no Python."""
    commits = log.where("kind = 'commit'").select("xid")
    body = log.where("kind in ('change', 'sub_abort')").join(commits, "xid", "left_semi")
    touched = body.where("kind = 'sub_abort'").select("xid").distinct()
    plain = body.join(touched, "xid", "left_anti")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(xid, seq, kind, subxid) in order of (xid, seq): the kept (xid, seq).  Only numbers of the
        transaction at hand are held, not its rows."""
        now, kept, first = None, [], {}  # first: each subtransaction's first place in kept
        for batch in batches:
            done: list[tuple] = []
            for x, seq, k, s in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if x != now:
                    done += ((now, q) for q in kept)
                    now, kept, first = x, [], {}
                if k != "sub_abort":
                    if s is not None:
                        first.setdefault(s, len(kept))
                    kept.append(seq)
                elif (at := first.get(s)) is not None and at < len(kept):
                    del kept[at:]
                    first = {a: b for a, b in first.items() if b < at}
            yield pairs(done)
        yield pairs([(now, q) for q in kept])

    def pairs(rows: list[tuple]) -> pa.RecordBatch:
        xs, seqs = zip(*rows, strict=True) if rows else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(xs, pa.int64()), pa.array(seqs, pa.int64())], names=["xid", "seq"])

    some = body.join(touched, "xid", "left_semi").select(body.columns)
    narrow = some.select(F.col("xid").cast("long"), F.col("seq").cast("long"), "kind", F.col("subxid").cast("long").alias("subxid"))
    kept = narrow.repartition("xid").sortWithinPartitions("xid", "seq").mapInArrow(fold, "xid long, seq long")
    return plain.unionByName(some.join(kept, ["xid", "seq"], "left_semi"))


def assemble(log: DataFrame) -> DataFrame:
    """Surviving changes with commit_lsn (the commit record's position), commit_idx (from 0) and,
    if records have one, the commit's commit_ts."""
    body = log.drop("commit_lsn", "commit_idx", "commit_ts")
    ts = ["commit_ts"] if "commit_ts" in log.columns else []
    commits = log.where("kind = 'commit'").select("xid", F.col("seq").alias("commit_lsn"), *ts)
    in_txn = Window.partitionBy("xid").orderBy("seq")
    return surviving(body).join(commits, "xid").withColumn("commit_idx", (F.row_number().over(in_txn) - 1).cast("int"))


def slices(changes: DataFrame, size: int) -> DataFrame:
    """Numbers the slices of at most `size` changes that a transaction is dispatched in."""
    return changes.withColumn("slice", F.expr(f"commit_idx div {size}"))


#: Transactions that are folded in one task.
BLOCK = 200_000


def _jumps(n_changes: np.ndarray, boundary: np.ndarray, max_transactions: int, max_changes: int) -> np.ndarray:
    """Where the next batch begins if one begins at each place; the number of places for beyond."""
    n, i = len(n_changes), np.arange(len(n_changes))
    before = np.concatenate([[0], np.cumsum(n_changes)])
    full = np.searchsorted(before, before[:-1] + max_changes)
    marks = np.append(np.flatnonzero(boundary), n)
    solo = np.where(boundary, i + 1, marks[np.searchsorted(marks[:-1], i, side="right")])
    return np.minimum.reduce([i + max_transactions, full, solo, np.full(n, n)])


def _last_starts(jump: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From each of `first`: the last place that is reached by jumps, and how many places are."""
    n = len(jump)
    lifts, step = [], np.append(jump, n)
    while (step[:-1] < n).any():
        lifts.append(step)
        step = step[step]
    at, count = first.copy(), np.ones(len(first), dtype=np.int64)
    for k in reversed(range(len(lifts))):
        to = lifts[k][at]
        go = to < n
        at, count = np.where(go, to, at), count + np.where(go, 1 << k, 0)
    return at, count


def batches(transactions: DataFrame, max_transactions: int, max_changes: int) -> DataFrame:
    """Greedy batches of (commit_lsn, n_changes, boundary) in commit order: adds `batch`.

    A batch closes at the transaction cap or once its changes reach the size cap (tested before
    a transaction is added, so the last may overshoot); a boundary transaction is a batch of its
    own.  Numbers rise with commit order.

    Where a batch ends follows from where it begins, and that lies at most max_transactions back.
    So blocks of transactions are folded apart, each for every beginning of the batch that may
    reach into it (the block sees the max_transactions before it); one task then walks over the
    blocks, of which it reads these few rows each, and tells each its true beginning."""
    size = max(BLOCK, 2 * max_transactions)
    rows = numbered(transactions, ["commit_lsn"], "_at")
    rows = materialise(rows.withColumn("_block", F.expr(f"_at div {size}")), "numbered")
    ahead = F.when(F.col("_at") % size >= size - max_transactions, F.array(F.col("_block"), F.col("_block") + 1)).otherwise(F.array("_block"))
    seen = rows.select("_at", "n_changes", "boundary", F.explode(ahead).alias("_block"))

    def entries(pdf: pd.DataFrame) -> pd.DataFrame:
        """(block, the last batch's start before it, the last one's in it, how many start in it)."""
        pdf = pdf.sort_values("_at")
        i, block = pdf["_at"].to_numpy(), int(pdf["_block"].iloc[0])
        own = int(np.searchsorted(i, block * size))
        none = {"block": [], "start": [], "last": [], "n": []}
        if own == len(i):  # nothing but what another block's end looks ahead to
            return pd.DataFrame(none).astype("int64")
        jump = _jumps(pdf["n_changes"].to_numpy(), pdf["boundary"].to_numpy(), max_transactions, max_changes)
        first = np.zeros(1, dtype=np.int64)
        start = np.full(1, -1)
        if own:
            before = np.flatnonzero(jump[:own] >= own)
            first, start = jump[before], i[before]
        within = first < len(i)
        last, n = _last_starts(jump, np.where(within, first, 0))
        # a batch may reach over a last block that is short
        return pd.DataFrame({"block": block, "start": start, "last": np.where(within, i[last], start), "n": np.where(within, n, 0)})

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, total = -1, 0
        for pdf in parts:
            out = []
            for block, start, end, n in pdf.itertuples(index=False):
                if start == last and (not out or out[-1][0] != block):
                    out.append((block, start, total))
                    last, total = end, total + n
            yield pd.DataFrame(out, columns=["_block", "_start", "_offset"])

    found = seen.groupBy("_block").applyInPandas(entries, "block long, start long, last long, n long")
    true = found.coalesce(1).sortWithinPartitions("block", "start").mapInPandas(walk, "_block long, _start long, _offset long")
    true = materialise(true, "entries")

    def number(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_at")
        i, start, block = pdf["_at"].to_numpy(), int(pdf["_start"].iloc[0]), int(pdf["_block"].iloc[0])
        jump = _jumps(pdf["n_changes"].to_numpy(), pdf["boundary"].to_numpy(), max_transactions, max_changes)
        starts = np.zeros(len(i), dtype=np.int64)
        at = int(jump[np.searchsorted(i, start)]) if start >= 0 else 0
        while at < len(i):
            starts[at] = 1
            at = int(jump[at])
        pdf = pdf.assign(batch=int(pdf["_offset"].iloc[0]) - 1 + np.cumsum(starts))
        return pdf.loc[i >= block * size, ["_at", "batch"]]

    cut = seen.join(F.broadcast(true), "_block").groupBy("_block").applyInPandas(number, "_at long, batch long")
    return rows.join(cut, "_at").drop("_at", "_block")
