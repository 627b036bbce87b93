"""Best-fit packing of token pieces into sequences of one capacity.

1. Every whole text becomes ids and an end id; only what is longer than the capacity is cut.
2. The lengths are counted: at most `capacity` numbers, whatever the table's size.  They are all
   the driver sees.
3. A configuration is a multiset of lengths that fits one sequence.  The configuration linear
   program (least number of sequences so that every length is covered) is solved by
   multiplicative weights: each length has a price, which falls as it is covered; in each round a
   knapsack dynamic program over the prices gives, for every length, the best configuration that
   holds it, and those near the best of all are taken as the round's answer.
4. The rounds' average is rounded: configurations are taken a whole number of times, by running
   totals, never more often than their lengths are left, and only if they are as full as any.  What
   is left goes to the better of two: a knapsack over what is there fills one configuration after
   the other, or best fit, longest first.  The same may be solved again for what is left; the least number of
   sequences counts.
5. The pieces, dealt by ranges of their length and numbered, take their places: the k-th piece of a
   length goes where the plan has that length's k-th place, found by binary search in a table of
   places whose size is bounded by the rounds, not by the input."""

from __future__ import annotations

import gc
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_ids import ByteCoder
from .common import groups, materialise, per_process, shuffle_partitions, table

CAPACITY = 2048
END = 0
#: Bytes of texts that are encoded at a time.
GROUP_BYTES = 4 << 20
#: Rounds of multiplicative weights for each solution of the program, and answers taken from each.
ROUNDS, ANSWERS = 60, 48
#: Step of the weights; how far below the best an answer's value may be.
STEP, NEAR = 1.0, 0.02
#: Solutions one after the other, each of what the last one's rounding left.
SOLUTIONS = 3


def byte_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@dataclass
class Plan:
    """Places by length: rank `first` and on of `length` go to sequence `sequence` and on, `times` to a
    sequence, the first at `offset`.  Rows are sorted by (length, first)."""

    length: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    times: np.ndarray
    n_sequences: int

    def places(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces by their length and rank among those of the same length."""
        key = (self.length.astype(np.int64) << 44) | self.first
        at = np.searchsorted(key, (length.astype(np.int64) << 44) | rank, side="right") - 1
        k = rank - self.first[at]
        return self.sequence[at] + k // self.times[at], self.offset[at] + k % self.times[at] * length


def price(values: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The knapsack: the best value for each room, and the length that is taken last there (0: none, so
    look at the next smaller room that has one).  `values` by length, below 0 for lengths there are none of."""
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    for room in range(1, capacity + 1):
        got = values[1 : room + 1] + best[room - 1 :: -1] if room > 1 else values[1:2] + best[:1]
        k = int(got.argmax())
        if got[k] > best[room - 1]:
            best[room], last[room] = got[k], k + 1
        else:
            best[room] = best[room - 1]
    return best, last


def configurations(lengths: np.ndarray, last: np.ndarray, capacity: int) -> list[tuple[tuple[int, int], ...]]:
    """For each length the best configuration that holds it: pairs of length and number, longest first."""
    eff = np.maximum.accumulate(np.where(last > 0, np.arange(capacity + 1), 0))
    room, taken = eff[capacity - lengths], [lengths]
    while room.any():
        took = last[room]  # 0 where the room is 0
        taken.append(took)
        room = eff[room - took]
    rows = np.stack(taken, axis=1)
    return [tuple(sorted(Counter(x for x in row if x).items(), reverse=True)) for row in rows.tolist()]


def solve(counts: np.ndarray, capacity: int, rounds: int = ROUNDS, seed: int = 0) -> dict[tuple[tuple[int, int], ...], float]:
    """A nearly optimal fractional solution: how often each configuration is taken so that lengths are
    covered about as often as `counts` says (counts[0] isn't read)."""
    rnd = np.random.default_rng(seed)
    lengths = np.flatnonzero(counts[: capacity + 1])
    lengths = lengths[lengths > 0]
    need = counts[lengths].astype(float)
    # prices begin at the lengths' shares of a sequence: then every full configuration has the same value
    weight = need * lengths
    total: Counter = Counter()
    covered = np.zeros(len(lengths))
    index = np.zeros(capacity + 1, dtype=np.int64)
    index[lengths] = np.arange(len(lengths))
    size = need @ lengths / capacity
    for _ in range(rounds):
        values = np.full(capacity + 1, -1e30)
        # a little noise parts equal values, so that rounds don't repeat one answer
        values[lengths] = weight / need * (1 + 0.01 * rnd.random(len(lengths)))
        best, last = price(values, capacity)
        own = values[lengths] + best[capacity - lengths]
        good = np.flatnonzero(own >= (1 - NEAR) * best[capacity])
        chance = need[good] * lengths[good]
        few = rnd.choice(good, size=min(ANSWERS, len(good)), replace=False, p=chance / chance.sum())
        gain = np.zeros(len(lengths))
        answers = configurations(lengths[few], last, capacity)
        # each answer as often as its own length asks for, all together one solution's worth
        mass = np.array([need[i] / dict(c)[int(lengths[i])] for i, c in zip(few, answers, strict=True)])
        mass *= size / mass.sum()
        for c, m in zip(answers, mass, strict=True):
            total[c] += m / rounds
            for length, n in c:
                gain[index[length]] += n * m
        covered += gain / rounds
        ratio = gain / need
        weight = weight * np.exp(-STEP * np.minimum(ratio, 5.0))
        weight /= weight.sum()
    return total


def fill(counts: np.ndarray, capacity: int) -> tuple[tuple[int, int], ...]:
    """The longest that is there and the fullest sum beside it, over the numbers that are left: a
    knapsack on sums, kept as bits."""
    longest = int(np.flatnonzero(counts)[-1])
    room, have = capacity - longest, counts.copy()
    have[longest] -= 1
    steps: list[tuple[int, int]] = []
    sums, full = 1, 1 << room
    for length in np.flatnonzero(have[: room + 1])[::-1].tolist():
        for _ in range(min(int(have[length]), room // length)):
            steps.append((length, sums))
            more = (sums | sums << length) & ((full << 1) - 1)
            if more == sums:
                break
            sums = more
            if sums & full:
                break
        if sums & full:
            break
    at, out = sums.bit_length() - 1, Counter({longest: 1})
    for length, before in reversed(steps):
        if not before >> at & 1:
            out[length] += 1
            at -= length
    return tuple(sorted(out.items(), reverse=True))


def best_fit(counts: np.ndarray, capacity: int) -> Counter:
    """Configurations, and how often each, when every piece, longest first, goes where least room stays.
    Equal sequences are one entry with its number, so counts may be of any size."""
    rooms: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0  # a bit for each room that a sequence has
    for length in np.flatnonzero(counts)[::-1].tolist():
        rest = int(counts[length])
        while rest:
            fits = open_rooms >> length
            if fits:
                room = length + (fits & -fits).bit_length() - 1
                one, times = rooms[room].pop()
                if times > rest:
                    rooms[room].append((one, times - rest))
                if not rooms[room]:
                    open_rooms &= ~(1 << room)
            else:
                room, one, times = capacity, (), -(-rest // (capacity // length))
            # an empty sequence takes as many as it holds; others one, so that the next goes where least room is
            more = 1 if fits else min(capacity // length, rest)
            times = min(times, rest // more)
            rest -= times * more
            rooms[room - more * length].append((one + (length,) * more, times))
            open_rooms |= (1 << (room - more * length)) & ~1
    done: Counter = Counter()
    for room in rooms:
        for one, times in room:
            done[tuple(sorted(Counter(one).items(), reverse=True))] += times
    return done


def filled(counts: np.ndarray, capacity: int) -> Counter:
    """The same by fill(), one configuration after the other."""
    left, done = counts.copy(), Counter()
    while left.any():
        c = fill(left, capacity)
        times = min(int(left[length]) // m for length, m in c)
        done[c] += times
        for length, m in c:
            left[length] -= m * times
    return done


def rounded(solution: dict[tuple[tuple[int, int], ...], float], counts: np.ndarray) -> Counter:
    """Whole numbers of the solution's fullest configurations: those of the running totals, never more
    than what is left of their lengths allows."""
    left, done, due = counts.copy(), Counter(), 0.0
    sums = {c: sum(length * m for length, m in c) for c in solution}
    full = max(sums.values())
    for c, often in sorted(solution.items(), key=lambda x: -x[1]):
        if sums[c] < full:
            continue
        times = min(int(due + often) - int(due), *(int(left[length]) // m for length, m in c))
        due += often
        if times > 0:
            done[c] += times
            for length, m in c:
                left[length] -= m * times
    return done


def make_plan(counts: np.ndarray, capacity: int = CAPACITY) -> Plan:
    """From how many pieces there are of each length (counts[k] of length k) to places for all of them."""
    left = counts.astype(np.int64).copy()
    left[0] = 0
    if len(left) != capacity + 1 or (left < 0).any():
        raise ValueError("counts of lengths up to the capacity are needed")
    taken = Counter({((capacity, 1),): int(left[capacity])} if left[capacity] else {})
    left[capacity] = 0
    least = -(-int(left @ np.arange(capacity + 1)) // capacity) + taken.total()
    best: Counter | None = None
    for k in range(SOLUTIONS if left.any() else 0):
        for c, times in rounded(solve(left, capacity, seed=k), left).items():
            taken[c] += times
            for length, m in c:
                left[length] -= m * times
        rest = min(filled(left, capacity), best_fit(left, capacity), key=Counter.total)
        if best is None or taken.total() + rest.total() < best.total():
            best = taken + rest
        if best.total() == least or not left.any():
            break
    rows: list[tuple[int, int, int, int, int]] = []
    rank, n = [0] * (capacity + 1), 0
    for c, times in sorted((taken if best is None else best).items()):
        offset = 0
        for length, m in c:
            rows.append((length, rank[length], n, offset, m))
            rank[length] += m * times
            offset += m * length
        n += times
    made = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return Plan(*made.T.copy(), n)


def token_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian unsigned 32-bit), row for each piece of each whole
    text and the end id behind it; row tells pieces apart.

    A document of more than `capacity` ids is cut into pieces of `capacity`, of which the first may
    be shorter.  Null and empty texts are the end id alone; rows without an id, or that share one, are
    documents of their own."""
    path = path or byte_tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = per_process(("ByteCoder", path), lambda: ByteCoder(path))
        end = np.array([end_id], dtype="<u4").tobytes()
        row = TaskContext.get().partitionId() << 40
        step = 4 * capacity
        gc.disable()  # nothing here makes cycles, and the caches are long to walk
        try:
            for batch in groups(batches, limit=GROUP_BYTES):
                columns: list[list] = [[], [], [], [], [], []]
                for doc, ids in zip(batch.column(0).to_pylist(), coder.encode(batch.column(1).to_pylist()), strict=True):
                    ids += end
                    cuts = [0, *range(len(ids) % step or step, len(ids) + 1, step)]
                    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                        for column, value in zip(columns, (doc, k, a // 4, (b - a) // 4, ids[a:b], row), strict=True):
                            column.append(value)
                        row += 1
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids", "row"])
        finally:
            gc.enable()

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary, row long")


def packed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`pieces` (length from 1 to capacity, row, which tells them apart, and any other columns) with
    sequence_id and offset: every piece in one sequence, pieces of a sequence side by side from offset 0.

    `pieces` is read twice and must give the same rows both times, so write it first."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # at most `capacity` rows
        counts[length] = n
    plan = make_plan(counts, capacity)
    below = np.concatenate([[0], np.cumsum(counts)[:-1]])  # pieces of smaller lengths
    spark = pieces.sparkSession
    dealt = pieces.repartitionByRange(shuffle_partitions(spark), "length", "row").sortWithinPartitions("length", "row")
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = materialise(dealt.withColumns({"_part": F.spark_partition_id(), "_i": inside}), "dealt")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    totals = totals.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))  # a row for each range
    numbered = dealt.join(F.broadcast(totals), "_part").withColumn("_number", F.col("_before") + F.col("_i"))
    numbered = numbered.select(*pieces.columns, "_number")
    kept = [c for c in pieces.columns if c != "row"]
    shipped = spark.sparkContext.broadcast((plan, below))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, below = shipped.value
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            sequence, offset = plan.places(length, batch.column(batch.num_columns - 1).to_numpy() - below[length])
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=[*kept, "sequence_id", "offset"])

    schema = ", ".join(f"`{c}` {pieces.schema[c].dataType.simpleString()}" for c in kept)
    return numbered.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids, sequence_id, offset of each piece of each document; see
    token_pieces for what documents become and for odd rows.  No documents give no pieces."""
    return packed(materialise(token_pieces(docs, path, capacity, end_id, id_col, text_col), "pieces"), capacity)


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id, ids (of all its pieces), segments (for each id the number of its piece there), a row
    a sequence; a group has `capacity` ids at most."""
    whole = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "length", "ids"))).alias("parts"))
    segments = F.flatten(F.transform("parts", lambda p, i: F.array_repeat(i, p["length"].cast("int"))))
    return whole.select("sequence_id", F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), "").alias("hex"), segments.alias("segments")).select("sequence_id", F.unhex("hex").alias("ids"), "segments")


def op12_packing(spark, sf_dir: str) -> DataFrame:
    pieces = materialise(token_pieces(table(spark, sf_dir, "documents")), "pieces")
    # ids stay behind: what the result shows of them is their checksum
    narrow = materialise(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "row"), "narrow")
    return packed(narrow).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
