"""Conversation structure repair by composing weighted finite-state machines.

A conversation's turns are an input acceptor, one arc a turn.  An edit transducer keeps, reroles or
deletes a turn or inserts an empty one, each at a cost, and writes the role's initial.  An acceptor of
the role grammar `(s?(ua)+)?` reads those initials.  The composition of the three isn't built: its
states are pairs of a turn and a state of the grammar, and only those a path leads to are made, turn
by turn, which is a topological order.  A path's weight is its cost and then its label string, and
the least path is wanted.

Of the paths to a state only the least is kept.  Two paths that have taken the same turns never are
one the other's beginning unless the longer one has inserted more and so costs more; so among paths
of one cost the order of the labels so far is final, and a rank stands for the string.  States whose
cost is more than SLACK above the least can't end in the least path (insertions lead from any state
to where another one's paths go on) and are dropped.

Turns are sorted and streamed; an edit is passed on as soon as all paths agree on it, so a task holds
the turns on which they differ and 16 bytes for each earlier turn of the conversation, which tell duplicates."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, table

#: The grammar's arcs: from a state by an initial to a state; the states are named by what was read last.
GRAMMAR = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
FINAL = ("", "a")
ROLES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
KEEP, REROLE, DELETE, INSERT = "KRDI"
COST = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
#: What keeping or reroling a truncated turn costs besides.
TRUNCATED = 5
#: Two insertions lead from any state to any that others' paths go on from; a kept system turn is deleted instead.
INSERTIONS, SLACK = 2, 12
#: Undecided edits after which it is looked for what all paths agree on.
UNDECIDED = 256
WHITE = " \t\n\x0b\x0c\r"
EDIT = "conv_id long, n long, edit string, turn long, role string, text string, was string, fault string"
SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class _Edit:
    __slots__ = ("back", "edit", "role", "turn")

    def __init__(self, back: _Edit | None, edit: str, role: str, turn: tuple | None) -> None:
        self.back, self.edit, self.role, self.turn = back, edit, role, turn


class _Path:
    __slots__ = ("cost", "rank", "last")

    def __init__(self, cost: int, rank: int, last: _Edit | None) -> None:
        self.cost, self.rank, self.last = cost, rank, last


def arcs(role: str, fault: str | None) -> Iterator[tuple[str, str | None, str, int]]:
    """The edit transducer's arcs for a turn: label, initial written, role, cost."""
    if fault not in ("blank", "duplicate"):
        more = TRUNCATED if fault == "truncated" else 0
        if role:
            yield KEEP, role[0], role, COST[KEEP] + more
        for initial, name in ROLES.items():
            yield REROLE, initial, name, COST[REROLE] + more
    yield DELETE, None, role, COST[DELETE]


def _inserted(state: str, times: int) -> list[tuple[str, str]]:
    """The states and roles of so many insertions in a row; the grammar allows one initial at each."""
    out = []
    for _ in range(times):
        initial = next(x for x in ROLES if x in GRAMMAR[state])
        state = GRAMMAR[state][initial]
        out.append((state, ROLES[initial]))
    return out


#: By state and number of insertions: the state then and the roles inserted.
REACHED = {(s, k): ((_inserted(s, k) or [(s, "")])[-1][0], [r for _, r in _inserted(s, k)]) for s in GRAMMAR for k in range(INSERTIONS + 1)}


def cheapest_edits(turns: Iterator[tuple]) -> Iterator[tuple[str, str, tuple | None]]:
    """(edit, role, turn) in order for the turns (role, fault, ...) of one conversation: the least path."""
    paths = {"": _Path(0, 0, None)}
    undecided = 0

    def extended(path: _Path, state: str, k: int) -> _Edit | None:
        last = path.last
        for role in REACHED[state, k][1]:
            last = _Edit(last, INSERT, role, None)
        return last

    for turn in turns:
        least = min(p.cost for p in paths.values())
        found: dict[str, tuple] = {}
        for state, path in paths.items():
            for k in range(INSERTIONS + 1):
                cost = path.cost + k * COST[INSERT]
                if cost > least + SLACK:
                    break
                now = REACHED[state, k][0]
                for label, initial, role, more in arcs(turn[0], turn[1]):
                    # an insertion in front of a deletion is one behind it with a greater label string
                    to = (now if not k else None) if initial is None else GRAMMAR[now].get(initial)
                    if to is not None:
                        weight = (cost + more, path.rank, INSERT * k + label)
                        if to not in found or weight < found[to][0]:
                            found[to] = (weight, state, k, label, role)
        order = {to: r for r, to in enumerate(sorted(found, key=lambda x: found[x][0][1:]))}
        paths = {to: _Path(w[0], order[to], _Edit(extended(paths[state], state, k), label, role, turn)) for to, (w, state, k, label, role) in found.items()}
        undecided += 1
        if undecided >= UNDECIDED:
            done, undecided = _agreed([p.last for p in paths.values()])
            yield from done
    ends = [((p.cost + k * COST[INSERT], p.rank, INSERT * k), s, k) for s, p in paths.items() for k in range(INSERTIONS + 1) if REACHED[s, k][0] in FINAL]
    _, state, k = min(ends)
    yield from _listed(extended(paths[state], state, k))


def _listed(last: _Edit | None) -> list[tuple[str, str, tuple | None]]:
    out = []
    while last is not None:
        out.append((last.edit, last.role, last.turn))
        last = last.back
    return out[::-1]


def _agreed(ends: list[_Edit]) -> tuple[list[tuple[str, str, tuple | None]], int]:
    """What all paths begin with, which is cut off them, and how much is left of the longest; if little
    is agreed the next look is later."""
    chains = []
    for last in ends:
        chain = []
        while last is not None:
            chain.append(last)
            last = last.back
        chains.append(chain[::-1])
    n = 0
    while all(len(c) > n for c in chains) and all(c[n] is chains[0][n] for c in chains):
        n += 1
    if not n:
        return [], -max(map(len, chains))
    done = _listed(chains[0][n - 1])
    for c in chains:
        if len(c) > n:
            c[n].back = None
    if any(len(c) == n for c in chains):
        # a path that ends here needs a last edit: the agreed one stays
        chains[0][n - 1].back = None
        return done[:-1], max(map(len, chains)) - n + 1
    return done, max(map(len, chains)) - n


def judged(turns: Iterator[tuple]) -> Iterator[tuple]:
    """(role, fault, turn, text) of the turns (turn, role, text) of one conversation; the first fault counts."""
    seen: set[bytes] = set()
    for turn, role, text in turns:
        body = text.rstrip(WHITE)
        key = hashlib.blake2b(b"%d:%s%s" % (len(role), role.encode(), text.encode()), digest_size=16).digest()
        if not body:
            fault = "blank"
        elif key in seen:
            fault = "duplicate"
        else:
            fault = None if body[-1] in ".!?" else "truncated"
        seen.add(key)
        yield role, fault, turn, text


def _by_conversation(rows: Iterator[tuple]) -> Iterator[tuple[int | None, Iterator[tuple]]]:
    """Neighbouring rows with the same first value, streamed: (value, its rows without it)."""
    rows = iter(rows)
    held = next(rows, None)
    while held is not None:
        key = held[0]

        def own() -> Iterator[tuple]:
            nonlocal held
            while held is not None and held[0] == key:  # noqa: B023
                yield held[1:]
                held = next(rows, None)

        part = own()
        yield key, part
        for _ in part:
            pass


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096, limit: int = 4 << 20, text: int | None = None) -> Iterator[pa.RecordBatch]:
    held, weight = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    for row in rows:
        held.append(row)
        weight += len(row[text] or "") if text is not None else 0
        if len(held) >= size or weight >= limit:
            yield batch()
            held, weight = [], 0
    if held:
        yield batch()


def _schema(kinds: str) -> pa.Schema:
    types = {"long": pa.int64(), "string": pa.large_string()}
    return pa.schema([(name, types[kind]) for name, kind in (x.split() for x in kinds.split(", "))])


def _mapped(df: DataFrame, function: Callable[[Iterator[tuple]], Iterator[tuple]], kinds: str, text: int | None = None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _schema(kinds).remove_metadata()
        schema = pa.schema([(f.name, pa.string() if pa.types.is_large_string(f.type) else f.type) for f in schema])
        yield from _batches(function(_rows(batches)), schema, text=text)

    return df.mapInArrow(run, kinds)


def repair_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each edit of each conversation, a conversation's rows in order in one partition:
    conv_id, n (from 0), edit (K, R, D or I), turn, role and text after it (of a deleted turn as they
    were), was (the role before; null where inserted), fault.

    Turns are taken by turn, nulls first, those of one turn by role and text; a null role or text is
    one space; rows without a conv_id are one conversation.  A turn's first fault counts: blank, duplicate (role and text came
    earlier), truncated (the last character but white space is none of `.!?`).  A turn with an empty
    role can't be kept as it is.  No rows give no rows; other columns aren't read."""
    def some(c: str):
        return F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias

    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), some(role_col)("role"), some(text_col)("text"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    dealt = rows.repartition(shuffle_partitions(turns.sparkSession), "conv_id").sortWithinPartitions(*order)

    def edits(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv, own in _by_conversation(rows):
            for n, (edit, role, turn) in enumerate(cheapest_edits(judged(own))):
                was, fault, number, text = turn or (None, None, None, "")
                yield conv, n, edit, number, role, text, was, fault

    return _mapped(dealt, edits, EDIT, text=5)


def summaries(edits: DataFrame) -> DataFrame:
    """A row for each conversation of what repair_turns returned (as it returned it, in its partitions
    and order): gaps in the numbers of turns, faults, neighbours whose roles' initials aren't su, ua or
    au, the edits' cost and labels, and the SHA-256 of what is left, `role:text` joined by new lines."""

    def told(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv, own in _by_conversation(rows):
            low = high = number = before = None
            distinct = illegal = cost = 0
            faults = {"blank": 0, "duplicate": 0, "truncated": 0}
            labels, digest, first = [], hashlib.sha256(), True
            for _, edit, turn, role, text, was, fault in own:
                labels.append(edit)
                cost += COST[edit] + (TRUNCATED if fault == "truncated" and edit != DELETE else 0)
                if edit != INSERT:
                    if fault:
                        faults[fault] += 1
                    illegal += before is not None and before[:1] + was[:1] not in LEGAL
                    before = was
                    if turn is not None:
                        low, high = turn if low is None else low, turn
                        distinct += turn != number  # turns rise
                        number = turn
                if edit != DELETE:
                    digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                    first = False
            gaps = high - low + 1 - distinct if distinct else 0
            yield conv, gaps, *faults.values(), illegal, cost, "".join(labels), digest.hexdigest()

    return _mapped(edits.select(*[x.split()[0] for x in EDIT.split(", ")]), told, SUMMARY)


def damaged(conversations: DataFrame) -> DataFrame:
    """`conversations` with faults made by crc32 of `conv_id:turn` modulo 20 (nulls are one space): 0
    drops the turn, 1 empties its text, 2 removes `.!?` from it, 3 repeats it, 4 makes its role user."""
    some = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    dice = F.crc32(F.concat(some["conv_id"], F.lit(":"), some["turn"]).cast("binary")) % 20
    text = F.when(F.col("_dice") == 1, "").when(F.col("_dice") == 2, F.regexp_replace(some["text"], "[.!?]", "")).otherwise(some["text"])
    times = F.when(F.col("_dice") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("_dice", dice).where("_dice != 0")
    return rows.select("conv_id", "turn", F.when(F.col("_dice") == 4, "user").otherwise(some["role"]).alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    found = summaries(repair_turns(damaged(conversations)))
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    joined = every.join(found.withColumnRenamed("conv_id", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256(b"").hexdigest()
    return joined.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
