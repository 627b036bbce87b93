"""Control plane: state tables and the rules over them (OP-CTL-*, OP-BF-3..9)."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..storage import Files, Versions

VERSION = 2


def gap(checkpoint: Column, consistent: Column, recreated: Column) -> Column:
    """Whether the log has a hole: the checkpoint is before what is still there; or the slot was
    made anew and the checkpoint is behind it or unknown."""
    return (
        F.when(checkpoint.isNotNull() & (checkpoint < consistent), "gap").when(recreated & checkpoint.isNull(), "gap").when(recreated & (checkpoint > consistent), "rewind_gap").otherwise("none")
    )


def health(faulted: Column, leader_failures: Column, role: Column, fanout_failures: Column, backfill_failures: Column, thresholds: tuple[int, int, int] = (3, 3, 3)) -> Column:
    """First match wins; a threshold of 0 switches its test off."""
    crash, fanout, backfill = thresholds
    over = lambda c, t: F.lit(t > 0) & (c >= t)
    return (
        F.when(faulted | over(leader_failures, crash), "unhealthy")
        .when((role == "suspended") | over(fanout_failures, fanout) | over(backfill_failures, backfill), "degraded")
        .otherwise("healthy")
    )


def control_step(state: str, origin: str | None, flag: bool, heartbeat_age: float | None = None, grace: float = 60.0) -> tuple[str, str | None, str]:
    """(state, origin, action) after a node looks at the control row.

    A node whose configuration asks for suspension requests it if running; a node without the
    flag resumes a suspension of configuration's once its last assertion is older than the
    grace; a client's suspension is never resumed by configuration."""
    if flag and state == "running":
        state, origin = "suspend_requested", "configuration"
    elif not flag and state != "running" and origin == "configuration" and (heartbeat_age is None or heartbeat_age >= grace):
        state, origin = "running", None
    return state, origin, {"suspend_requested": "finalize", "suspended": "idle"}.get(state, "proceed")


def control_column(state: Column, origin: Column, flag: Column, age: Column, grace: float = 60.0) -> Column:
    """control_step over a column of rows: the action."""
    lifted = ~flag & (state != "running") & (origin == "configuration") & (F.coalesce(age, F.lit(grace)) >= grace)
    after = F.when(flag & (state == "running"), "suspend_requested").when(F.coalesce(lifted, F.lit(False)), "running").otherwise(state)
    return F.when(after == "suspend_requested", "finalize").when(after == "suspended", "idle").otherwise("proceed")


@dataclass
class StateStore:
    """Small state tables, each a versioned JSON value.  Every change is a function of the rows as
    they are, applied anew if another writer came first.  A newer layout is refused."""

    spark: SparkSession
    path: str

    def __post_init__(self) -> None:
        self.files = Files(self.spark)
        found = json.loads(self.files.read(f"{self.path}/VERSION") or "0")
        if found > VERSION:
            raise RuntimeError(f"state has layout {found}, this build knows {VERSION}")
        if found < VERSION:
            self.files.write(f"{self.path}/VERSION", json.dumps(VERSION))

    def _versions(self, name: str) -> Versions:
        return Versions(self.files, f"{self.path}/{name}")

    def load(self, name: str) -> dict[str, dict]:
        rows = self._versions(name).load()[1]
        # tables of the first layout are one file each until they change
        return rows if rows is not None else json.loads(self.files.read(f"{self.path}/{name}.json") or "{}")

    def update(self, name: str, change: Callable[[dict[str, dict]], object]) -> object:
        """Let `change` edit the rows; what it returns is returned, and False leaves them as they are."""
        answer: list[object] = []

        def apply(rows: dict | None) -> dict | None:
            rows = rows if rows is not None else json.loads(self.files.read(f"{self.path}/{name}.json") or "{}")
            answer[:] = [change(rows)]
            return None if answer[0] is False else rows

        self._versions(name).update(apply)
        return answer[0]

    def save(self, name: str, rows: dict[str, dict]) -> None:
        def change(now: dict[str, dict]) -> None:
            now.clear()
            now.update(rows)

        self.update(name, change)

    def request_backfill(self, table: str, purge: bool = False) -> None:
        def change(rows: dict[str, dict]) -> None:
            row = rows.setdefault(table, {"status": None, "purge": False})
            rows[table] = row | {"status": "requested", "purge": row.get("purge", False) or purge, "cursor": None, "attempts": 0, "next_attempt_at": 0}

        self.update("backfill", change)

    def cancel_backfill(self, table: str) -> bool:
        def change(rows: dict[str, dict]) -> bool:
            if rows.get(table, {}).get("status") != "requested":
                return False
            rows[table]["status"] = "cancelled"
            return True

        return self.update("backfill", change)

    def save_progress(self, table: str, cursor: object, rows_copied: int, **more) -> bool:
        """A progress write loses to a request that came meanwhile."""

        def change(rows: dict[str, dict]) -> bool:
            if rows.get(table, {}).get("status") != "in_progress":
                return False
            rows[table] |= {"cursor": cursor, "rows_copied": rows_copied} | more
            return True

        return self.update("backfill", change)

    def enqueue_fanout(self, lookup_hash: str, job: dict) -> None:
        """Equal sets of lookups are one job; a new trigger resets its attempts."""

        def change(rows: dict[str, dict]) -> None:
            rows[lookup_hash] = job | {"status": "requested", "attempts": 0, "cursor": None}

        self.update("fanout", change)


def encode_cursor(key: list[str], values: list, batch: int | None = None) -> str:
    return json.dumps({"v": 1} | ({"b": batch} if batch is not None else {}) | {"pk": key, "cur": values})


def decode_cursor(text: str | None, key: list[str]) -> list | None:
    """The cursor's values, or None (start anew) where anything about it doesn't fit."""
    try:
        c = json.loads(text or "")
        fits = c["v"] == 1 and c["pk"] == key and isinstance(c["cur"], list) and len(c["cur"]) == len(key)
        return c["cur"] if fits else None
    except (ValueError, KeyError, TypeError):
        return None


def encode_ranges(key: list[str], ranges: list[list[str]], done: int, after: list | None = None) -> str:
    """A cursor over ranges: their upper bounds, how many are done, and the key they begin behind."""
    return json.dumps({"v": 2, "pk": key, "ranges": ranges, "done": done, "after": after})


def decode_ranges(text: str | None, key: list[str]) -> dict | None:
    """ranges, done and after of a cursor; an old one, of a key alone, has no ranges yet; None (start anew)
    where anything about it doesn't fit."""
    if (old := decode_cursor(text, key)) is not None:
        return {"ranges": None, "done": 0, "after": old}
    try:
        c = json.loads(text or "")
        fits = c["v"] == 2 and c["pk"] == key and 0 <= c["done"] <= len(c["ranges"]) + 1 and all(len(r) == len(key) for r in [*c["ranges"], *([c["after"]] if c["after"] else [])])
        return {k: c[k] for k in ("ranges", "done", "after")} if fits else None
    except (ValueError, KeyError, TypeError):
        return None


class ControlClient:
    """Suspending, resuming and waiting over the control row of a state store.

    A client's suspension is resumed by a client only; while anything but running, publications
    aren't widened.  stop() is called between request and suspension, so that a state of
    suspended means that nothing runs."""

    def __init__(self, state: StateStore, clock=None) -> None:
        import time

        self.state, self.clock = state, clock or time.time

    RUNNING = {"state": "running", "origin": None, "asserted_at": None, "widened": False}

    def row(self) -> dict:
        return self.state.load("control").get("row", dict(self.RUNNING))

    def _change(self, change: Callable[[dict], dict | None]) -> dict:
        """The row after `change` (None leaves it), which sees it as it is when it is written."""

        def apply(rows: dict[str, dict]) -> dict:
            row = rows.get("row", dict(self.RUNNING))
            rows["row"] = row | (change(row) or {})
            return rows["row"]

        return self.state.update("control", apply)

    def suspend(self, origin: str = "client", reason: str | None = None) -> dict:
        asked = {"state": "suspend_requested", "origin": origin, "reason": reason, "asserted_at": self.clock()}
        return self._change(lambda row: asked if row["state"] == "running" else None)

    def finalise(self, stop) -> dict:
        """Stop the queries first, then mark the row."""
        if self.row()["state"] != "suspend_requested":
            return self.row()
        stop()
        return self._change(lambda row: {"state": "suspended"} if row["state"] == "suspend_requested" else None)

    def resume(self) -> dict:
        return self._change(lambda row: {"state": "running", "origin": None, "reason": None, "asserted_at": None})

    def gate(self, flag: bool, grace: float = 60.0) -> str:
        """What a node does now; keeps configuration's assertion fresh or lifts it."""

        def look(row: dict) -> tuple[str, str | None, str]:
            age = None if row.get("asserted_at") is None else self.clock() - row["asserted_at"]
            return control_step(row["state"], row["origin"], flag, age, grace)

        def change(row: dict) -> dict | None:
            state, origin, _ = look(row)
            if flag and origin == "configuration":
                return {"state": state, "origin": origin, "asserted_at": self.clock()}
            return {"state": state, "origin": origin, "asserted_at": None} if (state, origin) != (row["state"], row["origin"]) else None

        row = self.row()
        if change(row) is not None:
            row = self._change(change)
        return look(row)[2]

    def widen(self, on: bool = True) -> dict:
        """Switch column selection off (or on again); only while running."""

        def change(row: dict) -> dict:
            if row["state"] != "running":
                raise RuntimeError("publications are widened only while running")
            return {"widened": on}

        return self._change(change)

    def status(self) -> list[dict]:
        """The control row, each table's backfill and the queued scopes, one row each."""
        out = [{"kind": "control", "name": "engine"} | {k: self.row().get(k) for k in ("state", "origin", "widened")}]
        for name, row in sorted(self.state.load("backfill").items()):
            out.append({"kind": "backfill", "name": name, "state": row.get("status"), "rows_copied": row.get("rows_copied", 0), "attempts": row.get("attempts", 0), "last_error": row.get("last_error")})
        for name, job in sorted(self.state.load("fanout").items()):
            out.append({"kind": "fanout", "name": name, "state": job.get("status"), "table": job.get("table"), "attempts": job.get("attempts", 0), "last_error": job.get("last_error")})
        return out

    def wait(self, done, timeout: float, poll: float = 0.5, sleep=None) -> dict:
        """Until done(row); an error with the last row after `timeout` seconds."""
        import time

        end = self.clock() + timeout
        while not done(row := self.row()):
            if self.clock() >= end:
                raise TimeoutError(f"still {row} after {timeout} s")
            (sleep or time.sleep)(poll)
        return row


class Throttled:
    """A checkpoint that is written at most once in `every` seconds; the first save writes, and one
    that fails counts for nothing."""

    def __init__(self, save: Callable[[int], None], every: float = 5.0, clock=None) -> None:
        import time

        self.write, self.every, self.clock, self.last = save, every, clock or time.monotonic, None

    def save(self, position: int) -> bool:
        now = self.clock()
        if self.last is not None and now - self.last < self.every:
            return False
        self.write(position)
        self.last = now
        return True
