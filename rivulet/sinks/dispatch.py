"""Delivery: sinks side by side, retries with backoff, outcomes (OP-SNK-1..4, OP-SNK-14)."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Options


@dataclass(frozen=True)
class Batch:
    """What a delivery is: whose (the live stream, a table's backfill), in which run of it, and
    its number there.  Numbers rise within a run; a new run of a scope starts its own."""

    number: int
    scope: str = "live"
    run: str = ""

    @classmethod
    def of(cls, batch: Batch | int) -> Batch:
        return batch if isinstance(batch, Batch) else cls(batch)


class Sink(Protocol):
    """Optional: open() before the first delivery, close() after the last, purge(destination)."""

    name: str

    def deliver(self, records: DataFrame, batch: Batch) -> str:
        """success, retryable or permanent; an exception is permanent.  Deliveries of one sink
        never overlap."""


class DelegateSink:
    def __init__(self, name: str, handler: Callable[[DataFrame, int], str | None]) -> None:
        self.name, self.handler = name, handler

    def deliver(self, records: DataFrame, batch: Batch) -> str:
        return self.handler(records, Batch.of(batch).number) or "success"


class CaptureSink:
    """Keeps every record on the driver, for tests."""

    def __init__(self, name: str) -> None:
        self.name, self.records, self.batches = name, [], []

    def deliver(self, records: DataFrame, batch: Batch) -> str:
        self.records += [r.asDict() for r in records.orderBy("commit_lsn", "commit_idx").collect()]
        self.batches.append(Batch.of(batch).number)
        return "success"

    def latest(self) -> dict:
        out: dict = {}
        for r in self.records:
            out[(r["destination"], r["document_id"])] = r
        return {k: r["document"] for k, r in out.items() if not r["is_deletion"]}

    def purge(self, destination: str | None = None) -> None:
        self.records = [r for r in self.records if destination and r["destination"] != destination]


class DeliveryError(RuntimeError):
    """At least one sink didn't accept the batch; the batch isn't acknowledged."""


def _one(sink: Sink, records: DataFrame, batch: Batch, options: Options, sleep: Callable[[float], None]) -> str:
    for attempt in range(options.retry_attempts + 1):
        outcome = sink.deliver(records, batch)
        if outcome != "retryable":
            return outcome
        if attempt < options.retry_attempts:
            sleep(min(options.retry_base_seconds * 2**attempt, options.retry_max_seconds) * random.uniform(0.8, 1.2))
    return "retryable"


def dispatch(records: DataFrame, sinks: list[Sink], batch: Batch | int, options: Options | None = None, sleep: Callable[[float], None] = time.sleep) -> dict[str, str]:
    """Every sink gets its own records; all are waited for before a failure is raised."""
    options, batch = options or Options(), Batch.of(batch)
    done: dict[str, str] = {}
    errors: list[BaseException] = []
    with ThreadPoolExecutor(max(1, len(sinks))) as pool:
        jobs = {s.name: pool.submit(_one, s, records.where(F.col("sink") == s.name), batch, options, sleep) for s in sinks}
        for name, job in jobs.items():
            try:
                done[name] = job.result()
            except Exception as e:  # noqa: BLE001
                done[name] = "permanent"
                errors.append(e)
    if failed := {n: o for n, o in done.items() if o != "success"}:
        raise DeliveryError(f"batch {batch.number} of {batch.scope} not accepted: {failed}") from (errors[0] if errors else None)
    return done
