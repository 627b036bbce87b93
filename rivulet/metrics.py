"""What the engine does, in numbers (OP-AGG-8): DataFrames over a log, metrics that come along
with the engine's own jobs, and a streaming listener."""

from __future__ import annotations

import json
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

#: Upper edges of a histogram's buckets in seconds; the last bucket has none.
EDGES = (0.01, 0.05, 0.1, 0.5, 1.0, 5.0, 10.0, 30.0, 60.0, 300.0, 1800.0, 3600.0, 86400.0)


def received(events: DataFrame) -> DataFrame:
    return events.groupBy("table", "action").agg(F.count(F.lit(1)).alias("changes_received"))


def lag(events: DataFrame, now) -> DataFrame:
    """Seconds from commit to receipt: median, 95th percentile and greatest."""
    seconds = (now.cast("timestamp").cast("double") - F.col("commit_ts").cast("timestamp").cast("double")).alias("s")
    p = F.percentile_approx("s", F.array(F.lit(0.5), F.lit(0.95)), 10_000)
    return events.where("commit_ts is not null").select(seconds).agg(p[0].alias("p50"), p[1].alias("p95"), F.max("s").alias("max"))


def delivered(records: DataFrame) -> DataFrame:
    return records.groupBy("sink").agg(F.count(F.lit(1)).alias("records_delivered"), F.count_if("is_deletion").alias("deletions"), F.count_if("is_backfill").alias("backfilled"))


@dataclass
class Histogram:
    """Counts of seconds by bucket, with their sum and greatest."""

    counts: list[int] = field(default_factory=lambda: [0] * (len(EDGES) + 1))
    total: float = 0.0
    greatest: float = 0.0

    @property
    def count(self) -> int:
        return sum(self.counts)

    def add(self, seconds: float) -> None:
        self.merge([int(i == bisect_left(EDGES, seconds)) for i in range(len(EDGES) + 1)], seconds, seconds)

    def merge(self, counts: Iterable[int], total: float, greatest: float) -> None:
        self.counts = [a + b for a, b in zip(self.counts, counts, strict=True)]
        self.total, self.greatest = self.total + total, max(self.greatest, greatest)

    def quantile(self, q: float) -> float:
        """The upper edge of the bucket that holds the quantile (the greatest value where that is less)."""
        reached, wanted = 0, q * self.count
        for edge, n in zip((*EDGES, float("inf")), self.counts, strict=True):
            reached += n
            if reached >= wanted and reached:
                return min(edge, self.greatest)
        return 0.0


class Observed:
    """Aggregates of a frame that come along with the one job that reads it.

    `over` marks the frame, `get` gives the values once that job is done.  Nulls count as 0."""

    def __init__(self) -> None:
        self._observation = Observation()

    def over(self, rows: DataFrame, *aggregates: Column) -> DataFrame:
        return rows.observe(self._observation, *aggregates)

    def get(self) -> dict[str, float]:
        return {k: v or 0 for k, v in self._observation.get.items()}


def lag_aggregates(now: Column) -> list[Column]:
    """Aggregates for lag_histogram; a commit of the future has no lag."""
    s = F.greatest(now.cast("timestamp").cast("double") - F.col("commit_ts").cast("timestamp").cast("double"), F.lit(0.0))
    edges = [None, *EDGES, None]
    buckets = [F.count_if((s > a if a is not None else F.lit(True)) & (s <= b if b is not None else F.lit(True)) & s.isNotNull() & F.col("commit_ts").isNotNull()).alias(f"lag_{i}") for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
    known = F.when(F.col("commit_ts").isNotNull(), s)
    return [*buckets, F.sum(known).alias("lag_total"), F.max(known).alias("lag_greatest")]


def lag_histogram(values: dict[str, float]) -> tuple[list[int], float, float]:
    return [values[f"lag_{i}"] for i in range(len(EDGES) + 1)], values["lag_total"], values["lag_greatest"]


class Counters(StreamingQueryListener):
    """Rows, seconds and positions of the micro-batches of all queries, without a job of its own."""

    def __init__(self) -> None:
        self.totals: dict = defaultdict(float)
        self.seconds: dict[str, Histogram] = defaultdict(Histogram)
        #: The position that a stream of positions has reached, and how far behind the newest one that is.
        self.gauges: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.totals["queries"] += 1

    def onQueryProgress(self, event) -> None:  # noqa: N802
        progress = event.progress
        self.totals["changes.received"] += progress.numInputRows
        self.totals["batches"] += 1
        for phase, ms in progress.durationMs.items():
            self.seconds[phase].add(ms / 1000)
        for source in progress.sources:
            end, newest = (_position(x) for x in (source.endOffset, source.latestOffset))
            if end is not None:
                self.gauges["log.position"] = end
                self.gauges["log.behind"] = max((end if newest is None else newest) - end, 0)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.totals["failures"] += bool(event.exception)


def _position(offset: str | None) -> int | None:
    """The position that an offset of a stream of positions names."""
    try:
        return int(json.loads(offset)["position"])
    except (TypeError, ValueError, KeyError):
        return None
