"""Sinks of outside systems: webhooks, topics, bulk APIs and search indexes (OP-SNK-5..9).

Requests are built and sent inside tasks by a transport that the caller gives, a function of a
Request that returns a Response; it must be picklable.  Requests of one part go one after the
other and stop at the first that isn't accepted, so a document's records keep their order.  A
ledger has the last accepted request of each part: a retry of the batch sends the serialised requests behind
it alone.  A transport's errors are graded where they arise, so Spark doesn't run a task again for
them; a task that an executor's loss repeats sends its part again, and receivers know records by
their idempotency keys or ids."""

from __future__ import annotations

import gzip
import json
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import message_id, webhook_signatures
from ..storage import discard, materialise
from . import payloads
from .dispatch import Batch

#: Outcomes from best to worst.
OUTCOMES = ("success", "retryable", "permanent")


@dataclass(frozen=True)
class Request:
    method: str
    url: str
    body: bytes = b""
    headers: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Response:
    status: int
    body: bytes = b""

    def json(self) -> dict:
        return json.loads(self.body or b"{}")


Transport = Callable[[Request], Response]


def grade(status: int) -> int:
    """Below 300 is success; 408, 429 and 5xx can be retried; anything else, redirects too, is permanent."""
    return 0 if 200 <= status < 300 else 1 if status in (408, 429) or status >= 500 else 2


def sent(transport: Transport, request: Request) -> tuple[int, Response | None]:
    """The outcome of a request; one that times out, or finds or keeps no connection, can be retried, any other
    error can't."""
    try:
        response = transport(request)
    except OSError:  # what sockets raise, time-outs and refused connections among it
        return 1, None
    except Exception:  # noqa: BLE001
        return 2, None
    return grade(response.status), response


class RemoteSink:
    """What the sinks below share: rows in order within their part, an outcome for each row."""

    name: str

    def frames(self, records: DataFrame) -> DataFrame:
        """Rows with `part` and `step`, in the order in which a part is sent."""
        raise NotImplementedError

    def phases(self, rows: DataFrame) -> list[DataFrame]:
        """The rows that are sent together; those of a later phase wait for all of the earlier ones."""
        return [rows]

    def send(self, row: dict) -> int:
        """Send one row's request; an index of OUTCOMES."""
        raise NotImplementedError

    def __getstate__(self) -> dict:
        # what tasks get: not the ledger, which is the driver's
        return {k: v for k, v in self.__dict__.items() if k != "_ledger"}

    def deliver(self, records: DataFrame, batch: Batch | int) -> str:
        send, batch = self.send, Batch.of(batch)
        ledger: dict[str, tuple[Batch, DataFrame, dict]] = self.__dict__.setdefault("_ledger", {})
        kept = ledger.pop(batch.scope, None)
        if kept and kept[0] == batch:
            _, rows, done = kept
        else:
            if kept:
                discard(kept[1])
            # everything is serialised before the first request
            rows, done = materialise(self.frames(records), "requests"), {}

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            outcome: dict = {}
            place: dict = {}
            accepted: dict = {}
            for pdf in frames:
                for row in pdf.to_dict("records"):
                    part = row["part"]
                    place[part] = place.get(part, 0) + 1
                    if outcome.get(part) or place[part] <= done.get(part, 0):
                        continue
                    outcome[part] = send(row)
                    if not outcome[part]:
                        accepted[part] = place[part]
            parts = list(outcome)
            yield pd.DataFrame({"part": parts, "outcome": [outcome[p] for p in parts], "accepted": [accepted.get(p, done.get(p, 0)) for p in parts]}, dtype="int64")

        worst = 2
        try:
            for phase in self.phases(rows):
                # all of a phase's requests are over before the next one's begin
                dealt = phase.repartition("part").sortWithinPartitions("part", "step")
                told = dealt.mapInPandas(run, "part long, outcome long, accepted long").collect()  # a row for each part
                done = done | {r["part"]: r["accepted"] for r in told}
                worst = max((r["outcome"] for r in told), default=0)
                if worst:
                    break
        finally:
            if OUTCOMES[worst] == "retryable":
                ledger[batch.scope] = (batch, rows, done)
            else:
                discard(rows)
        return OUTCOMES[worst]


@dataclass
class HttpSink(RemoteSink):
    """Signed webhooks: an envelope of at most `per_request` records in commit order.

    The body is signed as it is and compressed afterwards; the id of a request follows from its
    records, so a repeat has the same."""

    name: str
    url: str
    transport: Transport
    secrets: tuple[str, ...] = ()
    per_request: int = 500
    annotations: dict[str, str] | None = None
    compress: bool = False
    parts: int | None = None
    clock: Callable[[], float] = time.time

    def frames(self, records: DataFrame) -> DataFrame:
        return payloads.http_requests(records, self.name, self.per_request, self.annotations, self.parts).withColumnRenamed("request", "step")

    def send(self, row: dict) -> int:
        body = row["body"].encode()
        ident, now = message_id(self.name, list(row["keys"])), int(self.clock())
        headers = {"content-type": "application/json", "webhook-id": ident, "webhook-timestamp": str(now)}
        if self.secrets:
            headers["webhook-signature"] = webhook_signatures(list(self.secrets), ident, now, body)
        if self.compress:
            headers["content-encoding"], body = "gzip", gzip.compress(body, mtime=0)
        return sent(self.transport, Request("POST", self.url, body, headers))[0]


#: Kafka's public errors that a later attempt may not meet, and those of sockets below it.
RETRYABLE_ERRORS = (
    "BrokerNotAvailableException", "ConnectException", "CoordinatorLoadInProgressException", "CoordinatorNotAvailableException", "CorruptRecordException", "DisconnectException",
    "KafkaStorageException", "LeaderNotAvailableException", "NetworkException", "NotCoordinatorException", "NotEnoughReplicasAfterAppendException", "NotEnoughReplicasException",
    "NotLeaderOrFollowerException", "SocketTimeoutException", "TimeoutException", "UnknownTopicOrPartitionException",
)


def retryable(error: BaseException) -> bool:
    """Whether an error of Spark's writer has one of these as a cause; of a failed task's only the text is left."""
    seen = str(error)
    cause = getattr(error, "java_exception", None)
    while cause is not None:
        seen += f"\n{cause.getClass().getName()}: "
        cause = cause.getCause()
    return isinstance(error, (TimeoutError, ConnectionError)) or any(re.search(rf"\b[\w.$]*{name}\b", seen) for name in RETRYABLE_ERRORS)


@dataclass
class KafkaSink:
    """Topics through Spark's own Kafka writer, or the writer that the caller gives; a deletion is
    a record without a value."""

    name: str
    servers: str = ""
    writer: Callable[[DataFrame], None] | None = None
    annotations: dict[str, str] | None = None

    def deliver(self, records: DataFrame, batch: Batch | int) -> str:
        rows = materialise(payloads.kafka_records(records, self.annotations), "topic_records")
        try:
            if self.writer:
                self.writer(rows)
            else:
                options = {"kafka.bootstrap.servers": self.servers, "includeHeaders": "true", "kafka.acks": "all", "kafka.enable.idempotence": "true"}
                rows.write.format("kafka").options(**options).save()
        except Exception as e:
            if retryable(e):
                return "retryable"
            raise
        finally:
            discard(rows)
        return "success"


@dataclass
class BulkSink(RemoteSink):
    """The bulk API that two search engines share: at most `per_request` documents a request, each
    item graded by itself; a delete of what isn't there is fine."""

    name: str
    url: str
    transport: Transport
    per_request: int = 500

    def frames(self, records: DataFrame) -> DataFrame:
        return payloads.chunked(payloads.bulk_lines(records), self.per_request, F.concat_ws("", F.transform("rows", lambda r: r["lines"])).alias("body"))

    def send(self, row: dict) -> int:
        outcome, response = sent(self.transport, Request("POST", f"{self.url}/_bulk", row["body"].encode(), {"content-type": "application/x-ndjson"}))
        if outcome:
            return outcome
        items = [(op, item) for entry in response.json().get("items", []) for op, item in entry.items()]
        return max((0 if op == "delete" and item["status"] == 404 else grade(item["status"]) for op, item in items), default=0)

    def purge(self, destination: str) -> None:
        body = json.dumps({"query": {"match_all": {}}}).encode()
        outcome, response = sent(self.transport, Request("POST", f"{self.url}/{destination}/_delete_by_query?conflicts=proceed&refresh=true", body, {"content-type": "application/json"}))
        if outcome and not (response and response.status == 404):
            raise RuntimeError(f"{self.name}: {destination} wasn't emptied")


@dataclass
class IndexSink(RemoteSink):
    """A search index that works off tasks: all upserts are sent, by many tasks for an index, before all deletes, and
    every task is waited for.  The id is encoded for the index and stamped into the document as
    `key`; `attributes` must be in every document.  A delete in an index that isn't there is fine."""

    name: str
    url: str
    transport: Transport
    key: str = "id"
    attributes: tuple[str, ...] = ()
    per_request: int = 500
    #: Parts of an index, which tasks send side by side; by default as many as Spark has shuffle partitions.
    parts: int | None = None
    polls: int = 200
    poll_seconds: float = 0.05

    def frames(self, records: DataFrame) -> DataFrame:
        return payloads.index_requests(records, self.per_request, self.parts)

    def phases(self, rows: DataFrame) -> list[DataFrame]:
        return [rows.where("not deletion"), rows.where("deletion")]

    def send(self, row: dict) -> int:
        base = f"{self.url}/indexes/{row['index']}/documents"
        if row["deletion"]:
            request = Request("POST", f"{base}/delete-batch", json.dumps(list(row["ids"])).encode(), {"content-type": "application/json"})
        else:
            documents = []
            for ident, text in zip(row["ids"], row["documents"], strict=True):
                document = json.loads(text)
                if missing := [a for a in self.attributes if not payloads.has_attribute(document, a)]:
                    raise ValueError(f"{row['index']}: document {ident} has no {', '.join(missing)}")
                documents.append(document | {self.key: ident})
            request = Request("POST", f"{base}?primaryKey={self.key}", json.dumps(documents, ensure_ascii=False).encode(), {"content-type": "application/json"})
        outcome, response = sent(self.transport, request)
        return outcome or self._waited(response.json().get("taskUid"), bool(row["deletion"]))

    def _waited(self, task: int | None, deletion: bool) -> int:
        if task is None:
            return 0
        for _ in range(self.polls):
            outcome, response = sent(self.transport, Request("GET", f"{self.url}/tasks/{task}"))
            if outcome:
                return outcome
            state = response.json()
            if state.get("status") == "succeeded":
                return 0
            if state.get("status") in ("failed", "canceled"):
                return 0 if deletion and state.get("error", {}).get("code") == "index_not_found" else 2
            time.sleep(self.poll_seconds)
        return 1

    def purge(self, destination: str) -> None:
        outcome, response = sent(self.transport, Request("DELETE", f"{self.url}/indexes/{destination}/documents"))
        if (outcome and not (response and response.status == 404)) or (not outcome and self._waited(response.json().get("taskUid"), True)):
            raise RuntimeError(f"{self.name}: {destination} wasn't emptied")
