"""Keyed tables as sinks: merge with a no-op guard, hash-gated embedding (OP-SNK-10..13)."""

from __future__ import annotations

import json
import threading
import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import text_hash
from ..operators.collapse import last_wins
from ..storage import discard, materialise
from .dispatch import Batch
from .keyed_store import KeyedStore, overlapping


def merged(current: DataFrame, batch: DataFrame, columns: list[str]) -> DataFrame:
    """The table (id, columns) after a batch of records (id, is_deletion, columns), with
    `outcome`: kept, inserted, updated, unchanged (the same values again), deleted."""
    mine = current.select("id", *[F.col(c).alias(f"_old_{c}") for c in columns], F.lit(True).alias("_was"))
    theirs = batch.select("id", "is_deletion", *columns)
    j = mine.join(theirs, "id", "full_outer")
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"_old_{c}").eqNullSafe(F.col(c))
    outcome = (
        F.when(F.col("is_deletion").isNull(), "kept").when(F.col("is_deletion"), "deleted").when(F.col("_was").isNull(), "inserted").when(same, "unchanged").otherwise("updated")
    )
    new = {c: F.when(F.col("is_deletion").isNull(), F.col(f"_old_{c}")).otherwise(F.col(c)) for c in columns}
    return j.withColumn("outcome", outcome).select("id", "outcome", *[e.alias(c) for c, e in new.items()])


def hashed(text: Column, version: str) -> Column:
    """A text's hash, null for an empty text."""
    return F.when(F.coalesce(F.length(text), F.lit(0)) > 0, text_hash(version, text))


def gate(found: Column, stored: Column) -> Column:
    """What to do with a text of a hash (see hashed): embed (no or another hash stored), keep, or null."""
    return F.when(found.isNull(), "null").when(stored.eqNullSafe(found), "keep").otherwise("embed")


def embedding_gate(batch: DataFrame, stored: DataFrame, version: str) -> DataFrame:
    """(id, text) with text_hash and what to do (see gate), one row for each of the batch.  Where ids come
    several times, here or there, a text is kept if any stored row of its id has its hash."""
    known = stored.select("id", "text_hash").distinct().withColumn("_stored", F.col("text_hash"))
    found = batch.withColumn("text_hash", hashed(F.col("text"), version))
    j = found.join(known, ["id", "text_hash"], "left")
    return j.select(*found.columns, gate(F.col("text_hash"), F.col("_stored")).alias("step"))


class EmbeddingTimeout(TimeoutError):
    """An embedder took too long; the batch can be tried again."""


def embedded(text: Column, embedder: Callable[[list[str]], list[list[float]]], dimensions: int, batch: int = 96, concurrency: int = 1, timeout: float | None = None) -> Column:
    """The vectors of texts, null for a null, in sub-batches of which a task has up to `concurrency` in
    flight; results keep the rows' order.  A sub-batch that takes more than `timeout` seconds is an
    EmbeddingTimeout; a wrong count or size of vectors is an error that can't be retried."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pool, flight = ThreadPoolExecutor(concurrency), deque()

        def landed() -> pd.Series:
            there, job = flight.popleft()
            out = np.full(len(there), None, dtype=object)
            if job is None:
                return pd.Series(out)
            try:
                vectors = job.result(timeout)
            except TimeoutError as e:
                raise EmbeddingTimeout(f"EmbeddingTimeout: {there.sum()} texts took more than {timeout} s") from e
            if len(vectors) != there.sum() or any(len(v) != dimensions for v in vectors):
                raise ValueError("the embedder gave a wrong number or size of vectors")
            for k, v in zip(np.flatnonzero(there), vectors, strict=True):
                out[k] = v
            return pd.Series(out)

        try:
            for texts in parts:
                # nulls go along with the texts before them
                number = np.maximum(np.cumsum(texts.notna().to_numpy()) - 1, 0) // batch
                cuts = [0, *(np.flatnonzero(np.diff(number)) + 1), len(texts)] if len(texts) else []
                for low, high in zip(cuts, cuts[1:], strict=False):
                    cut = texts.iloc[low:high]
                    there = cut.notna().to_numpy()
                    flight.append((there, pool.submit(embedder, cut[there].tolist()) if there.any() else None))
                    if len(flight) >= concurrency:
                        yield landed()
            while flight:
                yield landed()
        finally:
            pool.shutdown(wait=False, cancel_futures=True)

    # an embedder may give other vectors the next time, so Spark isn't to call it more than once for a row
    return run.asNondeterministic()(text)


def embed(rows: DataFrame, embedder: Callable[[list[str]], list[list[float]]], dimensions: int, batch: int = 96, concurrency: int = 1, timeout: float | None = None) -> DataFrame:
    """(id, embedding) of the rows (id, text); see embedded."""
    return rows.select("id", embedded(F.col("text"), embedder, dimensions, batch, concurrency, timeout).alias("embedding"))


def passthrough(document: Column, vector: Column) -> list[Column]:
    """The vector as it came, and the document without it."""
    return [vector.cast("array<float>").alias("embedding"), F.to_json(document, {"ignoreNullFields": "false"}).alias("document")]


def cut_field(text: str, name: str) -> str:
    """A JSON object's text without one of its fields, everything else as it stands."""
    decoder, parts, at, more = json.JSONDecoder(), [], text.index("{") + 1, True
    head = text[:at]
    while more:
        end = at
        while text[end] in " \t\r\n":
            end += 1
        if text[end] == "}":
            break
        key, end = decoder.raw_decode(text, end)
        end = text.index(":", end) + 1
        while text[end] in " \t\r\n":
            end += 1
        _, end = decoder.raw_decode(text, end)
        if key != name:
            parts.append(text[at:end])
        while text[end] in " \t\r\n":
            end += 1
        more, at = text[end] == ",", end + 1
    return head + ",".join(parts) + "}"


def without_field(document: Column, name: str) -> Column:
    """A JSON object without one of its fields, a null or a flat array; the others keep their text (1.0 stays
    1.0).  Where the name is spelled once it is cut out by a pattern; where fields of inner objects have it
    as well, or it is spelled with escapes, by a scan of the text in Python."""
    key = f'"\\Q{json.dumps(name)[1:-1]}\\E"\\s*:'
    field = key + r'\s*(?:null|\[[^\[\]{}"]*\])'
    behind = F.regexp_replace(document, rf",\s*{field}", "")
    cut = F.when(behind != document, behind).otherwise(F.regexp_replace(document, rf"{field}\s*,?\s*", ""))
    there = F.array_contains(F.json_object_keys(document), name)
    plain = (F.regexp_count(document, F.lit(key)) == 1) & (cut != document)

    @F.pandas_udf("string")
    def scanned(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None else cut_field(t, name))

    return F.when(~F.coalesce(there, F.lit(False)), document).when(plain, cut).otherwise(scanned(F.when(there & ~plain, document)))


class TableSink:
    """A table of present documents, kept as runs like a log-structured merge tree.

    A batch is written as a run of its own, whatever the table's size; FAN runs of one level are
    merged into one of the next, so a row is rewritten as often as the table grew by a factor of
    FAN.  Of the merged files those whose key ranges overlap are rewritten; the others are
    taken over as they are.  A reader takes the last record of each id over all runs.

    Every delivery and every merge makes a version.  What read() returned stays readable, with its own
    version's rows, for `retain` seconds after a newer version came, and as long as a lease lasts
    (held()); vacuum(), which every merge calls, deletes what nothing uses any more.

    For each scope (the live stream, a table's backfill) the list holds the run and number of
    the last batch: the same batch again changes nothing, and batches of other scopes, or of a
    new run of the same scope, are never taken for old ones."""

    SCHEMA = "id string, destination string, document string"
    #: Runs of a level that become one of the next.
    FAN = 8

    def __init__(self, spark: SparkSession, path: str, name: str = "table", retain: float = 3600.0, clock: Callable[[], float] = time.time) -> None:
        self.spark, self.path, self.name = spark, path.rstrip("/"), name
        self.store = KeyedStore(spark, self.path, self.SCHEMA, retain, clock)
        self.lock = threading.Lock()

    def _visible(self, rows: DataFrame, purged: dict[str, int]) -> DataFrame:
        """The last record of each id, less those that a later purge emptied."""
        for destination, seq in purged.items():
            rows = rows.where((F.col("destination") != destination) | (F.col("seq") > seq))
        return last_wins(rows, ["destination", "id"], ("seq",))

    def read(self, version: int | None = None) -> DataFrame:
        """The present documents, or those of an older version that is still used."""
        _, p = self.store.list(version)
        rows = self._visible(self.store.rows(self.store.run_files(p["runs"])), p["purged"])
        return rows.where("not is_deletion").drop("is_deletion", "seq")

    def version(self) -> int:
        return self.store.list()[0]

    def held(self, seconds: float = 3600.0, version: int | None = None):
        """A lease on a version while it lasts: `with sink.held() as v: sink.read(v)`."""
        return self.store.held(seconds, version)

    def vacuum(self, retain: float | None = None) -> int:
        with self.lock:
            return self.store.vacuum(retain)

    def columns(self) -> list[str]:
        return self.spark.createDataFrame([], self.SCHEMA).columns

    def records(self, records: DataFrame, made: list[DataFrame]) -> DataFrame:
        """A batch's rows (SCHEMA and is_deletion) from sink records, the last of each id.  Frames in
        `made` are deleted once these rows are written."""
        last = last_wins(records, ["destination", "document_id"])
        return last.select(F.col("document_id").alias("id"), "destination", "document", "is_deletion")

    def deliver(self, records: DataFrame, batch: Batch | int) -> str:
        batch = Batch.of(batch)
        with self.lock:
            while True:
                version, p = self.store.list()
                last = p["batches"].get(batch.scope)
                if last and last["run"] == batch.run and batch.number <= last["number"]:
                    return "success"
                made: list[DataFrame] = []
                try:
                    rows = self.records(records, made).withColumn("seq", F.lit(p["next"]).cast("bigint"))
                    name = self.store.write(rows.select(*self.columns(), "is_deletion", "seq"))
                finally:
                    discard(*made)
                done = p | {"next": p["next"] + 1, "runs": [*p["runs"], {"name": name, "level": 0}], "batches": p["batches"] | {batch.scope: {"run": batch.run, "number": batch.number}}}
                if self.store.replace(version, done):
                    break
                self._drop(name)
            self._merge()
        return "success"

    def _drop(self, name: str) -> None:
        """A run that no version names."""
        for path in (name, f"{name}-bloom", f"manifests/{name}.json"):
            self.store.files.delete(f"{self.path}/{path}")

    def forget(self, scope: str) -> None:
        """A scope that is over: its last batch needn't be known any more."""
        with self.lock:
            while scope in (p := (found := self.store.list())[1])["batches"]:
                if self.store.replace(found[0], p | {"batches": {k: v for k, v in p["batches"].items() if k != scope}}):
                    return

    def _merge(self) -> None:
        """Merge the newest runs of equal level while there are FAN of them; deletions that no older
        run lies below, and what was purged, go for good."""
        merged_any = False
        while True:
            version, p = self.store.list()
            level = p["runs"][-1]["level"] if p["runs"] else 0
            tail = [r for r in p["runs"] if r["level"] == level]
            if len(tail) < self.FAN:
                break
            rest = p["runs"][: -len(tail)]
            stale = lambda f: any(f["lo"][0] <= d <= f["hi"][0] for d in p["purged"]) or (not rest and f["deletions"])  # noqa: B023, E731
            groups = overlapping(self.store.run_files(tail))
            again = [g for g in groups if len(g) > 1 or stale(g[0])]
            carried = [g[0] for g in groups if len(g) == 1 and not stale(g[0])]
            of = self.spark.createDataFrame([(f["path"].rsplit("/", 1)[1], n) for n, g in enumerate(again) for f in g], "_name string, _group int")
            # files have names of their own, and there is a row for each that is merged
            rows = self.store.rows([f for g in again for f in g]).withColumn("_name", F.col("_metadata.file_name")) if again else self.store.rows([]).withColumn("_name", F.lit(""))
            last = self._visible(rows, p["purged"]).join(F.broadcast(of), "_name").drop("_name")
            name = self.store.write(last if rest else last.where("not is_deletion"), carried, group=True)
            done = p | {"runs": [*rest, {"name": name, "level": level + 1}], "purged": p["purged"] if rest else {}}
            if self.store.replace(version, done):
                merged_any = True
            else:
                self._drop(name)
        if merged_any:
            self.store.vacuum()

    def purge(self, destination: str) -> None:
        """Empty a destination: a mark in the list, made good when runs are merged."""
        with self.lock:
            while True:
                version, p = self.store.list()
                if self.store.replace(version, p | {"purged": p["purged"] | {destination: p["next"]}, "next": p["next"] + 1}):
                    return


class VectorSink(TableSink):
    """Rows (id, text_hash, embedding, document) for vector search.

    The document is JSON.  With `text_field`, texts are embedded where their hash is missing or
    another than the stored one, and an unchanged text keeps its vector; with `vector_field`, the
    document's own vector is taken and left out of the stored document.  A row that would be
    stored with the same values again isn't written, and deletions take no embedding."""

    SCHEMA = "id string, destination string, text_hash string, embedding array<float>, document string"

    def __init__(self, spark: SparkSession, path: str, dimensions: int, embedder: Callable[[list[str]], list[list[float]]] | None = None, text_field: str | None = None, vector_field: str | None = None, version: str = "1", name: str = "vectors", retain: float = 3600.0, clock: Callable[[], float] = time.time, concurrency: int = 1, timeout: float | None = 60.0) -> None:
        super().__init__(spark, path, name, retain, clock)
        if (embedder is None or text_field is None) == (vector_field is None):
            raise ValueError("a vector sink either embeds a text field or takes a vector field")
        self.dimensions, self.embedder, self.text_field, self.vector_field, self.version = dimensions, embedder, text_field, vector_field, version
        #: Sub-batches of texts that a task has in flight, and the seconds that one may take.
        self.concurrency, self.timeout = concurrency, timeout

    def deliver(self, records: DataFrame, batch: Batch | int) -> str:
        try:
            return super().deliver(records, batch)
        except Exception as e:
            if EmbeddingTimeout.__name__ in str(e):  # a task's error comes as text
                return "retryable"
            raise

    def _stored(self, ids: DataFrame) -> DataFrame:
        """Stored rows of a batch's ids, from the files that may hold them."""
        _, p = self.store.list()
        near = self.store.rows(self.store.holding(ids, p["runs"])).join(ids, ["destination", "id"], "left_semi")
        return self._visible(near, p["purged"]).where("not is_deletion").drop("is_deletion", "seq")

    def records(self, records: DataFrame, made: list[DataFrame]) -> DataFrame:
        """The batch's last records beside the stored rows: both are dealt by key once, everything else is found in
        the joined row.  Documents move twice, to this join and to the run, and only changed ones are written."""
        stored = self._stored(records.select("destination", F.col("document_id").alias("id")).distinct())
        columns = ["text_hash", "embedding", "document"]
        known = stored.select("destination", "id", *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_was"))
        batch = super().records(records, made)
        if self.vector_field:
            vector = F.from_json(F.get_json_object("document", f"$['{self.vector_field}']"), "array<float>")
            sized = F.when(vector.isNull() | (F.size(vector) == self.dimensions), vector).otherwise(F.raise_error(F.lit("a vector has the wrong size")))
            new = batch.select("id", "destination", "is_deletion", F.lit(None).cast("string").alias("text_hash"), sized.alias("embedding"), without_field(F.col("document"), self.vector_field).alias("document"))
            j = new.join(known, ["destination", "id"], "left")
            same_vector, vectors = F.col("embedding").eqNullSafe(F.col("_embedding")), F.col("embedding")
        else:
            text = F.get_json_object("document", f"$['{self.text_field}']")
            j = batch.join(known, ["destination", "id"], "left")
            found = hashed(text, self.version)
            j = j.withColumns({"text_hash": found, "_step": gate(found, F.col("_text_hash"))})
            # with a hash and the same as before the vector is kept, without one there is none
            same_vector = F.col("text_hash").isNotNull() | F.col("_embedding").isNull()
            made_now = embedded(F.when(F.col("_step") == "embed", text), self.embedder, self.dimensions, concurrency=self.concurrency, timeout=self.timeout)
            vectors = F.when(F.col("_step") == "keep", F.col("_embedding")).otherwise(made_now)
        was = F.coalesce("_was", F.lit(False))
        same = was & F.col("text_hash").eqNullSafe(F.col("_text_hash")) & same_vector & F.col("document").eqNullSafe(F.col("_document"))
        changed = j.where(F.when(F.col("is_deletion"), was).otherwise(~same))
        # a deletion has neither document nor text; written before it is dealt by ranges, which reads it twice
        changed = materialise(changed.select("id", "destination", "text_hash", vectors.alias("embedding"), "document", "is_deletion"), "changed")
        made.append(changed)
        return changed
