"""Runs of keyed rows with versions that readers hold (OP-SNK-10, OP-AGG-7).

A run is a set of Parquet files of rows (destination, id, ...), dealt by ranges of that key, so a
run's files hold disjoint ranges; a run's manifest names them with their ranges, and each has a Bloom
filter of its keys, a table of words of bits.  The list of runs is a value of which every change is a
version of its own.  Files are never changed; a version's files stay as long as something uses it:
it is the newest, it was the newest less than `retain` seconds ago, or a lease names it.
vacuum() deletes what only other versions name, and nothing else, so files that are being written
aren't in its way."""

from __future__ import annotations

import json
import time
import uuid
from bisect import bisect_right
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import Files, Versions

#: Bits that a key sets, and rows to a word of 64 bits: about 1 in 400 keys that a file hasn't seems to be there.
PROBES, ROWS_A_WORD = 4, 4
KEY = ["destination", "id"]


class KeyedStore:
    EMPTY = {"next": 1, "runs": [], "batches": {}, "purged": {}}

    def __init__(self, spark: SparkSession, path: str, schema: str, retain: float = 3600.0, clock: Callable[[], float] = time.time) -> None:
        self.spark, self.path, self.schema, self.retain, self.clock = spark, path, schema, retain, clock
        self.files = Files(spark)
        self.state = Versions(self.files, f"{path}/list", keep_all=True)
        self._known: dict[str, list[dict]] = {}

    # ---- versions

    def list(self, version: int | None = None) -> tuple[int, dict]:
        """The newest version's number and value, or those of an older one that something still uses."""
        if version is None:
            version, found = self.state.load()
            return version, found or dict(self.EMPTY)
        found = self.state.at(version)
        if found is None:
            raise LookupError(f"version {version} isn't there, or nothing used it any more and it was deleted")
        return version, found

    def replace(self, version: int, value: dict) -> bool:
        return self.state.replace(version, value | {"at": self.clock()})

    def lease(self, seconds: float, version: int | None = None) -> tuple[str, int]:
        """Keep a version (by default the newest) for so many seconds; (the lease, the version)."""
        while True:
            number, _ = self.list(version)
            name = f"{self.path}/leases/{uuid.uuid4().hex}.json"
            self.files.write(name, json.dumps({"version": number, "until": self.clock() + seconds}))
            # it counts only if the version was there after the lease was
            if number == 0 or self.state.at(number) is not None:
                return name, number
            self.files.delete(name)

    def release(self, lease: str) -> None:
        self.files.delete(lease)

    @contextmanager
    def held(self, seconds: float = 3600.0, version: int | None = None) -> Iterator[int]:
        name, number = self.lease(seconds, version)
        try:
            yield number
        finally:
            self.release(name)

    def vacuum(self, retain: float | None = None) -> int:
        """Delete versions that nothing uses and the files that only they name; how many files."""
        retain, now = self.retain if retain is None else retain, self.clock()
        leased = set()
        for n in self.files.names(f"{self.path}/leases"):
            lease = json.loads(self.files.read(f"{self.path}/leases/{n}") or "{}") if n.endswith(".json") else {}
            if lease.get("until", 0) > now:
                leased.add(lease["version"])
            elif lease:
                self.files.delete(f"{self.path}/leases/{n}")
        numbers = self.state.numbers()
        values = {n: self.state.at(n) for n in numbers}
        # a version is over when the next one comes; one that was forgotten was over long ago
        ended = {n: values[m]["at"] if values[m] else float("-inf") for n, m in zip(numbers, numbers[1:], strict=False)}
        gone = [n for n in numbers[:-1] if n not in leased and ended[n] + retain <= now and values[n]]
        used = {r["name"] for n in numbers if n not in gone and values[n] for r in values[n]["runs"]}
        over = {r["name"] for n in gone for r in values[n]["runs"]} - used
        for n in gone:
            self.state.forget(n)
        kept = {f["path"] for name in used for f in self.manifest(name)}
        filters = {f["bloom"] for name in used for f in self.manifest(name)}
        deleted = 0
        for name in over:
            for f in self.manifest(name):
                if f["path"] not in kept:
                    self.files.delete(f"{self.path}/{f['path']}")
                    deleted += 1
                if f["bloom"] not in filters:
                    self.files.delete(f"{self.path}/{f['bloom']}")
            self.files.delete(f"{self.path}/manifests/{name}.json")
            self._known.pop(name, None)
            if not any(path.startswith(f"{name}/") for path in kept):
                self.files.delete(f"{self.path}/{name}")
        return deleted

    # ---- runs

    def manifest(self, name: str) -> list[dict]:
        """A run's files by rising range: path, lo, hi, rows, deletions, bloom, words."""
        if name not in self._known:
            self._known[name] = json.loads(self.files.read(f"{self.path}/manifests/{name}.json") or "[]")
        return self._known[name]

    def run_files(self, runs: list[dict]) -> list[dict]:
        return [f for r in runs for f in self.manifest(r["name"])]

    def rows(self, files: list[dict]) -> DataFrame:
        """Rows of files, with is_deletion and the number (seq) of their batch."""
        kind = self.schema + ", is_deletion boolean, seq bigint"
        if not files:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*[f"{self.path}/{f['path']}" for f in files])

    def write(self, rows: DataFrame, carried: list[dict] = (), group: bool = False) -> str:
        """Write a run of `rows` and of files that are taken over as they are; its name.  With `group`
        rows have a number _group, and no file holds rows of two groups."""
        name = f"run-{uuid.uuid4().hex}"
        target, first = f"{self.path}/{name}", ["_group"] if group else []
        dealt = rows.repartitionByRange(*first, *KEY).sortWithinPartitions(*first, *KEY)
        (dealt.write.partitionBy("_group") if group else dealt.write).parquet(target)
        made = self._described(name) if self._any(target) else []
        files = sorted([*made, *carried], key=lambda f: f["lo"])
        self.files.write(f"{self.path}/manifests/{name}.json", json.dumps(files))
        self._known[name] = files
        return name

    def _any(self, folder: str) -> bool:
        return any(n.startswith("_group") or n.endswith(".parquet") for n in self.files.names(folder))

    def _described(self, name: str) -> list[dict]:
        """Ranges and Bloom filters of a run that was written: keys alone are read, a row a file is returned."""
        keys = self.spark.read.parquet(f"{self.path}/{name}").select("*", F.col("_metadata.file_path").alias("_file"))
        key = F.struct(*KEY)
        found = keys.groupBy("_file").agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count(F.lit(1)).alias("rows"), F.count_if("is_deletion").alias("deletions")).collect()
        if not found:
            return []
        words, bloom = -(-max(r["rows"] for r in found) // ROWS_A_WORD), f"{name}-bloom"
        bits = keys.select(F.substring_index("_file", f"/{name}/", -1).alias("file"), F.explode(positions(words)).alias("p"))
        bits = bits.select("file", F.expr("p div 64").alias("word"), F.expr("shiftleft(1L, cast(p % 64 as int))").alias("bit"))
        bits.groupBy("file", "word").agg(F.bit_or("bit").alias("bits")).write.parquet(f"{self.path}/{bloom}")
        tail = lambda path: path.rsplit(f"/{name}/", 1)[1]
        return [{"path": f"{name}/{tail(r['_file'])}", "lo": list(r["lo"]), "hi": list(r["hi"]), "rows": r["rows"], "deletions": r["deletions"], "bloom": bloom, "words": words} for r in found]

    def holding(self, keys: DataFrame, runs: list[dict]) -> list[dict]:
        """The files of `runs` that may hold one of the keys (destination, id): by range, a search in each run's
        sorted ranges, then by Bloom filter, a join by file and word.  A row a file comes to the driver."""
        by_run = [m for r in runs if (m := self.manifest(r["name"]))]
        if not by_run:
            return []
        shipped = self.spark.sparkContext.broadcast([([tuple(f["lo"]) for f in m], [(tuple(f["hi"]), f["path"], f["words"]) for f in m]) for m in by_run])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out: list[tuple] = []
                for key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    for los, rest in shipped.value:
                        k = bisect_right(los, key) - 1
                        if k >= 0 and key <= rest[k][0]:
                            out.append((*key, rest[k][1], rest[k][2]))
                columns = list(zip(*out, strict=True)) if out else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)], names=[*KEY, "path", "words"])

        near = keys.select(*KEY).distinct().mapInArrow(run, "destination string, id string, path string, words long")
        probes = near.select(*KEY, "path", F.explode(positions(F.col("words"))).alias("p"))
        probes = probes.select(*KEY, F.substring_index("path", "/", 1).alias("run"), F.expr("substring(path, instr(path, '/') + 1)").alias("file"), F.expr("p div 64").alias("word"), F.expr("shiftleft(1L, cast(p % 64 as int))").alias("bit"))
        filters = sorted({f["bloom"] for m in by_run for f in m})
        bloom = self.spark.read.parquet(*[f"{self.path}/{b}" for b in filters]).select(F.regexp_extract("_metadata.file_path", "(run-[0-9a-f]+)-bloom/", 1).alias("run"), "file", "word", "bits")
        hit = probes.join(bloom, ["run", "file", "word"]).where(F.col("bits").bitwiseAND(F.col("bit")) != 0)
        sure = hit.groupBy(*KEY, "run", "file").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == PROBES)
        found = {f"{r['run']}/{r['file']}" for r in sure.select("run", "file").distinct().collect()}
        return [f for m in by_run for f in m if f["path"] in found]


def positions(words) -> F.Column:
    """The bits of a key in a filter of so many words."""
    bits = (words if isinstance(words, F.Column) else F.lit(words)) * 64
    return F.array(*[F.pmod(F.xxhash64(*KEY, F.lit(k)), bits) for k in range(PROBES)])


def overlapping(files: list[dict]) -> list[list[dict]]:
    """Files in groups: those whose ranges overlap, also by way of others, are one."""
    out: list[list[dict]] = []
    high = None
    for f in sorted(files, key=lambda f: f["lo"]):
        if high is not None and f["lo"] <= high:
            out[-1].append(f)
            high = max(high, f["hi"])
        else:
            out.append([f])
            high = f["hi"]
    return out
