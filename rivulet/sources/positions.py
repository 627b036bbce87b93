"""The change log as a stream whose offsets are positions of the log (OP-SRC-1, OP-CTL-3).

A log is a folder of segments.  Every append is one file of `appends`, named by the position
that it follows and listing its segments: each has the rows behind one position up to another,
in a Parquet file with a known number of rows.  Segments follow each other without a break,
so a reader that asks for rows behind a position sees whether retention has deleted some of
them.  A position is an unsigned 64-bit number; all rows of one are in one segment."""

from __future__ import annotations

import json
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from ..storage import Files
from .changelog import log_schema

POSITION = "_position"
FORMAT = "rivulet_log"


class RetentionHole(RuntimeError):
    """Rows behind the reader's position are gone from the log."""


def _name(after: int) -> str:
    return f"{after:020d}.json"


def append_segments(rows: DataFrame, path: str, segments: int = 8, position: Column | None = None) -> tuple[int, int]:
    """Append rows to the log, as at most `segments` segments; the positions that they follow and end at.

    Rows must be behind all that the log has.  The position is the commit's, or a record's
    own (seq) where it has none.  A writer that another one came before raises FileExistsError."""
    spark, files = rows.sparkSession, Files(rows.sparkSession)
    known = sorted(n for n in files.names(f"{path}/appends") if n.endswith(".json"))
    newest = json.loads(files.read(f"{path}/appends/{known[-1]}"))[-1]["last"] if known else 0
    at = F.coalesce(F.col("commit_lsn"), F.col("seq").cast("decimal(20,0)")) if position is None else position
    folder = f"{path}/data/{uuid.uuid4().hex}"
    dealt = rows.withColumn(POSITION, at.cast("decimal(20,0)")).repartitionByRange(segments, POSITION).sortWithinPartitions(POSITION)
    dealt.write.option("maxRecordsPerFile", 0).parquet(folder)
    # one row a file, of which there are `segments` at most
    found = spark.read.parquet(folder).groupBy(F.col("_metadata.file_name").alias("f")).agg(
        F.min(POSITION).alias("low"), F.max(POSITION).alias("high"), F.count(F.lit(1)).alias("n"), F.count_if(F.col(POSITION).isNull()).alias("lost")
    ).collect()
    found = sorted((r for r in found if r["n"]), key=lambda r: r["high"] or 0)
    if any(r["lost"] for r in found) or (found and found[0]["low"] <= newest):
        files.delete(folder)
        raise ValueError(f"rows without a position, or at or before {newest}, which the log has already")
    if not found:
        files.delete(folder)
        return newest, newest
    edges = [newest, *(int(r["high"]) for r in found)]
    listed = [{"after": a, "last": b, "file": f"{folder}/{r['f']}", "rows": r["n"]} for a, b, r in zip(edges, edges[1:], found, strict=False)]
    if not files.create(f"{path}/appends/{_name(newest)}", json.dumps(listed)):
        files.delete(folder)
        raise FileExistsError(f"another writer appended behind {newest}")
    return newest, edges[-1]


def trim_segments(spark: SparkSession, path: str, before: int) -> int:
    """Delete appends that end at or before a position, but never the newest; how many."""
    files = Files(spark)
    known = sorted(n for n in files.names(f"{path}/appends") if n.endswith(".json"))
    gone = 0
    for name in known[:-1]:
        listed = json.loads(files.read(f"{path}/appends/{name}"))
        if listed[-1]["last"] > before:
            break
        files.delete(f"{path}/appends/{name}")
        files.delete(listed[0]["file"].rsplit("/", 1)[0])
        gone += 1
    return gone


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """A path's file system; `file:/x`, as Hadoop writes it, is a local path."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path)


@dataclass
class Segment(InputPartition):
    """Rows of a file behind one position up to another."""

    file: str
    rows: int
    after: int
    last: int


@dataclass
class Hole(InputPartition):
    """Rows behind one position up to another that the log doesn't have any more."""

    after: int
    last: int


class LogReader(DataSourceStreamReader):
    def __init__(self, schema: T.StructType, options: dict) -> None:
        self.schema, self.path = schema, options["path"].rstrip("/")
        self.on_hole, self.start = options.get("onHole", "fail"), options.get("startingPosition")
        if self.on_hole not in ("fail", "snapshot"):
            raise ValueError("onHole is fail or snapshot")

    def _appends(self) -> list[int]:
        fs, folder = _file_system(f"{self.path}/appends")
        found = fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
        return sorted(int(i.base_name.removesuffix(".json")) for i in found if i.base_name.endswith(".json"))

    def _listed(self, after: int) -> list[dict]:
        fs, name = _file_system(f"{self.path}/appends/{_name(after)}")
        with fs.open_input_file(name) as f:
            return json.loads(f.read())

    def initialOffset(self) -> dict:  # noqa: N802
        """The given position, or what the first available row follows."""
        known = self._appends()
        return {"position": str(int(self.start) if self.start is not None else known[0] if known else 0)}

    def latestOffset(self) -> dict:  # noqa: N802
        known = self._appends()
        return {"position": str(self._listed(known[-1])[-1]["last"]) if known else self.initialOffset()["position"]}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """The segments between two positions.  Where rows are missing, an error or, with
        onHole=snapshot, a partition that says so."""
        at, stop = int(start["position"]), int(end["position"])
        if at > stop:
            raise RetentionHole(f"the log ends at {stop}, before the reader's position {at}: it was made anew")
        known = self._appends()
        out: list[InputPartition] = []
        for after in known[max(bisect_right(known, at) - 1, 0) :]:
            if at >= stop:
                break
            for s in self._listed(after):
                if s["last"] <= at or at >= stop:
                    continue
                if s["after"] > at:
                    out.append(self._hole(at, min(s["after"], stop)))
                    at = out[-1].last
                if at < stop:
                    out.append(Segment(s["file"], s["rows"], at, min(s["last"], stop)))
                    at = out[-1].last
        if at < stop:
            out.append(self._hole(at, stop))
        return out

    def _hole(self, after: int, last: int) -> Hole:
        if self.on_hole == "fail":
            raise RetentionHole(f"the log has no rows any more behind {after} up to {last}")
        return Hole(after, last)

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        """Columns by name, unknown ones ignored, missing ones null."""
        wanted = to_arrow_schema(self.schema)
        if isinstance(partition, Hole):
            given = {"kind": "gap", "token": f"{partition.after}-{partition.last}"}
            yield pa.RecordBatch.from_arrays([pa.array([given.get(f.name)], f.type) for f in wanted], schema=wanted)
            return
        fs, name = _file_system(partition.file)
        seen = 0
        with fs.open_input_file(name) as f:
            file = pq.ParquetFile(f)
            have = set(file.schema_arrow.names)
            for batch in file.iter_batches(8192, columns=[c for c in wanted.names if c in have] + [POSITION]):
                seen += batch.num_rows
                place = batch.column(POSITION)
                edge = [pa.scalar(x, place.type) for x in (partition.after, partition.last)]
                batch = batch.filter(pc.and_(pc.greater(place, edge[0]), pc.less_equal(place, edge[1])))
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(w.name).cast(w.type) if w.name in have else pa.nulls(batch.num_rows, w.type) for w in wanted], schema=wanted)
        if seen != partition.rows:
            raise RuntimeError(f"{partition.file} has {seen} rows, not the {partition.rows} that were appended")


class LogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def streamReader(self, schema: T.StructType) -> LogReader:  # noqa: N802
        return LogReader(schema, self.options)


def stream_positions(spark: SparkSession, path: str, image: T.StructType, on_hole: str = "fail", start: int | None = None) -> DataFrame:
    """The log behind a position (the first available one if not given) as a stream.

    A batch goes up to the newest position.  If retention has deleted rows that the stream
    still needs, the batch fails (on_hole="fail"), or gets a record of kind `gap` in their
    place ("snapshot"), for which the engine asks for a backfill of all its tables."""
    spark.dataSource.register(LogSource)
    reader = spark.readStream.format(FORMAT).schema(log_schema(image)).option("path", path).option("onHole", on_hole)
    return (reader if start is None else reader.option("startingPosition", str(start))).load()
