"""Files that driver and executors share, through Spark's own file systems."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in a local run without it, a temporary folder of this session."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="rivulet-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back; a write that fails leaves nothing there."""
    path = f"{shared_dir(df.sparkSession)}/rivulet-work/{name}-{uuid.uuid4().hex}"
    try:
        df.write.parquet(path)
    except Exception:
        Files(df.sparkSession).delete(path)
        raise
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.__dict__["rivulet_path"] = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what materialise() wrote for these, once nothing reads it any more."""
    for df in frames:
        Files(df.sparkSession).delete(df.__dict__["rivulet_path"])


class Files:
    """Small text files on any file system that Spark reads."""

    def __init__(self, spark: SparkSession) -> None:
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        p = self._path(path)
        return p.getFileSystem(self.conf).exists(p)

    def read(self, path: str) -> str | None:
        p = self._path(path)
        fs = p.getFileSystem(self.conf)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def names(self, path: str) -> list[str]:
        """Names in a folder; none if it isn't there."""
        p = self._path(path)
        fs = p.getFileSystem(self.conf)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def create(self, path: str, text: str) -> bool:
        """Write a file that isn't there yet; False if it is."""
        try:
            self.write(path, text, overwrite=False)
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception.getClass().getName()):
                raise
            return False

    def write(self, path: str, text: str, overwrite: bool = True) -> None:
        """Whole or not at all: a temporary file is renamed (over the old one)."""
        p, tmp = self._path(path), self._path(f"{path}.{uuid.uuid4().hex}.tmp")
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.conf)
        fs = p.getFileSystem(self.conf)
        fs.mkdirs(p.getParent())
        stream = fs.create(tmp, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = self.jvm.java.lang.reflect.Array.newInstance(rename.OVERWRITE.getClass(), 1)
        options[0] = rename.OVERWRITE if overwrite else rename.NONE
        try:
            context.rename(tmp, p, options)
        except Py4JJavaError:
            fs.delete(tmp, False)
            raise

    def delete(self, path: str) -> None:
        p = self._path(path)
        p.getFileSystem(self.conf).delete(p, True)


class Versions:
    """A JSON value of which every change is a file of its own, numbered on.  A change that another
    writer came before is made again from the newer value, so none is lost."""

    KEPT = 8

    def __init__(self, files: Files, path: str, keep_all: bool = False) -> None:
        """With `keep_all` old versions stay until forget()."""
        self.files, self.path, self.keep_all = files, path, keep_all

    def numbers(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self.files.names(self.path) if n.endswith(".json"))

    def load(self) -> tuple[int, dict | None]:
        numbers = self.numbers()
        return (numbers[-1], self.at(numbers[-1])) if numbers else (0, None)

    def at(self, version: int) -> dict | None:
        """A version's value; None if it isn't there or was forgotten."""
        text = self.files.read(f"{self.path}/{version:012d}.json")
        return json.loads(text) if text else None

    def forget(self, version: int) -> None:
        """Delete a version's value.  The newest KEPT keep their numbers, so that a writer that is late
        can't take one of them again."""
        if version > self.numbers()[-1] - self.KEPT:
            self.files.write(f"{self.path}/{version:012d}.json", "null")
        else:
            self.files.delete(f"{self.path}/{version:012d}.json")

    def replace(self, version: int, value: dict) -> bool:
        """The value after `version`; False if another one is there already."""
        name = f"{self.path}/{version + 1:012d}.json"
        if not self.files.create(name, json.dumps(value, sort_keys=True)):
            return False
        if self.numbers()[-1] >= version + self.KEPT:  # so far behind that the name was free again
            self.files.delete(name)
            return False
        if version >= self.KEPT and not self.keep_all:
            self.files.delete(f"{self.path}/{version - self.KEPT + 1:012d}.json")
        return True

    def update(self, change: Callable[[dict | None], dict | None]) -> dict | None:
        """Replace the value by what `change` makes of it (None leaves it)."""
        while True:
            version, value = self.load()
            new = change(value)
            if new is None:
                return value
            if self.replace(version, new):
                return new
