"""Small files in whatever store Spark's paths name, published whole under names that are taken once."""

from __future__ import annotations

import json
import os
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def scratch(spark: SparkSession) -> str:
    """A folder that driver and executors share, from ``spark.checkpoint.dir``; a local session without it gets a temporary one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        found = f"file://{tempfile.mkdtemp(prefix='strandline-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Conflict(RuntimeError):
    """Another writer has published since the snapshot was read."""


class Files:
    """Text files through Hadoop's file system, as the driver's JVM sees it."""

    def __init__(self, spark: SparkSession):
        self.spark, self._jvm = spark, spark._jvm

    def _open(self, path: str):
        found = self._jvm.org.apache.hadoop.fs.Path(path)
        return found, found.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def read(self, path: str) -> str | None:
        """The file's text, or None where there is no file."""
        at, fs = self._open(path)
        if not fs.exists(at):
            return None
        stream = fs.open(at)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def names(self, path: str) -> list[str]:
        """What is in a folder; nothing where there is none."""
        at, fs = self._open(path)
        return [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []

    def create(self, path: str, text: str) -> bool:
        """Write beside, then take the name if it is free, in one step: of several writers one succeeds."""
        beside, fs = self._open(f"{path}.{uuid.uuid4().hex}")
        stream = fs.create(beside, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        at, _ = self._open(path)
        try:
            if fs.getScheme() == "file":
                os.link(beside.toUri().getPath(), at.toUri().getPath())
            else:
                none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(beside), fs.makeQualified(at), none)
        except FileExistsError:
            return False
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception):
                raise
            return False
        finally:
            fs.delete(beside, False)
        return True

    def delete(self, path: str) -> None:
        at, fs = self._open(path)
        fs.delete(at, True)


class Numbered:
    """States of one thing as files ``name-<number>.json``: the greatest number holds, and a number is taken once."""

    def __init__(self, files: Files, folder: str, name: str):
        self.files, self.folder, self.name = files, folder, name

    def _numbers(self) -> list[int]:
        start, end = f"{self.name}-", ".json"
        return sorted(int(x[len(start) : -len(end)]) for x in self.files.names(self.folder) if x.startswith(start) and x.endswith(end) and x[len(start) : -len(end)].isdigit())

    def path(self, number: int) -> str:
        return f"{self.folder}/{self.name}-{number:012d}.json"

    def read(self) -> tuple[int, dict | list | None]:
        """The number and the state that hold; 0 and None before the first."""
        while numbers := self._numbers():
            text = self.files.read(self.path(numbers[-1]))
            if text is not None:  # else it was cleared away since, and there is a later one
                return numbers[-1], json.loads(text)
        return 0, None

    def publish(self, after: int, state: dict | list) -> None:
        """The state that follows number ``after``; a Conflict if another one does."""
        if not self.files.create(self.path(after + 1), json.dumps(state)):
            raise Conflict(f"{self.name} in {self.folder} was written by another session")

    def clear(self, keep: int) -> None:
        """Delete all but the last ``keep`` states."""
        for number in self._numbers()[:-keep]:
            self.files.delete(self.path(number))
