"""Versions in Parquet, published by numbered snapshots.

A write adds a folder of Parquet files and then publishes the next manifest, which lists the folders and the
next seq.  A write that was cut off is never listed.  A manifest's number is taken once, whoever writes: the
writer that comes second reads the new snapshot and writes anew.  Readers keep the snapshot that they started
from: a compaction lists what it has replaced as retired, and ``vacuum`` deletes that only after its retention.
Seqs are unique, so resolution may use the join on (key, seq).
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators.compact import compacted
from strandline.operators.resolve import VERSION, alive, live, newest
from strandline.sources.catalog import KEEP, Catalog, Collection
from strandline.sources.files import Conflict, Files, Numbered

__all__ = ["Conflict", "VersionStore"]
_FIRST = {"next_seq": 0, "parts": [], "rows": 0, "batches": {}, "retired": []}


class VersionStore:
    """``retain_ms``: how long replaced parts stay; ``retries``: of a write after a conflict."""

    def __init__(self, spark: SparkSession, root: str, retain_ms: int = 3_600_000, retries: int = 16):
        self.spark, self.root, self.retain_ms, self.retries = spark, root.rstrip("/"), retain_ms, retries
        self.files = Files(spark)
        self.catalog = Catalog(self.files, self.root)

    def _folder(self, entry: Collection) -> str:
        return f"{self.root}/{entry.folder}"

    def _manifests(self, entry: Collection) -> Numbered:
        return Numbered(self.files, self._folder(entry), "manifest")

    def _manifest(self, entry: Collection) -> tuple[int, dict]:
        number, state = self._manifests(entry).read()
        return number, state or _FIRST

    def parts(self, name: str) -> list[str]:
        entry = self.catalog.get(name)
        return [f"{self._folder(entry)}/{p}" for p in self._manifest(entry)[1]["parts"]]

    def _read(self, parts: list[str]) -> DataFrame:
        return self.spark.read.schema(VERSION).parquet(*parts) if parts else self.spark.createDataFrame([], VERSION)

    def versions(self, name: str) -> DataFrame:
        """The collection's versions as of now."""
        return self._read(self.parts(name))

    def live(self, name: str, now_ms: int) -> DataFrame:
        return live(self.versions(name), now_ms, unique=True)

    def append(self, name: str, rows: DataFrame, source: str | None = None, batch: int = 0, waited: Callable[[float], None] | None = None) -> int:
        """Add versions: pos (unique for each key, from 0), key, value, is_tombstone, expiry_ms; returns their number.

        Later positions win.  Of one ``source`` a ``batch`` is added once, however often it is handed in.
        ``waited`` is told the milliseconds of each attempt that came second to another writer.
        """
        for turn in range(self.retries + 1):
            began, entry = time.monotonic(), self.catalog.get(name)
            number, old = self._manifest(entry)
            if source is not None and old["batches"].get(source, -1) >= batch:
                return 0
            part = f"part-{uuid.uuid4().hex}"
            made = rows.select("key", (F.col("pos") + old["next_seq"]).cast("bigint").alias("seq"), "value", F.col("is_tombstone").cast("boolean").alias("is_tombstone"), F.col("expiry_ms").cast("bigint").alias("expiry_ms"))
            self._write(made, f"{self._folder(entry)}/{part}")
            n, last = self._read([f"{self._folder(entry)}/{part}"]).agg(F.count("*"), F.max("seq")).first()
            new = old | {"next_seq": old["next_seq"] if last is None else last + 1, "rows": old["rows"] + n, "parts": [*old["parts"], *([part] if n else [])]}
            if source is not None:
                new["batches"] = old["batches"] | {source: batch}
            try:
                self._manifests(entry).publish(number, new)
                return n
            except Conflict:
                self.files.delete(f"{self._folder(entry)}/{part}")
                if waited:
                    waited(1000 * (time.monotonic() - began))
                if turn == self.retries:
                    raise
        raise AssertionError

    @staticmethod
    def _write(rows: DataFrame, path: str) -> None:
        # sorted files have narrow key ranges to skip by; Bloom filters help where they don't
        rows.sortWithinPartitions("key").write.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.expected.ndv#key", "1000000").parquet(path)

    def dead_ratio(self, name: str, now_ms: int) -> float:
        """The share of versions that a compaction would remove."""
        entry = self.catalog.get(name)
        rows = self._manifest(entry)[1]["rows"]
        return 1 - newest(self.versions(name), unique=True).where(alive(now_ms)).count() / rows if rows else 0.0

    def compact(self, name: str, now_ms: int) -> None:
        """Replace the versions by the newest live ones; parts that were added meanwhile stay as they are."""
        entry = self.catalog.get(name)
        _, old = self._manifest(entry)
        if not old["parts"]:
            return
        part = f"part-{uuid.uuid4().hex}"
        path = f"{self._folder(entry)}/{part}"
        self._write(compacted(self._read([f"{self._folder(entry)}/{p}" for p in old["parts"]]), now_ms), path)
        kept = self._read([path]).count()
        while True:
            number, now = self._manifest(entry)
            if now["parts"][: len(old["parts"])] != old["parts"]:
                self.files.delete(path)  # another compaction has replaced them
                return
            retired = [*now["retired"], *([p, int(time.time() * 1000)] for p in old["parts"])]
            try:
                self._manifests(entry).publish(number, now | {"parts": [part, *now["parts"][len(old["parts"]) :]], "rows": now["rows"] - old["rows"] + kept, "retired": retired})
                break
            except Conflict:
                continue
        self.vacuum(name)

    def vacuum(self, name: str) -> None:
        """Delete what was retired longer ago than the retention, and old manifests."""
        entry = self.catalog.get(name)
        number, now = self._manifest(entry)
        due = int(time.time() * 1000) - self.retain_ms
        gone = [p for p, at in now["retired"] if at <= due]
        if gone:
            try:
                self._manifests(entry).publish(number, now | {"retired": [x for x in now["retired"] if x[0] not in gone]})
            except Conflict:
                return  # the next one will
            for part in gone:
                self.files.delete(f"{self._folder(entry)}/{part}")
        self._manifests(entry).clear(keep=KEEP)
