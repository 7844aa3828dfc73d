"""Compaction: what remains of versions once newest-wins has been applied."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.resolve import alive, newest


def compacted(versions: DataFrame, now_ms: int, unique: bool = True) -> DataFrame:
    """The newest live versions, dealt by key ranges and sorted, so that files cover disjoint keys.

    Deletions and expired rows go only after the newest version has been picked.
    """
    kept = newest(versions, unique).where(alive(now_ms))
    return kept.select("key", "seq", "value", F.lit(False).alias("is_tombstone"), "expiry_ms").repartitionByRange("key").sortWithinPartitions("key")
