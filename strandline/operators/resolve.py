"""Newest-wins resolution: from versions to live rows.

versions: key, seq, value, is_tombstone, expiry_ms.  The version with the greatest seq decides about
a key, and only then is it asked whether it is a deletion or has expired: an expired or deleted
newest version hides older live ones.  Filters on the key may stand above; they reach the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERSION = "key string, seq bigint, value string, is_tombstone boolean, expiry_ms bigint"


def alive(now_ms: int) -> Column:
    """Neither deleted nor expired; a row whose expiry is ``now_ms`` has expired."""
    return ~F.coalesce(F.col("is_tombstone"), F.lit(False)) & (F.col("expiry_ms").isNull() | (F.col("expiry_ms") > F.lit(now_ms).cast("bigint")))


def newest(versions: DataFrame, unique: bool = False) -> DataFrame:
    """The newest version of each key.

    With ``unique`` (no two versions of a key share a seq, as the store guarantees) only numbers are
    aggregated, and the rows are fetched by a join that adaptive execution may split or broadcast.
    Otherwise the greatest of (seq, tombstone, expiry, value) is taken.  Both sum up before they
    shuffle, so a key with very many versions is no bottleneck.
    """
    if unique:
        top = versions.groupBy("key").agg(F.max("seq").alias("seq"))
        return versions.join(top, ["key", "seq"]).select("key", "seq", "value", "is_tombstone", "expiry_ms")
    best = F.max(F.struct("seq", "is_tombstone", "expiry_ms", "value")).alias("v")
    return versions.groupBy("key").agg(best).select("key", "v.seq", "v.value", "v.is_tombstone", "v.expiry_ms")


def live(versions: DataFrame, now_ms: int, unique: bool = False) -> DataFrame:
    """key, value and expiry_ms of every live key."""
    return newest(versions, unique).where(alive(now_ms)).select("key", "value", "expiry_ms")
