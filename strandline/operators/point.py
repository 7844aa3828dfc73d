"""Point reads: READ, EXISTS and MGET, one key or a table of keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def read(rows: DataFrame, key: str) -> DataFrame:
    """The live row of a key, or none."""
    return rows.where(F.col("key") == key).select("key", "value")


def exists(rows: DataFrame, key: str) -> bool:
    return not read(rows, key).isEmpty()


def exists_many(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``keys`` (pos, key) with found."""
    return keys.join(rows.select("key", F.lit(True).alias("found")), "key", "left").select("pos", "key", F.coalesce("found", F.lit(False)).alias("found"))


def mget(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``keys`` (pos, key), repeats and all, with value; null where the key isn't live.  Order by pos for the order asked for."""
    return keys.join(rows.select("key", "value"), "key", "left").select("pos", "key", "value")


def key_table(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A list of keys as pos, key."""
    return rows.sparkSession.createDataFrame(list(enumerate(keys)), "pos long, key string")
