"""Ordered scans and counts over live rows.

``rows`` is what resolve.live gives, or versions through the ``*_of`` forms, which put the key filter
below the resolution, where it reaches the files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.keys import prefix_successor


def in_range(start: str, end: str) -> Column:
    """Both bounds belong to the range; a range that ends before it starts is empty."""
    return F.col("key").between(start, end) if start <= end else F.lit(False)


def has_prefix(prefix: str) -> Column:
    """Keys that start with ``prefix``; every key starts with the empty one.

    The bounds are implied; they let files and row groups be skipped by their least and greatest keys.
    """
    if not prefix:
        return F.lit(True)
    found = F.col("key").startswith(prefix) & (F.col("key") >= prefix)
    after = prefix_successor(prefix)
    return found if after is None else found & (F.col("key") < after)


def scan_range(rows: DataFrame, start: str, end: str) -> DataFrame:
    return rows.where(in_range(start, end)).select("key", "value").orderBy("key")


def scan_prefix(rows: DataFrame, prefix: str) -> DataFrame:
    return rows.where(has_prefix(prefix)).select("key", "value").orderBy("key")


def list_keys(rows: DataFrame) -> DataFrame:
    return rows.select("key")


def count(rows: DataFrame, condition: Column) -> DataFrame:
    """One row: n, the number of live keys that meet the condition."""
    return rows.where(condition).agg(F.count("*").alias("n"))
