"""Streams of commands: continuous ingest into a store, and state per key.

ops: key, seq, op, value, ttl_secs, at_ms, as in operators.fold.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strandline.operators.fold import RESULT, KeyState, fold, versions_of
from strandline.operators.resolve import newest
from strandline.operators.ttl import expiry_column
from strandline.sources.store import VersionStore


def ingest(ops: DataFrame, store: VersionStore, collection: str, checkpoint: str, source: str = "stream", answers_to: str | None = None) -> StreamingQuery:
    """Apply a stream of commands to a collection, each micro-batch as one snapshot.

    A batch that is run again after a failure is added once.  Writes and deletions are appended as they are.  If a batch has
    commands that read what they change (or answers are asked for), the newest versions of its keys are looked up and
    stand before its commands in the fold.  Seqs are 0 or more; within a batch they order the commands of a key.
    ``answers_to``: a folder in which each batch's answers (operators.fold.RESULT) are written.
    """

    def add(batch: DataFrame, number: int) -> None:
        default = store.catalog.get(collection).default_ttl_secs
        if answers_to is None and batch.where(~F.col("op").isin("PUT", "DEL")).isEmpty():
            rows = batch.select("key", "seq", F.when(F.col("op") == "PUT", F.coalesce("value", F.lit(""))).alias("value"), (F.col("op") == "DEL").alias("is_tombstone"), F.when(F.col("op") == "PUT", expiry_column(F.col("at_ms"), F.col("ttl_secs"), default)).alias("expiry_ms"))
        else:
            # a version as the PUT that leaves it behind: one that expires was written a second before
            old = newest(store.versions(collection), unique=True).where("NOT is_tombstone").join(batch.select("key").distinct(), "key", "left_semi")
            ttl, at = F.when(F.col("expiry_ms").isNull(), 0).otherwise(1).cast("bigint"), F.coalesce(F.col("expiry_ms") - 1000, F.lit(0))
            old = old.select("key", F.lit(-1).cast("bigint").alias("seq"), F.lit("PUT").alias("op"), "value", ttl.alias("ttl_secs"), at.alias("at_ms"))
            results = fold(old.unionByName(batch.select(*old.columns)), default).where("seq >= 0")
            if answers_to is not None:
                results.write.mode("overwrite").parquet(f"{answers_to}/batch={number}")
            rows = versions_of(results)
        # only the order within a key matters: numbers per key are enough to make (key, seq) unique
        ranked = rows.withColumn("pos", F.row_number().over(Window.partitionBy("key").orderBy("seq", "is_tombstone", "value")) - 1)
        store.append(collection, ranked, source, number)

    return ops.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def answers(ops: DataFrame, default_secs: int = 0) -> DataFrame:
    """The answer to each command of a stream, as operators.fold gives it, with one state per key."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value, expiry_ms = state.get if state.exists else (None, None)
        own = KeyState(value, None if expiry_ms is None or pd.isna(expiry_ms) else int(expiry_ms))
        number = lambda x: None if pd.isna(x) else int(x)
        out = []
        for row in pd.concat(list(batches)).sort_values("seq").itertuples(index=False):
            text = None if pd.isna(row.value) else row.value
            status, payload, writes = own.apply(row.op, text, number(row.ttl_secs), int(row.at_ms), default_secs)
            out.append((row.key, row.seq, status, payload, writes, own.value if writes else None, writes and own.value is None, own.expiry_ms if writes else None))
        state.update((own.value, own.expiry_ms))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")]).astype({"expiry_ms": "Int64"})

    return ops.groupBy("key").applyInPandasWithState(step, RESULT, "value string, expiry_ms bigint", "append", GroupStateTimeout.NoTimeout)


def rollup(points: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Extension: count, sum, least and greatest of numeric values by metric and time window (metric, ts, value)."""
    return points.withWatermark("ts", late).groupBy(F.window("ts", width), "metric").agg(F.count("*").alias("n"), F.sum("value").alias("sum"), F.min("value").alias("min"), F.max("value").alias("max"))
