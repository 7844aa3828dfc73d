"""The test tables as versions, in DataFrames and in SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.keys import padded

#: The time at which the registered queries look at the data.
NOW_MS = 1706572632194
DAY_MS = 86_400_000


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_ms(column: str):
    return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column})")


def money(column: str):
    return F.col(column).cast("decimal(18,2)").cast("string")


def event_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_type:user -> value; every tenth version deletes, every third expires after five days."""
    e = load(spark, sf_dir, "events")
    return e.select(
        padded(F.col("event_type"), F.col("user_id")).alias("key"),
        F.col("event_id").alias("seq"),
        money("value").alias("value"),
        (F.col("event_id") % 10 == 7).alias("is_tombstone"),
        F.when(F.col("event_id") % 3 == 0, epoch_ms("ts") + 5 * DAY_MS).alias("expiry_ms"),
    )


EVENTS = f"""
v AS (
  SELECT event_type || ':' || lpad(CAST(user_id AS VARCHAR), 10, '0') AS key, event_id AS seq, CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS value,
    event_id % 10 = 7 AS is_tombstone, CASE WHEN event_id % 3 = 0 THEN epoch_us(ts) // 1000 + {5 * DAY_MS} END AS expiry_ms
  FROM events
), newest AS (
  SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1
), live AS (
  SELECT key, value, expiry_ms FROM newest WHERE NOT is_tombstone AND (expiry_ms IS NULL OR expiry_ms > {NOW_MS})
)"""


def series_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_type:second -> value, as telemetry is kept."""
    e = load(spark, sf_dir, "events")
    return e.select(padded(F.col("event_type"), F.floor(epoch_ms("ts") / 1000)).alias("key"), F.col("event_id").alias("seq"), money("value").alias("value"), F.lit(False).alias("is_tombstone"), F.lit(None).cast("bigint").alias("expiry_ms"))


SERIES = """
v AS (
  SELECT event_type || ':' || lpad(CAST(epoch_us(ts) // 1000000 AS VARCHAR), 10, '0') AS key, event_id AS seq, CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS value FROM events
), live AS (
  SELECT key, value FROM v QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1
)"""


def order_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """status:customer -> price of the newest order."""
    o = load(spark, sf_dir, "orders")
    return o.select(padded(F.col("o_orderstatus"), F.col("o_custkey")).alias("key"), F.col("o_orderkey").alias("seq"), money("o_totalprice").alias("value"), F.lit(False).alias("is_tombstone"), F.lit(None).cast("bigint").alias("expiry_ms"))


ORDERS = """
v AS (
  SELECT o_orderstatus || ':' || lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS key, o_orderkey AS seq, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS value FROM orders
), live AS (
  SELECT key, value FROM v QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1
)"""


def event_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of commands per user: writes, deletions, changes of expiry, increments and reads by turns."""
    e = load(spark, sf_dir, "events")
    k = F.col("event_id") % 7
    op = F.when(k == 0, "PUT").when(k == 1, "TTL").when(k == 2, "INCR").when(k == 3, "GET").when(k == 4, "DEL").when(k == 5, "INCR").otherwise("EXISTS")
    value = F.when(F.col("event_id") % 14 == 0, money("value")).otherwise((F.col("event_id") % 100).cast("string"))
    return e.select(padded(F.lit("u"), F.col("user_id")).alias("key"), F.col("event_id").alias("seq"), op.alias("op"), F.when(k == 0, value).alias("value"), F.when(k == 1, (F.col("event_id") % 4) * 86400).alias("ttl_secs"), epoch_ms("ts").alias("at_ms"))


def scripted(default_secs: int) -> str:
    """The answers to ``event_ops``, a command of each key after the other: f has key, n, seq, status, payload, and the value v and expiry e that are left."""
    due = f"o.at_ms + {1000 * default_secs}" if default_secs else "CAST(NULL AS BIGINT)"
    return f"""WITH RECURSIVE o AS (
  SELECT key, seq, at_ms, row_number() OVER (PARTITION BY key ORDER BY seq) AS n,
    CASE k WHEN 0 THEN 'PUT' WHEN 1 THEN 'TTL' WHEN 2 THEN 'INCR' WHEN 3 THEN 'GET' WHEN 4 THEN 'DEL' WHEN 5 THEN 'INCR' ELSE 'EXISTS' END AS op,
    CASE WHEN seq % 14 = 0 THEN money ELSE CAST(seq % 100 AS VARCHAR) END AS value, seq % 4 * 86400 AS ttl
  FROM (SELECT 'u:' || lpad(CAST(user_id AS VARCHAR), 10, '0') AS key, event_id AS seq, event_id % 7 AS k, epoch_us(ts) // 1000 AS at_ms, CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS money FROM events)
), f AS (
  SELECT DISTINCT key, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS VARCHAR) AS payload, CAST(NULL AS VARCHAR) AS v, CAST(NULL AS BIGINT) AS e FROM o
  UNION ALL
  SELECT key, n, seq,
    CASE WHEN op = 'PUT' THEN 'OK' WHEN op = 'INCR' THEN CASE WHEN alive AND NOT whole THEN 'ERROR' ELSE 'OK' END WHEN alive THEN 'OK' ELSE 'NOT_FOUND' END,
    CASE WHEN op = 'INCR' THEN CASE WHEN NOT alive THEN '1' WHEN whole THEN CAST(CAST(v AS BIGINT) + 1 AS VARCHAR) ELSE 'invalid digit found in string' END WHEN op = 'GET' AND alive THEN v END,
    CASE WHEN op = 'PUT' THEN value WHEN op = 'DEL' THEN NULL WHEN op = 'INCR' THEN CASE WHEN NOT alive THEN '1' WHEN whole THEN CAST(CAST(v AS BIGINT) + 1 AS VARCHAR) ELSE v END ELSE v END,
    CASE WHEN op = 'PUT' OR (op = 'INCR' AND NOT alive) THEN due WHEN op = 'DEL' THEN NULL WHEN op = 'TTL' AND alive THEN CASE WHEN ttl > 0 THEN at_ms + 1000 * ttl END ELSE e END
  FROM (
    SELECT o.*, f.v, f.e, {due} AS due, f.v IS NOT NULL AND (f.e IS NULL OR f.e > o.at_ms) AS alive, coalesce(regexp_full_match(f.v, '[+-]?[0-9]+'), false) AS whole
    FROM f JOIN o ON o.key = f.key AND o.n = f.n + 1
  )
)"""
