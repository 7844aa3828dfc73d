"""Queries by name, and their oracles for DuckDB."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.keys import key_crc32, padded
from strandline.functions.numeric import parse_f64, parse_i64
from strandline.operators import aggregate, compact, fold, point, resolve, scan
from strandline.operators.ttl import expiry_column
from strandline.plans.command import Command
from strandline.queries.mappings import DAY_MS, EVENTS, NOW_MS, ORDERS, SERIES, epoch_ms, event_ops, event_versions, load, money, order_versions, scripted, series_versions
from strandline.session import Session
from strandline.sources.files import scratch
from strandline.sources.store import VersionStore
from strandline.sources.wire import FrameParser, decode_command, encode_command
from strandline.streaming.ingest import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def add(name: str, query: Query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def live_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.live(event_versions(spark, sf_dir), NOW_MS, unique=True)


def numbers(condition: str, source: str = EVENTS) -> str:
    return f"WITH {source}, x AS (SELECT CAST(value AS DECIMAL(18,2)) AS d FROM live WHERE {condition})"


# the flagship: all reductions under a prefix
add(
    "reductions_prefix",
    lambda s, d: aggregate.reductions(live_events(s, d), scan.has_prefix("click:")),
    numbers("starts_with(key, 'click:')") + " SELECT count(*) AS n, CAST(sum(d) AS DOUBLE) AS sum, CAST(sum(d) AS DOUBLE) / nullif(CAST(count(*) AS DOUBLE), 0) AS avg, CAST(min(d) AS DOUBLE) AS min, CAST(max(d) AS DOUBLE) AS max, CAST(NULL AS VARCHAR) AS bad_key FROM x",
)

# point reads
add("get_hit", lambda s, d: point.read(live_events(s, d), "click:0000000005"), f"WITH {EVENTS} SELECT key, value FROM live WHERE key = 'click:0000000005'")
add("get_missing", lambda s, d: point.read(live_events(s, d), "nosuch:0000000000"), f"WITH {EVENTS} SELECT key, value FROM live WHERE key = 'nosuch:0000000000'")


def _of_state(s: SparkSession, d: str, tombstone: bool) -> DataFrame:
    """Point reads of every key whose newest version is deleted, or has expired: none may be found."""
    versions = event_versions(s, d)
    newest = resolve.newest(versions, unique=True)
    dead = newest.where("is_tombstone") if tombstone else newest.where(f"NOT is_tombstone AND expiry_ms <= {NOW_MS}")
    found = point.exists_many(resolve.live(versions, NOW_MS, unique=True), dead.select(F.col("seq").alias("pos"), "key"))
    return found.groupBy("found").agg(F.count("*").alias("n"))


_DEAD = "SELECT CAST(live.key IS NOT NULL AS BOOLEAN) AS found, count(*) AS n FROM newest LEFT JOIN live ON newest.key = live.key WHERE {} GROUP BY 1"
add("get_deleted", lambda s, d: _of_state(s, d, True), f"WITH {EVENTS} " + _DEAD.format("newest.is_tombstone"))
add("get_expired", lambda s, d: _of_state(s, d, False), f"WITH {EVENTS} " + _DEAD.format(f"NOT newest.is_tombstone AND newest.expiry_ms <= {NOW_MS}"))


def _asked(s: SparkSession, d: str) -> DataFrame:
    """Each customer's open order, asked for twice, and as often one that can't be there."""
    c = load(s, d, "customer")
    key = F.concat(F.lit("O:"), F.lpad(F.col("c_custkey").cast("string"), 10, "0"))
    return c.select(F.explode(F.array(F.struct((F.col("c_custkey") * 3).alias("pos"), key.alias("key")), F.struct((F.col("c_custkey") * 3 + 1).alias("pos"), key.alias("key")), F.struct((F.col("c_custkey") * 3 + 2).alias("pos"), F.concat(F.lit("?"), key).alias("key")))).alias("x")).select("x.*")


_ASKED = "asked AS (SELECT c_custkey * 3 + i AS pos, CASE WHEN i = 2 THEN '?' ELSE '' END || 'O:' || lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS key FROM customer, (VALUES (0), (1), (2)) t(i))"
add("mget_ordered", lambda s, d: point.mget(resolve.live(order_versions(s, d), NOW_MS, unique=True), _asked(s, d)), f"WITH {ORDERS}, {_ASKED} SELECT pos, asked.key, value FROM asked LEFT JOIN live ON asked.key = live.key")
add("exists_batch", lambda s, d: point.exists_many(resolve.live(order_versions(s, d), NOW_MS, unique=True), _asked(s, d)), f"WITH {ORDERS}, {_ASKED} SELECT pos, asked.key, live.key IS NOT NULL AS found FROM asked LEFT JOIN live ON asked.key = live.key")
add("list_keys", lambda s, d: scan.list_keys(live_events(s, d)), f"WITH {EVENTS} SELECT key FROM live")

# ordered scans
for name, start, end in (("range_inclusive", "click:0000000010", "purchase:0000000100"), ("range_inverted", "z", "a"), ("range_single", "click:0000000005", "click:0000000005"), ("range_series", "click:1704067200", "click:1706000000")):
    rows = (lambda s, d: resolve.live(series_versions(s, d), NOW_MS, unique=True)) if name == "range_series" else live_events
    add(name, lambda s, d, rows=rows, start=start, end=end: scan.scan_range(rows(s, d), start, end), f"WITH {SERIES if name == 'range_series' else EVENTS} SELECT key, value FROM live WHERE key BETWEEN '{start}' AND '{end}'")
for name, prefix in (("prefix_basic", "view:"), ("prefix_empty", ""), ("prefix_boundary", "click:000000001"), ("prefix_none", "clicks")):
    add(name, lambda s, d, prefix=prefix: scan.scan_prefix(live_events(s, d), prefix), f"WITH {EVENTS} SELECT key, value FROM live WHERE starts_with(key, '{prefix}')")

# counts and reductions
_BOUNDS = {"prefix": (scan.has_prefix, ("click:",), "starts_with(key, 'click:')"), "range": (scan.in_range, ("click:0000000010", "purchase:0000000100"), "key BETWEEN 'click:0000000010' AND 'purchase:0000000100'")}
for kind, (make, bounds, where) in _BOUNDS.items():
    add(f"count_{kind}", lambda s, d, make=make, bounds=bounds: scan.count(live_events(s, d), make(*bounds)), f"WITH {EVENTS} SELECT count(*) AS n FROM live WHERE {where}")
    for op in aggregate.NAMES:
        value = "CAST(sum(d) AS DOUBLE) / nullif(CAST(count(*) AS DOUBLE), 0)" if op == "avg" else f"CAST({op}(d) AS DOUBLE)"
        add(f"{op}_{kind}", lambda s, d, make=make, bounds=bounds, op=op: aggregate.reduce_one(live_events(s, d), make(*bounds), op), numbers(where) + f" SELECT {value} AS value, CAST(NULL AS VARCHAR) AS bad_key FROM x")
add("count_inverted", lambda s, d: scan.count(live_events(s, d), scan.in_range("z", "a")), f"WITH {EVENTS} SELECT count(*) AS n FROM live WHERE false")
add("count_everything", lambda s, d: scan.count(live_events(s, d), scan.has_prefix("")), f"WITH {EVENTS} SELECT count(*) AS n FROM live")
add("agg_empty", lambda s, d: aggregate.reductions(live_events(s, d), scan.has_prefix("disk:")).select("n", "sum", "min", "max"), "SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS DOUBLE) AS sum, CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max")


def _with_nan(s: SparkSession, d: str) -> DataFrame:
    """Every hundredth live value is NaN."""
    rows = live_events(s, d)
    return rows.withColumn("value", F.when(F.substring("key", -2, 2) == "00", F.lit("NaN")).otherwise(F.col("value")))


for op in ("min", "max"):
    add(
        f"agg_nan_{op}",
        lambda s, d, op=op: aggregate.reduce_one(_with_nan(s, d), scan.has_prefix(""), op).select(F.isnan("value").alias("is_nan"), "bad_key"),
        f"WITH {EVENTS} SELECT bool_or(key LIKE '%00') AS is_nan, CAST(NULL AS VARCHAR) AS bad_key FROM live",
    )
add(
    "agg_not_numeric",
    lambda s, d: aggregate.reduce_one(live_events(s, d).withColumn("value", F.when(F.substring("key", -1, 1) == "3", F.concat("value", F.lit("d"))).otherwise(F.col("value"))), scan.has_prefix(""), "sum"),
    f"WITH {EVENTS} SELECT CAST(NULL AS DOUBLE) AS value, min(key) AS bad_key FROM live WHERE key LIKE '%3'",
)

# resolution
add("newest_wins", lambda s, d: resolve.newest(event_versions(s, d)), f"WITH {EVENTS} SELECT key, seq, value, is_tombstone, expiry_ms FROM newest")
add("live_rows", live_events, f"WITH {EVENTS} SELECT key, value, expiry_ms FROM live")


def _shadowed(s: SparkSession, d: str, newest_is: str) -> DataFrame:
    """Keys that are dead although an older version would be alive."""
    v = event_versions(s, d)
    alive = v.where(resolve.alive(NOW_MS)).select("key").distinct()
    return resolve.newest(v, unique=True).where(newest_is).join(alive, "key", "left_semi").select("key", "seq")


_OLDER = f"EXISTS (SELECT 1 FROM v WHERE v.key = newest.key AND NOT v.is_tombstone AND (v.expiry_ms IS NULL OR v.expiry_ms > {NOW_MS}))"
add("tombstone_shadow", lambda s, d: _shadowed(s, d, "is_tombstone"), f"WITH {EVENTS} SELECT key, seq FROM newest WHERE is_tombstone AND {_OLDER}")
add("expired_newest_shadows_older_live", lambda s, d: _shadowed(s, d, f"NOT is_tombstone AND expiry_ms <= {NOW_MS}"), f"WITH {EVENTS} SELECT key, seq FROM newest WHERE NOT is_tombstone AND expiry_ms <= {NOW_MS} AND {_OLDER}")

# time to live
_TTLS = {"ttl_default": (None, 3 * 86400), "ttl_explicit_zero": (0, 3 * 86400), "ttl_explicit": (86400, 3 * 86400), "ttl_none": (None, 0)}
for name, (ttl, default) in _TTLS.items():
    seconds = default if ttl is None else ttl

    def _written(s, d, ttl=ttl, default=default):
        e = load(s, d, "events")
        rows = e.select(F.col("event_id").cast("string").alias("key"), F.col("event_id").alias("seq"), money("value").alias("value"), F.lit(False).alias("is_tombstone"), expiry_column(epoch_ms("ts"), F.lit(ttl).cast("bigint"), default).alias("expiry_ms"))
        return resolve.live(rows, NOW_MS, unique=True)

    due = f"epoch_us(ts) // 1000 + {seconds * 1000}" if seconds else "CAST(NULL AS BIGINT)"
    add(name, _written, f"SELECT CAST(event_id AS VARCHAR) AS key, CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS value, {due} AS expiry_ms FROM events WHERE {due} IS NULL OR {due} > {NOW_MS}")


def _ops(s: SparkSession, d: str, second: str, ttl: int | None) -> DataFrame:
    """Two commands for each event's key: a write that expires in a day, then ``second`` an hour later."""
    e = load(s, d, "events").select(F.col("event_id").cast("string").alias("key"), F.col("event_id").alias("seq"), money("value").alias("value"), epoch_ms("ts").alias("at_ms"))
    one = e.select("key", (F.col("seq") * 2).alias("seq"), F.lit("PUT").alias("op"), "value", F.lit(86400).cast("bigint").alias("ttl_secs"), "at_ms")
    two = e.select("key", (F.col("seq") * 2 + 1).alias("seq"), F.lit(second).alias("op"), "value", F.lit(ttl).cast("bigint").alias("ttl_secs"), (F.col("at_ms") + 3_600_000).alias("at_ms"))
    return one.union(two)


def _left(s: SparkSession, d: str, second: str, ttl: int | None) -> DataFrame:
    return resolve.live(fold.versions_of(fold.fold(_ops(s, d, second, ttl))), NOW_MS, unique=True)


_ALL = "SELECT CAST(event_id AS VARCHAR) AS key, CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS value, {0} AS expiry_ms FROM events WHERE coalesce({0} > %d, true)" % NOW_MS
add("ttl_persist", lambda s, d: _left(s, d, "TTL", 0), _ALL.format("CAST(NULL AS BIGINT)"))
add("ttl_set", lambda s, d: _left(s, d, "TTL", 7 * 86400), _ALL.format(f"epoch_us(ts) // 1000 + {3_600_000 + 7 * DAY_MS}"))
add("overwrite_clears_ttl", lambda s, d: _left(s, d, "PUT", None), _ALL.format("CAST(NULL AS BIGINT)"))

# mutations
def _stored(s: SparkSession) -> VersionStore:
    return VersionStore(s, f"{scratch(s)}/store-{uuid.uuid4().hex}")


def _mset(s: SparkSession, d: str) -> DataFrame:
    """All orders in two batches of a store, the later one by the later orders; the last write of a key wins."""
    store, rows = _stored(s), order_versions(s, d)
    middle = rows.agg(F.floor(F.avg("seq"))).first()[0] or 0
    for part in (rows.where(F.col("seq") <= middle), rows.where(F.col("seq") > middle)):
        store.append("default", part.withColumnRenamed("seq", "pos"))
    return store.live("default", NOW_MS).select("key", "value")


add("mset_last_wins", _mset, f"WITH {ORDERS} SELECT key, value FROM live")


def _hits(s: SparkSession, d: str) -> DataFrame:
    """One INCR of a user's counter for each event."""
    e = load(s, d, "events")
    return e.select(F.concat(F.lit("hits:"), F.lpad(F.col("user_id").cast("string"), 10, "0")).alias("key"), F.col("event_id").alias("seq"), F.lit("INCR").alias("op"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("bigint").alias("ttl_secs"), epoch_ms("ts").alias("at_ms"))


add("incr_counts", lambda s, d: resolve.live(fold.versions_of(fold.fold(_hits(s, d))), NOW_MS, unique=True).select("key", "value"), "SELECT 'hits:' || lpad(CAST(user_id AS VARCHAR), 10, '0') AS key, CAST(count(*) AS VARCHAR) AS value FROM events GROUP BY user_id")
add("incr_answers", lambda s, d: fold.fold(_hits(s, d)).select("key", "seq", "status", "payload"), "SELECT 'hits:' || lpad(CAST(user_id AS VARCHAR), 10, '0') AS key, event_id AS seq, 'OK' AS status, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS VARCHAR) AS payload FROM events")


def _deletes(s: SparkSession, d: str) -> DataFrame:
    e = load(s, d, "events")
    return e.select(F.col("event_type").alias("key"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 == 0, "PUT").otherwise("DEL").alias("op"), money("value").alias("value"), F.lit(None).cast("bigint").alias("ttl_secs"), epoch_ms("ts").alias("at_ms"))


add(
    "delete_status",
    lambda s, d: fold.fold(_deletes(s, d)).select("key", "seq", "status"),
    "SELECT event_type AS key, event_id AS seq, CASE WHEN event_id % 3 = 0 OR lag(event_id) OVER (PARTITION BY event_type ORDER BY event_id) % 3 = 0 THEN 'OK' ELSE 'NOT_FOUND' END AS status FROM events",
)
add("script_fold", lambda s, d: fold.fold(event_ops(s, d), 3 * 86400).select("key", "seq", "status", "payload"), f"{scripted(3 * 86400)} SELECT key, seq, status, payload FROM f WHERE n > 0")


def _intact(s: SparkSession, d: str) -> DataFrame:
    """Each INCR that fails, and what a GET right after it finds."""
    e = event_ops(s, d).withColumn("seq", F.col("seq") * 2)
    looks = e.where("op = 'INCR'").select("key", (F.col("seq") + 1).alias("seq"), F.lit("GET").alias("op"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("bigint").alias("ttl_secs"), "at_ms")
    found = fold.fold(e.unionByName(looks))
    failed = found.where("status = 'ERROR'").select("key", "seq", F.col("payload").alias("problem"))
    return failed.join(found.select("key", (F.col("seq") - 1).alias("seq"), F.col("payload").alias("value")), ["key", "seq"])


add("incr_error_intact", _intact, f"{scripted(0)} SELECT key, seq * 2 AS seq, payload AS problem, v AS value FROM f WHERE status = 'ERROR'")


def _compacted(s: SparkSession, d: str) -> DataFrame:
    return resolve.live(compact.compacted(event_versions(s, d), NOW_MS), NOW_MS, unique=True)


add("compact_equivalence", _compacted, f"WITH {EVENTS} SELECT key, value, expiry_ms FROM live")


def filled(s: SparkSession, d: str) -> VersionStore:
    """A store that holds the events in three parts."""
    store, rows = _stored(s), event_versions(s, d).withColumnRenamed("seq", "pos")
    for k in range(3):
        # positions count from the part's beginning; the parts follow each other in the order of events
        low, high = rows.agg(F.min("pos"), F.max("pos")).first()
        if low is None:
            return store
        step = (high - low) // 3 + 1
        part = rows.where(F.col("pos").between(low + k * step, low + (k + 1) * step - 1))
        store.append("default", part.withColumn("pos", F.col("pos") - F.lit(low + k * step)))
    return store


def _store_compaction(s: SparkSession, d: str) -> DataFrame:
    """Live rows by a reader from before COMPACT and by one from after it, with what the collection then holds."""
    store = filled(s, d)
    before, rows = store.live("default", NOW_MS), store.versions("default").count()
    store.compact("default", NOW_MS)
    counts = store.versions("default").agg(F.count("*").alias("n_after")).withColumn("n_before", F.lit(rows).cast("bigint"))
    both = before.withColumn("reader", F.lit("before")).unionByName(store.live("default", NOW_MS).withColumn("reader", F.lit("after")))
    return both.crossJoin(F.broadcast(counts))  # one row


add(
    "store_compaction",
    _store_compaction,
    f"WITH {EVENTS} SELECT key, value, expiry_ms, reader, (SELECT count(*) FROM v) AS n_before, (SELECT count(*) FROM live) AS n_after FROM live, (VALUES ('before'), ('after')) t(reader)",
)
add("store_prefix", lambda s, d: scan.scan_prefix(filled(s, d).live("default", NOW_MS), "view:"), f"WITH {EVENTS} SELECT key, value FROM live WHERE starts_with(key, 'view:')")


def _streamed(s: SparkSession, d: str) -> DataFrame:
    """The events as a stream of commands into a store: writes that expire, and deletions."""
    store = _stored(s)
    events = s.readStream.schema(load(s, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    op = F.when(F.col("event_id") % 10 == 7, "DEL").otherwise("PUT")
    ttl = F.when(F.col("event_id") % 3 == 0, 5 * 86400).otherwise(0).cast("bigint")
    ops = events.select(padded(F.col("event_type"), F.col("user_id")).alias("key"), F.col("event_id").alias("seq"), op.alias("op"), money("value").alias("value"), ttl.alias("ttl_secs"), epoch_ms("ts").alias("at_ms"))
    ingest(ops, store, "default", f"{store.root}/checkpoint").awaitTermination()
    return store.live("default", NOW_MS)


add("stream_ingest", _streamed, f"WITH {EVENTS} SELECT key, value, expiry_ms FROM live")


def _framed(s: SparkSession, d: str) -> DataFrame:
    """A WRITE for each event as frames of bytes, cut anywhere, and read back."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sent = b"".join(encode_command(Command("WRITE", items=((k, v, None if pd.isna(t) else int(t)),))) for k, v, t in zip(pdf["key"], pdf["value"], pdf["ttl"]))
            parser = FrameParser()
            got = [decode_command(f).items[0] for at in range(0, len(sent), 1000) for f in parser.feed(sent[at : at + 1000])]
            yield pd.DataFrame(got, columns=["key", "value", "ttl"]).astype({"ttl": "Int64"})

    e = load(s, d, "events")
    rows = e.select(padded(F.col("event_type"), F.col("event_id")).alias("key"), money("value").alias("value"), F.when(F.col("event_id") % 2 == 0, F.col("event_id") % 100).alias("ttl"))
    return rows.mapInPandas(run, "key string, value string, ttl bigint")


add("wire_round_trip", _framed, "SELECT event_type || ':' || lpad(CAST(event_id AS VARCHAR), 10, '0') AS key, CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS value, CASE WHEN event_id % 2 = 0 THEN event_id % 100 END AS ttl FROM events")


def _commands(s: SparkSession, d: str) -> DataFrame:
    """A session over the nations: what each command answers."""
    session = Session(_stored(s), clock=lambda: NOW_MS)
    nations = [(f"nation:{r['n_nationkey']:03d}", str(r["n_regionkey"]), None) for r in load(s, d, "nation").orderBy("n_nationkey").collect()]
    session.execute(Command("MSET", items=tuple(nations)))
    session.run("WRITE other x")
    lines = ["COUNT nation:", "SUM nation:", "MAX nation:000 nation:009", "READ nation:003", "MGET nation:001 nowhere", "RANGE nation:020 nation:022", "SUM other", "DELETE nation:003", "DELETE nation:003", "INCR nation:004", "COUNT nation:", "EXISTS nation:003", "INCR fresh", "SUM disk:"]
    answers = [(k, line, r.status, "|".join(r.payload)) for k, line in enumerate(lines) for r in [session.run(line)]]
    return s.createDataFrame(answers, "n long, line string, status string, answer string")


add(
    "session_commands",
    _commands,
    """WITH t AS (SELECT 'nation:' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS key, n_regionkey AS r FROM nation)
SELECT CAST(0 AS BIGINT) AS n, 'COUNT nation:' AS line, 'OK' AS status, (SELECT CAST(count(*) AS VARCHAR) FROM t) AS answer
UNION ALL SELECT 1, 'SUM nation:', 'OK', (SELECT CAST(CAST(sum(r) AS DOUBLE) AS VARCHAR) FROM t)
UNION ALL SELECT 2, 'MAX nation:000 nation:009', 'OK', (SELECT CAST(CAST(max(r) AS DOUBLE) AS VARCHAR) FROM t WHERE key <= 'nation:009')
UNION ALL SELECT 3, 'READ nation:003', 'OK', (SELECT CAST(r AS VARCHAR) FROM t WHERE key = 'nation:003')
UNION ALL SELECT 4, 'MGET nation:001 nowhere', 'OK', (SELECT key || '|' || r || '|nowhere|' || chr(0) FROM t WHERE key = 'nation:001')
UNION ALL SELECT 5, 'RANGE nation:020 nation:022', 'OK', (SELECT string_agg(key || '|' || r, '|' ORDER BY key) FROM t WHERE key BETWEEN 'nation:020' AND 'nation:022')
UNION ALL SELECT 6, 'SUM other', 'ERROR', 'SUM: non-numeric value for key other'
UNION ALL SELECT 7, 'DELETE nation:003', 'OK', ''
UNION ALL SELECT 8, 'DELETE nation:003', 'NOT_FOUND', ''
UNION ALL SELECT 9, 'INCR nation:004', 'OK', (SELECT CAST(r + 1 AS VARCHAR) FROM t WHERE key = 'nation:004')
UNION ALL SELECT 10, 'COUNT nation:', 'OK', (SELECT CAST(count(*) - 1 AS VARCHAR) FROM t)
UNION ALL SELECT 11, 'EXISTS nation:003', 'NOT_FOUND', ''
UNION ALL SELECT 12, 'INCR fresh', 'OK', '1'
UNION ALL SELECT 13, 'SUM disk:', 'NOT_FOUND', ''""",
)


def _by_part(s: SparkSession, d: str) -> DataFrame:
    """part -> price; a line's place among the lines of all orders is its seq, the remaining columns break ties."""
    place = F.struct("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_suppkey")
    return load(s, d, "lineitem").select(padded(F.lit("p"), F.col("l_partkey")).alias("key"), place.alias("seq"), money("l_extendedprice").alias("value"), F.lit(False).alias("is_tombstone"), F.lit(None).cast("bigint").alias("expiry_ms"))


# heavy overwrite
add(
    "last_price_by_part",
    lambda s, d: resolve.newest(_by_part(s, d)).where(resolve.alive(NOW_MS)).select("key", F.col("seq.l_orderkey").alias("seq"), "value"),
    "SELECT 'p:' || lpad(CAST(l_partkey AS VARCHAR), 10, '0') AS key, l_orderkey AS seq, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS value FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC, l_quantity DESC, l_discount DESC, l_tax DESC, l_suppkey DESC) = 1",
)


# collections
def _collections(s: SparkSession, d: str) -> VersionStore:
    """A collection for each event type, with a default time to live of its own, holding the values of users."""
    store = _stored(s)
    e = load(s, d, "events").select("event_type", F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("pos"), money("value").alias("value"), F.lit(False).alias("is_tombstone"), F.lit(None).cast("bigint").alias("expiry_ms"))
    for name in sorted(r[0] for r in e.select("event_type").distinct().collect()):
        store.catalog.create(name, 60 * len(name))
        store.append(name, e.where(F.col("event_type") == name).drop("event_type"))
    return store


def _isolated(s: SparkSession, d: str) -> DataFrame:
    """The same keys in all collections: each answers from its own."""
    store = _collections(s, d)
    found = [store.live(name, NOW_MS).select(F.lit(name).alias("collection"), "key", "value") for name, _ in store.catalog.show()]
    return reduce(DataFrame.union, found)


add("collections_isolation", _isolated, "SELECT event_type AS collection, CAST(user_id AS VARCHAR) AS key, CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS value FROM events QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id DESC) = 1")
add("show_collections", lambda s, d: _collections(s, d).catalog.table(), "SELECT DISTINCT event_type AS name, CAST(60 * length(event_type) AS BIGINT) AS default_ttl_secs FROM events UNION ALL SELECT 'default', 0")

# scalar functions
_TEXTS = ["+1", ".5", "5.", "1e5", "1e+5", "inf", "-inf", "+INFINITY", "-0", "", " 1 ", "\t1", "1\n", "1d", "1.0f", "0x1p3", "1_0", ".", "1e", "+", "e5", "0", "-5", "9223372036854775807", "9223372036854775808", "1.5"]


def _parsed(s: SparkSession, d: str) -> DataFrame:
    """What each event's value, and each of some texts, is as a float and as an integer; null if it is none."""
    e = load(s, d, "events").select(money("value").alias("value"))
    texts = e.select(F.explode(F.array(F.col("value"), *[F.lit(t) for t in _TEXTS])).alias("text"))
    return texts.groupBy("text").agg(F.count("*").alias("n")).select("text", "n", parse_f64(F.col("text")).alias("as_float"), parse_i64(F.col("text")).alias("as_integer"))


_LIST = ", ".join("('" + t + "')" if t not in ("\t1", "1\n") else ("(chr(9) || '1')" if t == "\t1" else "('1' || chr(10))") for t in _TEXTS)
add(
    "parse_numbers",
    _parsed,
    f"""WITH t AS (SELECT CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS text FROM events UNION ALL SELECT x FROM events, (VALUES {_LIST}) v(x))
SELECT text, count(*) AS n, CASE WHEN regexp_full_match(text, '[+-]?(([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))') THEN TRY_CAST(text AS DOUBLE) END AS as_float,
  CASE WHEN regexp_full_match(text, '[+-]?[0-9]+') THEN TRY_CAST(text AS BIGINT) END AS as_integer FROM t GROUP BY text""",
)
# the polynomial's table and the steps over a key's bytes, by rule
_CRC = """c AS MATERIALIZED (
  SELECT list_transform(range(256), lambda i: list_reduce(CAST(range(8) AS BIGINT[]), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, CAST(i AS BIGINT))) AS x
)"""
add(
    "key_checksums",
    lambda s, d: live_events(s, d).select("key", F.length("key").cast("bigint").alias("size"), key_crc32(F.col("key")).alias("crc")),
    f"""WITH {EVENTS}, {_CRC} SELECT key, CAST(length(key) AS BIGINT) AS size,
  xor(4294967295, list_reduce(list_transform(range(1, strlen(key) + 1), lambda i: CAST(ascii(substr(key, i, 1)) AS BIGINT)), lambda a, b: xor(a >> 8, x[(xor(a, b) & 255) + 1]), CAST(4294967295 AS BIGINT))) AS crc FROM live, c""",
)


def entry(spark: SparkSession) -> DataFrame:
    return QUERIES["reductions_prefix"](spark, "/root/testdata/sf0.001")
