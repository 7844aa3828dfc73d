"""Commands that read what they change: TTL, INCR, DELETE's answer, and reads within a script.

Keys without any expiry in their log are answered by window functions alone: a value is what the last PUT or DEL left,
plus the INCRs since.  A key's log is cut into blocks of ``BLOCK`` seqs, each is summed up, and what a block begins
with is carried over from the sums, so a key with very many commands is split.

What other keys answer depends on the time of each command, so these are folded in order, by Python in
Arrow batches.  A PUT needs nothing of what was before, so each one begins a segment that is folded apart; a pass holds
one segment's current state.

ops: key, seq, op, value, ttl_secs, at_ms.  op is PUT, DEL, TTL, INCR, GET or EXISTS.  A null ttl_secs
means the collection's default, 0 never, n that many seconds from at_ms.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.numeric import I64, INT_MAX, integer_of, parse_i64

#: Seqs of a block.
BLOCK = 1 << 14
OPS = "key string, seq bigint, op string, value string, ttl_secs bigint, at_ms bigint"
RESULT = "key string, seq bigint, status string, payload string, writes boolean, value string, is_tombstone boolean, expiry_ms bigint"


def expiry(at_ms: int, ttl_secs: int | None, default_secs: int) -> int | None:
    """The time at which a write expires: by its own time to live, or else by the default; 0 is never."""
    seconds = default_secs if ttl_secs is None else ttl_secs
    return at_ms + 1000 * seconds if seconds else None


@dataclass
class KeyState:
    """The newest version of one key; ``value`` is None where there is none or it is deleted."""

    value: str | None = None
    expiry_ms: int | None = None

    def alive(self, now_ms: int) -> bool:
        return self.value is not None and (self.expiry_ms is None or self.expiry_ms > now_ms)

    def apply(self, op: str, value: str | None, ttl_secs: int | None, at_ms: int, default_secs: int = 0) -> tuple[str, str | None, bool]:
        """Carry out one command: (status, payload, whether a version was written)."""
        alive = self.alive(at_ms)
        if op == "PUT":
            self.value, self.expiry_ms = value or "", expiry(at_ms, ttl_secs, default_secs)
            return "OK", None, True
        if op == "DEL":
            self.value, self.expiry_ms = None, None
            return "OK" if alive else "NOT_FOUND", None, True
        if op == "TTL":
            if not alive:
                return "NOT_FOUND", None, False
            self.expiry_ms = at_ms + 1000 * ttl_secs if ttl_secs else None
            return "OK", None, True
        if op == "INCR":
            try:
                number = integer_of(self.value) if alive else 0
            except ValueError as e:
                return "ERROR", str(e), False
            if number == INT_MAX:
                return "ERROR", "increment would overflow", False
            if not alive:
                self.expiry_ms = expiry(at_ms, None, default_secs)
            self.value = str(number + 1)
            return "OK", self.value, True
        if op in ("GET", "EXISTS"):
            return ("OK" if alive else "NOT_FOUND"), (self.value if alive and op == "GET" else None), False
        return "ERROR", f"unknown op {op}", False


def _folded(ops: DataFrame, default_secs: int) -> DataFrame:
    """RESULT of each command, by ``KeyState``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, state = None, KeyState()
        number = lambda x: None if pd.isna(x) else int(x)
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                if place != (row.key, row.segment):
                    place, state = (row.key, row.segment), KeyState()
                text = None if pd.isna(row.value) else row.value
                status, payload, writes = state.apply(row.op, text, number(row.ttl_secs), int(row.at_ms), default_secs)
                out.append((row.key, row.seq, status, payload, writes, state.value if writes else None, writes and state.value is None, state.expiry_ms if writes else None))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")]).astype({"expiry_ms": "Int64"})

    segment = F.count_if(F.col("op") == "PUT").over(Window.partitionBy("key").orderBy("seq"))
    return ops.withColumn("segment", segment).repartition("key", "segment").sortWithinPartitions("key", "segment", "seq").mapInPandas(run, RESULT)


def _windowed(ops: DataFrame) -> DataFrame:
    """RESULT of each command of keys whose values never expire."""
    op, incr = F.col("op"), (F.col("op") == "INCR").cast("long")
    resets = op.isin("PUT", "DEL")
    left = F.when(resets, F.struct((op == "PUT").alias("put"), F.when(op == "PUT", F.coalesce("value", F.lit(""))).alias("value")))
    own = Window.partitionBy("key", "block").orderBy("seq")
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    rows = ops.withColumn("block", F.floor(F.col("seq") / BLOCK)).withColumn("c", F.sum(incr).over(own)).withColumn("left", left)
    # within the block: what the last reset before a command left, and the INCRs between
    rows = rows.withColumn("base", F.last("left", True).over(before)).withColumn("k", F.col("c") - incr - F.coalesce(F.last(F.when(resets, F.col("c")), True).over(before), F.lit(0)))
    after = F.struct("seq", F.coalesce("left", "base").alias("base"), F.when(resets, F.lit(0)).otherwise(F.col("k") + incr).alias("k"))
    sums = rows.groupBy("key", "block").agg(F.max_by(after, "seq").alias("x")).select("key", "block", "x.base", "x.k")
    # from block to block: the last reset, and the INCRs of its block and those since
    blocks = Window.partitionBy("key").orderBy("block")
    sums = sums.withColumn("total", F.sum("k").over(blocks))
    earlier = blocks.rowsBetween(Window.unboundedPreceding, -1)
    since = F.sum("k").over(earlier) - F.coalesce(F.last(F.when(F.col("base").isNotNull(), F.col("total") - F.col("k")), True).over(earlier), F.lit(0))
    carried = sums.select("key", "block", F.last("base", True).over(earlier).alias("carried"), F.coalesce(since, F.lit(0)).alias("k0"))
    rows = rows.join(carried, ["key", "block"])
    rows = rows.withColumn("k", F.col("k") + F.when(F.col("base").isNull(), F.col("k0")).otherwise(0)).withColumn("base", F.coalesce("base", "carried"))
    # the value before a command: a PUT's text, or a number once it was incremented
    text, put = F.col("base.value"), F.coalesce(F.col("base.put"), F.lit(False))
    number = F.when(put, parse_i64(text)).otherwise(F.lit(0)).cast("decimal(38,0)")
    reached = F.least(number + F.col("k"), F.lit(INT_MAX).cast("decimal(38,0)"))
    rows = rows.withColumn("number", number).withColumn("reached", reached)
    alive = put | (F.col("k") > 0)
    value = F.when((F.col("k") > 0) & F.col("number").isNotNull(), F.col("reached").cast("string")).otherwise(text)
    wrong = F.when(text == "", "cannot parse integer from empty string").when(~text.rlike(I64), "invalid digit found in string")
    wrong = wrong.when(text.startswith("-"), "number too small to fit in target type").otherwise("number too large to fit in target type")
    fails = F.col("number").isNull() | (F.col("reached") == INT_MAX)
    status = (
        F.when(op == "PUT", "OK")
        .when(op == "INCR", F.when(fails, "ERROR").otherwise("OK"))
        .when(op.isin("DEL", "GET", "EXISTS"), F.when(alive, "OK").otherwise("NOT_FOUND"))
        .otherwise("ERROR")
    )
    more = (F.col("reached") + 1).cast("string")
    payload = (
        F.when(op == "INCR", F.when(F.col("number").isNull(), wrong).when(fails, "increment would overflow").otherwise(more))
        .when((op == "GET") & alive, value)
        .when(~op.isin("PUT", "DEL", "INCR", "GET", "EXISTS"), F.concat(F.lit("unknown op "), op))
    )
    writes = resets | ((op == "INCR") & ~fails)
    kept = F.when(op == "PUT", F.coalesce("value", F.lit(""))).when((op == "INCR") & ~fails, more)
    return rows.select("key", "seq", status.alias("status"), payload.alias("payload"), writes.alias("writes"), kept.alias("value"), (op == "DEL").alias("is_tombstone"), F.lit(None).cast("bigint").alias("expiry_ms"))


def fold(ops: DataFrame, default_secs: int = 0) -> DataFrame:
    """RESULT for each command: its answer and, where it writes, the version that it leaves behind.

    A look at the log tells whether anything in it expires; where nothing does, keys needn't be told apart.
    """
    ops = ops.select("key", "seq", "op", "value", "ttl_secs", "at_ms")
    expires = (F.col("op") == "TTL") | ((F.col("op") == "PUT") & (F.coalesce("ttl_secs", F.lit(default_secs)) != 0)) | ((F.col("op") == "INCR") & F.lit(default_secs != 0))
    if ops.where(expires).isEmpty():
        return _windowed(ops)
    timed = ops.where(expires).select("key").distinct()
    return _windowed(ops.join(timed, "key", "left_anti")).union(_folded(ops.join(timed, "key", "left_semi"), default_secs))


def versions_of(results: DataFrame) -> DataFrame:
    """The versions that a fold wrote, for resolve."""
    return results.where("writes").select("key", "seq", "value", "is_tombstone", "expiry_ms")
