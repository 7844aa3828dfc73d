"""SimHash near-duplicates, with pigeonring filtering of the candidate pairs.

A 64-bit fingerprint is cut into 16 segments on a ring.  If two fingerprints differ in at most 2
bits, some start on the ring has every chain of l consecutive segments within l * 2/16 differing
bits: its first 7 segments are equal, and any prefix of the ring from there to 15 segments has at most
one difference.  So fingerprints are dealt by (start, 7 equal segments); within a bucket the chain
budgets prune before the full Hamming check.  A bucket beyond ``BUCKET`` distinct fingerprints is
dealt anew by the same rule over its remaining 36 bits, then 20; the last level can't exceed 4096.

Buckets emit a spanning forest of their links, so a large group of near copies costs as many rows
as it has members.  Components are joined up from those.

Rows: a null or empty text has fingerprint zero and is linked like any other.  A null doc_id gets its
component's smallest id, or null when nobody there has one.  Repeated rows are repeated in the
result.  Extra columns are ignored by ``near_duplicates``.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import Stored, table
from strandline.llm.components import components
from strandline.llm.near_copies import near_copies, node_of

#: Bits that may differ.
BUDGET = 2
#: Distinct fingerprints that one bucket may hold before it is dealt anew.
BUCKET = 4096
#: Ids of removed documents that may be broadcast (8 bytes each).
BROADCAST_IDS = 500_000
_BLOCK = 1 << 15
#: (bits of the ring, bits of a segment, segments that a chain within budget has equal)
LEVELS = ((64, 4, 7), (36, 4, 4), (20, 4, 2))


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """Bits set in over half the shingles' XXH64, as a signed 64-bit integer."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _BLOCK):
        end = min(n, at + _BLOCK)
        if n == 1:
            hashes = [digest(b" ".join(words), 42)]
        else:
            hashes = [digest(b" ".join(words[k : k + shingle]), 42) for k in range(at, end)]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def _fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([fingerprint(t) for t in texts], dtype="int64")


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fp") -> DataFrame:
    marks = F.pandas_udf(_fingerprints, "long").asNondeterministic()  # evaluated once, where it is written
    return docs.withColumn(out, marks(F.col(text).cast("binary")))


def _turned(value: Column, width: int, by: int) -> Column:
    """``value``, a number of ``width`` bits, turned right on its ring."""
    if not by:
        return value
    turned = F.shiftrightunsigned(value, by).bitwiseOR(F.shiftleft(value, width - by))
    return turned if width == 64 else turned.bitwiseAND(F.lit((1 << width) - 1))


def _dealt(rows: DataFrame, level: int) -> DataFrame:
    """Rows (fp, start, code, rest) by every start on the ring of ``rest``; code names the bucket."""
    width, segment, equal = LEVELS[level]
    bits = segment * equal
    choices = []
    for k in range(width // segment):
        turned = _turned(F.col("rest"), width, k * segment)
        start = F.lit(k) if level == 0 else F.col("start")
        code = F.shiftleft(F.col("code"), 4 + bits) if level < 2 else F.shiftleft(F.col("code"), 3 + bits)
        choices.append(F.struct(start.alias("start"), (code + F.lit(k << bits) + turned.bitwiseAND(F.lit((1 << bits) - 1))).alias("code"), F.shiftrightunsigned(turned, bits).alias("rest")))
    return rows.select("fp", F.explode(F.array(*choices)).alias("x")).select("fp", "x.*")


def _passes(x: np.ndarray, start: int) -> np.ndarray:
    """Chain budgets from ``start``, from short to long, then the Hamming check; x: differing bits."""
    turned = x if not start else (x >> np.uint64(4 * start)) | (x << np.uint64(64 - 4 * start))
    ok = np.bitwise_count(turned & np.uint64((1 << 32) - 1)) <= 1
    ok[ok] = np.bitwise_count(turned[ok] & np.uint64((1 << 60) - 1)) <= 1
    ok[ok] = np.bitwise_count(turned[ok]) <= BUDGET
    return ok


def _forest(fps: np.ndarray, start: int) -> list[tuple[int, int]]:
    """Links from members of a bucket to the least fingerprint that they reach in it."""
    values = np.sort(fps)
    bits, parent = values.view(np.uint64), list(range(len(values)))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    rows = max(1, (1 << 20) // len(values))
    for at in range(0, len(values), rows):
        block = np.arange(at, min(len(values), at + rows))
        xor = bits[block][:, None] ^ bits[at:][None, :]
        left, right = np.nonzero(_passes(xor.ravel(), start).reshape(xor.shape))
        later = right > left
        for a, b in zip((left[later] + at).tolist(), (right[later] + at).tolist()):
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
    return [(int(values[k]), int(values[root(k)])) for k in range(len(values)) if root(k) != k]


def _links(starts: pd.Series, buckets: pd.Series) -> pd.Series:
    out = []
    for start, fps in zip(starts, buckets):
        if len(fps) == 2:
            a, b = int(max(fps)), int(min(fps))
            x = (a ^ b) & ((1 << 64) - 1)
            out.append([{"a": a, "b": b}] if x.bit_count() <= BUDGET else [])
        else:
            out.append([{"a": a, "b": b} for a, b in _forest(np.asarray(fps, np.int64), int(start))])
    return pd.Series(out)


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) that connect what the fingerprints' links of at most 2 bits connect; fps: distinct fp."""
    rows = fps.select("fp", F.lit(0).alias("start"), F.lit(0).cast("long").alias("code"), F.col("fp").alias("rest"))
    found, within = None, F.pandas_udf(_links, "array<struct<a:long,b:long>>")
    for level in range(len(LEVELS)):
        dealt = _dealt(rows, level)
        shared = dealt.groupBy("code").agg(F.count("*").alias("n")).where("n > 1")
        kept = Stored(dealt.join(shared, "code"), "buckets").df
        own = kept.where(F.col("n") <= BUCKET).groupBy("start", "code").agg(F.collect_list("fp").alias("fps"))
        own = own.select(F.explode(within("start", "fps")).alias("x")).select("x.*")
        found = own if found is None else found.union(own)
        rows = kept.where(F.col("n") > BUCKET).select("fp", "start", "code", "rest")
        if rows.isEmpty():
            break
    return found


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, fp (long) and component_id of every row."""
    marked = Stored(with_fingerprint(docs.select("doc_id", F.col(text).alias("__text")), "__text").select("doc_id", "fp"), "fingerprints").df
    fps = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    to = components(links(fps)).df.select(F.col("a").alias("fp"), F.col("b").alias("root"))
    named = fps.join(to, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return marked.join(named.join(least, "root").select("fp", "component_id"), "fp")


def op3_simhash_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of each group of near copies with the smallest id; rows without id stay.

    The groups are those of ``near_copies`` (five words, similarity 0.8); 3 words and 2 bits are the query's contract only.
    Rows that share an id are told apart by their words: where they are no near copies, each group keeps its own.
    Of rows with equal ids and words the least stays.
    """
    found = near_copies(docs).where("doc_id IS NOT NULL")
    first = found.groupBy("root").agg(F.min(F.struct("doc_id", "node")).alias("first"))
    rows = found.join(first, "root").select("doc_id", "node", (F.struct("doc_id", "node") == F.col("first")).alias("leads"))
    rows = Stored(rows.groupBy("doc_id", "node").agg(F.count("*").alias("n"), F.first("leads").alias("leads")), "groups").df
    ids = rows.groupBy("doc_id").agg(F.sum("n").alias("n"), F.max("leads").alias("leads"))
    # few go in most corpora: up to BROADCAST_IDS ids travel to the texts, more are joined by a shuffle
    gone = ids.where("NOT leads OR n > 1").select("doc_id")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    again = rows.join(ids.where("n > 1").select("doc_id"), "doc_id", "left_semi").where("leads").select(F.col("doc_id").alias("__id"), F.col("node").alias("__node"))
    if not again.isEmpty():
        shared = docs.join(ids.where("leads AND n > 1").select("doc_id"), "doc_id", "left_semi").select(F.struct(*docs.columns).alias("x"), node_of("text").alias("__n"))
        shared = shared.join(again, (F.col("x.doc_id") == F.col("__id")) & (F.col("__n") == F.col("__node")))
        kept = kept.union(shared.groupBy("__id", "__node").agg(F.min("x").alias("x")).select("x.*"))
    return kept


QUERIES = {"op3_simhash_ring": op3_simhash_ring}
ORACLES: dict[str, str] = {}
