"""Benchmark decontamination by spaced-seed hashing.

Fixed masks look at some of the words in a short window and ignore the rest, so a substituted word
spoils only the windows in which it is looked at.  The masks' hashes of the benchmark are joined with
those of every document; around each hit the item and the document are compared word by word along
their common diagonal.  The overlap is the best-scoring stretch (match +1, substitution -2) if that
counts, else the longest stretch that does.

A stretch counts from ``OVERLAP`` words on, or from a whole item's words if it has fewer, with at
least ``IDENTITY`` of them equal.  However these are spread, one of the masks hits such a stretch (a test
has the proof).  Words are lower-cased and stripped of ASCII punctuation.  Items under ``MASKED`` words
are matched whole and exactly, wherever they stand; items under ``SHORTEST`` words, which can't be told from
ordinary prose, match documents that consist of nothing else.

The benchmark reaches the executors in blocks of at most ``BLOCK_WORDS`` words, however large it is.
A block is compared with all documents, its findings are stored, and it is taken back before the next
one, so what is broadcast at a time is bounded.

Rows: null and empty texts overlap nothing, items without a word neither.  A null doc_id is carried through.  Repeated items are
one, under their least item_id; an item without id or text is left out.  Repeated documents are
repeated in the result.  An empty benchmark marks nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import Stored, table

MASKS = ("100110001", "1010011", "1100101", "1111")
OVERLAP, IDENTITY, SHORTEST, MASKED = 13, 0.7, 5, 10
BLOCK_WORDS = 1_000_000
CHUNK_BYTES = 1 << 18
_PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_STEP = np.uint64(0x9E3779B97F4A7C15)
_TABLE_BITS = 22


def plain(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "replace").translate(None, _PUNCTUATION)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word: differences of prefix sums of byte * step**position."""
    buf = np.frombuffer(data + b"\n", np.uint8)
    space = _SPACE[buf]
    before = np.concatenate(([True], space[:-1]))
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * np.cumprod(np.full(len(buf), _STEP, np.uint64)))))
        back = np.cumprod(np.full(len(buf), pow(int(_STEP), -1, 1 << 64), np.uint64))
        return _mixed((sums[ends] - sums[starts]) * back[starts]), starts


def _seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """The mask's hash at each start; the mask's text tells equal windows of different masks apart."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(hash_of_mask(mask)))
    with np.errstate(over="ignore"):
        for k, sign in enumerate(mask):
            if sign == "1":
                out = out * np.uint64(0x100000001B3) + words[k : k + n]
        return _mixed(out)


def hash_of_mask(mask: str) -> int:
    return int("1" + mask, 2) * 0x9E3779B1 & 0xFFFFFFFFFFFFFFFF


class SeedIndex:
    """The seeds of one block of items."""

    def __init__(self, items: list[tuple[int, bytes]]):
        least: dict[bytes, int] = {}
        for item, text in items:
            key = b" ".join(text.split())
            least[key] = min(item, least.get(key, item))
        self.ids = np.array(sorted(least.values()), np.int64)
        by_id = {i: t for t, i in least.items()}
        self.tiny = {t: i for t, i in least.items() if 0 < len(t.split()) < SHORTEST}
        self.words = [word_hashes(by_id[i])[0] for i in self.ids.tolist()]
        #: What a part of a long text has in common with the next: as many words as the longest item.
        self.shared = re.compile(rb"[\x09-\x0d\x20]*(?:[^\x09-\x0d\x20]+[\x09-\x0d\x20]*+){0,%d}" % max(map(len, self.words), default=0))
        self.masks = list(MASKS) + sorted({"1" * len(w) for w in self.words if SHORTEST <= len(w) < MASKED})
        hashes, owner, at = [], [], []
        for k, words in enumerate(self.words):
            if len(words) < SHORTEST:
                continue
            for mask in self.masks:
                if (len(words) < MASKED) == (mask == "1" * len(words)):
                    seeds = _seeds(words, mask)
                    hashes.append(seeds)
                    owner.append(np.full(len(seeds), k))
                    at.append(np.arange(len(seeds)))
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.hashes = h[order]
        self.owner = np.concatenate(owner)[order] if hashes else np.zeros(0, np.int64)
        self.at = np.concatenate(at)[order] if hashes else np.zeros(0, np.int64)
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[self.hashes >> np.uint64(64 - _TABLE_BITS)] = True

    def overlaps(self, texts: list[bytes]) -> dict[tuple[int, int], tuple[int, int]]:
        """(row, item_id) -> (equal words, words) of the best overlap; texts as ``plain`` gives them."""
        found: dict[tuple[int, int], tuple[int, int]] = {}
        if self.tiny:
            for row, text in enumerate(texts):
                few = text.split(None, SHORTEST - 1)
                if len(few) < SHORTEST and (key := b" ".join(few).rstrip()) in self.tiny:
                    found[row, self.tiny[key]] = len(few), len(few)
        if not len(self.hashes):
            return found
        for rows, parts in self._pieces(texts):
            words, starts = word_hashes(b"\n".join(parts))
            sizes = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
            part = np.searchsorted(np.cumsum(sizes), starts, "right")
            bounds = np.searchsorted(part, np.arange(len(parts) + 1))
            hits = []
            for mask in self.masks:
                seeds = _seeds(words, mask)
                near = np.flatnonzero(self.table[seeds >> np.uint64(64 - _TABLE_BITS)])
                near = near[part[near] == part[near + len(mask) - 1]]
                lo, hi = np.searchsorted(self.hashes, seeds[near], "left"), np.searchsorted(self.hashes, seeds[near], "right")
                n = hi - lo
                if n.any():
                    where = np.repeat(near, n)
                    entry = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    hits.append(np.stack([part[where], self.owner[entry], where - self.at[entry]], 1))
            if not hits:
                continue
            for p, k, origin in np.unique(np.concatenate(hits), axis=0).tolist():
                best = self._stretch(words, self.words[k], origin, bounds[p], bounds[p + 1])
                key = rows[p], int(self.ids[k])
                if best and best > found.get(key, (0, 0)):
                    found[key] = best
        return found

    @staticmethod
    def _stretch(words: np.ndarray, item: np.ndarray, origin: int, first: int, end: int) -> tuple[int, int] | None:
        lo, hi = max(0, first - origin), min(len(item), end - origin)
        equal = words[origin + lo : origin + hi] == item[lo:hi]
        sums = np.concatenate(([0], np.cumsum(np.where(equal, 1, -2))))
        gain = sums - np.minimum.accumulate(sums)
        stop = int(gain.argmax())
        start = int(sums[: stop + 1].argmin()) if stop else 0
        n, same, need = stop - start, int(equal[start:stop].sum()), min(OVERLAP, len(item))
        if n >= need and same >= IDENTITY * n:
            return same, n
        # the longest stretch with enough equal words: for each end, the first start whose sum isn't larger
        sums = np.concatenate(([0], np.cumsum(np.where(equal, 100, 0) - round(100 * IDENTITY))))
        starts = np.searchsorted(-np.minimum.accumulate(sums), -sums, "left")
        sizes = np.arange(len(sums)) - starts
        stop = int(sizes.argmax())
        n = int(sizes[stop])
        return (int(equal[stop - n : stop].sum()), n) if n >= need else None

    def _pieces(self, texts: list[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
        """Texts in groups of about CHUNK_BYTES; a longer one in parts that share as many words as any item has."""
        rows, parts, size = [], [], 0
        for row, text in enumerate(texts):
            at = 0
            while at < len(text):
                end = at + CHUNK_BYTES
                if end < len(text):
                    cut = max(text.rfind(b" ", at, end), text.rfind(b"\n", at, end))
                    end = cut if cut > at else end
                part = text[at : self.shared.match(text, end).end()]
                if parts and size + len(part) > CHUNK_BYTES:
                    yield rows, parts
                    rows, parts, size = [], [], 0
                rows.append(row)
                parts.append(part)
                size += len(part)
                at = end
        if parts:
            yield rows, parts


def blocks(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> Iterator[SeedIndex]:
    """Indexes of at most BLOCK_WORDS words each (or one item), one at a time on the driver."""
    items, words = [], 0
    for row in benchmark.select(item, text).where(F.col(item).isNotNull() & F.col(text).isNotNull()).toLocalIterator():
        body = plain(row[1])
        n = len(body.split())
        if items and words + n > BLOCK_WORDS:
            yield SeedIndex(items)
            items, words = [], 0
        items.append((row[0], body))
        words += n
    if items:
        yield SeedIndex(items)


_FOUND = "doc_id long, item_id long, n_equal long, n_words long"


def overlaps(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, item_id, n_equal, n_words: the best overlap of every document and item that have one."""
    rows, found = docs.select("doc_id", F.col(text).alias("text")), docs.sparkSession.createDataFrame([], _FOUND)
    for index in blocks(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                got = sent.value.overlaps([plain(t) for t in pdf["text"]])
                ids = pdf["doc_id"].astype("Int64")
                yield pd.DataFrame({"doc_id": [ids.iat[r] for r, _ in got], "item_id": [i for _, i in got], "n_equal": [e for e, _ in got.values()], "n_words": [n for _, n in got.values()]}).astype({"doc_id": "Int64"})

        found = found.union(Stored(rows.mapInPandas(run, _FOUND), "overlaps").df)
        sent.destroy()
    return found


def _clean(sent: Broadcast) -> Callable:
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = np.ones(len(texts), bool)
            for row, _ in sent.value.overlaps([plain(t) for t in texts]):
                out[row] = False
            yield pd.Series(out)

    return F.pandas_udf(clean, "boolean")


def without_overlaps(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents that overlap no item.

    One block filters the rows as they pass.  Of several, each but the last marks rows (by hashes of id and text) in a stored table.
    """
    last, marked = None, None
    key = F.xxhash64("doc_id", text), F.xxhash64(F.lit(1), F.col("doc_id"), F.col(text))
    for index in blocks(benchmark):
        if last is not None:
            sent = docs.sparkSession.sparkContext.broadcast(last)
            hit = Stored(docs.where(~_clean(sent)(F.col(text))).select(key[0].alias("__a"), key[1].alias("__b")), "hits").df
            marked = hit if marked is None else marked.union(hit)
            sent.destroy()
        last = index
    if last is None:
        return docs
    kept = docs.where(_clean(docs.sparkSession.sparkContext.broadcast(last))(F.col(text)))
    if marked is None:
        return kept
    return kept.join(marked.distinct(), (key[0] == F.col("__a")) & (key[1] == F.col("__b")), "left_anti")


def op7_seed_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_overlaps(docs, table(spark, sf_dir, "benchmark"))


QUERIES = {"op7_seed_decontam": op7_seed_decontam}
ORACLES: dict[str, str] = {}
