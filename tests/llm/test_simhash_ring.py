import random

import numpy as np
import pytest
import xxhash

from strandline.llm import simhash_ring as s
from strandline.llm.components import components


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(pairs, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("text", ["", "a", "A b", "the quick  brown\tfox", "É x É y é", "漢字 a b c"])
def test_fingerprint(text):
    assert s.fingerprint(text.encode()) & ((1 << 64) - 1) == slow_fingerprint(text)


def test_long_fingerprint(prose, monkeypatch):
    monkeypatch.setattr(s, "_BLOCK", 100)
    text = prose(1, 1000)
    assert s.fingerprint(text.encode()) & ((1 << 64) - 1) == slow_fingerprint(text)


def test_pigeonring_misses_nothing():
    """Any two fingerprints within budget pass at one start at least, and share its bucket there."""
    rng = random.Random(1)
    for _ in range(3000):
        x = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 2)))
        starts = [k for k in range(16) if ((x >> 4 * k | x << 64 - 4 * k) & ((1 << 64) - 1)) & ((1 << 28) - 1) == 0]
        assert any(s._passes(np.array([x], np.uint64), k)[0] for k in starts)
    for _ in range(300):
        x = sum(1 << b for b in rng.sample(range(64), rng.randint(3, 8)))
        assert not any(s._passes(np.array([x], np.uint64), k)[0] for k in range(16))


@pytest.mark.parametrize("bucket", [4096, 3])
def test_links_against_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(s, "BUCKET", bucket)  # 3: nearly every bucket is dealt anew
    rng = random.Random(2)
    values = set()
    for _ in range(30):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            values.add(x)
            x ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3)))
    values |= {0, 1, 3, (1 << 64) - 1, (1 << 64) - 2}
    df = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    to = {r["a"]: r["b"] for r in components(s.links(df)).df.collect()}
    nodes = sorted(signed(v) for v in values)
    pairs = [(a, b) for a in nodes for b in nodes if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2]
    assert {n: to.get(n, n) for n in nodes} == grouped(pairs, nodes)


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 5)]
    got = {r["a"]: r["b"] for r in components(spark.createDataFrame(links, "a long, b long")).df.collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100, 200: 0}
    assert components(spark.createDataFrame([], "a long, b long")).df.isEmpty()


def test_odd_rows(spark, odd_docs):
    rows = s.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = [(r["doc_id"], r["fp"], r["component_id"]) for r in rows]
    assert {c for d, f, c in by if f == 0} == {2} and {c for d, f, c in by if d in (1, 5)} == {1}
    assert s.near_duplicates(odd_docs.limit(0)).isEmpty()


def test_stage(spark, odd_docs):
    out = s.stage(spark, odd_docs, "")
    rows = out.collect()
    assert out.columns == odd_docs.columns
    ids = sorted(r["doc_id"] for r in rows if r["doc_id"] is not None)
    assert ids == [1, 2, 6, 8, 9, 10] and sum(r["doc_id"] is None for r in rows) == 2
    twice = odd_docs.where("doc_id = 5")
    assert s.stage(spark, twice, "").count() == 1
