import random

import numpy as np
import pytest

from strandline.llm import near_copies as n
from strandline.llm import simhash_ring


def slow_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def edited(text, every, prose, seed):
    words = text.split()
    for k in range(seed % every, len(words), every):
        words[k] = prose(90_000 + seed * 100 + k, 1) + "x"
    return " ".join(words)


@pytest.fixture(scope="module")
def copies(prose):
    """Texts, copies with from one to many words edited, and chains of them; short, empty and null ones too."""
    rng = random.Random(4)
    texts = [prose(k, rng.choice([3, 5, 9, 30, 120, 400])) for k in range(60)]
    for k in range(150):
        texts.append(edited(texts[rng.randrange(len(texts))], rng.choice([20, 40, 60, 80, 150]), prose, k))
    texts += [texts[4].upper().replace(" ", "\n "), None, "", " \t"]
    return [(k, t) for k, t in enumerate(texts)]


def test_sets(copies):
    for _, text in copies[:80]:
        assert len(n.shingles((text or "").encode())) == len(slow_set(text))


def test_long_texts_in_chunks(prose, monkeypatch):
    text = prose(1, 3000).encode()
    whole = n.shingles(text)
    monkeypatch.setattr(n, "_CHUNK", 50)
    assert (n.shingles(text) == whole).all()


def test_against_all_pairs(spark, copies):
    sets = [slow_set(t) for _, t in copies]
    root = list(range(len(sets)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    linked = 0
    for a in range(len(sets)):
        for b in range(a):
            if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
                linked += sets[a] != sets[b]
    assert linked > 30
    docs = spark.createDataFrame(copies, "doc_id long, text string").repartition(3)
    assert {r["doc_id"]: r["component_id"] for r in n.near_copies(docs).collect()} == {k: find(k) for k in range(len(sets))}


def test_large_group_and_no_rows(spark, prose):
    base = prose(5, 100)
    rows = [(k, edited(base, 97, prose, k)) for k in range(1, 300)] + [(1000, prose(6, 100))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in n.near_copies(docs).collect()}
    assert found[1000] == 1000 and {c for d, c in found.items() if d < 1000} == {1}
    assert n.near_copies(docs.limit(0)).isEmpty()


def test_stage_drops_edited_copies(spark, prose):
    """Far beyond 2 bits: each copy has two of its 150 words replaced."""
    rows = [(k, prose(k, 150)) for k in range(20)]
    rows += [(100 + k, edited(t, 75, prose, k)) for k, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash_ring.stage(spark, docs, "").collect()) == list(range(20))


def test_groups_beyond_a_task(spark, copies, prose, monkeypatch):
    """With blocks of a few nodes the components are those of whole groups."""
    base = prose(5, 100)
    rows = copies + [(1000 + k, edited(base, 97 if k % 3 else 33, prose, k)) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = {r["doc_id"]: r["component_id"] for r in n.near_copies(docs).collect()}
    monkeypatch.setattr(n, "BLOCK_NODES", 5)
    monkeypatch.setattr(n, "PIVOTS", 1)
    assert {r["doc_id"]: r["component_id"] for r in n.near_copies(docs).collect()} == want
    assert sum(want[1000 + k] == want[1001] for k in range(60)) >= 40 and len({want[1000 + k] for k in range(60)}) > 5


def test_stage_tells_texts_of_one_id_apart(spark, prose):
    one, two, three = prose(1, 60), prose(2, 60), prose(3, 60)
    rows = [(1, one, "a"), (1, two, "b"), (1, one.upper(), "c"), (2, edited(two, 100, prose, 1), "d"), (3, three, "e"), (3, three, "e"), (None, one, "f"), (None, three, "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted((r["doc_id"] or 0, r["source"]) for r in simhash_ring.stage(spark, docs, "").collect())
    assert got == sorted([(0, "f"), (0, "g"), (1, "a" if one < one.upper() else "c"), (1, "b"), (3, "e")])


def test_pairs_by_fingerprints_and_chains(prose, monkeypatch):
    """All pairs at just the similarity are candidates, for small sets and large; hardly any others are."""
    rng = np.random.default_rng(3)
    monkeypatch.setattr(n, "_PAIRS", 500)
    for size in (4, 5, 8, 9, 16, 40, 79, 80, 300):
        sets = []
        for _ in range(60):
            both = rng.integers(0, 1 << 63, size, np.uint64)
            # one fifth more on one side: the similarity is 0.8 or a little above
            sets += [np.sort(both), np.sort(np.append(both, rng.integers(0, 1 << 63, size // 4, np.uint64)))]
        found = set(n.candidates(n.fingerprints(sets), np.array([len(x) for x in sets])))
        assert {(k, k + 1) for k in range(0, 120, 2)} <= found
        # sets of four are alike by chance
        assert size < 8 or len(found) <= 65


def test_links_are_found_by_fingerprints(prose, monkeypatch):
    """No pair is compared that the chains don't let through."""
    text = prose(1, 200)
    sets = [n.shingles(t.encode()) for t in (text, text + " more words", prose(2, 200))]
    assert n.forest([1, 2, 3], sets, [1, 2, 3]) == [(2, 1)]
    monkeypatch.setattr(n, "fingerprints", lambda sets: np.arange(len(sets) * n.WORDS, dtype=np.uint64).reshape(-1, n.WORDS) * np.uint64(0x9E3779B97F4A7C15))
    assert n.forest([1, 2, 3], sets, [1, 2, 3]) == []
