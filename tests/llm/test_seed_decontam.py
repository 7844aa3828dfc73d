import random

import pytest

from strandline.llm import seed_decontam as d


def found(spark, docs, items):
    df = d.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    return {(r["doc_id"], r["item_id"]): (r["n_equal"], r["n_words"]) for r in df.collect()}


def test_exact_and_substituted(spark, prose):
    rng = random.Random(1)
    items = [(k, prose(500 + k, rng.randint(15, 50))) for k in range(20)]
    docs, want = [], set()
    for k in range(200):
        words = prose(k, 300).split()
        if k % 2:
            item, text = items[rng.randrange(20)]
            passage = text.split()
            for i in range(len(passage)):
                if k % 4 == 3 and i % 6 == 5:
                    passage[i] = prose(9000 + k * 50 + i, 1)
            at = rng.randrange(len(words))
            words[at:at] = [w.upper() + "," if i % 7 == 3 else w for i, w in enumerate(passage)]
            want.add((k, item))
        docs.append((k, " ".join(words)))
    assert set(found(spark, docs, items)) == want


def test_against_brute_force(spark):
    """A small vocabulary, so that chance overlaps occur; whatever is found is a true stretch, and every exact 13 words are found."""
    rng = random.Random(3)
    vocabulary = "a b c d e".split()
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(20))) for k in range(5)]
    docs = [(k, " ".join(rng.choice(vocabulary) for _ in range(60)) + " " + " ".join(items[k % 5][1].split()[3:17])) for k in range(20)]
    got = found(spark, docs, items)
    for k, text in docs:
        words = text.split()
        for i, item in items:
            w = item.split()
            exact = any(words[s : s + 13] == w[t : t + 13] for s in range(len(words) - 12) for t in range(len(w) - 12))
            assert not exact or (k, i) in got
    assert all(n >= 13 and e >= d.IDENTITY * n for e, n in got.values())


@pytest.mark.parametrize("size, changed", [(10, 1), (10, 3), (12, 3), (13, 3), (16, 2), (16, 3), (16, 4), (20, 4), (20, 6), (30, 9), (45, 13)])
def test_spread_substitutions_of_whole_items(prose, size, changed):
    """Whole items with 70 % of the words equal, wherever the others are; and one word more is found as by brute force."""
    rng = random.Random(size * 100 + changed)
    item = [f"{w}q{k}" for k, w in enumerate(prose(size, size).split())]
    index = d.SeedIndex([(1, d.plain(" ".join(item)))])
    for trial in range(300):
        more = rng.choice([0, 0, 1, 3])
        words = list(item)
        for at in rng.sample(range(size), changed + more):
            words[at] = f"other{trial}x{at}"
        equal = [a == b for a, b in zip(words, item)]
        need = min(13, size)
        want = any(10 * sum(equal[a:b]) >= 7 * (b - a) for a in range(size) for b in range(a + need, size + 1))
        assert want or more
        got = index.overlaps([d.plain("before it " + " ".join(words) + " after it")])
        assert ((0, 1) in got) == want
        assert all(n >= need and 10 * e >= 7 * n for e, n in got.values())


def test_masks_miss_no_stretch():
    """The fewest substitutions that spoil every mask are too many, for all sizes; a stretch of 26 words or more has a half that counts."""
    patterns = [(len(m), int(m, 2)) for m in d.MASKS]
    fewest, keep = {0: 0}, (1 << max(map(len, d.MASKS)) - 1) - 1
    for n in range(1, 26):
        after = {}
        for state, cost in fewest.items():
            for bit in (0, 1):
                window = state << 1 | bit
                if not any(n >= size and window & p == p for size, p in patterns):
                    key = window & keep
                    after[key] = min(after.get(key, 99), cost + 1 - bit)
        fewest = after
        assert n < d.MASKED or min(fewest.values()) > 3 * n // 10


def test_odd_rows(spark, odd_docs, prose):
    items = [(1, prose(2, 20)), (2, None), (None, prose(3, 30)), (3, ""), (4, prose(2, 20)), (5, "a b c"), (6, prose(77, 7))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [(r["doc_id"], r["item_id"]) for r in d.overlaps(odd_docs, bench).collect()]
    assert sorted(got) == [(1, 1), (5, 1), (5, 1)]
    kept = d.without_overlaps(odd_docs, bench)
    assert kept.columns == odd_docs.columns and {r["doc_id"] for r in kept.collect()} == {None, 2, 3, 6, 7, 8, 9, 10}
    assert d.overlaps(odd_docs, bench.limit(0)).isEmpty() and d.without_overlaps(odd_docs, bench.limit(0)).count() == odd_docs.count()
    assert d.overlaps(odd_docs.limit(0), bench).isEmpty()
    short = spark.createDataFrame([(1, "x " + prose(77, 7) + " y"), (2, "x " + prose(77, 6) + " y")], "doc_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in d.overlaps(short, bench).collect()] == [(1, 6)]


@pytest.mark.parametrize("words", [30, 1_000_000])
def test_blocks_and_parts_find_the_same(spark, prose, monkeypatch, words):
    monkeypatch.setattr(d, "BLOCK_WORDS", words)
    items = [(k, prose(500 + k, 25)) for k in range(6)]
    docs = [(k, prose(k, 400) + " " + items[k % 6][1] + " " + prose(k + 50, 400)) for k in range(12)]
    assert set(found(spark, docs, items)) == {(k, k % 6) for k in range(12)}
    index = d.SeedIndex([(i, d.plain(t)) for i, t in items])
    monkeypatch.setattr(d, "CHUNK_BYTES", 1000)
    assert set(index.overlaps([d.plain(t) for _, t in docs])) == {(k, k % 6) for k in range(12)}
    assert set(index.overlaps([d.plain(t.replace(" ", " " * 700)) for _, t in docs])) == {(k, k % 6) for k in range(12)}
    both = [*docs[:6], (20, prose(900, 100)), (None, prose(901, 30)), (None, docs[0][1])]
    kept = d.without_overlaps(spark.createDataFrame(both, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(r["text"] for r in kept.collect()) == sorted((prose(900, 100), prose(901, 30)))


def test_items_of_few_words(spark):
    """They match whole documents only."""
    items = [(1, "Who was it?"), (2, "yes"), (3, ""), (4, "a b c d")]
    docs = [(1, " who  was\nIT "), (2, "Yes."), (3, "yes yes"), (4, "who was it then"), (5, ""), (6, None), (7, "a b c d" + " " * 5000), (8, "a b c d e")]
    assert found(spark, docs, items) == {(1, 1): (3, 3), (2, 2): (1, 1), (7, 4): (4, 4)}
