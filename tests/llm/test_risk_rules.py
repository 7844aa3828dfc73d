import math
import random
import re
import zlib

import pytest

from strandline.llm import risk_rules as q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, covered = {}, set()
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            for i in places:
                covered |= set(range(i, i + 8))
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n)


def test_features_against_brute_force(spark, odd_docs, prose):
    texts = [prose(k, 9) for k in range(4)]
    more = [(50, " ".join(texts)), (51, texts[0] + "\n" + texts[0] + " x " + texts[0]), (52, "a " * 50), (53, "\n".join(["x y"] * 3 + [" x y", "", " \t "] * 2)), (54, "#*$%&|<> é🙂 " * 5), (55, prose(1, 8)), (56, "\x0b a\x0cb\r")]
    docs = odd_docs.select("doc_id", "text", "n_words", "kept").union(spark.createDataFrame([(i, t, 0, True) for i, t in more], "doc_id long, text string, n_words int, kept boolean"))
    got = sorted(str((r["doc_id"], *(r[c] for c in q.COUNTS), r["f"])) for r in q.features(docs).withColumn("f", q.base_failed()).collect())
    assert got == sorted(str((r["doc_id"], *brute(r["text"]))) for r in docs.collect())


def test_exact_bound():
    for k, n, p in ((0, 50, 0.02), (3, 200, 0.01), (10, 100, 0.3)):
        assert math.isclose(q._tail(k, n, p), sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)), rel_tol=1e-9)
    for strata in (1, 4):
        n = q.fewest_good(strata)
        assert q._tail(0, n, q.RISK) <= q.ERROR / strata < q._tail(0, n - 1, q.RISK)


def test_strata_that_are_tested():
    assert q.tested({"a": q.fewest_good(1), "b": q.fewest_good(1)}) == ["a"]
    assert q.tested({"a": q.fewest_good(2), "b": q.fewest_good(2), "c": 3}) == ["a", "b"] and q.tested({}) == [] and q.tested({"a": 5}) == []


def test_path_takes_what_rejects_most_bad_for_a_good_one_first():
    cells = {"symbols": {4: (0, 200), 8: (1, 50), 12: (400, 50)}, "repeats": {3: (2, 30), 6: (0, 60)}}
    steps = q.path(cells, 1000, 500)
    assert steps == [("symbols", 4), ("symbols", 8), ("repeats", 6)]
    assert q.path({}, 10, 10) == [] and q.path({"symbols": {1: (10, 0)}}, 10, 0) == []


def test_certificate_covers_the_risk():
    """Over simulated holdouts, a setting beyond the risk is certified no more often than the error allows."""
    rng = random.Random(1)
    n, strata, trials = 600, 2, 1500
    shares = [0.002, 0.01, 0.02, q.RISK + 0.002, 0.2]  # of good documents, that each step rejects
    wrong = 0
    for _ in range(trials):
        rejected, last = {}, 0.0
        left = n
        for k, share in enumerate(shares):
            rejected[k] = sum(rng.random() < (share - last) / (1 - last) for _ in range(left))
            left -= rejected[k]
            last = share
        wrong += q.certified(rejected, n, len(shares), strata) > 3
    assert wrong / trials <= q.ERROR / strata + 3 * math.sqrt(q.ERROR / strata / trials)
    assert q.certified({}, n, 5, strata) == 5 and q.certified({0: n}, n, 5, strata) == 0


def test_calibration_against_plain_counts(spark, many):
    """Steps and certificates by counting documents one by one."""
    found = q.features(many.drop("quality")).withColumn("f", q.base_failed())
    rows = found.select("doc_id", "lang", "f", *q.ratios()).join(many.select("doc_id", "quality"), "doc_id").where("NOT f").collect()
    cutoffs = q.calibrate(q.features(many.drop("quality")), many.select("doc_id", "quality"))
    proposes = lambda r: zlib.crc32(str(r["doc_id"]).encode()) % q.PROPOSING == 0
    good = {}
    for r in rows:
        if r["quality"] == 1 and not proposes(r):
            good[r["lang"]] = good.get(r["lang"], 0) + 1
    strata = q.tested({"" if s is None else f"={s}": n for s, n in good.items()})
    for lang in {s for s, _ in cutoffs}:
        assert ("" if lang is None else f"={lang}") in strata
        own = [r for r in rows if r["lang"] == lang and r["quality"] == 1 and not proposes(r)]
        gone = sum(any(r[rule] > c for (s, rule), c in cutoffs.items() if s == lang) for r in own)
        assert q._tail(gone, len(own), q.RISK) <= q.ERROR / len(strata)
    cells = {}
    for r in rows:
        if r["lang"] == "en" and proposes(r):
            for rule in q.RULES:
                hit = [k for k in range(q.GRID_STEPS) if r[rule] > q.GRID_TOP * 2 ** (-k / 4)]
                if hit:
                    pair = cells.setdefault(rule, {}).get(hit[0], (0, 0))
                    cells[rule][hit[0]] = (pair[0] + (r["quality"] == 1), pair[1] + (r["quality"] != 1))
    both = [sum(r["lang"] == "en" and proposes(r) and (r["quality"] == 1) == g for r in rows) for g in (True, False)]
    steps, last = q.path(cells, *both), {}
    rejected, seen = {}, set()
    own = [r for r in rows if r["lang"] == "en" and r["quality"] == 1 and not proposes(r)]
    for n, (rule, k) in enumerate(steps):
        new = {r["doc_id"] for r in own if r[rule] > q.GRID_TOP * 2 ** (-k / 4)} - seen
        rejected[n], seen = len(new), seen | new
    for rule, k in steps[: q.certified(rejected, len(own), len(steps), len(strata))]:
        last["en", rule] = q.GRID_TOP * 2 ** (-k / 4)
    assert last and last == {key: c for key, c in cutoffs.items() if key[0] == "en"}


@pytest.fixture(scope="module")
def many(spark, prose):
    texts = [prose(k, 30) for k in range(40)]
    rows = []
    for k in range(3000):
        bad = k % 5 == 0
        rows.append((k, "fr" if k % 50 == 1 else None if k % 3 == 0 else "en", " ".join(w + "###" for w in texts[k % 40].split()) if bad else texts[k % 40], 0 if bad else 1))
    return spark.createDataFrame(rows, "doc_id long, lang string, text string, quality int")


def test_verdicts(spark, many):
    found = q.features(many.drop("quality"))
    labels = many.select("doc_id", "quality").union(spark.createDataFrame([(None, 1), (5, None)], "doc_id long, quality int"))
    cutoffs = q.calibrate(found, labels)
    assert {s for s, _ in cutoffs} <= {"en", None} and ("en", "symbols") in cutoffs
    rows = q.verdicts(found, cutoffs).join(many.select("doc_id", "quality"), "doc_id").collect()
    assert len(rows) == 3000 and all(r["kept"] for r in rows if r["quality"] == 1)
    assert not any(r["kept"] for r in rows if r["quality"] == 0 and r["lang"] == "en")
    assert all(r["kept"] for r in rows if r["lang"] == "fr")  # too few labels for any certificate


def test_odd_rows(spark, odd_docs):
    found = q.features(odd_docs)
    out = q.verdicts(found, q.calibrate(found, spark.createDataFrame([], "doc_id long, quality int")))
    rows = out.collect()
    assert len(rows) == odd_docs.count() and all(r["kept"] == (not r["base_failed"]) for r in rows)
    assert q.features(odd_docs.limit(0)).isEmpty()


def test_cutoffs_travel_in_the_plan(spark):
    """A table made of a list would start Python on the executors, beside a JVM that holds the features."""
    docs = spark.range(3).selectExpr("id AS doc_id", "'en' AS lang", "'a b c' AS text")
    out = q.verdicts(q.features(docs), {("en", "symbols"): 0.1, (None, "repeats"): 0.2})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" not in plan and "LocalTableScan" in plan and out.count() == 3
