import random

import pytest

from strandline.llm import line_winnow as w


def brute(docs):
    """Lines to delete by comparing every stretch of lines with all earlier ones."""
    lines = {}
    for d, t in docs.items():
        if t is not None:
            lines[d] = [(p, x.strip(" \t\r\x0b\x0c")) for p, x in enumerate(t.split("\n")) if x.strip(" \t\r\x0b\x0c")]
    seen, gone = {}, {d: set() for d in docs}
    for d in sorted(lines):
        ls = lines[d]
        for i in range(len(ls)):
            words = 0
            for j in range(i, len(ls)):
                words += len(ls[j][1].split())
                if words >= w.RUN_WORDS:
                    run = tuple(x for _, x in ls[i : j + 1])
                    if run in seen and seen[run] != (d, i):
                        gone[d] |= set(range(ls[i][0], ls[j][0] + 1))
                    seen.setdefault(run, (d, i))
    return gone


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, prose, seed):
    rng = random.Random(seed)
    pool = [prose(s, rng.choice([1, 3, 10, 20, 30, 55])) for s in range(8)] + [""]
    docs = {}
    for d in range(14):
        blocks = [prose(1000 * seed + d, 15)] if rng.random() < 0.5 else []
        start = rng.randrange(5)
        blocks += pool[start : start + rng.randint(1, 4)] if rng.random() < 0.8 else []
        blocks += [f" {rng.choice(pool)} " for _ in range(rng.randint(0, 6))]
        docs[d] = "\n".join(blocks)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r["doc_id"]: r for r in w.dedup_lines(df).collect()}
    for d, gone in brute(docs).items():
        kept = "\n".join(x for p, x in enumerate(docs[d].split("\n")) if p not in gone)
        assert (got[d]["text"], got[d]["n_removed"], got[d]["n_lines"]) == (kept, len(gone), len(docs[d].split("\n"))), d


def test_only_windows_at_shared_fingerprints_are_compared(spark, prose):
    """One long text without repeats, and a run that two others share: only the run's windows are left."""
    alone = [(k, "\n".join(prose(100 * k + j, 12) for j in range(40))) for k in range(3)]
    run = "\n".join(prose(7000 + j, 12) for j in range(8))
    docs = spark.createDataFrame([*alone, (10, f"{prose(1, 60)}\n{run}"), (11, f"{run}\n{prose(2, 60)}")], "doc_id long, text string")
    every = w.windows(docs)
    near = w.anchored(every).collect()
    rows = every.collect()
    places = {}
    for r in rows:
        places.setdefault(r["anchor"], set()).add((r["doc_id"], r["th"], r["at"]))
    assert sorted((r["doc_id"], r["i"], r["j"]) for r in near) == sorted((r["doc_id"], r["i"], r["j"]) for r in rows if len(places[r["anchor"]]) > 1)
    assert {r["doc_id"] for r in near} == {10, 11} and len(rows) > 200 > 40 > len(near) >= 4


def test_odd_rows(spark, odd_docs):
    out = w.dedup_lines(odd_docs)
    rows = out.collect()
    assert len(rows) == odd_docs.count() and [c for c in out.columns if c not in ("n_lines", "n_removed")] == odd_docs.columns
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by[2]["text"] is None and by[3]["text"] == "" and by[1]["n_removed"] == 0
    assert [r["text"] for r in rows if r["doc_id"] == 5] == ["", ""]  # copies of document 1, both of them
    assert by[8]["n_removed"] == 2 and by[8]["text"].count("\n") == 0
    assert w.dedup_lines(odd_docs.limit(0)).isEmpty()


def test_clashing_names(spark, prose):
    df = spark.createDataFrame([(1, prose(1, 60), "a", 5), (2, prose(1, 60), "b", 6)], "doc_id long, text string, cuts string, n_lines long")
    got = {r["doc_id"]: r for r in w.dedup_lines(df).collect()}
    assert got[1]["cuts"] == "a" and got[1]["n_lines"] == 1 and got[2]["text"] == "" and got[2]["n_removed"] == 1


def test_stage_drops_what_was_only_copies(spark, prose):
    df = spark.createDataFrame([(1, prose(1, 60)), (2, prose(1, 60)), (3, prose(1, 60) + "\n" + prose(2, 9)), (4, ""), (5, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in w.stage(spark, df, "").collect()}
    assert got == {1: prose(1, 60), 3: prose(2, 9), 4: "", 5: None}
