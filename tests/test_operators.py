import math
import random

import pytest

from strandline.operators import aggregate, compact, fold, point, resolve, scan

NOW = 1000


def versions(spark, rows):
    return spark.createDataFrame(rows, resolve.VERSION)


def put(key, seq, value, expiry=None):
    return (key, seq, value, False, expiry)


def gone(key, seq):
    return (key, seq, None, True, None)


@pytest.mark.parametrize("unique", [True, False])
def test_newest_wins_before_liveness(spark, unique):
    rows = [put("a", 1, "old"), put("a", 2, "new"), put("b", 1, "1"), gone("b", 2), put("c", 1, "1"), put("c", 2, "2", NOW), put("d", 1, "1", NOW + 1), gone("e", 1), put("e", 2, "back")]
    got = {r["key"]: r["value"] for r in resolve.live(versions(spark, rows), NOW, unique).collect()}
    assert got == {"a": "new", "d": "1", "e": "back"}


def test_scans_against_brute_force(spark):
    keys = ["aaa", "café:a", "café:b", "cafez", "cpu:1", "cpu:2", "mmm", "zzz", "", "￿", "\U00010000"]
    live = resolve.live(versions(spark, [put(k, 1, str(i)) for i, k in enumerate(keys)]), NOW)
    order = sorted(keys, key=lambda k: k.encode())
    for prefix in ["cpu:", "café:", "", "disk:", "z", "￿"]:
        want = [k for k in order if k.startswith(prefix)]
        assert [r["key"] for r in scan.scan_prefix(live, prefix).collect()] == want
        assert scan.count(live, scan.has_prefix(prefix)).first()["n"] == len(want)
    for start, end in [("a", "d"), ("z", "a"), ("cpu:1", "cpu:1"), ("", "zzz")]:
        want = [k for k in order if start.encode() <= k.encode() <= end.encode()]
        assert [r["key"] for r in scan.scan_range(live, start, end).collect()] == want
        assert scan.count(live, scan.in_range(start, end)).first()["n"] == len(want)
    assert sorted(r["key"] for r in scan.list_keys(live).collect()) == sorted(keys)


def reduced(spark, values, prefix=""):
    live = resolve.live(versions(spark, [put(f"k:{i:03}", 1, v) for i, v in enumerate(values)]), NOW)
    return {op: aggregate.value_of(live, scan.has_prefix(prefix), op) for op in aggregate.NAMES}


def test_reductions(spark):
    assert reduced(spark, ["1.0", "2.0", "1e3"]) == {"sum": 1003.0, "avg": 1003.0 / 3, "min": 1.0, "max": 1000.0}
    assert reduced(spark, ["1"], "disk:") == dict.fromkeys(aggregate.NAMES)
    for values in (["1.0", "NaN", "2"], ["NaN", "nan"]):
        got = reduced(spark, values)
        assert math.isnan(got["min"]) and math.isnan(got["max"]) and math.isnan(got["sum"])
    assert reduced(spark, ["inf", "1"])["sum"] == float("inf")
    assert reduced(spark, [f"0.{i:02}" for i in range(100)])["sum"] == 49.5


def test_not_numeric_names_the_first_key(spark):
    rows = [put("a", 1, "1"), put("b", 1, "x"), put("c", 1, "y"), put("dead", 1, "z"), gone("dead", 2)]
    live = resolve.live(versions(spark, rows), NOW)
    with pytest.raises(aggregate.NotNumeric, match="^SUM: non-numeric value for key b$"):
        aggregate.value_of(live, scan.has_prefix(""), "sum")
    assert aggregate.value_of(live, scan.has_prefix("dead"), "sum") is None


def test_points(spark):
    live = resolve.live(versions(spark, [put("k1", 1, "v1"), put("k0", 1, "\0")]), NOW)
    got = point.mget(live, point.key_table(live, ["k1", "k2", "k1", "k0"])).orderBy("pos").collect()
    assert [(r["key"], r["value"]) for r in got] == [("k1", "v1"), ("k2", None), ("k1", "v1"), ("k0", "\0")]
    assert point.exists(live, "k1") and not point.exists(live, "k2")
    assert point.read(live, "k2").isEmpty()
    found = point.exists_many(live, point.key_table(live, ["k2", "k1"])).orderBy("pos").collect()
    assert [r["found"] for r in found] == [False, True]


class Model:
    """The store as a dictionary, written apart from the operator."""

    def __init__(self, default):
        self.data, self.default = {}, default

    def do(self, op, key, value, ttl, at):
        held = self.data.get(key)
        alive = held is not None and (held[1] is None or held[1] > at)
        due = lambda t: None if not t else at + t * 1000
        if op == "PUT":
            self.data[key] = (value, due(self.default if ttl is None else ttl))
            return "OK", None
        if op == "DEL":
            self.data.pop(key, None)
            return ("OK" if alive else "NOT_FOUND"), None
        if op == "TTL":
            if alive:
                self.data[key] = (held[0], due(ttl))
            return ("OK" if alive else "NOT_FOUND"), None
        if op == "INCR":
            if not alive:
                self.data[key] = ("1", due(self.default))
                return "OK", "1"
            try:
                n = int(held[0]) + 1 if held[0].lstrip("+-").isdigit() and held[0].isascii() else None
            except ValueError:
                n = None
            if n is None or n > (1 << 63) - 1:
                return "ERROR", None
            self.data[key] = (str(n), held[1])
            return "OK", str(n)
        return ("OK" if alive else "NOT_FOUND"), (held[0] if alive and op == "GET" else None)


@pytest.mark.parametrize("seed, default, timed", [(1, 3, True), (2, 6, True), (3, 0, False), (4, 0, True)])
def test_fold_against_a_dictionary(spark, seed, default, timed, monkeypatch):
    """With and without expiry; blocks are so small that keys go through many."""
    monkeypatch.setattr(fold, "BLOCK", 40)
    rng, model = random.Random(seed), Model(default)
    rows, want = [], {}
    at = 0
    for seq in range(1500):
        at += rng.randrange(1500)
        key = f"k{rng.randrange(20)}"
        still = not timed or (seed == 4 and key < "k15")  # keys without expiry, among others or alone
        op = rng.choice(["PUT", "DEL", "INCR" if still else "TTL", "INCR", "INCR", "GET", "EXISTS"])
        value = rng.choice(["1", "-7", "+3", "x", "1.5", "", "9223372036854775806", "99999999999999999999"]) if op == "PUT" else None
        ttl = rng.choice([0, 1, 5]) if op == "TTL" else rng.choice([None, 0] if still else [None, 0, 2]) if op == "PUT" else None
        rows.append((key, seq, op, value, ttl, at))
        status, payload = model.do(op, key, value, ttl, at)
        want[seq] = status, payload
    results = fold.fold(spark.createDataFrame(rows, fold.OPS).repartition(3), default)
    got = {r["seq"]: (r["status"], None if r["status"] == "ERROR" else r["payload"]) for r in results.collect()}
    assert got == want
    live = {r["key"]: (r["value"], r["expiry_ms"]) for r in resolve.live(fold.versions_of(results), at, unique=True).collect()}
    assert live == {k: v for k, v in model.data.items() if v[1] is None or v[1] > at}


def test_fold_says_why(spark):
    rows = [(k, s, op, v, None, 0) for k, v in (("e", ""), ("x", "1x"), ("big", "9" * 25), ("low", "-" + "9" * 25), ("max", "9223372036854775807")) for s, op, v in ((0, "PUT", v), (1, "INCR", None), (2, "GET", None))]
    rows += [("u", 0, "NOPE", None, None, 0), ("u", 1, "GET", None, None, 0)]
    got = {(r["key"], r["seq"]): (r["status"], r["payload"], r["writes"]) for r in fold.fold(spark.createDataFrame(rows, fold.OPS)).collect()}
    for key, seq, op, value, _, _ in rows:
        state = fold.KeyState()
        for k, s, o, v, *_ in rows:
            if k == key and s <= seq:
                want = state.apply(o, v, None, 0)
        assert got[key, seq] == want, (key, seq)


def test_compaction_keeps_what_is_live(spark):
    rng = random.Random(4)
    rows = [(f"k{rng.randrange(50)}", s, str(s), rng.random() < 0.2, rng.choice([None, NOW, NOW + 5])) for s in range(400)]
    v = versions(spark, rows)
    small = compact.compacted(v, NOW)
    assert sorted(map(tuple, resolve.live(small, NOW).collect()), key=str) == sorted(map(tuple, resolve.live(v, NOW).collect()), key=str)
    assert small.where("is_tombstone").isEmpty() and small.count() == small.select("key").distinct().count()


def test_empty_tables(spark):
    empty = versions(spark, [])
    assert resolve.live(empty, NOW).isEmpty() and scan.count(resolve.live(empty, NOW), scan.has_prefix("")).first()["n"] == 0
    assert fold.fold(spark.createDataFrame([], fold.OPS)).isEmpty()


def test_filters_reach_the_files(spark, tmp_path):
    versions(spark, [put(f"k{i}", i, "1") for i in range(10)]).write.parquet(f"{tmp_path}/v")
    live = resolve.live(spark.read.parquet(f"{tmp_path}/v"), NOW, unique=True)
    plan = scan.scan_prefix(live, "k1")._jdf.queryExecution().toString()
    assert "StringStartsWith(key,k1)" in plan and "GreaterThanOrEqual(key,k1)" in plan
    counted = scan.count(live, scan.has_prefix(""))._jdf.queryExecution().executedPlan().toString()
    assert "value" not in counted.split("ReadSchema")[1].split("\n")[0]
