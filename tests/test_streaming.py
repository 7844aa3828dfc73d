import datetime

from strandline.operators import fold, resolve
from strandline.sources.store import VersionStore
from strandline.streaming import ingest


def ops(spark, path, rows):
    spark.createDataFrame(rows, fold.OPS).coalesce(1).write.mode("append").parquet(path)


def test_ingest_adds_each_batch_once(spark, tmp_path):
    source, store = f"{tmp_path}/ops", VersionStore(spark, f"file://{tmp_path}/db")
    ops(spark, source, [("a", 1, "PUT", "1", None, 0), ("a", 2, "PUT", "2", None, 0), ("b", 3, "PUT", "1", 1, 0)])
    stream = lambda: spark.readStream.schema(fold.OPS).parquet(source)
    ingest.ingest(stream(), store, "default", f"{tmp_path}/ck").awaitTermination(120)
    ops(spark, source, [("a", 4, "DEL", None, None, 0), ("c", 5, "PUT", "9", 0, 0)])
    ingest.ingest(stream(), store, "default", f"{tmp_path}/ck").awaitTermination(120)
    assert {r["key"]: r["value"] for r in store.live("default", 500).collect()} == {"b": "1", "c": "9"}
    assert {r["key"] for r in store.live("default", 1000).collect()} == {"c"}
    n = len(store.parts("default"))
    assert store.append("default", store.versions("default").selectExpr("0 as pos", "key", "value", "is_tombstone", "expiry_ms"), "stream", 0) == 0
    assert len(store.parts("default")) == n


def test_ingest_applies_all_commands(spark, tmp_path):
    """Batch by batch the store holds what the fold of all commands leaves, and answers are what it answers."""
    source, store = f"{tmp_path}/ops", VersionStore(spark, f"file://{tmp_path}/db")
    rows = [(f"k{i % 5}", i, ["PUT", "INCR", "GET", "DEL", "INCR", "TTL", "INCR"][i % 7], "5" if i % 7 == 0 else None, 3 if i % 7 == 5 else None, i * 400) for i in range(90)]
    for k in range(0, 90, 30):
        ops(spark, source, rows[k : k + 30])
        ingest.ingest(spark.readStream.schema(fold.OPS).parquet(source), store, "default", f"{tmp_path}/ck", answers_to=f"{tmp_path}/answers").awaitTermination(120)
    whole = fold.fold(spark.createDataFrame(rows, fold.OPS))
    answers = {(r["seq"], r["status"], r["payload"]) for r in spark.read.parquet(f"{tmp_path}/answers").collect()}
    assert answers == {(r["seq"], r["status"], r["payload"]) for r in whole.collect()} and len(answers) == 90
    for now in (0, 20_000, 37_000):
        want = {tuple(r) for r in resolve.live(fold.versions_of(whole), now, unique=True).collect()}
        assert {tuple(r) for r in store.live("default", now).collect()} == want


def test_answers_equal_the_batch_fold(spark, tmp_path):
    rows = [(f"k{i % 3}", i, ["PUT", "INCR", "GET", "DEL", "INCR", "TTL"][i % 6], "5" if i % 6 == 0 else None, 1 if i % 6 == 5 else None, i * 400) for i in range(60)]
    source = f"{tmp_path}/ops"
    for k in range(0, 60, 20):
        ops(spark, source, rows[k : k + 20])
    query = ingest.answers(spark.readStream.schema(fold.OPS).option("maxFilesPerTrigger", 1).parquet(source)).writeStream.format("memory").queryName("answers").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    query.awaitTermination(180)
    got = {(r["seq"], r["status"], r["payload"]) for r in spark.table("answers").collect()}
    want = {(r["seq"], r["status"], r["payload"]) for r in fold.fold(spark.createDataFrame(rows, fold.OPS)).collect()}
    assert len(got) == 60 and got == want


def test_rollup(spark):
    at = datetime.datetime(2024, 1, 1)
    points = spark.createDataFrame([("cpu", at + datetime.timedelta(minutes=20 * i), float(i)) for i in range(6)], "metric string, ts timestamp, value double")
    assert [(r["n"], r["sum"]) for r in ingest.rollup(points).orderBy("window").collect()] == [(3, 3.0), (3, 12.0)]
