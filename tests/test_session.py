import io
import threading

import pytest

from strandline.config import EngineConfig
from strandline.plans.command import OP_CODES, BadCommand, Command, Quit, Response, parse_command, printed
from strandline.session import Session, Stats
from strandline.shell import talk
from strandline.sources.catalog import CatalogError
from strandline.sources.store import Conflict, VersionStore
from strandline.sources.wire import FrameError, FrameParser, decode_command, decode_response, encode_command, encode_response


class Clock:
    now = 1_000_000

    def __call__(self):
        return self.now


@pytest.fixture
def session(spark, tmp_path):
    clock = Clock()
    s = Session(VersionStore(spark, f"file://{tmp_path}/db"), clock=clock)
    s.clock_ = clock
    return s


def ok(*payload):
    return Response("OK", payload)


def test_commands(session):
    run, clock = session.run, session.clock_
    assert run("PING") == ok("PONG")
    assert run("WRITE a hello  world") == ok() and run("read a") == ok("hello world")
    assert run("MSET cpu:1 1.5 cpu:2 2 cpu:1 3 odd") == ok()
    assert run("PREFIX cpu:") == ok("cpu:1", "3", "cpu:2", "2")
    assert run("RANGE cpu:1 cpu:1") == ok("cpu:1", "3") and run("RANGE z a") == ok()
    assert run("SUM cpu:") == ok("5.0") and run("AVG cpu:1 cpu:2") == ok("2.5") and run("MIN cpu:") == ok("2.0") and run("MAX cpu:") == ok("3.0")
    assert run("COUNT cpu:") == ok("2") and run("COUNT z a") == ok("0") and run("SUM disk:") == Response("NOT_FOUND")
    assert run("SUM a") == Response("ERROR", ("SUM: non-numeric value for key a",))
    assert run("MGET a nope a") == ok("a", "hello world", "nope", "\0", "a", "hello world")
    assert run("INCR n") == ok("1") and run("INCR n") == ok("2") and run("INCR a") == Response("ERROR", ("invalid digit found in string",))
    assert run("EXISTS n") == ok() and run("DELETE n") == ok() and run("DELETE n") == Response("NOT_FOUND") and run("EXISTS n") == Response("NOT_FOUND")
    assert run("WRITETTL t 1 x") == ok() and run("READ t") == ok("x")
    clock.now += 1000
    assert run("READ t") == Response("NOT_FOUND") and run("TTL t 5") == Response("NOT_FOUND")
    before = run("LIST")
    assert run("COMPACT") == ok() and sorted(run("LIST").payload) == sorted(before.payload)
    assert len(session.store.parts("default")) == 1
    stats = dict(x.split("=") for x in run("STATS").payload[0].split("\n"))
    assert stats["deletes"] == "1" and stats["compaction_count"] == "1" and stats["writes"] == "7"
    assert session.execute(Command("INVALID", code=99)) == Response("ERROR", ("Invalid op code: 99",))


def test_collections(session, spark):
    run, clock = session.run, session.clock_
    assert run("CREATE COLLECTION metrics 1") == ok() and run("CREATE COLLECTION metrics") == Response("ERROR", ("collection exists",))
    assert run("CREATE COLLECTION a_b").status == "ERROR" and run("USE nope") == Response("ERROR", ("no such collection: nope",))
    run("WRITE k main")
    assert run("USE metrics") == ok() and run("READ k") == Response("NOT_FOUND")
    run("WRITE k here")
    run("INCR c")
    session.execute(Command("WRITE", items=(("stays", "x", 0),)))
    clock.now += 1000
    assert run("READ k") == Response("NOT_FOUND") and run("READ c") == Response("NOT_FOUND") and run("READ stays") == ok("x")
    assert run("SHOW COLLECTIONS") == ok("default\t0", "metrics\t1")
    again = VersionStore(spark, session.store.root)
    assert [tuple(r) for r in again.catalog.table().orderBy("name").collect()] == [("default", 0), ("metrics", 1)]
    assert Session(again, clock=clock).run("READ k") == ok("main")
    assert run("DROP COLLECTION default").status == "ERROR" and run("DROP COLLECTION metrics") == ok()
    assert run("READ k") == Response("ERROR", ("no such collection: metrics",))
    kv = Session(again, EngineConfig(engine="kv"))
    assert kv.run("USE default").payload == ("collections are not supported by the KV engine",) and kv.run("SUM a").payload == ("SUM not supported by KV engine",)


def test_a_number_is_taken_once(spark, tmp_path):
    store = VersionStore(spark, f"file://{tmp_path}/db")
    entry = store.catalog.get("default")
    number, old = store._manifest(entry)
    Session(store).run("WRITE a 1")
    with pytest.raises(Conflict):
        store._manifests(entry).publish(number, old)


def test_two_writers(spark, tmp_path):
    """Both write at once, through stores of their own: every write is there, and those that came second are counted."""
    stats, failed = Stats(), []

    def write(k):
        s = Session(VersionStore(spark, f"file://{tmp_path}/db"), stats=stats)
        for j in range(4):
            failed.extend(x for x in [s.run(f"WRITE w{k}:{j} {j}")] if x != ok())
        s.close()

    VersionStore(spark, f"file://{tmp_path}/db")
    threads = [threading.Thread(target=write, args=(k,)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    s = Session(VersionStore(spark, f"file://{tmp_path}/db"))
    assert not failed and sorted(s.run("LIST").payload) == [f"w{k}:{j}" for k in range(3) for j in range(4)]
    seqs = [r["seq"] for r in s.store.versions("default").collect()]
    assert len(set(seqs)) == 12 and stats.active_connections == 0 and stats.writes == 12
    assert (stats.write_blocked_attempts > 0) == (stats.write_blocked_total_ms > 0)


def test_readers_survive_compaction(spark, tmp_path):
    store = VersionStore(spark, f"file://{tmp_path}/db")
    s = Session(store)
    for line in ("WRITE a 1", "WRITE b 2", "WRITE a 3", "DELETE b"):
        s.run(line)
    before = store.live("default", 10)
    old = store.parts("default")
    assert s.run("COMPACT") == ok()
    s.run("WRITE a 4")
    assert [tuple(r)[:2] for r in before.collect()] == [("a", "3")] and s.run("READ a") == ok("4")
    store.retain_ms = 0
    store.vacuum("default")
    assert not any(store.files.names(p) for p in old) and s.run("READ a") == ok("4")
    assert len([x for x in store.files.names(old[0].rpartition("/")[0]) if x.startswith("part-")]) == 2


def test_compaction_beside_writes(spark, tmp_path, monkeypatch):
    """In the background, with a write and a second COMPACT while it works."""
    store = VersionStore(spark, f"file://{tmp_path}/db")
    s = Session(store, EngineConfig(background=True))
    for line in ("WRITE a 1", "WRITE a 2", "WRITE b 1"):
        s.run(line)
    going, go = threading.Event(), threading.Event()
    write = VersionStore._write

    def slow(rows, path):
        if threading.current_thread() is s.working:
            going.set()
            go.wait(60)
        write(rows, path)

    monkeypatch.setattr(VersionStore, "_write", staticmethod(slow))
    assert s.run("COMPACT") == ok() and going.wait(60)
    assert s.run("COMPACT") == Response("NOOP") and "compacting=true" in s.run("STATS").payload[0]
    assert s.run("WRITE c 1") == ok() and s.run("DELETE b") == ok()
    go.set()
    s.close()
    assert sorted(s.run("LIST").payload) == ["a", "c"] and s.run("READ a") == ok("2")
    assert s.stats.compaction_count == 1 and len(store.parts("default")) == 3 and store._manifest(store.catalog.get("default"))[1]["rows"] == 4


def test_collections_are_shared(spark, tmp_path):
    one, two = (Session(VersionStore(spark, f"file://{tmp_path}/db")) for _ in range(2))
    assert one.run("CREATE COLLECTION m 5") == ok() and two.run("USE m") == ok() and two.run("CREATE COLLECTION m") == Response("ERROR", ("collection exists",))
    assert two.run("CREATE COLLECTION n") == ok() and one.run("SHOW COLLECTIONS") == two.run("SHOW COLLECTIONS") == ok("default\t0", "m\t5", "n\t0")
    two.run("WRITE k v")
    assert one.run("DROP COLLECTION m") == ok() and two.run("READ k").status == "ERROR"


def test_bad_catalogs(spark, tmp_path):
    good = {"name": "default", "default_ttl_secs": 0, "folder": "default-x"}
    for k, rows in enumerate(([good, good], [good | {"name": "a_b"}], [{"name": "x"}])):
        store = VersionStore(spark, f"file://{tmp_path}/{k}")
        store.catalog.states.publish(1, rows)
        with pytest.raises(CatalogError):
            VersionStore(spark, store.root)


def test_auto_compaction(spark, tmp_path):
    s = Session(VersionStore(spark, f"file://{tmp_path}/a"), EngineConfig(max_parts=2))
    for k in range(4):
        s.run(f"WRITE k {k}")
    assert s.stats.compaction_count >= 1 and s.run("READ k") == ok("3")
    s = Session(VersionStore(spark, f"file://{tmp_path}/b"), EngineConfig(engine="kv", max_dead_ratio=0.5))
    for k in range(3):
        assert s.store.dead_ratio("default", 1) == [0.0, 0.0, 0.5][k] and s.stats.compaction_count == 0
        s.run(f"WRITE k {k}")
    assert s.stats.compaction_count == 1 and len(s.store.parts("default")) == 1 and s.run("READ k") == ok("2")


def test_config():
    assert EngineConfig.from_args("--engine kv --max-parts 3 --max-dead-ratio 0.5 --background --retain-ms 7".split()) == EngineConfig("kv", 3, 0.5, True, 7)
    for bad in ("--engine x", "--max-parts -1", "--max-parts", "--max-parts x", "--nope 1", "kv"):
        with pytest.raises(ValueError):
            EngineConfig.from_args(bad.split())


def test_shell(spark, tmp_path):
    session, out, errors = Session(VersionStore(spark, f"file://{tmp_path}/db")), io.StringIO(), io.StringIO()
    talk(session, io.StringIO("write a x  y\nread a\nread b\n\nnope\nsum a\nquit\nread a\n"), out, errors, prompt="")
    assert out.getvalue() == "OK\nx y\nNot found\nError > SUM: non-numeric value for key a\n" and errors.getvalue() == "Unknown command: nope\n"
    talk(session, io.StringIO("ping"), out, errors)
    assert out.getvalue().endswith("> PONG\n> ")


@pytest.mark.parametrize("line", ["WRITE k", "READ", "READ a b", "WRITETTL k 0 v", "WRITETTL k x v", "MWRITETTL 1 k", "MWRITETTL 5 a b c", "TTL k", "TTL k -1", "TTL k 4294967296", "INCR", "COUNT", "SUM a b c", "CREATE x", "CREATE COLLECTION a z", "DROP COLLECTION", "SHOW", "NOPE", ""])
def test_rejected_text(line):
    with pytest.raises(BadCommand):
        parse_command(line)


def test_text_and_wire():
    with pytest.raises(Quit):
        parse_command("quit")
    assert parse_command("mwritettl 5 a 1 b 2").items == (("a", "1", 5), ("b", "2", 5))
    lines = ["READ a", "WRITE a b", "WRITETTL a 3 é", "DELETE a", "COMPACT", "STATS", "LIST", "EXISTS a", "PING", "MGET a b", "MSET a 1 b 2", "RANGE a b", "TTL a 0", "INCR a", "PREFIX a", "USE c", "CREATE COLLECTION c", "CREATE COLLECTION c 9", "DROP COLLECTION c", "SHOW COLLECTIONS"]
    lines += [f"{v} {k}" for v in ("COUNT", "SUM", "AVG", "MIN", "MAX") for k in ("p", "a b")]
    commands = [parse_command(x) for x in lines]
    assert {c.op for c in commands} == set(OP_CODES)
    stream = b"".join(map(encode_command, commands))
    parser, frames = FrameParser(), []
    for k in range(0, len(stream), 7):
        frames += parser.feed(stream[k : k + 7])
    assert [decode_command(f) for f in frames] == commands
    assert encode_command(parse_command("READ ab")) == b"\x00\x00\x00\x05\x01\x00\x02ab"
    assert decode_command(b"\x00\x00\x00\x01\x63") == Command("INVALID", code=0x63)
    for r in (ok("a", "", "é"), Response("NOT_FOUND"), Response("ERROR", ("x",)), Response("NOOP")):
        assert decode_response(encode_response(r)) == r
    with pytest.raises(FrameError):
        decode_command(b"\x00\x00\x00\x05\x01\x00\x09ab")
    with pytest.raises(FrameError):
        list(FrameParser().feed(b"\xff\xff\xff\xff"))
    assert printed(Response("ERROR", ("x",))) == "Error > x" and printed(Response("NOT_FOUND")) == "Not found"
