import gzip
import hashlib
import io
from pathlib import Path

import pytest

from strandline.llm import warc_segments as w

SCHEMA = "page_id long, url string, html string, digest string, block int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def round_trip(spark, rows, path):
    w.write_archives(pages(spark, rows), f"file://{path}/a")
    return w.read_archives(spark, f"file://{path}/a", with_payload=True).collect()


def test_round_trip(spark, tmp_path):
    big = "<p>é</p>\r\n\r\nWARC/1.1\r\n" * 9000
    rows = [(1, "http://a/", "x" * 100), (2, "http://b/", "x" * 100), (3, None, "y" * 99), (4, "u", "y" * 99), (5, "u\r\nX: 1", big), (6, "u", None), (None, "u", "x" * 100), (7, "u", ""), (8, "é", "🙂" * 40)]
    got = {r["page_id"]: r for r in round_trip(spark, rows, tmp_path)}
    assert len(got) == len(rows)
    for page, _, html in rows:
        r, data = got[page], (html or "").encode()
        assert bytes(r["payload"]) == data and r["payload_bytes"] == len(data) and r["payload_digest"] == hashlib.sha256(data).hexdigest()
        assert (r["record_type"], r["refers_to"]) == (("revisit", 1) if page in (2, None) else ("response", None))


def test_repeated_rows(spark, tmp_path):
    rows = [(1, "u", "z" * 200)] * 3 + [(2, "u", "short")] * 2
    got = sorted((r["page_id"], r["record_type"], str(r["refers_to"])) for r in round_trip(spark, rows, tmp_path))
    assert got == [(1, "response", "None"), (1, "revisit", "1"), (1, "revisit", "1"), (2, "response", "None"), (2, "response", "None")]


def test_empty(spark, tmp_path):
    assert round_trip(spark, [], tmp_path) == []


def test_archives_are_segmented(spark, tmp_path):
    w.write_archives(pages(spark, [(1, "u", "q" * (3 * w.SEGMENT_BYTES))]), f"file://{tmp_path}/a")
    data = b"".join(gzip.decompress(f.read_bytes()) for f in Path(f"{tmp_path}/a").glob("*.gz"))
    found = list(w.parse(io.BytesIO(data)))
    assert [f["warc-type"] for f, _ in found] == ["response", "continuation", "continuation", "continuation"]
    assert [int(f["warc-segment-number"]) for f, _ in found] == [1, 2, 3, 4]
    assert int(found[-1][0]["warc-segment-total-length"]) == sum(len(b) for _, b in found)
    assert {f["warc-segment-origin-id"] for f, _ in found[1:]} == {found[0][0]["warc-record-id"]}


def test_damage_is_named():
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nabc\r\n0\r\n\r\n"
    assert w.payload_of(block, "sha256:" + hashlib.sha256(b"abc").hexdigest(), "r") == b"abc"
    assert w.payload_of(b"HTTP/1.1 200 OK\r\n\r\nabc", None, "r") == b"abc"
    with pytest.raises(ValueError, match="digest"):
        w.payload_of(block, "sha256:00", "r")
    with pytest.raises(ValueError, match="chunk"):
        w.dechunk(b"2\r\nabc\r\n0\r\n\r\n")
    assert w.assemble([(2, b"b", 2), (1, b"a", None)], "r") == b"ab"
    for bad in ([(1, b"a", None), (3, b"b", 2)], [(1, b"a", None), (2, b"b", 9)], [(2, b"b", 1)]):
        with pytest.raises(ValueError, match="segments"):
            w.assemble(bad, "r")
    with pytest.raises(ValueError, match="no WARC record"):
        list(w.parse(io.BytesIO(b"junk\r\n\r\n")))
    with pytest.raises(ValueError, match="length"):
        list(w.parse(io.BytesIO(b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabcd\r\n\r\n")))


def test_a_revisit_without_its_response_is_an_error(spark, tmp_path):
    w.write_archives(pages(spark, [(1, "u", "z" * 200), (2, "u", "z" * 200)]), f"file://{tmp_path}/a")
    data = b"".join(gzip.decompress(f.read_bytes()) for f in Path(f"{tmp_path}/a").glob("*.gz"))
    records = [x for x in data.split(b"WARC/1.1\r\n") if b"WARC-Type: revisit" in x]
    (tmp_path / "b").mkdir()
    # one member for a record, as others write them
    (tmp_path / "b" / "x.warc.gz").write_bytes(b"".join(gzip.compress(b"WARC/1.1\r\n" + x) for x in records))
    with pytest.raises(Exception, match="a record that is not there"):
        w.read_archives(spark, f"file://{tmp_path}/b").collect()
