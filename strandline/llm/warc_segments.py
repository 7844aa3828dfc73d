"""WARC archives: writing with segmented, chunked responses and revisits; reading by reassembly.

Writing.  Each page becomes an HTTP response in chunked framing.  Of pages with equal payloads of at
least ``REVISIT_BYTES`` bytes the one with the smallest page_id is written as response, the others
as revisits of it.  A block longer than ``SEGMENT_BYTES`` is cut: the response holds segment 1, and
continuation records carry the origin's id, their number and, in the last, the total length.  Archives
are gzip files of at most ``FILE_RECORDS`` records, so a file has a bounded size however long pages are.

Reading.  Archives are parsed file by file and record by record as they are decompressed.  Segmented records are grouped by origin id, ordered by
number and checked: numbers without gaps, the total length, and the payload's digest.  Then the
chunked framing is decoded.  A revisit takes its payload from the response that it refers to; one whose
response is in none of the archives is an error.

Rows: a null html is an empty payload.  A null page_id is left out of the record and comes back as
null; it never precedes another as response.  Of equal pages with equal ids the one with the least
url is the response, then the first copy; a repeated row is written as often as it is there.  Empty
tables give no archives and no rows.  Damaged archives raise an error that names the record.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import Stored, shared_dir, table

REVISIT_BYTES = 100
SEGMENT_BYTES, CHUNK_BYTES = 32 * 1024, 4096
FILE_RECORDS, BATCH_BYTES = 2048, 1 << 24
DATE = "2020-01-01T00:00:00Z"
_END = "\r\n"
_HEAD = f"HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=utf-8{_END}Transfer-Encoding: chunked{_END}{_END}"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _field(name: str, value: Column) -> Column:
    """A header line, or nothing for a null value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(_END)), F.lit(""))


def _pieces(data: str, size: Column, step: int) -> Column:
    """Offsets 0, step, 2 * step ... below ``size``; none for zero."""
    return F.when(size > 0, F.sequence(F.lit(0), F.floor((size - 1) / step).cast("int"))).otherwise(F.array().cast("array<int>"))


def records(pages: DataFrame) -> DataFrame:
    """page_id, url, payload (binary), n_bytes, digest, id, first (id and page of the response that a revisit refers to)."""
    base = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("html"))
    base = base.select("page_id", "url", F.col("html").cast("binary").alias("payload"), F.octet_length("html").cast("long").alias("n_bytes"), F.sha2(F.col("html").cast("binary"), 256).alias("digest"))
    key = ["page_id", "url", "digest"]
    again = base.groupBy(*key).agg(F.count("*").alias("copies")).where("copies > 1")
    rows = base.withColumn("copy", F.lit(1))
    if not again.isEmpty():
        same = lambda a, b: a["page_id"].eqNullSafe(b["page_id"]) & a["url"].eqNullSafe(b["url"]) & (a["digest"] == b["digest"])
        once = base.join(again, same(base, again), "left_anti").withColumn("copy", F.lit(1))
        repeats = base.join(again, same(base, again), "left_semi").groupBy(*key).agg(F.first("payload").alias("payload"), F.first("n_bytes").alias("n_bytes"), F.count("*").alias("n"))
        rows = once.unionByName(repeats.select(*key, "payload", "n_bytes", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy")))
    name = F.md5(F.to_json(F.struct(*key, "copy")).cast("binary"))
    rows = rows.withColumn("id", name)
    order = F.struct(F.col("page_id").isNull().alias("n"), "page_id", "url", "copy", "id")
    first = rows.where(F.col("n_bytes") >= REVISIT_BYTES).groupBy("digest").agg(F.min(order).alias("x"), F.count("*").alias("c")).where("c > 1")
    first = first.select("digest", F.col("x.id").alias("first_id"))
    return rows.join(first, "digest", "left").withColumn("refers", F.when((F.col("n_bytes") >= REVISIT_BYTES) & (F.col("first_id") != F.col("id")), F.col("first_id")))


def write_archives(pages: DataFrame, path: str) -> None:
    """A record for every row of ``pages`` (page_id, url, html) in archives under ``path``."""
    rows = records(pages)
    size = F.col("n_bytes")
    chunks = F.transform(
        _pieces("payload", size, CHUNK_BYTES),
        lambda k: F.concat(F.lower(F.hex(F.least(F.lit(CHUNK_BYTES), size - k * CHUNK_BYTES))), F.lit(_END), F.substring("payload", k * CHUNK_BYTES + 1, F.lit(CHUNK_BYTES)).cast("string"), F.lit(_END)),
    )
    body = F.concat(F.lit(_HEAD), F.array_join(chunks, ""), F.lit(f"0{_END}{_END}"))
    rows = rows.select("page_id", "url", "digest", "id", "refers", F.when(F.col("refers").isNull(), body).otherwise(F.lit(_HEAD)).cast("binary").alias("block"))
    total = F.octet_length("block")
    rows = rows.select("*", total.alias("total"), F.posexplode(_pieces("block", total, SEGMENT_BYTES)).alias("p", "k"))
    part = F.substring("block", F.col("k") * SEGMENT_BYTES + 1, F.lit(SEGMENT_BYTES))
    last, cut = (F.col("k") + 1) * SEGMENT_BYTES >= F.col("total"), F.col("total") > SEGMENT_BYTES
    urn = lambda value: F.concat(F.lit("<urn:md5:"), value, F.lit(">"))
    kind = F.when(F.col("k") > 0, "continuation").when(F.col("refers").isNotNull(), "revisit").otherwise("response")
    own = F.when(F.col("k") > 0, F.concat("id", F.lit("-"), F.col("k") + 1)).otherwise(F.col("id"))
    head = F.concat(
        F.lit(f"WARC/1.1{_END}"),
        _field("WARC-Type", kind),
        _field("WARC-Record-ID", urn(own)),
        _field("WARC-Date", F.lit(DATE)),
        _field("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "")),
        _field("X-Page-ID", F.col("page_id").cast("string")),
        F.when(F.col("k") == 0, F.concat(_field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")), F.lit(f"Content-Type: application/http;msgtype=response{_END}"))).otherwise(F.lit("")),
        F.when(F.col("refers").isNotNull(), F.concat(_field("WARC-Profile", F.lit(_PROFILE)), _field("WARC-Refers-To", urn(F.col("refers"))))).otherwise(F.lit("")),
        F.when(cut, _field("WARC-Segment-Number", (F.col("k") + 1).cast("string"))).otherwise(F.lit("")),
        F.when(cut & (F.col("k") > 0), _field("WARC-Segment-Origin-ID", urn(F.col("id")))).otherwise(F.lit("")),
        F.when(cut & last, _field("WARC-Segment-Total-Length", F.col("total").cast("string"))).otherwise(F.lit("")),
        _field("Content-Length", F.octet_length(part).cast("string")),
        F.lit(_END),
    )
    # each line's separator is the end of a record
    rows.select(F.concat(head, part.cast("string")).alias("value")).write.option("lineSep", _END * 2).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def parse(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of an archive, one record at a time."""
    while first := stream.readline():
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no WARC record where {first[:40]!r} stands")
        fields = {}
        while line := stream.readline().rstrip(b"\r\n"):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.lower()] = value.strip()
        block = stream.read(int(fields["content-length"]))
        if len(block) < int(fields["content-length"]) or stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"{fields.get('warc-record-id')}: the block doesn't end where its length says")
        yield fields, block


def dechunk(body: bytes) -> bytes:
    """The payload of a chunked body."""
    parts, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(parts)
        at = end + 2
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk doesn't end where its size says")
        parts.append(body[at : at + size])
        at += size + 2


def payload_of(block: bytes, digest: str | None, name: str) -> bytes:
    """The payload of a whole HTTP response block, checked against the record's digest."""
    head, _, body = block.partition(b"\r\n\r\n")
    payload = dechunk(body) if b"transfer-encoding: chunked" in head.lower() else body
    if digest and digest != "sha256:" + hashlib.sha256(payload).hexdigest():
        raise ValueError(f"{name}: the payload doesn't have the record's digest")
    return payload


def assemble(segments: list[tuple[int, bytes, int | None]], name: str) -> bytes:
    """The block of the segments (number, part, total length where given), in any order."""
    segments = sorted(segments, key=lambda s: s[0])
    block = b"".join(part for _, part, _ in segments)
    if [s[0] for s in segments] != list(range(1, len(segments) + 1)) or segments[-1][2] != len(block):
        raise ValueError(f"{name}: segments {[s[0] for s in segments]} of {len(block)} bytes; the last should give that length, not {segments[-1][2]}")
    return block


_PARSED = "page_id long, kind string, id string, origin string, number int, total long, digest string, refers string, n_bytes long, payload binary, part binary"


def _parse_files(with_payload: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, kinds = [c.split()[0] for c in _PARSED.split(", ")], {"page_id": "Int64", "number": "Int32", "total": "Int64", "n_bytes": "Int64"}
        for pdf in batches:
            for content in pdf["content"]:
                rows, size = [], 0
                stream = io.BytesIO(content)
                for f, block in parse(gzip.GzipFile(fileobj=stream) if content[:2] == b"\x1f\x8b" else stream):
                    number = int(f["warc-segment-number"]) if "warc-segment-number" in f else None
                    total = int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None
                    page, kind, name = int(f["x-page-id"]) if "x-page-id" in f else None, f["warc-type"], f["warc-record-id"]
                    payload = payload_of(block, f.get("warc-payload-digest"), name) if kind == "response" and number is None else None
                    size += len(block)
                    rows.append((page, kind, name, f.get("warc-segment-origin-id", name), number, total, f.get("warc-payload-digest"), f.get("warc-refers-to"), None if payload is None else len(payload), payload if with_payload else None, block if number is not None else None))
                    if size > BATCH_BYTES:
                        yield pd.DataFrame(rows, columns=names).astype(kinds)
                        rows, size = [], 0
                yield pd.DataFrame(rows, columns=names).astype(kinds)

    return run


def _assemble_rows(with_payload: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for name, digest, segments in zip(pdf["id"], pdf["digest"], pdf["segments"]):
                block = assemble([(s["number"], bytes(s["part"]), None if pd.isna(s["total"]) else int(s["total"])) for s in segments], name)
                payload = payload_of(block, digest, name)
                out.append((len(payload), payload if with_payload else None))
            yield pd.DataFrame({"page_id": pdf["page_id"].astype("Int64"), "id": pdf["id"], "digest": pdf["digest"], "n_bytes": [n for n, _ in out], "payload": [p for _, p in out]})

    return run


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and, if asked for, payload of every record."""
    files = spark.read.format("binaryFile").load(path).select("content")
    parsed = Stored(files.mapInPandas(_parse_files(with_payload), _PARSED), "records").df
    whole = parsed.where("kind = 'response' AND number IS NULL").select("page_id", "id", "digest", "n_bytes", "payload")
    starts = F.max_by(F.struct("page_id", "digest"), F.col("kind") == "response")
    cut = parsed.where("number IS NOT NULL").groupBy(F.col("origin").alias("id")).agg(starts.alias("x"), F.collect_list(F.struct("number", "part", "total")).alias("segments"))
    joined = cut.select("x.page_id", "id", "x.digest", "segments").mapInPandas(_assemble_rows(with_payload), "page_id long, id string, digest string, n_bytes long, payload binary")
    responses = whole.unionByName(joined)
    revisits = parsed.where("kind = 'revisit'").select("page_id", "refers")
    seen = revisits.join(responses.select(F.col("page_id").alias("refers_to"), "id", "digest", "n_bytes", "payload"), F.col("refers") == F.col("id"), "left")
    lost = F.raise_error(F.concat(F.lit("a revisit of a record that is not there: "), "refers"))
    seen = seen.withColumn("n_bytes", F.when(F.col("id").isNull(), lost.cast("long")).otherwise(F.col("n_bytes")))
    both = responses.select("page_id", "n_bytes", "digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "payload").unionByName(seen.select("page_id", "n_bytes", "digest", F.lit("revisit").alias("record_type"), "refers_to", "payload"))
    out = both.select("page_id", F.col("n_bytes").alias("payload_bytes"), F.substring("digest", 8, 64).alias("payload_digest"), "record_type", "refers_to", "payload")
    return out if with_payload else out.drop("payload")


def op8_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/archives-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path)


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p
)
SELECT page_id, n AS payload_bytes, sha256(html) AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""

QUERIES = {"op8_warc_segments": op8_warc_segments}
ORACLES = {"op8_warc_segments": ORACLE}
