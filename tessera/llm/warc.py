"""WARC archives: writing, reading, and reassembly of segmented records.

Writing. A page is a response record, or a revisit of the page with the smallest id of equal payload. The payload goes
in chunked transfer framing after the HTTP header; a block above ``segment`` bytes is split over a first record and
continuation records. Spark's text sink writes the archive: a value is a record up to its block's end, and the line
separator is the two line breaks that end a record, so files are plain WARC files in any file system Spark knows.

Reading. Files are read whole (their size is bounded by the writer) and cut into records by Content-Length. Continuation
records are grouped by their origin's id, ordered by segment number, checked against the total length and joined; then
the transfer framing is decoded and the payload's digest compared with the header's.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import Scratch, checkpointed, read, small_side, text_of

VERSION = "WARC/1.1"
SEGMENT = 1 << 16
CHUNK = 1 << 13
#: Records in a file; with the segment size they bound it to about 66 MB.
FILE_RECORDS = 1000
LEAST_BYTES = 0

RECORDS = "page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, problem string, origin string, segment int, total long, block binary"


def _cuts(data: bytes, size: int) -> list[bytes]:
    """Parts of about size bytes that end between characters, as the text sink asks for."""
    out, start = [], 0
    while len(data) - start > size:
        end = start + size
        while end > start + 1 and data[end] & 0xC0 == 0x80:
            end -= 1
        out.append(data[start:end])
        start = end
    return [*out, data[start:]]


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    return b"".join(b"%x\r\n%s\r\n" % (len(c), c) for c in _cuts(payload, size) if c) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if n == 0:
            if body[at : at + 2] != b"\r\n" and b"\r\n\r\n" not in body[at:]:
                raise ValueError("no end of chunks")
            return b"".join(out)
        if at + n + 2 > len(body) or body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("chunk cut short")
        out.append(body[at : at + n])
        at += n + 2


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(headers: list[tuple[str, object]], block: bytes) -> str:
    head = "\r\n".join([VERSION, *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"])
    return head + "\r\n\r\n" + block.decode()


def page_records(page_id, url: str | None, payload: bytes, sha1: str, first, row: str, segment: int = SEGMENT) -> list[str]:
    """The records of one page. first: the page that this one revisits, if any."""
    me = f"<urn:page:{page_id}:{row}>"
    clean = "".join(c for c in url or "" if c > " ") or f"urn:page:{page_id}"
    common = [("WARC-Record-ID", me), ("WARC-Target-URI", clean), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{sha1}")]
    http = [("Content-Type", "application/http; msgtype=response")]
    if first is not None:
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        more = [("WARC-Type", "revisit"), ("WARC-Refers-To", f"<urn:page:{first}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        return [_record(more + common + http, block)]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = _cuts(block, segment)
    if len(parts) == 1:
        return [_record([("WARC-Type", "response"), *common, *http], block)]
    out = [_record([("WARC-Type", "response"), *common, *http, ("WARC-Segment-Number", 1)], parts[0])]
    for k, part in enumerate(parts[1:], 2):
        tail = [("WARC-Segment-Total-Length", len(block))] if k == len(parts) else []
        out.append(_record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:page:{page_id}:{row}:{k}>"), ("WARC-Target-URI", clean), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Segment-Origin-ID", me), ("WARC-Segment-Number", k), *tail], part))
    return out


def _write(segment: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            out: list[str] = []
            for page, url, html, sha, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                row += 1
                out += page_records(page, url, html.as_py().encode(), base64.b32encode(bytes.fromhex(sha)).decode(), first, f"{part}-{row}", segment)
                if len(out) > 200:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
                    out = []
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    return run


def write_archives(pages: DataFrame, path: str, segment: int = SEGMENT, least_bytes: int = LEAST_BYTES) -> None:
    """Writes a record for each row of pages (page_id, url, html) to files at path.

    A null html is an empty payload; a null url is named by the page's id. Of rows with equal payloads of at least
    least_bytes the smallest page_id is the response and the others revisit it; rows with that same id are responses too,
    and so are rows without an id.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), text_of("html").alias("html"))
    rows = rows.withColumns({"sha1": F.sha1("html"), "sha2": F.sha2("html", 256), "n": F.octet_length("html")})
    groups = rows.where(F.col("n") >= least_bytes).groupBy("sha2", "n").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    groups = checkpointed(groups)
    marked = rows.join(small_side(groups, groups.count()), ["sha2", "n"], "left")
    first = F.when(F.col("page_id") > F.col("first"), F.col("first"))
    records = marked.select("page_id", "url", "html", "sha1", first.alias("first")).mapInArrow(_write(segment), "value string")
    records.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def parse_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        first, *lines = content[at:end].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        start, n = end + 4, int(head["content-length"])
        if content[start + n : start + n + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} does not end where its length says")
        yield head, content[start : start + n]
        at = start + n + 4


def _page_of(uri: str) -> int | None:
    name = uri.strip("<>").split(":")[2]
    return None if name == "None" else int(name)


def _response(head_digest: str, block: bytes) -> tuple[int, str, str | None]:
    """payload_bytes, payload_digest and what is wrong with the record."""
    try:
        http, body = block.split(b"\r\n\r\n", 1)
        payload = unchunked(body) if b"transfer-encoding: chunked" in http.lower() else body
    except ValueError as error:
        return 0, head_digest, str(error)
    found = digest(payload)
    return len(payload), found, None if found == head_digest else "digest differs"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in RECORDS.split(", ")]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.binary()]
    for batch in batches:
        for content in batch.column(0):
            out = []
            for head, block in parse_records(content.as_py()):
                kind, sha = head["warc-type"], head.get("warc-payload-digest", "").removeprefix("sha1:")
                if kind == "continuation" or "warc-segment-number" in head:
                    origin = head.get("warc-segment-origin-id", head["warc-record-id"])
                    total = head.get("warc-segment-total-length")
                    out.append((_page_of(origin), "segment", None, sha or None, None, None, origin, int(head["warc-segment-number"]), int(total) if total else None, block))
                elif kind == "revisit":
                    n = next(int(x.split(b":")[1]) for x in block.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                    out.append((_page_of(head["warc-record-id"]), kind, n, sha, _page_of(head["warc-refers-to"]), None, None, None, None, None))
                elif kind == "response":
                    n, found, problem = _response(sha, block)
                    out.append((_page_of(head["warc-record-id"]), kind, n, found, None, problem, None, None, None, None))
            cols = list(zip(*out, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)


PAGES = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, problem string"


def _reassemble(group: pd.DataFrame) -> pd.DataFrame:
    rows = group.sort_values("segment")
    block, totals = b"".join(rows["block"]), rows["total"].dropna()
    sha = rows["payload_digest"].dropna()
    n, found, problem = 0, sha.iloc[0] if len(sha) else "", None
    if rows["segment"].tolist() != list(range(1, len(rows) + 1)):
        problem = "segments missing or repeated"
    elif len(totals) != 1 or int(totals.iloc[0]) != len(block):
        problem = "total length differs"
    else:
        n, found, problem = _response(found, block)
    page = rows["page_id"].iloc[0]
    return pd.DataFrame({"page_id": pd.array([page], "Int64"), "payload_bytes": [n], "payload_digest": [found], "record_type": ["response"], "refers_to": pd.array([None], "Int64"), "problem": [problem]})


def read_archives(spark: SparkSession, path: str, scratch: Scratch) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and problem (null if the record is sound) of each response or revisit at path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    records = scratch.table(files.mapInArrow(_parse, RECORDS))
    whole = records.where("record_type <> 'segment'").select(*[x.split()[0] for x in PAGES.split(", ")])
    parts = records.where("record_type = 'segment'").select("page_id", "payload_digest", "origin", "segment", "total", "block")
    return whole.unionByName(parts.groupBy("origin").applyInPandas(_reassemble, PAGES))


def archive_round_trip(pages: DataFrame, segment: int = SEGMENT, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """What is read back from the archives of pages. An empty table gives no rows; other columns are ignored."""
    with Scratch(pages.sparkSession, "warc") as scratch:
        write_archives(pages, f"{scratch.path}/archives", segment, least_bytes)
        return checkpointed(read_archives(pages.sparkSession, f"{scratch.path}/archives", scratch))


def op6_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(read(spark, sf_dir, "pages")).drop("problem")


_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(x, {5 * g + 1}, 5))::BIGINT >> {s}) & 31) + 1, 1)" for g in range(8) for s in (15, 10, 5, 0))
SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages), f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, strlen(p.h) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to
FROM p JOIN f ON p.h = f.h
"""
