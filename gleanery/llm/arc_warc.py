"""Legacy archive conversion: ARC (versions 1 and 2) to WARC/1.0.

``arc_archives`` makes ARC archives of pages; ``arc_records`` parses them by their version's header line and each
record's declared length; ``to_warc`` writes equivalent WARC records (record id, date, type, block and payload digests)
and makes revisits of repeated payloads; ``read_warc`` reads them back. Archives are rows of bytes in a Parquet dataset,
so any store that Spark reaches can hold them, and each is a few MB, so no task holds more than one large payload.

Edge cases: a null html is an empty payload; a null url is written as ``-`` and read back as null; white space,
controls and ``%`` in urls are percent-encoded; a null page_id has no page header and ranks below every number; of rows
with the same largest page_id one is the response; an empty table gives no archives; extra columns are not read.
A record whose declared length passes the archive's end raises ValueError.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The field names of the two versions' record lines.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
ARCHIVES = "archive string, content binary"
INDEX = "archive string, rec int, page_id long, digest binary"
READ = "record_id string, refers string, page_id long, url string, record_type string, payload_bytes long, payload_digest string"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def arc_head(version: int, name: str, date: str) -> bytes:
    """The version block that opens an archive."""
    body = f"{version} 0 gleanery\n{FIELDS[version]}\n\n".encode()
    extra = "" if version == 1 else f"200 - - 0 {name} "
    return f"filedesc://{name} 0.0.0.0 {date} text/plain {extra}{len(body)}\n".encode() + body


def arc_record(version: int, name: str, offset: int, url: str | None, date: str, content: bytes) -> bytes:
    line = [quote(url, safe="!#$&'()*+,/:;=?@[]~") if url else "-", "0.0.0.0", date, "text/html"]
    if version == 2:
        line += ["200", hashlib.md5(content).hexdigest(), "-", str(offset), name]
    return f"\n{' '.join([*line, str(len(content))])}\n".encode() + content


def http_response(page_id: int | None, payload: bytes) -> bytes:
    page = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{page}Content-Length: {len(payload)}\r\n\r\n".encode() + payload


def arc_archives(pages: DataFrame, date: str = "20240101000000", archive_bytes: int = 2 << 20) -> DataFrame:
    """ARC archives of ``pages(page_id, url, html)``; versions 1 and 2 take turns."""

    def run(batches):
        from pyspark import TaskContext

        part, k, buf, name = TaskContext.get().partitionId(), 0, bytearray(), ""
        made = lambda: pa.RecordBatch.from_pydict({"archive": [name], "content": [bytes(buf)]})
        for batch in batches:
            for p, u, h in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                version = k % 2 + 1
                if not buf:
                    name = f"part-{part:06d}-{k:06d}.arc"
                    buf += arc_head(version, name, date)
                buf += arc_record(version, name, len(buf), u, date, http_response(p, (h or "").encode("utf-8", "surrogatepass")))
                if len(buf) >= archive_bytes:
                    yield made()
                    k, buf = k + 1, bytearray()
        if buf:
            yield made()

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, ARCHIVES)


def parse_arc(content: bytes) -> Iterator[dict]:
    """Records of one archive: the version line names the fields of the lines that follow."""
    at, names = 0, None
    while at < len(content):
        if content[at : at + 1] == b"\n":
            at += 1
            continue
        end = content.find(b"\n", at)
        line = content[at : end if end >= 0 else len(content)].decode("utf-8").split(" ")
        size = int(line[-1])
        body = content[end + 1 : end + 1 + size]
        if end < 0 or size < 0 or len(body) < size:
            raise ValueError(f"record at {at} declares {line[-1]} bytes; {len(body)} are there")
        if names is None:
            names = body.split(b"\n")[1].decode().split(" ")
        else:
            yield dict(zip(names, line, strict=True)) | {"content": body}
        at = end + 1 + size


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """Header (with its blank line) and payload."""
    head, mark, payload = content.partition(b"\r\n\r\n")
    return head + mark, payload


def page_of(head: bytes) -> int | None:
    found = re.search(rb"\r\nX-Page-Id: (-?\d+)\r\n", head)
    return int(found[1]) if found else None


def arc_index(archives: DataFrame) -> DataFrame:
    """Place, page and payload digest of every ARC record, without the payloads."""

    def run(batches):
        for batch in batches:
            for name, content in zip(*(batch.column(c).to_pylist() for c in ("archive", "content")), strict=True):
                pages, digests = [], []
                for r in parse_arc(content):
                    head, payload = split_http(r["content"])
                    pages.append(page_of(head))
                    digests.append(hashlib.sha1(payload).digest())
                n = len(pages)
                yield pa.RecordBatch.from_pydict({"archive": [name] * n, "rec": pa.array(range(n), pa.int32()), "page_id": pa.array(pages, pa.int64()), "digest": pa.array(digests, pa.binary())})

    return archives.mapInArrow(run, INDEX)


def record_id(archive: str, rec: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{archive}:{rec}')}>"


def warc_record(record: dict, archive: str, rec: int, refers: tuple[str, int] | None) -> bytes:
    """One ARC record as WARC: a response, or a revisit that keeps only the HTTP header."""
    d = record["Archive-date"]
    head, payload = split_http(record["content"])
    block = head if refers else record["content"]
    url = "" if record["URL"] == "-" else f"WARC-Target-URI: {record['URL']}\r\n"
    more = f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: {record_id(*refers)}\r\n" if refers else ""
    text = (
        f"WARC/1.0\r\nWARC-Type: {'revisit' if refers else 'response'}\r\nWARC-Record-ID: {record_id(archive, rec)}\r\n"
        f"WARC-Date: {d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z\r\n{url}"
        f"WARC-IP-Address: {record['IP-address']}\r\nContent-Type: application/http; msgtype=response\r\n"
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}\r\nWARC-Payload-Digest: sha1:{base32_sha1(payload)}\r\n{more}"
        f"Content-Length: {len(block)}\r\n\r\n"
    )
    return text.encode() + block + b"\r\n\r\n"


def to_warc(archives: DataFrame, revisit_bytes: int = 0) -> DataFrame:
    """WARC archives, one per ARC archive.

    Of records with equal payloads the one with the largest page_id is the response. Only places, page numbers and
    digests are shuffled to find it; the archives are then joined once with their own lists of revisits.
    ``revisit_bytes``: shorter payloads are never revisits.
    """
    index = arc_index(archives)
    place = F.struct(F.coalesce("page_id", F.lit(-(2**63))).alias("p"), "archive", "rec")
    best = index.groupBy("digest").agg(F.max(place).alias("to"), F.count("*").alias("n")).filter("n > 1")
    moved = index.join(best, "digest").filter((F.col("to.archive") != F.col("archive")) | (F.col("to.rec") != F.col("rec")))
    lists = moved.groupBy("archive").agg(F.collect_list(F.struct("rec", F.col("to.archive").alias("a"), F.col("to.rec").alias("r"))).alias("revisits"))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                to = {x["rec"]: (x["a"], x["r"]) for x in row["revisits"] or ()}
                out = bytearray()
                for k, r in enumerate(parse_arc(row["content"])):
                    whole = len(split_http(r["content"])[1]) >= revisit_bytes
                    out += warc_record(r, row["archive"], k, to.get(k) if whole else None)
                yield pa.RecordBatch.from_pydict({"archive": [row["archive"].replace(".arc", ".warc")], "content": [bytes(out)]})

    return archives.join(lists, "archive", "left").mapInArrow(run, ARCHIVES)


def parse_warc(content: bytes) -> Iterator[tuple[dict, bytes]]:
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        lines = content[at:end].decode().split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        size = int(fields["Content-Length"])
        if lines[0] != "WARC/1.0" or end + 8 + size > len(content):
            raise ValueError(f"no whole record at {at}")
        yield fields, content[end + 4 : end + 4 + size]
        at = end + 8 + size


def read_warc(archives: DataFrame) -> DataFrame:
    """Every record of the archives; digests of responses are checked against their payloads."""

    def run(batches):
        for batch in batches:
            for content in batch.column("content").to_pylist():
                cols: dict[str, list] = {c.split()[0]: [] for c in READ.split(", ")}
                for f, block in parse_warc(content):
                    head, payload = split_http(block)
                    digest = f["WARC-Payload-Digest"].removeprefix("sha1:")
                    if f["WARC-Type"] == "response" and base32_sha1(payload) != digest:
                        raise ValueError(f"{f['WARC-Record-ID']}: the payload does not fit its digest")
                    url = f.get("WARC-Target-URI")
                    size = int(re.search(rb"\r\nContent-Length: (\d+)\r\n", head)[1])
                    for c, v in zip(cols, (f["WARC-Record-ID"], f.get("WARC-Refers-To"), page_of(head), url and unquote(url), f["WARC-Type"], size, digest), strict=True):
                        cols[c].append(v)
                types = {"page_id": pa.int64(), "payload_bytes": pa.int64()}
                yield pa.RecordBatch.from_pydict({c: pa.array(v, types.get(c, pa.string())) for c, v in cols.items()})

    return archives.mapInArrow(run, READ)


def page_records(records: DataFrame) -> DataFrame:
    """Per page: page_id, payload_bytes, payload_digest, record_type, refers_to (the response's page_id)."""
    to = records.filter("record_type = 'response'").select(F.col("record_id").alias("refers"), F.col("page_id").alias("refers_to"))
    again = records.filter("record_type = 'revisit'").join(to, "refers")
    first = records.filter("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long"))
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return first.select(cols).union(again.select(cols))
