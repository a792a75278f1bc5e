"""Operator 10: legacy ARC archives to WARC, and back to rows.

ARC files state in their version block which fields a record's header line has
(version 1: url ip date type length; version 2: url ip date type code checksum
location offset file length). The converter parses a line by that statement,
takes as many bytes as the line declares, and makes the WARC counterpart: an
identifier derived from the record, an ISO timestamp, a record type and digests.

Archives are plain WARC files, one Spark text part each, written in the shared
folder: every row is a record and the line separator is WARC's end of record.
They are read back as binary files and cut by Content-Length alone.

Defined results: null html is an empty payload; null urls become 'about:blank',
and spaces or controls in a url are percent-encoded. Rows of one page_id are
records of their own. A null page_id stays null and never is a response that
others refer to, unless all copies are null.
"""

from __future__ import annotations

import hashlib
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import Scratch, by_bytes, shared_dir, small_batches, table

#: Payloads under so many bytes are never revisits.
MIN_REVISIT_BYTES = 100
#: Records in one archive file, at most, so that a reader holds a few tens of MB.
RECORDS_A_FILE = 2000
END = "\r\n\r\n"
#: Header line fields by ARC version (fixed values)
ARC_FIELDS = {1: ("url", "ip", "date", "type", "length"), 2: ("url", "ip", "date", "type", "code", "checksum", "location", "offset", "file", "length")}
ARC_TITLES = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
CAPTURED = "20200102030405"


def safe_url(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "about:blank"


def arc_version_block(version: int, name: str = "pages.arc") -> bytes:
    body = f"{version} 0 graphloom\n{ARC_TITLES[version]}\n".encode()
    line = f"filedesc://{name} 0.0.0.0 {CAPTURED} text/plain " + ("" if version == 1 else f"200 - - 0 {name} ")
    return f"{line}{len(body)}\n".encode() + body + b"\n"


def arc_record(version: int, url: str, content: bytes, date: str = CAPTURED, kind: str = "text/html") -> bytes:
    more = "" if version == 1 else "200 - - 0 pages.arc "
    return f"{url} 0.0.0.0 {date} {kind} {more}{len(content)}\n".encode() + content + b"\n"


def parse_arc(raw: bytes) -> list[dict]:
    """Records of an ARC file: the header line's fields and content. Lengths are
    trusted, line ends aren't: contents may hold any bytes. A record that runs
    past the file's end raises."""
    out, i, fields = [], 0, None
    while i < len(raw):
        if raw[i : i + 1] in b"\n\r":  # records end in an empty line
            i += 1
            continue
        stop = raw.index(b"\n", i)
        words = raw[i:stop].rstrip(b"\r").decode("utf-8", "surrogateescape").split(" ")
        length, start = int(words[-1]), stop + 1
        if start + length > len(raw):
            raise ValueError("truncated record")
        content = raw[start : start + length]
        i = start + length
        if fields is None:
            if not words[0].startswith("filedesc:"):
                raise ValueError("no version block")
            version = int(content.split(b" ", 1)[0])
            fields = ARC_FIELDS[version]
            continue
        if len(words) < len(fields):
            raise ValueError(f"{len(words)} fields in a header line of {len(fields)}")
        words = [" ".join(words[: len(words) - len(fields) + 1]), *words[len(words) - len(fields) + 1 :]]  # a url may hold spaces
        out.append(dict(zip(fields, words, strict=True)) | {"content": content, "version": version})
    return out


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(map(str, parts)))}>"


def arc_to_warc(record: dict, name: str, payload_digest: str | None = None, refers_to: tuple[str, str] | None = None) -> bytes:
    """A parsed ARC record as a WARC record, without its end. refers_to: id and
    url of the record that holds the payload; the block is then the HTTP header alone."""
    content = record["content"]
    http = content.startswith(b"HTTP/")
    head, cut, payload = content.partition(b"\r\n\r\n") if http else (b"", b"", content)
    kind = ("revisit" if refers_to else "response") if http else "resource"
    block = head + cut if refers_to else content
    whole = payload_digest or hashlib.sha256(payload).hexdigest()
    d = record["date"].ljust(14, "0")
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(name, record['url'], record['date'], whole)}", f"WARC-Date: {d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z", f"WARC-Target-URI: {record['url']}",
        f"WARC-IP-Address: {record['ip']}", f"WARC-Payload-Digest: sha256:{whole}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"Content-Type: {'application/http; msgtype=response' if http else record['type']}", f"Content-Length: {len(block)}",
    ]
    if refers_to:
        lines[3:3] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {refers_to[0]}", f"WARC-Refers-To-Target-URI: {refers_to[1]}"]
    return "\r\n".join(lines).encode("utf-8", "surrogateescape") + b"\r\n\r\n" + block


def parse_warc(raw: bytes):
    """(headers, block) of each record, cut by Content-Length."""
    i = 0
    while i < len(raw):
        if raw[i : i + 1] in b"\r\n":
            i += 1
            continue
        stop = raw.index(b"\r\n\r\n", i)
        first, *rest = raw[i:stop].decode("utf-8", "surrogateescape").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in rest)}
        n = int(headers["content-length"])
        if stop + 4 + n > len(raw):
            raise ValueError("truncated record")
        yield headers, raw[stop + 4 : stop + 4 + n]
        i = stop + 4 + n


def page_name(page_id: object) -> str:
    return "pages/null" if page_id is None else f"pages/{page_id}"


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """(file, place, url, warc binary): the records of ARC files (plain or gzip) under `path`, as WARC records. A file is
    read by one task and a record at a time leaves it. refers_to and revisits are for write_archives: ARC files have none."""
    import gzip

    small_batches(spark)

    def run(batches):
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for k, record in enumerate(parse_arc(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw)):
                    warc = arc_to_warc(record, f"{name}#{k}")
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([k], pa.int64()), pa.array([record["url"]]), pa.array([warc], pa.binary())], names=["file", "place", "url", "warc"])

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.arc*").load(path)
    return found.select("path", "content").mapInArrow(run, "file string, place bigint, url string, warc binary")


def write_archives(pages: DataFrame, where: str, version: int = 1) -> None:
    """pages (page_id, url, html) as WARC files under `where`, through ARC records
    of the given version. Equal payloads are found by digest: one partial
    aggregate of (digest, smallest page_id), so a common payload doesn't gather."""
    spark = pages.sparkSession
    rows = pages.selectExpr("cast(page_id as bigint) page_id", "cast(url as string) url", "coalesce(cast(html as string), '') html").withColumns({"digest": F.sha2("html", 256), "size": F.octet_length("html")})
    first = rows.where(F.col("size") >= MIN_REVISIT_BYTES).groupBy("digest").agg(F.min_by(F.struct("page_id", "url"), F.struct(F.col("page_id").isNull(), "page_id", "url")).alias("first"), F.count("*").alias("copies")).where("copies > 1").select("digest", "first")
    head = version

    def run(batches):
        block = arc_version_block(head)
        for b in by_bytes(batches, 2):
            out = []
            for page_id, url, html, digest, first in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                payload = html.encode()
                url = safe_url(url)
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {'' if page_id is None else page_id}\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                (record,) = parse_arc(block + arc_record(head, url, http + payload))
                refers = None
                if first and first["page_id"] != page_id:
                    refers = record_id(page_name(first["page_id"]), safe_url(first["url"]), CAPTURED, digest), safe_url(first["url"])
                    record["refers_page"] = first["page_id"]
                warc = arc_to_warc(record, page_name(page_id), digest, refers)
                if refers:  # page ids are ours, so they go in a header of ours
                    warc = warc.replace(b"\r\nWARC-Refers-To:", f"\r\nX-Refers-To-Page-Id: {first['page_id']}\r\nWARC-Refers-To:".encode(), 1)
                out.append(warc.decode())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    with Scratch(spark):
        rows.join(first, "digest", "left").select("page_id", "url", "html", "digest", "first").mapInArrow(run, "value string").write.option("lineSep", END).option("maxRecordsPerFile", RECORDS_A_FILE).option("compression", "gzip").text(where)


def read_archives(spark: SparkSession, where: str) -> DataFrame:
    """One row per record of the WARC files under `where`."""
    import gzip

    small_batches(spark)
    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, warc_date string"

    def run(batches):
        for b in batches:
            for raw in b.column(0).to_pylist():
                rows = []
                for h, block in parse_warc(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    http = {k.lower(): v for k, _, v in (x.partition(": ") for x in head.decode().split("\r\n")[1:])}
                    digest = h["warc-payload-digest"].removeprefix("sha256:")
                    if h["warc-type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError("payload digest does not hold")
                    ref = h.get("x-refers-to-page-id")
                    rows.append((int(http["x-page-id"]) if http.get("x-page-id") else None, int(http["content-length"]), digest, h["warc-type"], int(ref) if ref and ref != "None" else None, h["warc-target-uri"], h["warc-date"]))
                    if len(rows) == 500:
                        yield _batch(rows)
                        rows = []
                yield _batch(rows)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(where).select("content").mapInArrow(run, schema)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "warc_date"])


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), where)
    return read_archives(spark, where).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
with p as (select page_id, coalesce(html, '') as html, strlen(coalesce(html, '')) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
f as (select *, min(page_id) over (partition by payload_digest) as first_id from p)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= 100 and page_id <> first_id then 'revisit' else 'response' end as record_type,
 case when payload_bytes >= 100 and page_id <> first_id then first_id end as refers_to from f
"""
