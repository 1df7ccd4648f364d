"""Legacy web archives: ARC files of both versions written, read, and converted to WARC.

An ARC file opens with a version block that names its version and the fields of its header lines:
five in version 1, ten in version 2. Every record is a header line whose last field declares the
length of what follows; nothing else marks its end. The converter reads the version, splits the
header lines by it, takes the declared lengths, and makes up what WARC asks for and ARC lacks:
record ids, timestamps of ISO form, record types and digests.

Archives are rows of Spark's text writer, one to a file, so that they can lie in any store and a
lost task is written again; payloads are therefore UTF-8. An archive closes at ``ARCHIVE`` bytes, so
no task holds more than one archive and its widest record. Of equal payloads the record with the
largest id is the response and the others revisit it: the digests are grouped by partial
aggregation, and their join back may be split where one payload has many copies.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findlake.llm.scratch import delete, folder, prepare, written

ARCHIVE = 2 << 20
ORIGIN = "findlake"
#: The crawl's time, for tables that name none.
CRAWLED = "19961231235959"
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMES = uuid.uuid5(uuid.NAMESPACE_URL, "findlake/web-archive")
_ID = b"X-Page-Id"

Batches = Iterator[pa.RecordBatch]


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- ARC -------------------------------------------------------------------------------------


def arc_line(version: int, url: str, length: int, date: str, mime: str, offset: int, name: str, code: int = 200, checksum: str = "-") -> str:
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) or "-"
    fields = (url, "0.0.0.0", date, mime, length) if version == 1 else (url, "0.0.0.0", date, mime, code, checksum, "-", offset, name, length)
    return " ".join(map(str, fields)) + "\n"


def arc_head(version: int, name: str, date: str) -> str:
    block = f"{version} 0 {ORIGIN}\n{' '.join(ARC_FIELDS[version])}\n"
    return arc_line(version, f"filedesc://{name}", len(block), date, "text/plain", 0, name) + block + "\n"


def http_head(page: object, size: int) -> str:
    own = "" if page is None else f"{_ID.decode()}: {page}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n{own}Content-Length: {size}\r\n\r\n"


def read_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, network document) of every record behind the version block."""
    at, fields = 0, ()
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.index(b"\n", at)
        values = data[at:end].decode("utf-8", "replace").split(" ")
        length = int(values[-1])
        body = data[end + 1 : end + 1 + length]
        if len(body) != length:
            raise ValueError(f"a record declares {length} bytes and has {len(body)}")
        at = end + 1 + length
        if not fields:
            if not values[0].startswith("filedesc://"):
                raise ValueError("an ARC file opens with its version block")
            fields = ARC_FIELDS[int(body.split(b" ", 1)[0])]
            continue
        if len(values) != len(fields):
            raise ValueError(f"{len(values)} header fields where the version has {len(fields)}")
        yield dict(zip(fields, values, strict=True)), body


def split_http(block: bytes) -> tuple[dict[bytes, bytes], bytes, bytes]:
    """(fields, head with its blank line, payload) of an HTTP response."""
    head, gap, payload = block.partition(b"\r\n\r\n")
    lines = (line.partition(b":") for line in head.split(b"\r\n")[1:])
    return {k.strip(): v.strip() for k, _, v in lines}, head + gap, payload


# --- WARC ------------------------------------------------------------------------------------


def record_id(page: object, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{page}/{payload_digest}')}>"


def iso(date14: str) -> str:
    d = date14.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(fields: Iterable[tuple[str, object]], block: str) -> str:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block.encode())}\r\n\r\n{block}\r\n\r\n"


def read_warc(data: bytes) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    at = 0
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].split(b"\r\n")
        if not lines[0].startswith(b"WARC/"):
            raise ValueError("a WARC record opens with its version")
        fields = {k: v.strip() for k, _, v in (line.partition(b":") for line in lines[1:])}
        length = int(fields[b"Content-Length"])
        body = data[end + 4 : end + 4 + length]
        if len(body) != length:
            raise ValueError(f"a record declares {length} bytes and has {len(body)}")
        yield fields, body
        at = end + 4 + length


# --- jobs ------------------------------------------------------------------------------------


def _save(archives: DataFrame, path: str) -> None:
    archives.write.option("maxRecordsPerFile", 1).option("compression", "gzip").text(path)


def _open(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")


def write_arc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = CRAWLED) -> None:
    """Pages as ARC archives under ``path``, rows by turns in version 1 and 2. A null url is ``-``, a
    null html an empty payload; white space in a url is percent-encoded, as header lines need."""
    prepare(pages.sparkSession)
    rows = pages.select(pages[id_col].cast("string"), pages[url_col].cast("string"), pages[html_col].cast("string"))

    def archives(source: Batches) -> Batches:
        open_: dict[int, list[str]] = {}
        sizes = {1: 0, 2: 0}
        turn = 0
        for batch in source:
            for page, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                html = html or ""
                size = len(html.encode())
                version, turn = 1 + turn % 2, turn + 1
                head, name = http_head(page, size), f"pages-v{version}.arc"
                parts = open_.get(version)
                if parts is None:
                    parts = open_[version] = [arc_head(version, name, date)]
                    sizes[version] = len(parts[0])
                line = arc_line(version, url or "", len(head.encode()) + size, date, "text/html", sizes[version], name)
                parts += [line, head, html, "\n"]
                sizes[version] += len(line.encode()) + len(head.encode()) + size + 1
                if sizes[version] >= ARCHIVE:
                    yield pa.RecordBatch.from_arrays([pa.array(["".join(open_.pop(version))])], ["value"])
        for parts in open_.values():
            yield pa.RecordBatch.from_arrays([pa.array(["".join(parts)])], ["value"])

    _save(rows.mapInArrow(archives, "value string"), path)


def arc_records(spark: SparkSession, path: str, blocks: bool) -> DataFrame:
    """``page, digest, bytes`` of every ARC record, with ``blocks`` also ``url, date, block`` (the
    HTTP response, deflated for its way through a shuffle)."""
    prepare(spark)

    def records(source: Batches) -> Batches:
        for batch in source:
            for data in batch.column(0):
                out = []
                for fields, block in read_arc(gzip.decompress(data.as_py())):
                    http, _, payload = split_http(block)
                    page = http.get(_ID)
                    row = {"page": page.decode() if page is not None else None, "digest": digest(payload), "bytes": len(payload)}
                    out.append(row | {"url": fields["URL"], "date": fields["Archive-date"], "block": zlib.compress(block, 1)} if blocks else row)
                if out:
                    yield pa.RecordBatch.from_pylist(out, _RECORD if blocks else _SHORT)

    return _open(spark, path).mapInArrow(records, "page string, digest string, bytes bigint" + (", url string, date string, block binary" if blocks else ""))


_SHORT = pa.schema([("page", pa.string()), ("digest", pa.string()), ("bytes", pa.int64())])
_RECORD = pa.schema([*_SHORT, ("url", pa.string()), ("date", pa.string()), ("block", pa.binary())])


def convert(spark: SparkSession, arc_path: str, warc_path: str, least: int = 0) -> None:
    """ARC archives as WARC archives. Of records with equal payloads of at least ``least`` bytes, that
    with the largest numeric page id is the response, the others are revisits without a payload.
    Records without an id are responses only where no equal payload has one; records that share the
    largest id are all responses."""
    number = F.col("page").cast("bigint")
    known = arc_records(spark, arc_path, blocks=False).groupBy("digest", "bytes").agg(F.max(number).alias("first"))
    rows = arc_records(spark, arc_path, blocks=True).join(known.hint("merge"), ["digest", "bytes"])
    revisits = (F.col("bytes") >= least) & ~number.eqNullSafe(F.col("first"))
    rows = rows.select("page", "digest", "url", "date", "block", F.when(revisits, F.col("first").cast("string")).alias("refers"))

    def archives(source: Batches) -> Batches:
        parts: list[str] = []
        size = 0
        for batch in source:
            for page, sha, url, date, block, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not parts:
                    about = f"software: {ORIGIN}\r\nformat: WARC File Format 1.1\r\n"
                    parts = [warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id("about", f"{page}/{sha}")), ("WARC-Date", iso(date)), ("Content-Type", "application/warc-fields")], about)]
                _, head, payload = split_http(zlib.decompress(block))
                body = head if refers is not None else head + payload
                fields = [("WARC-Type", "response" if refers is None else "revisit"), ("WARC-Record-ID", record_id(page, sha)), ("WARC-Date", iso(date)), ("WARC-Target-URI", url)]
                fields += [("WARC-Payload-Digest", f"sha1:{sha}"), ("WARC-Block-Digest", f"sha1:{digest(body)}"), ("Content-Type", "application/http;msgtype=response")]
                if refers is not None:
                    fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers, sha))]
                parts.append(warc_record(fields, body.decode()))
                size += len(body) + 500
                if size >= ARCHIVE:
                    yield pa.RecordBatch.from_arrays([pa.array(["".join(parts)])], ["value"])
                    parts, size = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(["".join(parts)])], ["value"])

    _save(rows.mapInArrow(archives, "value string"), warc_path)


_READ = pa.schema([("page", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()), ("refers_to_record", pa.string())])


def warc_records(spark: SparkSession, path: str) -> DataFrame:
    """``page, payload_bytes, payload_digest, record_type, record_id, refers_to_record`` of every
    response and revisit; a response whose payload doesn't have its digest is an error."""
    prepare(spark)

    def records(source: Batches) -> Batches:
        for batch in source:
            for data in batch.column(0):
                out = []
                for fields, block in read_warc(gzip.decompress(data.as_py())):
                    kind = fields[b"WARC-Type"].decode()
                    if kind not in ("response", "revisit"):
                        continue
                    http, _, payload = split_http(block)
                    sha = fields[b"WARC-Payload-Digest"].decode().removeprefix("sha1:")
                    if kind == "response" and digest(payload) != sha:
                        raise ValueError(f"{fields[b'WARC-Record-ID']!r} doesn't have its payload digest")
                    page, refers = http.get(_ID), fields.get(b"WARC-Refers-To")
                    values = (page.decode() if page is not None else None, int(http[b"Content-Length"]), sha, kind, fields[b"WARC-Record-ID"].decode(), refers.decode() if refers else None)
                    out.append(dict(zip(_READ.names, values, strict=True)))
                if out:
                    yield pa.RecordBatch.from_pylist(out, _READ)

    return _open(spark, path).mapInArrow(records, "page string, payload_bytes bigint, payload_digest string, record_type string, record_id string, refers_to_record string")


def archived(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", keep: str | None = None) -> DataFrame:
    """Pages through ARC to WARC and back: ``page, payload_bytes, payload_digest, record_type,
    record_id, refers_to_record, refers_to`` as text, one row per row of ``pages``.

    ``keep`` names a folder for the WARC archives; without it they are deleted once read. A null
    html is an empty payload. Repeated rows are records of their own. An empty table gives an empty
    result; other columns are not read.
    """
    spark = pages.sparkSession
    arc, warc = folder(spark, "arc"), keep or folder(spark, "warc")
    write_arc(pages, arc, id_col, url_col, html_col)
    convert(spark, arc, warc)
    delete(spark, arc)
    rows = written(warc_records(spark, warc), "records")
    if keep is None:
        delete(spark, warc)
    named = rows.where("record_type = 'response'").groupBy("record_id").agg(F.max("page").alias("refers_to")).withColumnRenamed("record_id", "refers_to_record")
    # responses refer to nothing: they stay out of the join, where they would all meet in one task
    joined = rows.where("refers_to_record is not null").join(named.hint("merge"), "refers_to_record", "left")
    return rows.where("refers_to_record is null").withColumn("refers_to", F.lit(None).cast("string")).unionByName(joined)
