"""Legacy web archives: ARC files are written, read by their version's header lines and declared lengths, and converted to WARC.

Archives are files in the shared folder that Spark's own writers commit, so a lost executor leaves none half done. ARC
records end with a line feed and WARC records with two line ends, which the writers put between rows; lengths alone tell
where a record ends. Each file is one gzip stream.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_BYTES, join_sized, shared_dir, slices, table, written

#: Payloads of fewer bytes are never revisits.
LEAST_REVISIT = 100
#: Parts, of about common.SLICE_BYTES each, of an archive file, at most. Whole files are read at once.
FILE_PARTS = 8
#: Parts that revisits of one payload are dealt out to when they look for the record they refer to.
SALTS = 16
#: Fields of an ARC record's header line, by the version that the file's version block names.
ARC_FIELDS = {
    b"1": ("url", "ip", "date", "mime", "length"),
    b"2": ("url", "ip", "date", "mime", "status", "checksum", "location", "offset", "filename", "length"),
}
ARC_DATE = "20240101000000"
END = b"\r\n"
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:pagemill:archive")


@dataclass
class ArcRecord:
    fields: dict[str, str]
    block: bytes
    offset: int


def arc_version_block(name: str, version: bytes = b"1") -> bytes:
    """First record of an ARC file: its own header line, then the version and the names of the fields of all others."""
    titles = {"url": "URL", "ip": "IP-address", "date": "Archive-date", "mime": "Content-type", "status": "Result-code", "checksum": "Checksum", "location": "Location", "offset": "Offset", "filename": "Filename", "length": "Archive-length"}
    body = version + b" 0 pagemill\n" + " ".join(titles[f] for f in ARC_FIELDS[version]).encode() + b"\n"
    middle = b"" if version == b"1" else b" 200 - - 0 %s" % name.encode()
    return b"filedesc://%s 0.0.0.0 %s text/plain%s %d\n" % (name.encode(), ARC_DATE.encode(), middle, len(body)) + body


def arc_record(fields: dict[str, str], block: bytes, version: bytes = b"1") -> bytes:
    """Header line and block. Blanks in a field are escaped; missing fields are `-`."""
    line = " ".join(re.sub(r"\s", lambda m: f"%{ord(m[0]):02X}", fields.get(f) or "-") for f in ARC_FIELDS[version][:-1])
    return f"{line} {len(block)}\n".encode("utf-8", "surrogatepass") + block


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """Records of an ARC file, or of several that follow each other, without the version blocks. A cut or malformed record raises ValueError."""
    at, version = 0, None
    while at < len(data):
        if data[at : at + 1] == b"\n":
            at += 1
            continue
        stop = data.find(b"\n", at)
        if stop < 0:
            raise ValueError(f"no header line at {at}")
        values = data[at:stop].decode("utf-8", "surrogatepass").split(" ")
        opens = values[0].startswith("filedesc:")
        names = ARC_FIELDS[version] if version and not opens else ARC_FIELDS[b"1"] if len(values) == 5 else ARC_FIELDS[b"2"]
        if len(values) != len(names) or not values[-1].isdigit():
            raise ValueError(f"not an ARC header line at {at}")
        length = int(values[-1])
        block = data[stop + 1 : stop + 1 + length]
        if len(block) != length:
            raise ValueError(f"{length} bytes declared at {at}, {len(block)} there")
        if version is None or opens:
            version = block.split(b" ", 1)[0]
            if version not in ARC_FIELDS:
                raise ValueError(f"unknown ARC version {version!r}")
        else:
            yield ArcRecord(dict(zip(names, values, strict=True)), block, at)
        at = stop + 1 + length


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """Status line and headers, and payload."""
    head, gap, body = block.partition(b"\r\n\r\n")
    return (head + gap, body) if gap and head.startswith(b"HTTP/") else (b"", block)


def http_header(head: bytes, name: bytes) -> str | None:
    m = re.search(rb"(?im)^%s:[ \t]*([^\r\n]*)" % re.escape(name), head)
    return m[1].decode("utf-8", "replace") if m else None


def warc_date(arc_date: str) -> str:
    """YYYYMMDDhhmmss, of which the end may lack, as WARC writes it."""
    d = (arc_date if arc_date.isdigit() else ARC_DATE)[:14]
    d += "00000101000000"[len(d) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(file: str, offset: int) -> str:
    """The same identifier whenever the same record is converted."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{file} {offset}')}>"


def warc_record(kind: str, headers: Iterable[tuple[str, str]], block: bytes) -> bytes:
    lines = [b"WARC/1.1", b"WARC-Type: " + kind.encode(), *(f"{k}: {v}".encode("utf-8", "surrogatepass") for k, v in headers), b"Content-Length: %d" % len(block)]
    return END.join(lines) + END + END + block


def converted(r: ArcRecord, file: str, refers_to: tuple[str, str] | None) -> bytes:
    """The WARC record of an ARC record; refers_to: identifier and page of the record that holds the same payload."""
    head, payload = split_http(r.block)
    digest = f"sha256:{hashlib.sha256(payload).hexdigest()}"
    headers = [("WARC-Record-ID", record_id(file, r.offset)), ("WARC-Date", warc_date(r.fields["date"])), ("WARC-Target-URI", r.fields["url"]), ("WARC-IP-Address", r.fields["ip"])]
    if refers_to:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", refers_to[0]), ("X-Refers-To-Page", refers_to[1])]
    block = head if refers_to else r.block
    kind = "revisit" if refers_to else "response" if head or r.fields["url"].startswith("http") else "resource"
    content = "application/http;msgtype=response" if head else r.fields["mime"]
    return warc_record(kind, [*headers, ("Content-Type", content), ("WARC-Payload-Digest", digest), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}")], block)


@dataclass
class WarcRecord:
    kind: str
    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""


def read_warc(data: bytes) -> Iterator[WarcRecord]:
    """Records of a WARC file. A cut or malformed record raises ValueError."""
    at = 0
    while at < len(data):
        if data[at : at + 2] == END:
            at += 2
            continue
        stop = data.find(END + END, at)
        lines = data[at:stop].split(END) if stop >= 0 else [b""]
        if not lines[0].startswith(b"WARC/"):
            raise ValueError(f"not a WARC record at {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.decode("utf-8", "surrogatepass").partition(":") for x in lines[1:])}
        length = int(headers["content-length"])
        block = data[stop + 4 : stop + 4 + length]
        if len(block) != length:
            raise ValueError(f"{length} bytes declared at {at}, {len(block)} there")
        yield WarcRecord(headers["warc-type"], headers, block)
        at = stop + 4 + length


def unpacked(content: bytes) -> bytes:
    """A gzip file's content, of one or more members; other content as it is."""
    out = []
    while content[:2] == b"\x1f\x8b":
        d = zlib.decompressobj(31)
        out.append(d.decompress(content) + d.flush())
        content = d.unused_data
    return b"".join(out) + content


def write_files(rows: DataFrame, path: str, separator: str) -> None:
    """Writes the rows' binary column `part`, each followed by the separator."""
    options = {"lineSep": separator, "compression": "gzip", "zlib.compress.level": "BEST_SPEED", "maxRecordsPerFile": FILE_PARTS}
    rows.select(F.col("part").cast("string").alias("value")).write.options(**options).text(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """name and content of each file."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")


def columns(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*(batch.column(c).to_pylist() for c in names), strict=True)


def write_arc(pages: DataFrame, path: str, version: bytes = b"1") -> None:
    """ARC files of pages (page_id, url, html). Each part begins with a version block. The page's id travels as a header of the response."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            records = []
            for page, url, html in columns(batch, "page_id", "url", "html"):
                payload = (html or "").encode("utf-8", "surrogatepass")
                mark = f"X-Page-Id: {page}\r\n" if page is not None else ""
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{mark}Content-Length: {len(payload)}\r\n\r\n"
                records.append(arc_record({"url": url, "ip": "0.0.0.0", "date": ARC_DATE, "mime": "text/html", "status": "200"}, head.encode() + payload, version))
            name = f"{uuid.uuid5(NAMESPACE, hashlib.sha256(records[0]).hexdigest())}.arc"
            yield pa.RecordBatch.from_arrays([pa.array([b"\n".join([arc_version_block(name, version), *records])], pa.binary())], names=["part"])

    write_files(pages.select("page_id", "url", "html").mapInArrow(run, "part binary"), path, "\n")


def arc_index(files: DataFrame) -> DataFrame:
    """file, offset, page_id, digest and payload_bytes of each record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in columns(batch, "file", "content"):
                rows = []
                for r in read_arc(unpacked(content)):
                    head, payload = split_http(r.block)
                    page = http_header(head, b"X-Page-Id")
                    rows.append((file, r.offset, int(page) if page else None, hashlib.sha256(payload).digest(), len(payload)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64()), strict=True)], names=["file", "offset", "page_id", "digest", "payload_bytes"])

    return files.mapInArrow(run, "file string, offset long, page_id long, digest binary, payload_bytes long")


def revisits(index: DataFrame) -> DataFrame:
    """file and offset of each record that repeats a payload, with the file, offset and page of the one it refers to.

    That is the one of the smallest page_id (nulls last; ties: by file and offset). One payload may be that of a third of all
    records: the search for the first is an aggregate, and its result is repeated for SALTS parts of the others.
    """
    large = index.where(F.col("payload_bytes") >= LEAST_REVISIT).withColumn("key", F.struct(F.col("page_id").isNull().alias("none"), "page_id", "file", "offset"))
    firsts = large.groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = firsts.select(F.col("digest").alias("of"), "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part"))
    salted = large.withColumn("salt", F.pmod(F.xxhash64("file", "offset"), F.lit(SALTS)).cast("int"))
    pairs = salted.join(firsts, (F.col("digest") == F.col("of")) & (F.col("salt") == F.col("part"))).where(F.col("key") != F.col("first"))
    return pairs.select("file", "offset", F.col("first.file").alias("to_file"), F.col("first.offset").alias("to_offset"), F.col("first.page_id").alias("to_page"))


def convert(spark: SparkSession, arc: str, warc: str) -> None:
    """Writes the records of the ARC files in one folder as WARC files in another; repeated payloads become revisits."""
    again = written(revisits(arc_index(read_files(spark, arc))))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in columns(batch, "file", "content"):
                held, size = [], 0
                for r in read_arc(unpacked(content)):
                    held.append((file, r.offset, r.fields["url"], r.fields["ip"], r.fields["date"], r.fields["mime"], r.block))
                    size += len(r.block)
                    if size > SLICE_BYTES:
                        yield to_batch(held)
                        held, size = [], 0
                if held:
                    yield to_batch(held)

    def to_batch(rows: list[tuple]) -> pa.RecordBatch:
        c = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c[0]), pa.array(c[1], pa.int64()), *(pa.array(x, pa.string()) for x in c[2:6]), pa.array(c[6], pa.binary())], names=["file", "offset", "url", "ip", "date", "mime", "block"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "block"):
            out = []
            for file, offset, url, ip, date, mime, block, to_file, to_offset, to_page in columns(batch, "file", "offset", "url", "ip", "date", "mime", "block", "to_file", "to_offset", "to_page"):
                refers = None if to_file is None else (record_id(to_file, to_offset), "" if to_page is None else str(to_page))
                out.append(converted(ArcRecord({"url": url, "ip": ip, "date": date, "mime": mime}, block, offset), file, refers))
            yield pa.RecordBatch.from_arrays([pa.array([(END + END).join(out)], pa.binary())], names=["part"])

    records = read_files(spark, arc).mapInArrow(parse, "file string, offset long, url string, ip string, date string, mime string, block binary")
    write_files(join_sized(records, again, ["file", "offset"], "left").mapInArrow(write, "part binary"), warc, (END + END).decode())


def warc_pages(files: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each record. Digests are checked against the bytes read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, content in columns(batch, "file", "content"):
                rows = []
                for r in read_warc(unpacked(content)):
                    head, payload = split_http(r.block)
                    digest = r.headers["warc-payload-digest"].removeprefix("sha256:")
                    if r.kind != "revisit" and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"{r.headers['warc-record-id']}: payload and digest differ")
                    page, to = http_header(head, b"X-Page-Id"), r.headers.get("x-refers-to-page")
                    size = int(http_header(head, b"Content-Length") or 0) if r.kind == "revisit" else len(payload)
                    rows.append((int(page) if page else None, size, digest, r.kind, int(to) if to else None))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return files.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page is archived as ARC, converted to WARC and read back. Null html counts as empty; a repeated row is a record of its own."""
    arc, warc = shared_dir(spark), shared_dir(spark)
    write_arc(table(spark, sf_dir, "pages"), arc)
    convert(spark, arc, warc)
    return warc_pages(read_files(spark, warc))


#: What op5_warc returns, where page_id is neither null nor repeated.
ORACLE_SQL = """
with p as (select page_id, coalesce(html, '') as payload from pages),
d as (select page_id, cast(octet_length(encode(payload)) as bigint) as payload_bytes, sha256(payload) as payload_digest from p),
f as (select *, min(page_id) over (partition by payload_digest) as first_page from d)
select page_id, payload_bytes, payload_digest,
 case when payload_bytes >= 100 and page_id <> first_page then 'revisit' else 'response' end as record_type,
 case when payload_bytes >= 100 and page_id <> first_page then first_page end as refers_to
from f
"""
