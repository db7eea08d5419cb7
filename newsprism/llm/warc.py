"""Legacy archive converter: ARC in, WARC out, and a WARC reader (operator 3).

* ``arc_archives`` writes pages as ARC archives (versions 1 and 2 of the header line).
* ``arc_records`` parses an ARC archive: the version block says which fields a header line has
  (five or ten), the declared length says where the record ends; nothing is searched for.
* ``read_arc`` reads a stored folder of archives (gzipped or not), ``convert_archives`` converts
  it: of equal payloads the latest capture is the response, the archives are read twice rather
  than payloads shuffled.
* ``warc_record`` synthesises the WARC record of an ARC record: identifier (a name-based UUID,
  so that a retried task writes the same record), ISO timestamp from the 14 digits, type, block and
  payload digests; a record whose payload another one holds becomes a ``revisit``, one that is no
  HTTP message a ``resource``.
* ``write_warc`` streams the records of a partition into archives of bounded size below a shared
  folder (each record ends with two line breaks, which is the sink's row separator), and
  ``read_warc`` reads archives back by their declared lengths.

Edge cases: a null payload is an empty one; a null url is written as ``urn:none``; a null
page_id has no identifier field, comes back null and is never referred to; equal payloads below
``least`` bytes are not folded; repeated page_ids are written one by one; payloads may hold any
bytes (other encodings, blank lines and archive headers included), as only lengths count; a
truncated or unknown archive is an error that names the place; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsprism.llm.scratch import BATCH_BYTES, BATCH_ROWS, bound_batches, scratch_path, small_side, written

#: Fields of a header line by version (fixed values of the format).
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
END = "\r\n\r\n"
LEAST = 1000
RECORDS_PER_FILE = 500
_DATE = "20240101000000"


@dataclass(frozen=True)
class ArcRecord:
    version: int
    fields: dict[str, str]
    offset: int
    block: bytes


def arc_header(version: int, **values: str) -> bytes:
    """One header line; a field without value is ``-``, blanks in a value are escaped."""
    return (" ".join(values.get(f, "-").replace("%", "%25").replace(" ", "%20").replace("\n", "%0A") if f == "URL" else values.get(f, "-")
                     for f in ARC_FIELDS[version].split()) + "\n").encode()


def arc_archive(version: int, name: str, records: list[tuple[str, bytes]], date: str = _DATE) -> bytes:
    """An archive: the version block, then one (url, block) after the other."""
    about = f"{version} 0 newsprism\n{ARC_FIELDS[version]}\n".encode()
    common = {"IP-address": "0.0.0.0", "Archive-date": date, "Result-code": "200", "Filename": name}
    out = [arc_header(version, **common | {"URL": f"filedesc://{name}", "Content-type": "text/plain", "Archive-length": str(len(about))}), about, b"\n"]
    at = sum(map(len, out))
    for url, block in records:
        out += [arc_header(version, **common | {"URL": url, "Content-type": "text/html", "Offset": str(at), "Archive-length": str(len(block))}), block, b"\n"]
        at += sum(map(len, out[-3:]))
    return b"".join(out)


class Ahead:
    """Bytes read ahead from chunks: what is asked for and one chunk are held at a time."""

    def __init__(self, chunks: Iterable[bytes]):
        self.chunks, self.data, self.pos, self.at = iter(chunks), b"", 0, 0

    def have(self, n: int) -> bool:
        """Whether ``n`` more bytes are there."""
        size = len(self.data) - self.pos
        if size < n:
            held = [self.data[self.pos:]]
            while size < n and (chunk := next(self.chunks, None)) is not None:
                held.append(chunk)
                size += len(chunk)
            self.data, self.pos = b"".join(held), 0
        return size >= n

    def before(self, mark: bytes) -> int:
        """Bytes before the next ``mark``; -1 if there is none."""
        seen = 0
        while (found := self.data.find(mark, self.pos + seen)) < 0:
            seen = max(0, self.left() - len(mark) + 1)
            if not self.have(self.left() + 1):
                return -1
        return found - self.pos

    def left(self) -> int:
        return len(self.data) - self.pos

    def next_is(self, marks: tuple[bytes, ...]) -> bool:
        return self.data.startswith(marks, self.pos)

    def take(self, n: int) -> bytes:
        out = self.data[self.pos:self.pos + n]
        self.pos += n
        self.at += n
        return out


def sliced(data: bytes, step: int = 1 << 18) -> Iterator[bytes]:
    return (data[i:i + step] for i in range(0, len(data), step))


def arc_records(archive: bytes | Iterable[bytes]) -> Iterator[ArcRecord]:
    """The records of an archive (its bytes, or chunks of them), the version block not among them."""
    ahead = Ahead(sliced(archive) if isinstance(archive, bytes) else archive)
    fields, version = None, 0
    while ahead.have(1):
        if ahead.next_is((b"\n", b"\r")):
            ahead.take(1)
            continue
        at, eol = ahead.at, ahead.before(b"\n")
        line = ahead.take(eol + 1).decode("utf-8", "replace").rstrip("\r\n") if eol >= 0 else ""
        if not re.search(r" \d+$", line):
            raise ValueError(f"no header line at {at}")
        length = int(line.rpartition(" ")[2])
        if not ahead.have(length):
            raise ValueError(f"record at {at} declares {length} bytes, {ahead.left()} are left")
        block = ahead.take(length)
        if fields is None:
            head = block.decode("utf-8", "replace").split("\n")
            version = int(head[0].split()[0])
            fields = head[1].split()
            if version not in ARC_FIELDS or len(fields) != len(ARC_FIELDS[version].split()):
                raise ValueError(f"unknown archive version {head[0]!r}")
        else:
            named = dict(zip(ARC_FIELDS[version].split(), line.rsplit(" ", len(fields) - 1), strict=True))
            named["URL"] = named["URL"].replace("%0A", "\n").replace("%20", " ").replace("%25", "%")
            yield ArcRecord(version, named, at, block)


def sha1_32(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, key)}>"


def parts(block: bytes) -> tuple[bytes, bytes]:
    """The HTTP header of a block, its blank line included, and the payload; a block that is no
    HTTP message is all payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    head, gap, payload = block.partition(END.encode())
    return head + gap, payload


def warc_date(digits: str) -> str:
    """ISO time of an archive's 14 digits; what shorter ones lack is the start of the period."""
    return datetime.strptime(digits + "00000101000000"[len(digits):], "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")


def warc_record(record: ArcRecord, key: str, refers_to: str | None = None) -> bytes:
    """The bytes of the equivalent WARC record, without the line breaks that end it.

    ``key`` names the record; ``refers_to`` the one that holds its payload."""
    head, payload = parts(record.block)
    f = record.fields
    block = head if refers_to is not None else record.block
    kind = "revisit" if refers_to is not None else "response" if head else "resource"
    url = f["URL"].replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A").replace(" ", "%20")
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(key)}", f"WARC-Date: {warc_date(f['Archive-date'])}",
             f"WARC-Target-URI: {url}", f"WARC-IP-Address: {f['IP-address']}",
             f"WARC-Payload-Digest: {sha1_32(payload)}", f"WARC-Block-Digest: {sha1_32(block)}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest",
                  f"WARC-Refers-To: {record_id(refers_to)}"]
    lines += [f"Content-Type: {'application/http; msgtype=response' if head else f['Content-type']}", f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + END).encode() + block


def http_block(payload: bytes, page_id: int | None) -> bytes:
    head = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    return ("\r\n".join(head) + END).encode() + payload


def page_key(page_id: int | None, url: str, block: bytes) -> str:
    return f"page:{page_id}" if page_id is not None else f"page:{url}:{hashlib.sha1(block).hexdigest()}"


def duplicates(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id -> refers_to for pages whose payload (of at least ``least`` bytes) a page with a
    larger id has too.  Digests are counted with partial aggregates, so a payload that a third of
    the pages share is a few rows per task."""
    body = F.col("html").cast("binary")
    sums = pages.where(F.coalesce(F.octet_length(body), F.lit(0)) >= least).select(
        F.col("page_id").cast("long").alias("page_id"), F.sha1(F.coalesce(body, F.lit(b""))).alias("digest"))
    sums = written(sums.where("page_id is not null"), "digests")
    held = sums.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("low")).where("low < refers_to")
    return sums.join(held.drop("low"), "digest").where("page_id < refers_to").select("page_id", "refers_to").distinct()


def convert(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """One column ``record``: the bytes of the WARC record of every page, by way of ARC archives
    (``html`` is a string, or bytes of any encoding).

    Payloads are not shuffled as long as the table of duplicates is of a checked size."""
    bound_batches(pages.sparkSession)
    again = written(duplicates(pages, least), "revisits")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("urn:none")).alias("url"),
                        F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("html")).join(small_side(again), "page_id", "left")

    def run(batches):
        for n, b in enumerate(batches):
            ids, urls, htmls, targets = (b.column(i) for i in range(4))
            version = n % 2 + 1
            blocks = [(u.as_py(), http_block(h.as_py(), i.as_py())) for i, u, h in zip(ids, urls, htmls, strict=True)]
            archive = arc_archive(version, f"part-{n}.arc", blocks)
            out = [warc_record(r, page_key(i.as_py(), r.fields["URL"], r.block), None if t.as_py() is None else f"page:{t.as_py()}")
                   for r, i, t in zip(arc_records(archive), ids, targets, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    return rows.select("page_id", "url", "html", "refers_to").mapInArrow(run, "record binary")


ARC_SCHEMA = ("file string, offset long, version int, url string, ip string, archive_date string, content_type string, "
              "payload_bytes long, payload_digest string, block binary")


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """The records of stored ARC archives (see ARC_SCHEMA); a batch is bounded by its bytes."""
    bound_batches(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    kinds = [pa.string(), pa.int64(), pa.int32(), *[pa.string()] * 4, pa.int64(), pa.string(), pa.binary()]
    names = [x.split()[0] for x in ARC_SCHEMA.split(", ")]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches):
        for b in batches:
            for file, content in zip(b.column(0), b.column(1), strict=True):
                data, rows, size = content.as_py(), [], 0
                for r in arc_records(inflate(data) if data[:2] == b"\x1f\x8b" else data):
                    payload, f = parts(r.block)[1], r.fields
                    rows.append((file.as_py(), r.offset, r.version, f["URL"], f["IP-address"], f["Archive-date"], f["Content-type"],
                                 len(payload), hashlib.sha1(payload).hexdigest(), r.block))
                    size += len(r.block)
                    if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    return files.mapInArrow(run, ARC_SCHEMA)


def convert_archives(spark: SparkSession, path: str, least: int = LEAST) -> DataFrame:
    """One column ``record``: the WARC records of the stored ARC archives below ``path``."""
    found = read_arc(spark, path).withColumn("key", F.concat_ws(":", F.lit("arc"), "file", "offset"))
    sums = written(found.where(F.col("payload_bytes") >= least).select("key", "archive_date", "payload_digest"), "digests")
    held = sums.groupBy("payload_digest").agg(F.max(F.struct("archive_date", "key"))["key"].alias("refers_to"), F.min("key").alias("low"), F.max("key").alias("high"))
    again = written(sums.join(held.where("low < high"), "payload_digest").where("key <> refers_to").select("key", "refers_to"), "revisits")

    def run(batches):
        for b in batches:
            out = [warc_record(ArcRecord(r["version"], {"URL": r["url"], "IP-address": r["ip"], "Archive-date": r["archive_date"],
                                                        "Content-type": r["content_type"]}, r["offset"], r["block"]), r["key"], r["refers_to"])
                   for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    return found.join(small_side(again), "key", "left").drop("payload_bytes", "payload_digest", "file").mapInArrow(run, "record binary")


def write_warc(records: DataFrame, path: str) -> None:
    """Write records as gzipped archives of at most RECORDS_PER_FILE records below ``path``."""
    records.select(F.col("record").cast("string")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def parse_warc(chunks: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record; at most one record and one chunk are held at a time."""
    ahead = Ahead(chunks)
    while ahead.have(1):
        end = ahead.before(END.encode())
        if end < 0:
            raise ValueError("an archive ends inside a header")
        lines = ahead.take(end + len(END))[:end].decode("utf-8", "replace").split("\r\n")
        if not re.fullmatch(r"WARC/1\.[01]", lines[0]):
            raise ValueError(f"no record starts with {lines[0][:40]!r}")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = int(fields["content-length"])
        if not ahead.have(length + len(END)):
            raise ValueError("an archive ends inside a block")
        yield fields, ahead.take(length + len(END))[:length]


def inflate(data: bytes, step: int = 1 << 18) -> Iterator[bytes]:
    """Chunks of a gzip file, member after member."""
    at = 0
    unzip = zlib.decompressobj(31)
    while at < len(data):
        out = unzip.decompress(data[at:at + step])
        at += step
        if out:
            yield out
        if unzip.eof:
            at -= len(unzip.unused_data)
            unzip = zlib.decompressobj(31)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """record_id, page_id, record_type, refers_to_id, target_uri, warc_date, declared_digest (hex),
    payload_bytes and payload_digest (of the stored payload; null for revisits)."""
    files = spark.read.format("binaryFile").load(path).select("content")
    schema = ("record_id string, page_id long, record_type string, refers_to_id string, target_uri string, warc_date string, "
              "declared_digest string, payload_bytes long, payload_digest string")

    def run(batches):
        for b in batches:
            for file in b.column(0):
                rows = []
                for f, block in parse_warc(inflate(file.as_py())):
                    head, payload = parts(block)
                    http = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])}
                    stored = f["warc-type"] in ("response", "resource")
                    named = re.fullmatch(r"-?\d{1,18}", http.get("x-page-id", ""))
                    rows.append((f["warc-record-id"], int(named[0]) if named else None, f["warc-type"],
                                 f.get("warc-refers-to"), f["warc-target-uri"], f["warc-date"],
                                 base64.b32decode(f["warc-payload-digest"][5:]).hex(),
                                 len(payload) if stored else None, hashlib.sha1(payload).hexdigest() if stored else None))
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 9
                kinds = [pa.string(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                                                 names=[x.split()[0] for x in schema.split(", ")])

    return files.mapInArrow(run, schema)


def archived_pages(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Write pages as WARC below the shared folder, read the archives back, and resolve revisits by
    the record they refer to."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_warc(convert(pages, least), path)
    back = written(read_warc(spark, path), "records")
    held = back.where("record_type = 'response' and page_id is not null").select(
        F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"),
        F.col("payload_bytes").alias("held_bytes"), F.col("payload_digest").alias("held_digest")).distinct()
    full = back.where("record_type = 'revisit'").join(held, "refers_to_id", "left") \
        .withColumns({"payload_bytes": F.col("held_bytes"), "payload_digest": F.col("held_digest")})
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", "warc_date", "record_id", "declared_digest"]
    plain = back.where("record_type <> 'revisit'").withColumn("refers_to", F.lit(None).cast("long"))
    return plain.select(*cols).unionByName(full.select(*cols))
