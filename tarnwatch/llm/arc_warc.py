"""Legacy archive converter: ARC files (versions 1 and 2) to WARC, and both formats' writers and readers.

An ARC file is a version block and records, each a header line and as many bytes as the line declares. The fields of the
line depend on the version:

    version 1: URL IP-address Archive-date Content-type Archive-length
    version 2: URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length

The converter takes records by declared lengths and gives each what a WARC record needs and ARC lacks: an identifier (a
name-based UUID of archive and offset, so a rerun gives the same), a date in ISO form from the 14 digits, a type, and
SHA-1 digests of block and payload. Payloads that occur more than once and have at least `REVISIT_BYTES` bytes are stored
once, in the record with the largest page_id; the others become revisit records that refer to it.

Files are written and read by Spark alone, so they may lie in any store: a task writes the bytes of records as rows of
the text sink with the format's own separator between records, and begins every file of `PER_FILE` records with the
version block or warcinfo record. Readers get whole files of that bounded number of records and parse them in tasks.

Defined results: a NULL html is an empty payload; a NULL or empty URL is written as `-` and read as NULL; blanks in a URL
are written as %20 and the like; NULL page_ids come back as NULL and never win over others; of rows with equal payload
and page_id the first record by identifier is the response; an empty table gives archives without records and no rows. A
line that fits no version, or a length beyond the end of the file, raises an error that names file and offset.
"""

import base64
import hashlib
import re
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, prepare, shared_folder
from .registry import register

PER_FILE = 1000
REVISIT_BYTES = 1000
CAPTURED = "20000101000000"
#: Fixed values of the formats: field names of the version blocks, WARC version, and the profile of revisits.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
WARC_VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ARC_SCHEMA = "arc string, offset long, version int, url string, ip string, captured string, content_type string, head binary, payload binary"
WARC_SCHEMA = "file string, offset long, record_type string, record_id string, refers_to_id string, url string, warc_date string, payload_digest string, page_id long, payload_bytes long, stored binary"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _field(text: str | None) -> str:
    """One field of a header line: no blanks, never empty."""
    text = re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), text or "")
    return text or "-"


def _http(payload: bytes, page_id) -> bytes:
    page = b"" if page_id is None else b"X-Page-Id: %d\r\n" % page_id
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n" + page + b"Content-Length: %d\r\n\r\n" % len(payload)


def _arc_record(version: int, arc: str, offset: int, url: str, ip: str, date: str, kind: str, body: bytes) -> bytes:
    fields = [url, ip, date, kind]
    if version == 2:
        fields += ["200", hashlib.md5(body).hexdigest(), "-", str(offset), arc]
    return " ".join([*fields, str(len(body))]).encode() + b"\n" + body


def _arc_files(batches):
    """Rows of the text sink: for every `PER_FILE` pages a version block and their records; versions alternate by file."""
    task, count, at, arc, version = TaskContext.get().partitionId(), 0, 0, "", 1
    for batch in batches:
        out = []
        for page_id, url, html, date in zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "html", "captured")]):
            if count % PER_FILE == 0:
                number = count // PER_FILE
                arc, version, at = f"pages-{task:06d}-{number:06d}.arc", 1 + (task + number) % 2, 0
                block = f"{version} 0 pages\n{ARC_FIELDS[version]}\n".encode()
                out.append(_arc_record(version, arc, at, f"filedesc://{arc}", "0.0.0.0", date or CAPTURED, "text/plain", block))
                at += len(out[-1]) + 1
            payload = (html or "").encode()
            out.append(_arc_record(version, arc, at, _field(url), "0.0.0.0", date or CAPTURED, "text/html", _http(payload, page_id) + payload))
            at += len(out[-1]) + 1
            count += 1
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])


def _write(rows: DataFrame, folder: str, separator: str) -> None:
    # A file's first row is its version block or warcinfo, so files hold one row more than records.
    rows.select(F.col("value").cast("string").alias("value")).write.option("maxRecordsPerFile", PER_FILE + 1).option(
        "lineSep", separator).option("compression", "gzip").text(folder)


def write_arc(pages: DataFrame, folder: str) -> None:
    """ARC files of a table with page_id, url, html and optionally captured (14 digits)."""
    prepare(pages.sparkSession)
    captured = F.col("captured") if "captured" in pages.columns else F.lit(CAPTURED)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", captured.alias("captured"))
    _write(rows.mapInArrow(_arc_files, "value binary"), folder, "\n")


def parse_arc(data: bytes, name: str = "archive"):
    """(arc, offset, version, url, ip, date, content type, body) of every record after the version block.

    `arc` is the name the file gives itself; the field count of each line is checked against the file's version.
    """
    at, version, arc = 0, None, name
    while at < len(data):
        end = data.find(b"\n", at)
        line = data[at : len(data) if end < 0 else end].decode("utf-8", "replace")
        if not line.strip():
            at = len(data) if end < 0 else end + 1
            continue
        fields = line.split(" ")
        if version is None:
            block = data[end + 1 :].split(b"\n", 2) if end >= 0 else []
            number = block[0].split(b" ")[0] if block else b""
            if not fields[0].startswith("filedesc://") or number not in (b"1", b"2"):
                raise ValueError(f"{name}: no version block at offset 0")
            version, arc = int(number), fields[0].removeprefix("filedesc://")
        if len(fields) != len(ARC_FIELDS[version].split(" ")) or not fields[-1].isdigit() or end < 0:
            raise ValueError(f"{name}: no version {version} record at offset {at}")
        size = int(fields[-1])
        if end + 1 + size > len(data):
            raise ValueError(f"{name}: record at offset {at} declares {size} bytes, the file ends before")
        if not fields[0].startswith("filedesc://"):
            yield arc, at, version, fields[0], fields[1], fields[2], fields[3], data[end + 1 : end + 1 + size]
        at = end + 1 + size + 1


def _unzipped(content: bytes) -> bytes:
    import gzip

    return gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content


def _batches(rows, names, kinds, size=500):
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield _batch(held, names, kinds)
            held = []
    if held:
        yield _batch(held, names, kinds)


def _batch(rows, names, kinds):
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)


_KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _schema(ddl: str):
    pairs = [x.split(" ") for x in ddl.split(", ")]
    return [p[0] for p in pairs], [_KINDS[p[1]] for p in pairs]


def read_arc(spark: SparkSession, folder: str) -> DataFrame:
    """Records of the ARC files in a folder; `head` is what comes before the payload (an HTTP head), if anything."""
    prepare(spark)
    names, kinds = _schema(ARC_SCHEMA)

    def records(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                for arc, at, version, url, ip, date, kind, body in parse_arc(_unzipped(content), path):
                    cut = body.find(b"\r\n\r\n") + 4 if body.startswith(b"HTTP/") and b"\r\n\r\n" in body else 0
                    yield arc, at, version, None if url == "-" else url, ip, date, kind, body[:cut], body[cut:]

    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    return files.mapInArrow(lambda batches: _batches(records(batches), names, kinds), ARC_SCHEMA)


def _head_number(head, name: bytes):
    """Number in a header field of an HTTP head."""
    m = re.search(rb"(?im)^" + re.escape(name) + rb": (-?\d+)\r?$", head or b"")
    return int(m[1]) if m else None


def _iso(date: str) -> str:
    digits = (date + CAPTURED[len(date):])[:14]
    return f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}T{digits[8:10]}:{digits[10:12]}:{digits[12:14]}Z"


def record_id(arc: str, offset: int) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'arc:{arc}#{offset}')}"


def warc_record(kind: str, record: str, date: str, content_type: str, block: bytes, fields: dict) -> bytes:
    lines = {"WARC-Type": kind, "WARC-Record-ID": f"<{record}>", "WARC-Date": date, **{k: v for k, v in fields.items() if v is not None},
             "WARC-Block-Digest": _sha1(block), "Content-Type": content_type, "Content-Length": str(len(block))}
    return (WARC_VERSION + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines.items()) + "\r\n").encode() + block


def _warc_files(batches):
    task, count = TaskContext.get().partitionId(), 0
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if count % PER_FILE == 0:
                name = f"pages-{task:06d}-{count // PER_FILE:06d}.warc"
                out.append(warc_record("warcinfo", record_id(name, 0), _iso(CAPTURED), "application/warc-fields", b"format: WARC File Format 1.1\r\n", {"WARC-Filename": name}))
            revisit = r["first_id"] is not None
            fields = {"WARC-Target-URI": r["url"], "WARC-IP-Address": r["ip"], "WARC-Payload-Digest": _sha1(r["payload"])}
            if revisit:
                fields |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": f"<{r['first_id']}>", "WARC-Refers-To-Target-URI": r["first_url"], "WARC-Refers-To-Date": _iso(r["first_date"])}
            block = r["head"] if revisit else r["head"] + r["payload"]
            out.append(warc_record("revisit" if revisit else "response", r["record_id"], _iso(r["captured"]), "application/http;msgtype=response", block, fields))
            count += 1
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])


def convert(spark: SparkSession, arc_folder: str, warc_folder: str, least: int = REVISIT_BYTES) -> None:
    """Write the WARC files of all records in the ARC files of a folder."""
    name = F.udf(record_id)
    number = F.udf(lambda head: _head_number(head, b"X-Page-Id"), "long")
    records = read_arc(spark, arc_folder).withColumn("digest", F.sha1("payload"))
    large = records.filter(F.octet_length("payload") >= least).select("digest", "arc", "offset", "url", "captured", "head")
    # Of equal payloads the record with the largest page_id, then the first archive place, combined before the shuffle.
    large = large.withColumn("page_id", number("head")).drop("head")
    place = F.struct(F.col("page_id").isNotNull().alias("has"), "page_id", (-F.col("offset")).alias("o"), "arc", "url", "captured")
    first = large.groupBy("digest").agg(F.max(place).alias("f"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    first = first.select(F.col("digest").alias("_digest"), F.col("f.arc").alias("first_arc"), (-F.col("f.o")).alias("first_offset"), F.col("f.url").alias("first_url"), F.col("f.captured").alias("first_date"))
    rows = records.join(first, (F.col("digest") == F.col("_digest")) & (F.octet_length("payload") >= least), "left")
    own = (F.col("arc") == F.col("first_arc")) & (F.col("offset") == F.col("first_offset"))
    again = F.col("first_arc").isNotNull() & ~own
    rows = rows.select(
        "url", "ip", "captured", "head", "payload", name("arc", "offset").alias("record_id"),
        F.when(again, name("first_arc", "first_offset")).alias("first_id"), "first_url", "first_date")
    _write(rows.mapInArrow(_warc_files, "value binary"), warc_folder, "\r\n\r\n")


def parse_warc(data: bytes, name: str = "archive"):
    """(offset, fields in lower case, block) of every record, by declared lengths."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        lines = data[at : max(end, at)].decode("utf-8", "replace").split("\r\n")
        fields = dict((k.lower(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:]))
        if end < 0 or not lines[0].startswith("WARC/") or not fields.get("content-length", "").isdigit():
            raise ValueError(f"{name}: no WARC record at offset {at}")
        size = int(fields["content-length"])
        if end + 4 + size > len(data):
            raise ValueError(f"{name}: record at offset {at} declares {size} bytes, the file ends before")
        yield at, fields, data[end + 4 : end + 4 + size]
        at = end + 4 + size
        while data[at : at + 2] == b"\r\n":
            at += 2


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Response and revisit records of the WARC files in a folder; `stored` is the payload kept in the record itself."""
    prepare(spark)
    names, kinds = _schema(WARC_SCHEMA)

    def records(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                for at, f, block in parse_warc(_unzipped(content), path):
                    if f["warc-type"] not in ("response", "revisit"):
                        continue
                    cut = block.find(b"\r\n\r\n") + 4
                    head, stored = block[:cut], block[cut:]
                    refers = f.get("warc-refers-to")
                    digest = base64.b32decode(f["warc-payload-digest"].removeprefix("sha1:")).hex()
                    if f["warc-type"] == "response" and hashlib.sha1(stored).hexdigest() != digest:
                        raise ValueError(f"{path}: payload at offset {at} does not match its digest")
                    yield (path, at, f["warc-type"], f["warc-record-id"].strip("<>"), refers and refers.strip("<>"), f.get("warc-target-uri"), f["warc-date"], digest,
                           _head_number(head, b"X-Page-Id"), _head_number(head, b"Content-Length"), stored)

    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    return files.mapInArrow(lambda batches: _batches(records(batches), names, kinds), WARC_SCHEMA)


def page_records(spark: SparkSession, folder: str) -> DataFrame:
    """One row per response or revisit with the page_id of the response it refers to."""
    rows = read_warc(spark, folder).drop("stored")
    named = rows.filter("record_type = 'response'").select(F.col("record_id").alias("_id"), F.col("page_id").alias("refers_to"))
    return rows.join(named, F.col("refers_to_id") == F.col("_id"), "left").drop("_id")


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest FROM p),
m AS (SELECT payload_digest, max(page_id) AS last FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN m.last IS NULL OR m.last = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN m.last <> d.page_id THEN m.last END AS refers_to
FROM d LEFT JOIN m ON d.payload_digest = m.payload_digest AND d.payload_bytes >= 1000
"""


@register("op4_arc_to_warc", SQL)
def op4_arc_to_warc(spark, sf_dir):
    """Pages written as ARC files, converted to WARC, and read back from there."""
    folder = f"{shared_folder(spark)}/archives-{uuid.uuid4().hex}"
    write_arc(load(spark, sf_dir, "pages"), f"{folder}/arc")
    convert(spark, f"{folder}/arc", f"{folder}/warc")
    return page_records(spark, f"{folder}/warc").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
