"""Legacy archives: ARC records are parsed by their version's header line and declared length, and become WARC records.

Version 1 lines are ``url ip date type length``; version 2 lines are ``url ip date type status checksum location offset
filename length``. The first record of a file (``filedesc:``) names the version. Each record's WARC counterpart gets an
identifier made from its content and place (UUID 5), the date in ISO form, a type and SHA-1 digests of block and payload.
WARC files begin with a ``warcinfo`` record, and every record is a gzip member of its own; ARC files are one gzip stream.

Of records with equal payloads the one with the largest id is the response; others longer than ``revisit_over`` bytes are
revisits, which name the response's record, address and date (and, in a field of this operator, its page id). Records without an
id come before all others. Groups are found by digest over rows without payloads, and what each file needs of that is sent
to it, so a payload of any frequency loads no single task; the files themselves travel packed, or not at all where the
revisits are few enough to be sent out.

Archives are written and read through Spark alone (the shared folder may be in any store). A file holds at most FILE_BYTES (one
record, if that is longer; a record must stay below 2 GB). Null html is an empty payload, a null url is ``unknown:``; blanks in
urls are %20. Every row has its record: a null page_id stays null, repeated ids and rows stay records of their own (those
with the largest id are all responses). Extra columns are left out; an empty table gives no records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import cut, shared_dir, spread_join, table

FILE_BYTES, LEVEL = 16 << 20, 4
ARC_HEAD = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def arc_record(version: int, page_id: int | None, url: str | None, payload: bytes) -> bytes:
    """An ARC record of an HTTP answer, as a crawler of that version would leave it."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: %s\r\n\r\n" % str("" if page_id is None else page_id).encode() + payload
    name = re.sub(r"\s", "%20", url) if url else "unknown:"
    middle = [] if version == 1 else ["200", "-", "-", "0", "-"]
    return " ".join([name, "0.0.0.0", "20200101000000", "text/html", *middle, str(len(block))]).encode("utf-8", "surrogatepass") + b"\n" + block + b"\n"


def filedesc(version: int) -> bytes:
    body = f"{version} 0 granary\n{ARC_HEAD[version]}\n".encode()
    middle = [] if version == 1 else ["200", "-", "-", "0", "-"]
    return " ".join(["filedesc://a.arc", "0.0.0.0", "20200101000000", "text/plain", *middle, str(len(body))]).encode() + b"\n" + body


def parse_arc(data: bytes):
    """(header dict, block) of each record after the file description; a wrong line or length raises."""
    at, version = 0, None
    while at < len(data):
        if data[at : at + 1] in b"\r\n":
            at += 1
            continue
        end = data.index(b"\n", at)
        fields = data[at:end].decode("utf-8", "surrogatepass").rstrip("\r").split(" ")
        if len(fields) not in (5, 10) or not fields[-1].isdigit():
            raise ValueError(f"no ARC header line at byte {at}")
        length = int(fields[-1])
        block = data[end + 1 : end + 1 + length]
        if len(block) < length:
            raise ValueError(f"the record at byte {at} is cut off")
        at = end + 1 + length
        if fields[0].startswith("filedesc:"):
            version = int(block.split(b" ", 1)[0])
            continue
        if len(fields) != len(ARC_HEAD[version or 1].split()):
            raise ValueError(f"a version {version} line has {len(fields)} fields")
        yield {"url": fields[0], "ip": fields[1], "date": fields[2], "type": fields[3]}, block


def split_http(block: bytes) -> tuple[dict, bytes, bytes]:
    """Header fields (lower-case names), head and payload of an HTTP block."""
    head, gap, payload = block.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, head + gap, payload


def unpacked(content: bytes) -> bytes:
    """The bytes of all gzip members, in one pass."""
    return gzip.GzipFile(fileobj=io.BytesIO(content)).read()


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(arc: dict, head: bytes, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{arc["url"]} {arc["date"]} {digest} {hashlib.sha1(head).hexdigest()}')}>"


def iso_date(d: str) -> str:
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def _warc(fields: list[tuple], block: bytes) -> bytes:
    every = [*fields, ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("Content-Length", str(len(block)))]
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in every).encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def warc_record(arc: dict, head: bytes, payload: bytes, of: dict | None) -> bytes:
    """The WARC counterpart of an ARC record; of: the response that a revisit refers to (refers_to, id, url, date)."""
    digest = base32_sha1(payload)
    fields = [
        ("WARC-Type", "response" if of is None else "revisit"), ("WARC-Record-ID", record_id(arc, head, digest)), ("WARC-Date", iso_date(arc["date"])),
        ("WARC-Target-URI", arc["url"]), ("WARC-IP-Address", arc["ip"]), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(payload))),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if of is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", of["id"]), ("WARC-Refers-To-Target-URI", of["url"]), ("WARC-Refers-To-Date", iso_date(of["date"])), ("X-Refers-To-Page", str(of["refers_to"]))]
    return _warc(fields, head if of is not None else head + payload)


def warcinfo(name: str, date: str) -> bytes:
    own = uuid.uuid5(uuid.NAMESPACE_URL, f"warcinfo {name}")
    return _warc([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{own}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"software: granary\r\nformat: WARC File Format 1.0\r\n")


def parse_warc(data: bytes):
    """(header dict, block) of each record, by declared length; a wrong block digest raises."""
    at = 0
    while at < len(data):
        if data[at : at + 1] in b"\r\n":
            at += 1
            continue
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")
        fields = {k: v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = int(fields["Content-Length"])
        block = data[end + 4 : end + 4 + length]
        if fields["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
            raise ValueError(f"the record at byte {at} is damaged")
        at = end + 4 + length
        yield fields, block


def _write(df: DataFrame, path: str) -> None:
    """Rows (content) as a file each. The text writer leaves the bytes as they are, and ends a file with a zero, which gzip
    readers skip as padding."""
    df.select(F.col("content").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def _files(spark, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select(F.col("path").alias("file"), "content")


def _packed(records, opened, closed, most: int):
    """Records (size, function from the file's number to bytes) as rows of whole files of up to ``most`` bytes: opened(k) begins
    the k-th, closed(bytes) ends it."""
    held, size, k = [], 0, 0

    def row():
        return pa.RecordBatch.from_arrays([pa.array([closed(b"".join([opened(k), *held]))], pa.binary())], names=["content"])

    for n, made in records:
        if held and size + n > most:
            yield row()
            held, size, k = [], 0, k + 1
        held.append(made(k))
        size += n
    if held:
        yield row()


def _to_arc(version: int | None, most: int):
    def of(k: int) -> int:
        return version or 1 + k % 2

    def records(batches):
        for b in batches:
            for page, url, html in zip(b[0], b[1], b[2]):
                payload = html.as_py() or b""
                yield len(payload) + 400, lambda k, page=page, url=url, payload=payload: arc_record(of(k), page.as_py(), url.as_py(), payload)

    return lambda batches: _packed(records(batches), lambda k: filedesc(of(k)) + b"\n", lambda data: gzip.compress(data, LEVEL, mtime=0), most)


ARC_ROWS = "file string, place bigint, page_id bigint, bytes bigint, digest string, id string, url string, date string"


def _from_arc(batches):
    """What each record is, without its payload."""
    for b in batches:
        for file, content in zip(b[0].to_pylist(), b[1]):
            rows = []
            for place, (arc, block) in enumerate(parse_arc(unpacked(content.as_py()))):
                fields, head, payload = split_http(block)
                digest = base32_sha1(payload)
                rows.append((file, place, int(fields["x-page-id"]) if fields["x-page-id"] else None, len(payload), digest, record_id(arc, head, digest), arc["url"], arc["date"]))
            if rows:
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), *[pa.string()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in ARC_ROWS.split(", ")])


def _to_warc(most: int):
    def run(batches):
        first: list = []

        def records():
            for b in batches:
                for file, content, refs in zip(b[0].to_pylist(), b[1], b[2].to_pylist()):
                    of = {r["place"]: r for r in refs or ()}
                    for place, (arc, block) in enumerate(parse_arc(unpacked(content.as_py()))):
                        _, head, payload = split_http(block)
                        first[:] = [file, iso_date(arc["date"])]
                        member = gzip.compress(warc_record(arc, head, payload, of.get(place)), LEVEL, mtime=0)
                        yield len(member), lambda k, member=member: member

        yield from _packed(records(), lambda k: gzip.compress(warcinfo(f"{first[0]} {k}", first[1]), LEVEL, mtime=0), lambda data: data, most)

    return run


WARC_ROWS = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, record_id string, refers_to_id string, url string, date string, payload string"


def _from_warc(batches):
    for b in batches:
        for content in b[1]:
            rows = []
            for f, block in parse_warc(unpacked(content.as_py())):
                if f["WARC-Type"] == "warcinfo":
                    continue
                http, _, payload = split_http(block)
                page, of = http["x-page-id"], f.get("X-Refers-To-Page")
                rows.append((int(page) if page else None, int(f["X-Payload-Length"]), f["WARC-Payload-Digest"][5:], f["WARC-Type"], of and int(of), f["WARC-Record-ID"], f.get("WARC-Refers-To"), f["WARC-Target-URI"], f["WARC-Date"], payload.decode("utf-8", "surrogatepass") if f["WARC-Type"] == "response" else None))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.string()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in WARC_ROWS.split(", ")])


def write_arcs(pages: DataFrame, path: str, version: int | None = None, file_bytes: int = FILE_BYTES) -> None:
    """Pages (page_id, url, html) as ARC files of a version, or of both by turns."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("binary"))
    _write(rows.mapInArrow(_to_arc(version, file_bytes), "content binary"), path)


def convert_arcs(spark, arcs: str, warcs: str, revisit_over: int = -1, file_bytes: int = FILE_BYTES) -> None:
    """ARC files of a folder as WARC files in another."""
    own = cut(_files(spark, arcs).mapInArrow(_from_arc, ARC_ROWS)).withColumn("group", F.concat_ws(":", "digest", "bytes"))
    last = own.where((F.col("bytes") > revisit_over) & F.col("page_id").isNotNull()).groupBy("group").agg(F.max("page_id").alias("refers_to"), F.max_by(F.struct("id", "url", "date"), "page_id").alias("of"))
    later = spread_join(own.select("file", "place", "page_id", "group"), last, "group", "place", "inner").where("page_id IS NULL OR page_id < refers_to")
    refs = later.groupBy("file").agg(F.collect_list(F.struct("place", "refers_to", "of.id", "of.url", "of.date")).alias("refs"))  # at most a file's records
    _write(_files(spark, arcs).join(refs, "file", "left").mapInArrow(_to_warc(file_bytes), "content binary"), warcs)


def read_warcs(spark, path: str) -> DataFrame:
    return _files(spark, path).mapInArrow(_from_warc, WARC_ROWS)


def op3_warc(spark, sf_dir: str) -> DataFrame:
    top = shared_dir(spark, "warc")
    write_arcs(table(spark, sf_dir, "pages"), f"{top}/arc")
    convert_arcs(spark, f"{top}/arc", f"{top}/warc")
    return read_warcs(spark, f"{top}/warc").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Digests in hex become base32 by 5-bit groups.
OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS n, sha1(h) AS x FROM p),
l AS (SELECT x, n, max(page_id) AS last FROM d GROUP BY x, n)
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(x, CAST(1 + 10 * (i // 8) AS INTEGER), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS INTEGER)) & 31 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id < last OR page_id IS NULL AND last IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < last OR page_id IS NULL THEN last END AS refers_to
FROM d JOIN l USING (x, n)
"""
