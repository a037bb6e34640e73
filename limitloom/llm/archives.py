"""Legacy ARC archives and their conversion to WARC.

Archives are byte-exact files of gzip members, one member a record, written and read through
Spark's own file sources so that any store Spark reaches will do. A task closes an archive at
a few megabytes, so that no reader holds more than that and one record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limitloom.session import durable, run_folder

PACKED_BYTES, PLAIN_BYTES = 4 << 20, 32 << 20
# The URL-record field lines of the two ARC versions.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_HEADER = b"X-Page-Id"


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


# An empty member ends every archive: its last byte is 0, the line end the text sink writes.
_END = _member(b"")


class _Archive:
    """Records of one archive in the making."""

    def __init__(self, head: bytes = b""):
        self.parts, self.packed, self.plain = [_member(head)] if head else [], 0, 0

    def add(self, record: bytes) -> None:
        part = _member(record)
        self.parts.append(part)
        self.packed += len(part)
        self.plain += len(record)

    @property
    def full(self) -> bool:
        return self.packed >= PACKED_BYTES or self.plain >= PLAIN_BYTES

    def content(self) -> bytes:
        return b"".join([*self.parts, _END])


def save_archives(archives: DataFrame, path: str) -> None:
    """Each row's ``content`` as one file of its own under ``path``."""
    rows = archives.select(F.expr("substring(content, 1, length(content) - 1)").cast("string").alias("value"))
    rows.write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _clean_url(url: str | None) -> bytes:
    raw = (url or "").strip().encode()
    return re.sub(rb"[^\x21-\x7e]", lambda m: b"%%%02X" % m[0][0], raw) or b"unknown:"


def pages_to_arc(pages: DataFrame, stamp: str = "20240101000000", agent: str = "limitloom") -> DataFrame:
    """ARC archives (one row each) of ``pages``: page_id, url, html.

    A page is an HTTP response whose header carries its id (none for a null id); a null html is an empty payload, a
    null or blank url ``unknown:``. Every other archive of a task is of version 2.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, nth, archive = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if archive is None:
                    version, name = 1 + nth % 2, f"{agent}-{task:06d}-{nth:06d}.arc.gz"
                    about = f"{version} 0 {agent}\n{ARC_FIELDS[version]}\n".encode()
                    extra = "200 - - 0 {} ".format(name) if version == 2 else ""
                    archive = _Archive(f"filedesc://{name} 0.0.0.0 {stamp} text/plain {extra}{len(about)}\n".encode() + about + b"\n")
                payload = (html or "").encode()
                known = b"" if page_id is None else b"%s: %d\r\n" % (ID_HEADER, page_id)
                block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n%sContent-Length: %d\r\n\r\n" % (known, len(payload)) + payload
                middle = b"200 - - %d %s " % (archive.packed, name.encode()) if version == 2 else b""
                archive.add(b"%s 0.0.0.0 %s text/html %s%d\n" % (_clean_url(url), stamp.encode(), middle, len(block)) + block + b"\n")
                if archive.full:
                    yield pa.RecordBatch.from_pydict({"content": pa.array([archive.content()], pa.binary())})
                    archive, nth = None, nth + 1
        if archive is not None:
            yield pa.RecordBatch.from_pydict({"content": pa.array([archive.content()], pa.binary())})

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(write, "content binary")


def plain(data: bytes) -> bytes:
    """An archive's bytes without gzip; what follows a broken member is left out."""
    if data[:2] != b"\x1f\x8b":
        return data
    out, at, view = [], 0, memoryview(data)
    while data[at : at + 2] == b"\x1f\x8b":
        unpacker = zlib.decompressobj(31)
        try:
            while not unpacker.eof and at < len(data):
                part = view[at : at + (1 << 15)]
                out.append(unpacker.decompress(part))
                at += len(part) - len(unpacker.unused_data)
        except zlib.error:
            break
    return b"".join(out)


def arc_records(data: bytes) -> Iterator[dict]:
    """Records of an ARC archive, the version block first.

    The version block's field line says how a header line is to be read; fields are taken from the right, as
    a url may hold spaces. A header that does not fit, or a declared length beyond the end, ends the
    archive with a record that has ``error``.
    """
    data, at, names = plain(data), 0, ARC_FIELDS[1].split()
    name = ""
    while at < len(data):
        if data[at : at + 1] in b"\r\n":
            at += 1
            continue
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)].decode("utf-8", "replace").rstrip("\r")
        first = line.startswith("filedesc://")
        values = line.split(" ") if first else line.rsplit(" ", len(names) - 1)
        field = dict(zip(names, values, strict=False))
        length = values[-1]
        if end < 0 or not length.isdigit() or len(values) < 5 or not first and len(values) != len(names):
            yield {"offset": at, "error": "header", "archive": name}
            return
        block = data[end + 1 : end + 1 + int(length)]
        if len(block) < int(length):
            yield {"offset": at, "error": "length", "archive": name}
            return
        if first:
            name = values[0][len("filedesc://") :]
            lines = block.decode("utf-8", "replace").splitlines()
            names = (lines[1].split() if len(lines) > 1 and lines[1].split()[-1:] == ["Archive-length"] else None) or ARC_FIELDS[1].split()
            field = dict(zip(ARC_FIELDS[1].split(), values, strict=False))
        yield {
            "offset": at, "error": None, "archive": name, "url": field["URL"], "ip": field["IP-address"],
            "stamp": field["Archive-date"], "content_type": field["Content-type"], "block": block,
        }
        at = end + 1 + int(length)


def warc_date(stamp: str) -> str:
    """ISO date of an ARC stamp of 14 digits or fewer; an impossible one gives the epoch."""
    full = (stamp + "00000101000000"[len(stamp) :])[:14]
    try:
        return datetime.strptime(full, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return "1970-01-01T00:00:00Z"


def equivalent(record: dict) -> dict:
    """The WARC identity of an ARC record: id, date, type, media type, where its payload starts, digest."""
    block, url = record["block"], record["url"]
    start, kind, media = 0, "resource", record["content_type"]
    if url.startswith("filedesc://"):
        kind, media = "warcinfo", "application/warc-fields"
    elif url.startswith("dns:"):
        kind, media = "response", "text/dns"
    elif block.startswith(b"HTTP/"):
        head = re.search(rb"\r?\n\r?\n", block)
        start, kind, media = (head.end() if head else len(block)), "response", "application/http;msgtype=response"
    known = re.search(rb"(?mi)^%s: (-?\d+)\r?$" % ID_HEADER, block[:start])
    payload = memoryview(block)[start:]
    return {
        "record_id": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{record['archive']}#{record['offset']}')}>",
        "date": warc_date(record["stamp"]), "kind": kind, "media": media, "start": start,
        "page_id": int(known[1]) if known else None, "payload_bytes": len(payload), "payload_digest": hashlib.sha1(payload).hexdigest(),
    }


_KINDS = {
    "path": ("string", pa.string()), "offset": ("long", pa.int64()),
    "page_id": ("long", pa.int64()), "payload_bytes": ("long", pa.int64()), "payload_digest": ("string", pa.string()), "record_id": ("string", pa.string()),
    "url": ("string", pa.string()), "date": ("string", pa.string()), "kind": ("string", pa.string()), "media": ("string", pa.string()),
    "ip": ("string", pa.string()), "start": ("int", pa.int32()), "block": ("binary", pa.binary()),
    "record_type": ("string", pa.string()), "refers_to": ("long", pa.int64()), "error": ("string", pa.string()),
}


def _rows(found: list[dict], columns: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in found], _KINDS[c][1]) for c in columns], columns)


def _schema(columns: list[str]) -> str:
    return ", ".join(f"{c} {_KINDS[c][0]}" for c in columns)


def parse_arc(archives: DataFrame, columns: list[str]) -> DataFrame:
    """The wanted columns of all records of ARC archives (path, content); a broken place is a row with ``error``."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = [{"path": path} | (r if r["error"] else r | equivalent(r)) for r in arc_records(content.as_py())]
                for i in range(0, len(found), 500):
                    yield _rows(found[i : i + 500], columns)

    return archives.mapInArrow(parse, _schema(columns))


def _warcinfo(name: str, agent: str) -> bytes:
    about = f"software: {agent}\r\nformat: WARC File Format 1.1\r\n"
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"]
    lines += ["WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(about)}"]
    return ("\r\n".join(lines) + "\r\n\r\n" + about + "\r\n\r\n").encode()


def _warc_record(r: dict, original: dict | None) -> bytes:
    digest = base64.b32encode(bytes.fromhex(r["payload_digest"])).decode()
    block = r["block"]
    head = [
        "WARC/1.1", f"WARC-Type: {r['kind']}", f"WARC-Record-ID: {r['record_id']}", f"WARC-Date: {r['date']}",
        f"WARC-Target-URI: {r['url']}", f"WARC-IP-Address: {r['ip']}", f"WARC-Payload-Digest: sha1:{digest}", f"Content-Type: {r['media']}",
    ]
    if r["page_id"] is not None:
        head.append(f"X-Page-Id: {r['page_id']}")
    if original:
        block = block[: r["start"]]
        head[1] = "WARC-Type: revisit"
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {original['id']}", f"WARC-Refers-To-Target-URI: {original['url']}"]
        head += [f"WARC-Refers-To-Date: {original['date']}", f"X-Refers-To-Page: {original['original']}", f"X-Payload-Length: {r['payload_bytes']}"]
    else:
        head.append("WARC-Block-Digest: sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode())
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def convert(spark: SparkSession, arc_path: str, warc_path: str, least: int = 1000, agent: str = "limitloom") -> None:
    """Convert all ARC archives under ``arc_path`` to WARC archives under ``warc_path``.

    Of responses with the same payload of at least ``least`` bytes, those with the largest page id keep it
    and the others become revisits of it; a null id counts as the smallest, and without any id all keep it.
    Places that cannot be parsed are left out of the output (``parse_arc`` lists them).
    """
    files = read_archives(spark, arc_path)
    meta = parse_arc(files, ["path", "offset", "page_id", "payload_bytes", "payload_digest", "record_id", "url", "date", "kind", "error"])
    meta = durable(meta.filter((F.col("payload_bytes") >= least) & (F.col("kind") == "response")), "payloads")
    same = ["payload_digest", "payload_bytes"]
    originals = (
        meta.groupBy(*same)
        .agg(F.max(F.struct("page_id", "record_id", "url", "date")).alias("o"), F.count("*").alias("n"))
        .filter("n > 1 and o.page_id is not null")
        .select(*same, F.col("o.page_id").alias("original"), F.col("o.record_id").alias("id"), F.col("o.url").alias("url"), F.col("o.date").alias("date"))
    )
    # an archive's revisits meet the archive itself, so payloads move packed and at most once
    again = F.col("page_id").isNull() | (F.col("page_id") < F.col("original"))
    revisits = meta.select("path", "offset", "page_id", *same).join(originals, same).filter(again)
    lists = revisits.groupBy("path").agg(F.collect_list(F.struct("offset", "original", "id", "url", "date")).alias("revisits"))
    sources = files.join(lists, "path", "left").select("content", "revisits")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, nth, archive = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            for content, revisits in zip(batch.column(0), batch.column(1), strict=True):
                earlier = {r["offset"]: r for r in revisits.as_py() or ()}
                for r in arc_records(content.as_py()):
                    if r["error"] or r["url"].startswith("filedesc://"):
                        continue
                    if archive is None:
                        name = f"{agent}-{task:06d}-{nth:06d}.warc.gz"
                        archive = _Archive(_warcinfo(name, agent))
                    archive.add(_warc_record(r | equivalent(r), earlier.get(r["offset"])))
                    if archive.full:
                        yield pa.RecordBatch.from_pydict({"content": pa.array([archive.content()], pa.binary())})
                        archive, nth = None, nth + 1
        if archive is not None:
            yield pa.RecordBatch.from_pydict({"content": pa.array([archive.content()], pa.binary())})

    save_archives(sources.mapInArrow(write, "content binary"), warc_path)


def warc_records(data: bytes) -> Iterator[dict]:
    """Header fields and block of each WARC record, by declared length."""
    data, at = plain(data), 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        version, *lines = data[at:end].decode("utf-8", "replace").lstrip("\r\n").split("\r\n")
        field = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        length = int(field.get("content-length", 0))
        yield field | {"block": data[end + 4 : end + 4 + length], "version": version}
        at = end + 4 + length + 4


def read_warc(spark: SparkSession, path: str, with_block: bool = False) -> DataFrame:
    """Records of all WARC archives under ``path`` but their warcinfo, payload digests as bare hex."""
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "date", "record_id", "error"] + ["block"] * with_block

    def record(f: dict) -> dict:
        digest = base64.b32decode(f["warc-payload-digest"].removeprefix("sha1:")).hex()
        size, error = int(f.get("x-payload-length", 0)), None
        if f["warc-type"] != "revisit":
            head = re.search(rb"\r?\n\r?\n", f["block"]) if f["block"].startswith(b"HTTP/") else None
            payload = f["block"][head.end() if head else 0 :]
            size, error = len(payload), None if hashlib.sha1(payload).hexdigest() == digest else "digest"
        number = lambda key: int(f[key]) if key in f else None
        return {
            "page_id": number("x-page-id"), "payload_bytes": size, "payload_digest": digest, "record_type": f["warc-type"], "refers_to": number("x-refers-to-page"),
            "url": f["warc-target-uri"], "date": f["warc-date"], "record_id": f["warc-record-id"], "error": error, "block": f["block"],
        }

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(1):
                found = [record(f) for f in warc_records(content.as_py()) if f["warc-type"] != "warcinfo"]
                for i in range(0, len(found), 500):
                    yield _rows(found[i : i + 500], columns)

    return read_archives(spark, path).mapInArrow(parse, _schema(columns))


def round_trip(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Pages written as ARC archives, converted to WARC, and read back: one row per page.

    Both sets of archives are stored in folders of this run under the shared folder. An empty table gives no rows.
    """
    spark = pages.sparkSession
    arc, warc = run_folder(spark, "arc"), run_folder(spark, "warc")
    save_archives(pages_to_arc(pages), arc)
    convert(spark, arc, warc, least)
    return read_warc(spark, warc)
