"""Legacy web archives (ARC) and their conversion to WARC.

An ARC file begins with a ``filedesc`` record whose body names the version and the fields of the header lines that
follow: version 1 has URL, IP address, date, type and length; version 2 adds the result code, checksum, location, offset
and file name. Records are found by their declared lengths alone, never by looking for separators.

Each ARC record becomes a WARC record with a synthesised identifier (a UUID derived from the record's place, URL,
date and digest, so a repeated run gives the same), the ISO form of its 14-digit date, a type, and digests of the
block and the payload (SHA-1, bare base32). Of the records with equal payloads of ``least_bytes`` bytes or more, one is a
``response`` and the others are ``revisit`` records that refer to it.

Files are written by Spark's text sink with a line separator equal to the format's own record separator and gzip over
the file (not over each record, which that sink can't do), so they reach any file system that Spark can, commit atomically
and survive lost executors. There is one file per input partition of the writing job, whose size
``spark.sql.files.maxPartitionBytes`` bounds. A compressed file is held as a whole while it is read, its content not.

Defined cases: a null payload is empty; a null URL is written as ``unknown:``; white space and control characters in
a URL are percent-encoded; repeated page ids are one record each, and the response of a group is the first of its rows
with the largest id (equal rows differ by their place in the archive); a null page id is kept as null and sorts
before every other; empty tables give archives without records. In ARC files spaces in URLs are read as part of them;
damaged headers and cut-off records are listed with their place and error, and the records after them are still read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, slices, small_batches

#: The header fields of each ARC version, and the separators of records.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
ARC_SEPARATOR, WARC_SEPARATOR = "\n", "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_unsafe = re.compile(r"[\x00-\x20\x7f-\xa0]")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def safe_url(url: str | None) -> str:
    return _unsafe.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url) if url else "unknown:"


def http_block(payload: bytes, headers: dict[str, str]) -> bytes:
    """A stored HTTP response: status line, headers, payload."""
    lines = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=UTF-8", *(f"{k}: {v}" for k, v in headers.items()), f"Content-Length: {len(payload)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + payload


def split_http(block: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers (names in lower case), the head's bytes with its blank line, and the payload of an HTTP response."""
    end = block.find(b"\r\n\r\n")
    if not block.startswith(b"HTTP/") or end < 0:
        return {}, b"", block
    lines = block[:end].decode("utf-8", "replace").split("\r\n")[1:]
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    return headers, block[: end + 4], block[end + 4 :]


def arc_record(version: int, values: dict[str, str], block: bytes) -> bytes:
    """Header line and block of one ARC record."""
    line = " ".join(str(len(block)) if f == "Archive-length" else values.get(f, "-") or "-" for f in ARC_FIELDS[version])
    return line.encode() + b"\n" + block


def arc_opening(version: int, name: str, date: str) -> bytes:
    """The filedesc record."""
    body = f"{version} 0 skiplight\n{' '.join(ARC_FIELDS[version])}\n".encode()
    return arc_record(version, {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/plain", "Result-code": "200", "Filename": name, "Offset": "0"}, body)


def parse_arc(data: bytes | io.BufferedIOBase, *, keep_damaged: bool = False):
    """(offset, version, fields, block, error) of each record after the filedesc record, read as a stream: a record at a
    time is in memory. A header line's fields are taken from its end, so a URL may hold spaces.

    Where no header line stands or a record is cut off, ValueError is raised; with ``keep_damaged`` a record without
    fields, whose error tells the place, is given instead, and reading goes on at the next line that is a header's.
    """
    f = io.BytesIO(data) if isinstance(data, bytes) else data
    version, names, at, lost = 0, ["Archive-length"], 0, False
    while line := f.readline():
        start, at = at, at + len(line)
        if not line.strip(b"\r\n"):  # separators
            continue
        parts = line.decode("utf-8", "replace").rstrip("\r\n").rsplit(" ", max(len(names) - 1, 1))
        good = line.endswith(b"\n") and parts[-1].isdigit() and (not version or len(parts) == len(names)) and (not lost or "://" in parts[0])
        opening = parts[0].startswith("filedesc://")
        block = f.read(int(parts[-1])) if good else b""
        error = None
        if not good or not version and not opening:
            error = f"no ARC header line at byte {start}" if version or not good else "no filedesc record"
        elif len(block) < int(parts[-1]):
            error = f"the record at byte {start} is cut off"
        elif opening:
            first, _, rest = block.partition(b"\n")
            version = int(n) if (n := first.split(b" ")[0]).isdigit() else 0
            names = rest.decode("utf-8", "replace").split("\n")[0].split(" ") if rest else ARC_FIELDS.get(version, [])
            if version not in ARC_FIELDS:
                error, version = f"unknown ARC version {version}", 0
        at += len(block)
        if error and not keep_damaged:
            raise ValueError(error)
        if error:
            if not lost:
                yield start, version, {}, b"", error
            lost = True
        elif not opening:
            lost = False
            yield start, version, dict(zip(names, parts)), block, None


def iso_date(date: str) -> str:
    """A 14-digit date (or a shorter one, filled up) as ISO 8601."""
    d = (date if date.isdigit() else "")[:14]
    d += "19700101000000"[len(d) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(headers: dict[str, str], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block


def parse_warc(data: bytes | io.BufferedIOBase):
    """(headers with names in lower case, block) of each record, by its declared length, a record at a time."""
    f = io.BytesIO(data) if isinstance(data, bytes) else data
    while line := f.readline():
        if not line.strip(b"\r\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:20]!r}")
        headers = {}
        while (line := f.readline()).strip(b"\r\n"):
            k, _, v = line.decode("utf-8").partition(":")
            headers[k.strip().lower()] = v.strip()
        size = int(headers["content-length"])
        block = f.read(size)
        if len(block) < size:
            raise ValueError("the last record is cut off")
        yield headers, block


def _write(rows: DataFrame, path: str, separator: str, level: str = "DEFAULT_COMPRESSION") -> None:
    """Rows of one binary column ``record`` as files; the text sink writes a string's bytes as they are."""
    values = rows.select(F.col("record").cast("string").alias("value"))
    values.write.option("lineSep", separator).option("compression", "gzip").option("zlib.compress.level", level).text(path)


def write_arcs(pages: DataFrame, path: str, *, version: int | None = None, date: str = "20240101000000", id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", level: str = "DEFAULT_COMPRESSION") -> None:
    """One ARC file per partition of ``pages``; the page id travels as a header of the stored response. Without a
    ``version``, files alternate between the two."""

    def run(batches):
        version = given or 1 + TaskContext.get().partitionId() % 2
        name = f"part-{TaskContext.get().partitionId():05d}.arc"
        yield pa.RecordBatch.from_pydict({"record": pa.array([arc_opening(version, name, date)], pa.binary())})
        for batch in batches:
            for part in slices(batch, "p"):
                out = []
                for k, u, p in zip(*(part.column(c).to_pylist() for c in "kup")):
                    block = http_block((p or "").encode(), {} if k is None else {"X-Page-Id": str(k)})
                    out.append(arc_record(version, {"URL": safe_url(u), "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/html", "Result-code": "200", "Filename": name}, block))
                yield pa.RecordBatch.from_pydict({"record": pa.array(out, pa.binary())})

    given = version
    rows = pages.select(F.col(id_col).cast("long").alias("k"), F.col(url_col).cast("string").alias("u"), F.col(payload_col).cast("string").alias("p"))
    _write(rows.mapInArrow(run, "record binary"), path, ARC_SEPARATOR, level)


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _content(raw: bytes) -> io.BufferedIOBase:
    """The file's bytes as a stream; only what is read is decompressed."""
    return io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(raw)), 1 << 16) if raw[:2] == b"\x1f\x8b" else io.BytesIO(raw)


def _rows(rows: list[dict], schema: pa.Schema, bytes_of: str, most: int = 8 << 20):
    """Record batches of about ``most`` bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[bytes_of] or b"")
        if size >= most:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def read_arcs(spark: SparkSession, path: str, *, with_block: bool = True) -> DataFrame:
    """The records of ARC files: file, offset, version, url, ip, date, mime, page_id, payload digest and, if asked for,
    the block. What can't be read as a record is a row with its place and ``error``, other columns null."""
    small_batches(spark)
    schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("version", pa.int32()), ("url", pa.string()), ("ip", pa.string()), ("date", pa.string()), ("mime", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("digest", pa.string()), ("block", pa.binary()), ("error", pa.string())])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                file = batch.column(0)[i].as_py().rpartition("/")[2]

                def records():
                    for at, version, f, block, error in parse_arc(_content(batch.column(1)[i].as_py()), keep_damaged=True):
                        if error:
                            yield {"file": file, "offset": at, "block": None, "error": error}
                            continue
                        headers, _, payload = split_http(block)
                        page = headers.get("x-page-id")
                        yield {"file": file, "offset": at, "version": version, "url": f["URL"], "ip": f["IP-address"], "date": f["Archive-date"], "mime": f["Content-type"], "page_id": None if page is None else int(page), "payload_bytes": len(payload), "digest": base32_sha1(payload), "block": block if with_block else None}

                yield from _rows(records(), schema, "block", 8 << 20)

    return files(spark, path).mapInArrow(run, "file string, offset long, version int, url string, ip string, date string, mime string, page_id long, payload_bytes long, digest string, block binary, error string")


def record_id(file: str, offset: int, url: str, date: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join((file, str(offset), url, date, digest)))}>"


def convert_arcs(spark: SparkSession, source: str, target: str, *, least_bytes: int = 0) -> DataFrame:
    """Read ARC files under ``source`` and write their records as WARC files under ``target``. Gives (file, offset, error)
    of what could not be read as a record; all other records are converted.

    Which records are revisits is found from headers alone; bodies then meet that table by their place (file, offset),
    which no two records share, so a payload of very many copies is no hot key.
    """
    heads = durable(read_arcs(spark, source, with_block=False).drop("block"), "heads")
    place = F.struct(F.coalesce(F.col("page_id"), F.lit(-(1 << 63))).alias("page_id"), "file", "offset")
    sound = heads.where(F.col("error").isNull() & (F.col("payload_bytes") >= least_bytes))
    chosen = sound.groupBy("digest", "payload_bytes").agg(F.max(F.struct(place.alias("place"), "url", "date")).alias("c"), F.count("*").alias("n")).where("n > 1")
    # of payloads that stand once, or are smaller, there is nothing to look up: their records are responses
    chosen = durable(chosen.select("digest", "payload_bytes", F.col("c.place.file").alias("first_file"), F.col("c.place.offset").alias("first_offset"), F.col("c.url").alias("first_url"), F.col("c.date").alias("first_date")), "chosen")
    revisits = sound.select("file", "offset", "digest", "payload_bytes").join(chosen, ["digest", "payload_bytes"]).where("file <> first_file OR offset <> first_offset")
    revisits = durable(revisits.drop("digest", "payload_bytes"), "revisits")
    rows = read_arcs(spark, source).where("error IS NULL").join(revisits, ["file", "offset"], "left")
    names = ["file", "offset", "url", "ip", "date", "mime", "digest", "payload_bytes", "block", "first_file", "first_offset", "first_url", "first_date"]

    def run(batches):
        task = TaskContext.get().partitionId()
        info = f"software: skiplight\r\nformat: WARC File Format 1.1\r\nisPartOf: part-{task:05d}\r\n".encode()
        opening = warc_record({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{target} {task}')}>", "WARC-Date": "1970-01-01T00:00:00Z", "Content-Type": "application/warc-fields"}, info)
        yield pa.RecordBatch.from_pydict({"record": pa.array([opening], pa.binary())})
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                out = []
                for r in batch.slice(a, 256).to_pylist():
                    _, head, payload = split_http(r["block"])
                    first = r["first_file"] is None
                    headers = {"WARC-Type": "response" if first else "revisit", "WARC-Record-ID": record_id(r["file"], r["offset"], r["url"], r["date"], r["digest"]), "WARC-Date": iso_date(r["date"]), "WARC-Target-URI": r["url"], "WARC-IP-Address": r["ip"], "Content-Type": "application/http; msgtype=response" if head else r["mime"], "WARC-Payload-Digest": f"sha1:{r['digest']}", "WARC-Identified-Payload-Type": r["mime"]}
                    block = r["block"]
                    if not first:
                        headers |= {"WARC-Refers-To": record_id(r["first_file"], r["first_offset"], r["first_url"], r["first_date"], r["digest"]), "WARC-Refers-To-Target-URI": r["first_url"], "WARC-Refers-To-Date": iso_date(r["first_date"]), "WARC-Profile": REVISIT_PROFILE}
                        block = head
                    headers["WARC-Block-Digest"] = f"sha1:{base32_sha1(block)}"
                    out.append(warc_record(headers, block))
                yield pa.RecordBatch.from_pydict({"record": pa.array(out, pa.binary())})

    _write(rows.select(*names).mapInArrow(run, "record binary"), target, WARC_SEPARATOR)
    return heads.where("error IS NOT NULL").select("file", "offset", "error")


def read_warcs(spark: SparkSession, path: str, *, with_payload: bool = True) -> DataFrame:
    """The response and revisit records of WARC files.

    A response's payload length and digest are taken from its bytes, and checked against the declared ones; a
    revisit's come from its stored HTTP head and its declared digest.
    """
    schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("refers_to_id", pa.string()), ("url", pa.string()), ("date", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):

                def records():
                    for h, block in parse_warc(_content(batch.column(0)[i].as_py())):
                        if h["warc-type"] not in ("response", "revisit"):
                            continue
                        http, _, payload = split_http(block)
                        declared = h["warc-payload-digest"].removeprefix("sha1:")
                        whole = h["warc-type"] == "response"
                        digest = base32_sha1(payload) if whole else declared
                        if digest != declared or base32_sha1(block) != h["warc-block-digest"].removeprefix("sha1:"):
                            raise ValueError(f"{h['warc-record-id']} fails its digest")
                        page = http.get("x-page-id")
                        yield {"record_id": h["warc-record-id"], "record_type": h["warc-type"], "refers_to_id": h.get("warc-refers-to"), "url": h["warc-target-uri"], "date": h["warc-date"], "page_id": None if page is None else int(page), "payload_bytes": len(payload) if whole else int(http["content-length"]), "payload_digest": digest, "payload": payload if with_payload else None}

                yield from _rows(records(), schema, "payload")

    return files(spark, path).select("content").mapInArrow(run, "record_id string, record_type string, refers_to_id string, url string, date string, page_id long, payload_bytes long, payload_digest string, payload binary")
