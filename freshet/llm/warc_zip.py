"""WARC records in ZIP packages: written by tasks, read back by range without extraction.

A package holds ``archive/data.warc.gz`` (records one after the other, each a gzip member of
its own) and ``indexes/index.csv`` (record id, offset, length), both stored as they are, so a
record is a byte range of the package itself. The reader takes the end of the file, parses the end record, the ZIP64
locator and directory where there is one and the central directory, finds the stored
members from their local headers and then reads only the ranges it needs.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm.common import materialise, scratch_root

# Fixed values of the ZIP format: signatures and layouts of its records.
LOCAL, CENTRAL, END, END64, LOCATOR64 = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
_LOCAL = struct.Struct("<IHHHHHIIIHH")
_CENTRAL = struct.Struct("<IHHHHHHIIIHHHHHII")
_END = struct.Struct("<IHHHHIIH")
_END64 = struct.Struct("<IQHHIIQQQQ")
_LOCATOR64 = struct.Struct("<IIQI")
_MAX16, _MAX32 = 0xFFFF, 0xFFFFFFFF
DATA, INDEX = "archive/data.warc.gz", "indexes/index.csv"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A package is closed at about this many bytes, so a task holds no more than one.
PACKAGE_BYTES = 64 << 20
#: Reading: archive bytes a task, records whose index lines a task takes, bytes that stay together.
TASK_BYTES, INDEX_RECORDS, STRETCH = 32 << 20, 1_000_000, 1 << 20


class ZipFormatError(ValueError):
    """The bytes are not a readable ZIP package."""


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    stored: int
    crc: int
    header: int  # offset of the local header


def _file(uri: str, write: bool = False):
    fs, path = pafs.FileSystem.from_uri(uri)
    if write:
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        return fs.open_output_stream(path)
    return fs.open_input_file(path)


def write_package(out, members: list[tuple[str, bytes]], force_zip64: bool = False) -> None:
    """Write stored members to a binary stream, with ZIP64 records where a field overflows."""
    at, central = 0, []
    for name, data in members:
        raw, crc = name.encode(), zlib.crc32(data)
        wide = force_zip64 or len(data) >= _MAX32
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if wide else b""
        size = _MAX32 if wide else len(data)
        out.write(_LOCAL.pack(LOCAL, 45 if wide else 20, 0x800, 0, 0, 0x21, crc, size, size, len(raw), len(extra)) + raw + extra)
        out.write(data)
        far = force_zip64 or at >= _MAX32
        more = (struct.pack("<QQ", len(data), len(data)) if wide else b"") + (struct.pack("<Q", at) if far else b"")
        extra = struct.pack("<HH", 1, len(more)) + more if more else b""
        central.append(_CENTRAL.pack(CENTRAL, 45, 45 if wide or far else 20, 0x800, 0, 0, 0x21, crc, size, size, len(raw), len(extra), 0, 0, 0, 0, _MAX32 if far else at) + raw + extra)
        at += _LOCAL.size + len(raw) + (20 if wide else 0) + len(data)
    directory = b"".join(central)
    out.write(directory)
    n = len(members)
    if force_zip64 or n >= _MAX16 or at >= _MAX32 or len(directory) >= _MAX32:
        out.write(_END64.pack(END64, _END64.size - 12, 45, 45, 0, 0, n, n, len(directory), at))
        out.write(_LOCATOR64.pack(LOCATOR64, 0, at + len(directory), 1))
        out.write(_END.pack(END, 0, 0, _MAX16, _MAX16, _MAX32, _MAX32, 0))
    else:
        out.write(_END.pack(END, 0, 0, n, n, len(directory), at, 0))


def _range(f, at: int, n: int) -> bytes:
    f.seek(at)
    got = f.read(n)
    if len(got) != n:
        raise ZipFormatError(f"{n} bytes at {at} go beyond the end")
    return bytes(got)


def read_directory(f) -> dict[str, Member]:
    """Members of a package (a seekable binary file) by name, from its central directory."""
    f.seek(0, 2)
    size = f.tell()
    tail = _range(f, max(0, size - _END.size - _MAX16), min(size, _END.size + _MAX16))
    where = len(tail) - _END.size
    while where >= 0:
        where = tail.rfind(struct.pack("<I", END), 0, where + 4)
        if where < 0:
            raise ZipFormatError("no end of central directory")
        if where + _END.size + struct.unpack_from("<H", tail, where + 20)[0] == len(tail):
            break
        where -= 1
    if where < 0:
        raise ZipFormatError("no end of central directory")
    _, _, _, _, count, length, start, _ = _END.unpack_from(tail, where)
    if count == _MAX16 or length == _MAX32 or start == _MAX32:
        at = size - len(tail) + where - _LOCATOR64.size
        signature, _, end64, _ = _LOCATOR64.unpack(_range(f, at, _LOCATOR64.size)) if at >= 0 else (0, 0, 0, 0)
        if signature == LOCATOR64:
            record = _END64.unpack(_range(f, end64, _END64.size))
            if record[0] != END64:
                raise ZipFormatError("the ZIP64 locator points to no ZIP64 end record")
            count, length, start = record[7:]
    raw, at, members = _range(f, start, length), 0, {}
    for _ in range(count):
        if at + _CENTRAL.size > len(raw):
            raise ZipFormatError("the central directory is cut short")
        x = _CENTRAL.unpack_from(raw, at)
        if x[0] != CENTRAL:
            raise ZipFormatError("not a central directory entry")
        method, crc, stored, full, n_name, n_extra, n_comment, header = x[4], x[7], x[8], x[9], x[10], x[11], x[12], x[16]
        name = raw[at + _CENTRAL.size :][:n_name].decode("utf-8" if x[3] & 0x800 else "cp437")
        extra, k = raw[at + _CENTRAL.size + n_name :][:n_extra], 0
        while k + 4 <= len(extra):
            tag, n = struct.unpack_from("<HH", extra, k)
            if tag == 1:
                values = iter(struct.unpack_from(f"<{n // 8}Q", extra, k + 4))
                full = next(values) if full == _MAX32 else full
                stored = next(values) if stored == _MAX32 else stored
                header = next(values) if header == _MAX32 else header
            k += 4 + n
        members[name] = Member(name, method, full, stored, crc, header)
        at += _CENTRAL.size + n_name + n_extra + n_comment
    return members


def data_offset(f, member: Member) -> int:
    """Where a stored member's bytes begin; an error for a compressed one."""
    if member.method:
        raise ZipFormatError(f"{member.name} is compressed, not stored")
    x = _LOCAL.unpack(_range(f, member.header, _LOCAL.size))
    if x[0] != LOCAL:
        raise ZipFormatError("no local header where the directory says")
    return member.header + _LOCAL.size + x[9] + x[10]


def warc_record(record_id: str, kind: str, uri: str, payload: bytes, digest: str, refers_to: str | None = None) -> bytes:
    """A WARC/1.1 record over an HTTP response. A revisit has the response's header, with
    its payload's length, but no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if kind == "revisit" else http + payload
    uri = "".join(c for c in uri if c not in "\r\n")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Target-URI: {uri}", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(raw: bytes) -> dict[str, str]:
    lines = raw.decode().split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC fields, HTTP fields, payload) of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = _fields(head)
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, _fields(http), payload


def _ident(page_id, digest: str) -> str:
    """A record's id: rows that repeat a page id with other payloads have ids of their own."""
    return f"urn:page:{page_id}:{digest}"


def _page_of(ident: str | None) -> int | None:
    part = "None" if ident is None else ident.split(":")[2]
    return None if part == "None" else int(part)


def _digest(min_bytes: int) -> Column:
    """SHA-1 of the payload ``html`` where it has ``min_bytes`` at least; null for others, and
    for a row of null id."""
    raw = F.col("html").cast("binary")
    return F.when(F.col("page_id").isNotNull() & (F.octet_length(raw) >= min_bytes), F.unhex(F.sha1(raw)))


def plan_revisits(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """page_id, digest, refers_to of the payloads of ``min_bytes`` at least that stand under
    a larger page_id too: the page of the largest id is the response, rows under any other
    id are revisits of it. A page of null id is never part of it. One row for each page_id
    and digest, however often such rows repeat.

    Digests with two rows or more are written and joined back by a plain shuffle join,
    which adaptive execution splits on a hot payload; no payload is shuffled.
    """
    slim = pages.select("page_id", F.coalesce("html", F.lit("")).alias("html")).select("page_id", _digest(min_bytes).alias("digest"))
    slim = materialise(slim.where(F.col("digest").isNotNull()), "digests")
    held = slim.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").select("digest", "refers_to")
    held = materialise(held, "repeated")
    return slim.join(held, "digest").where("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 1000, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write a record for every row of ``pages`` (page_id, url, html) into ZIP packages under
    ``folder``, a location all executors share; returns package, records, bytes (one row a
    package).

    A null html is an empty payload, a null url an empty target; a row of null id is
    written as a response without an id. Rows that repeat an id are records of their own,
    each judged by its own payload: rows of the largest id that holds a payload are all
    responses, and so is a row of an id whose other rows are revisits.
    Columns beyond the three are ignored. A task that is run again writes packages of new
    names, and only those of the run that counted are returned, so a lost executor or a
    second attempt leaves nothing double.
    """
    fields = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    revisits = plan_revisits(pages, min_bytes).withColumnsRenamed({"page_id": "_rid", "digest": "_rd"})
    # Rows without a digest match nothing, and their ids keep them from piling up under one key.
    rows = fields.withColumn("_d", _digest(min_bytes)).join(
        revisits, (F.col("page_id") == F.col("_rid")) & (F.coalesce("_d", F.lit(b"")) == F.col("_rd")), "left"
    ).select("page_id", "url", "html", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, index = io.BytesIO(), []

        def close() -> pa.RecordBatch:
            uri = f"{folder}/{uuid.uuid4().hex}.wacz"
            lines = "".join(f"{i},{a},{n}\n" for i, a, n in index).encode()
            with _file(uri, write=True) as out:
                write_package(out, [(DATA, data.getvalue()), (INDEX, lines)])
            done = pa.RecordBatch.from_pydict({"package": [uri], "records": pa.array([len(index)], pa.int64()), "bytes": pa.array([data.tell()], pa.int64())})
            data.seek(0), data.truncate(), index.clear()
            return done

        for batch in batches:
            for page, url, html, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                payload = html.encode()
                digest = hashlib.sha1(payload).hexdigest()
                raw = gzip.compress(warc_record(
                    _ident(page, digest), "response" if refers is None else "revisit", url, payload,
                    digest, None if refers is None else _ident(refers, digest),
                ), 6, mtime=0)
                index.append(("" if page is None else page, data.tell(), len(raw)))
                data.write(raw)
                if data.tell() >= package_bytes:
                    yield close()
        if index:
            yield close()

    return materialise(rows.mapInArrow(write, "package string, records long, bytes long"), "packages")


def read_index(packages: DataFrame) -> DataFrame:
    """package, page_id, offset, length of every record, from the packages' own indexes, so
    many packages a task as hold about ``INDEX_RECORDS`` records."""
    n = packages.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("package").to_pylist():
                with _file(uri) as f:
                    members = read_directory(f)
                    raw = _range(f, data_offset(f, members[INDEX]), members[INDEX].size)
                    if zlib.crc32(raw) != members[INDEX].crc:
                        raise ZipFormatError(f"the index of {uri} is damaged")
                    base = data_offset(f, members[DATA])
                rows = [x.split(",") for x in raw.decode().splitlines()]
                yield pa.RecordBatch.from_pydict({
                    "package": [uri] * len(rows), "page_id": pa.array([int(r[0]) if r[0] else None for r in rows], pa.int64()),
                    "offset": pa.array([base + int(r[1]) for r in rows], pa.int64()), "length": pa.array([int(r[2]) for r in rows], pa.int64()),
                })

    spread = packages.select("package").repartition(max(1, -(-n // INDEX_RECORDS)), "package")
    return spread.mapInArrow(read, "package string, page_id long, offset long, length long")


def spread_index(index: DataFrame, packages: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """The records of an index dealt evenly over tasks of about ``task_bytes`` of archive each
    (as many as the session runs at once, at least), whatever package they are in. Stretches of
    a package stay together and in order, so that ranges which follow each other are read
    at once."""
    total = packages.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    tasks = max(packages.sparkSession.sparkContext.defaultParallelism, -(-total // task_bytes))
    stretch = F.floor(F.col("offset") / STRETCH)
    return index.repartition(tasks, "package", stretch).sortWithinPartitions("package", "offset")


def read_records(index: DataFrame, window: int = 4 << 20) -> DataFrame:
    """Read the records of an index (or of any part of it) by byte range: page_id,
    record_type, target_uri, refers_to, payload_bytes, payload_digest, payload (null for a
    revisit, whose length and digest are those of the payload it stands for).

    Ranges that follow each other are read together, up to ``window`` bytes at once. A
    response whose payload doesn't have its digest is an error.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, f = None, None
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("package", "offset", "length")), strict=True))
            out: dict[str, list] = {c: [] for c in ("page_id", "record_type", "target_uri", "refers_to", "payload_bytes", "payload_digest", "payload")}
            held, start, volume = b"", 0, 0
            for k, (uri, at, n) in enumerate(rows):
                if uri != name:
                    if f:
                        f.close()
                    name, f, held = uri, _file(uri), b""
                if not (start <= at and at + n <= start + len(held)):
                    end, j = at + n, k + 1
                    while j < len(rows) and rows[j][0] == uri and rows[j][1] == end and end + rows[j][2] - at <= window:
                        end, j = end + rows[j][2], j + 1
                    held, start = _range(f, at, end - at), at
                fields, http, payload = parse_record(gzip.decompress(held[at - start : at - start + n]))
                digest = fields["warc-payload-digest"].removeprefix("sha1:")
                response = fields["warc-type"] == "response"
                if response and hashlib.sha1(payload).hexdigest() != digest:
                    raise ValueError(f"a payload in {uri} doesn't have its digest")
                out["page_id"].append(_page_of(fields["warc-record-id"]))
                out["record_type"].append(fields["warc-type"])
                out["target_uri"].append(fields["warc-target-uri"])
                out["refers_to"].append(_page_of(fields.get("warc-refers-to")))
                out["payload_bytes"].append(int(http["content-length"]))
                out["payload_digest"].append(digest)
                out["payload"].append(payload if response else None)
                volume += len(payload)
                if volume >= window or k == len(rows) - 1:
                    yield pa.RecordBatch.from_pydict({c: pa.array(v, {"page_id": pa.int64(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}.get(c, pa.string())) for c, v in out.items()})
                    out, volume = {c: [] for c in out}, 0
        if f:
            f.close()

    return index.select("package", "offset", "length").mapInArrow(
        read, "page_id long, record_type string, target_uri string, refers_to long, payload_bytes long, payload_digest string, payload binary"
    )


def archive_folder(spark: SparkSession) -> str:
    """A new folder for packages in the folder that executors share."""
    root = scratch_root(spark)
    return f"{root if '://' in root or root.startswith('file:') else 'file://' + root}/freshet-archives-{uuid.uuid4().hex}"
