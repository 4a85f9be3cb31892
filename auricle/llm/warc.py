"""WARC archives in ZIP packages, read by ranges.

A package holds stored (uncompressed) members: ``archive/data.warc.gz``, one gzip member for each record, and
``indexes/index.cdx``, one line for each record with its place. The reader takes the end of a package, finds the
end-of-central-directory record, its ZIP64 form where a value does not fit, and the central directory; from there
the place of a member inside the package. A record is then one range of the package: nothing is extracted.

Packages are written by tasks under the folder they are given, through a file system that the folder's address
names, first under a temporary name. Reading deals index lines, not packages, so a large package is read by many.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import scratch_path
from .common import materialize

END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2", b"PK\3\4"  # fixed values
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
PACKAGE_BYTES = 64_000_000
READ_GAP = 64_000


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def file_system(address: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of an address; ``file:/x`` is what Hadoop calls ``file:///x``."""
    if address.startswith("file:"):
        address = "file:///" + address.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(address)


# --- ZIP


@dataclass(frozen=True)
class Member:
    name: str
    offset: int  # of the member's bytes in the package
    size: int
    stored: bool


def _local_header(name: bytes, crc: int, size: int, wide: bool) -> bytes:
    extra = struct.pack("<HHQQ", 1, 16, size, size) if wide else b""
    small, version = (FULL32, 45) if wide else (size, 20)
    head = struct.pack("<4s5H3I2H", LOCAL, version, 0x800, 0, 0, 33, crc, small, small, len(name), len(extra))
    return head + name + extra


class PackageWriter:
    """Stored members written one after another to an open stream; ``zip64`` writes every wide form."""

    def __init__(self, out, zip64: bool = False):
        self.out, self.at, self.zip64, self.members = out, 0, zip64, []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: str, chunks: list[bytes]) -> int:
        """Write a member; the place of its bytes."""
        size = sum(map(len, chunks))
        crc = 0
        for c in chunks:
            crc = zlib.crc32(c, crc)
        wide, raw, at = self.zip64 or size >= FULL32, name.encode(), self.at
        self._put(_local_header(raw, crc, size, wide))
        begin = self.at
        for c in chunks:
            self._put(c)
        self.members.append((raw, crc, size, at))
        return begin

    def close(self) -> None:
        start = self.at
        for name, crc, size, at in self.members:
            wide = self.zip64 or size >= FULL32 or at >= FULL32
            extra = struct.pack("<HHQQQ", 1, 24, size, size, at) if wide else b""
            small, where = (FULL32, FULL32) if wide else (size, at)
            self._put(
                struct.pack(
                    "<4s6H3I5H2I", CENTRAL, 45, 45 if wide else 20, 0x800, 0, 0, 33, crc, small, small,
                    len(name), len(extra), 0, 0, 0, 0, where,
                )
                + name
                + extra
            )
        size, n = self.at - start, len(self.members)
        if self.zip64 or n >= FULL16 or start >= FULL32 or size >= FULL32:
            at = self.at
            self._put(struct.pack("<4sQ2H2I4Q", END64, 44, 45, 45, 0, 0, n, n, size, start))
            self._put(struct.pack("<4sIQI", LOCATOR64, 0, at, 1))
            n, size, start = min(n, FULL16), FULL32, FULL32
        self._put(struct.pack("<4s4H2IH", END, 0, 0, n, n, size, start, 0))


def read_range(file, offset: int, size: int) -> bytes:
    file.seek(offset)
    data = file.read(size)
    if len(data) != size:
        raise ValueError(f"package ends inside a range of {size} bytes at {offset}")
    return data


def directory(file, length: int) -> list[Member]:
    """Members of a package, from its central directory; a comment of any length may follow it."""
    tail_size = min(length, 22 + FULL16 + 20)
    tail = read_range(file, length - tail_size, tail_size)
    end = tail.rfind(END)
    while end >= 0 and (len(tail) - end < 22 or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
        end = tail.rfind(END, 0, end)
    if end < 0:
        raise ValueError("no end of central directory: not a ZIP package")
    n, size, start = struct.unpack_from("<H2I", tail, end + 10)
    locator = end - 20
    if locator >= 0 and tail[locator : locator + 4] == LOCATOR64:
        at = struct.unpack_from("<Q", tail, locator + 8)[0]
        head = read_range(file, at, 56)
        if head[:4] != END64:
            raise ValueError("broken ZIP64 end of central directory")
        n, size, start = struct.unpack_from("<3Q", head, 32)
    data, at, found = read_range(file, start, size), 0, []
    for _ in range(n):
        if data[at : at + 4] != CENTRAL:
            raise ValueError("broken central directory")
        method = struct.unpack_from("<H", data, at + 10)[0]
        packed, plain, name_size, extra_size, note_size = struct.unpack_from("<2I3H", data, at + 20)
        where = struct.unpack_from("<I", data, at + 42)[0]
        name = data[at + 46 : at + 46 + name_size]
        extra = data[at + 46 + name_size : at + 46 + name_size + extra_size]
        place = 0
        while place + 4 <= len(extra):
            kind, width = struct.unpack_from("<2H", extra, place)
            if kind == 1:
                wide = list(struct.unpack_from(f"<{width // 8}Q", extra, place + 4))
                if plain == FULL32:
                    plain = wide.pop(0)
                if packed == FULL32:
                    packed = wide.pop(0)
                if where == FULL32:
                    where = wide.pop(0)
            place += 4 + width
        local = read_range(file, where, 30)
        if local[:4] != LOCAL:
            raise ValueError("broken local header")
        begin = where + 30 + sum(struct.unpack_from("<2H", local, 26))
        found.append(Member(name.decode(), begin, packed, method == 0))
        at += 46 + name_size + extra_size + note_size
    return found


# --- records


@dataclass(frozen=True)
class Record:
    kind: str
    headers: dict[str, str]
    block: bytes


def record_bytes(page_id: int, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzip member: a response with its payload, or a revisit that names the record it repeats."""
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if url:
        lines.append("WARC-Target-URI: " + "".join(c if c.isprintable() else quote(c, safe="") for c in url))
    if refers_to is not None:
        lines.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = head + (payload if refers_to is None else b"")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    raw = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    return packer.compress(raw) + packer.flush()


def parse_record(member: bytes) -> Record:
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines)
    return Record(headers["WARC-Type"], headers, rest[: int(headers["Content-Length"])])


# --- Spark


def decide(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``page_id, size, digest, refers_to`` for pages whose payload of at least ``least_bytes`` bytes a larger id also has.

    Equal payloads are found by length and SHA-1; the response of a group is its largest id. An id with several
    payloads has a decision for each of them.
    """
    rows = pages.select("page_id", *_payload())
    rows = rows.where(F.col("page_id").isNotNull() & (F.col("size") >= least_bytes))
    groups = rows.groupBy("size", "digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
    again = rows.join(groups.where("n > 1"), ["size", "digest"]).where("page_id < refers_to")
    return again.groupBy("page_id", "size", "digest").agg(F.max("refers_to").alias("refers_to"))


def _payload() -> tuple[Column, Column]:
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    return F.octet_length(payload).alias("size"), F.sha1(payload).alias("digest")


def write_packages(
    pages: DataFrame, folder: str, least_bytes: int = 0, package_bytes: int = PACKAGE_BYTES, zip64: bool = True
) -> DataFrame:
    """Write a record for each row of ``pages`` (``page_id, url, html``); one row (``path``) per package."""
    types = {"page_id": "long", "url": "string", "html": "string"}
    rows = pages.select(*[F.col(c).cast(t).alias(c) for c, t in types.items()])
    marked = rows.select("*", *_payload()).join(decide(rows, least_bytes), ["page_id", "size", "digest"], "left")

    def run(batches):
        fs, root = file_system(folder)
        records: list[bytes] = []
        index: list[bytes] = []
        size = 0

        def flush() -> str:
            name = f"{root}/{uuid.uuid4().hex}.wacz"
            fs.create_dir(root, recursive=True)
            with fs.open_output_stream(name + ".tmp") as out:
                package = PackageWriter(out, zip64)
                package.add(DATA, records)
                package.add(INDEX, index)
                package.close()
            fs.move(name + ".tmp", name)
            return name

        for batch in batches:
            done = []
            for page, url, html, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to"))):
                payload = (html or "").encode()
                record = record_bytes(page, url, payload, digest_of(payload), refers)
                records.append(record)
                index.append(f"{'' if page is None else page} {size} {len(record)}\n".encode())
                size += len(record)
                if size >= package_bytes:
                    done.append(flush())
                    records.clear(), index.clear()
                    size = 0
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(done)], names=["path"])
        if records:
            yield pa.RecordBatch.from_arrays([pa.array([flush()])], names=["path"])

    # The list names the packages of the tasks that counted; a lost or repeated task leaves others unread.
    return materialize(marked.mapInArrow(run, "path string"), "packages")


def places(packages: DataFrame, folder: str, index: str = INDEX, data: str = DATA) -> DataFrame:
    """``path, page_id, offset, size`` of every record, from the packages' directories and index members."""

    def run(batches):
        fs, _ = file_system(folder)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with fs.open_input_file(path) as file:
                    members = {m.name: m for m in directory(file, file.size())}
                    for name in (index, data):
                        if name not in members or not members[name].stored:
                            raise ValueError(f"{path}: no stored member {name}")
                    lines = read_range(file, members[index].offset, members[index].size).decode().splitlines()
                fields = [line.split(" ") for line in lines]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([path] * len(fields), pa.string()),
                        pa.array([int(f[0]) if f[0] else None for f in fields], pa.int64()),
                        pa.array([members[data].offset + int(f[1]) for f in fields], pa.int64()),
                        pa.array([int(f[2]) for f in fields], pa.int64()),
                    ],
                    names=["path", "page_id", "offset", "size"],
                )

    return packages.repartition(F.col("path")).mapInArrow(run, "path string, page_id long, offset long, size long")


def _ranges(offsets: np.ndarray, sizes: np.ndarray, limit: int = 8_000_000) -> Iterator[tuple[int, int]]:
    """(first, last) of rising records that are read at once: close to each other, and not too many bytes."""
    first = 0
    for i in range(1, len(offsets) + 1):
        if (
            i == len(offsets)
            or offsets[i] - offsets[i - 1] - sizes[i - 1] > READ_GAP
            or offsets[i] + sizes[i] - offsets[first] > limit
        ):
            yield first, i
            first = i


RECORDS = (
    "page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, url string, "
    "payload binary"
)


def read_records(located: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """The records at ``located`` places; a revisit has no payload of its own but the length and digest it repeats.

    The digest of a response is taken anew from its payload and must be the one it carries.
    """

    def one(raw: bytes) -> tuple:
        record = parse_record(raw)
        h = record.headers
        page = h["WARC-Record-ID"].removeprefix("<urn:page:").removesuffix(">")
        refers = h.get("WARC-Refers-To", "").removeprefix("<urn:page:").removesuffix(">")
        said = h["WARC-Payload-Digest"].removeprefix("sha1:")
        payload = record.block.partition(b"\r\n\r\n")[2]
        size = len(payload)
        if record.kind == "revisit":
            payload, size = None, int(h["X-Payload-Length"])
        elif digest_of(payload) != said:
            raise ValueError(f"payload digest of page {page} differs")
        return (
            None if page == "None" else int(page), record.kind, size, said, int(refers) if refers else None,
            h.get("WARC-Target-URI"), payload if with_payload else None,
        )

    types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary())
    names = ["page_id", "record_type", "payload_bytes", "payload_digest", "refers_to", "url", "payload"]

    def run(batches):
        fs, _ = file_system(folder)
        for batch in batches:
            path = np.array(batch.column("path").to_pylist(), object)
            offset, size = batch.column("offset").to_numpy(), batch.column("size").to_numpy()
            for p in dict.fromkeys(path.tolist()):
                mine = np.flatnonzero(path == p)
                mine = mine[np.argsort(offset[mine])]
                o, s = offset[mine], size[mine]
                with fs.open_input_file(p) as file:
                    for i, j in _ranges(o, s):
                        raw = read_range(file, int(o[i]), int(o[j - 1] + s[j - 1] - o[i]))
                        rows = [one(raw[a - o[i] : a - o[i] + b]) for a, b in zip(o[i:j].tolist(), s[i:j].tolist())]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    dealt = located.repartitionByRange("path", "offset")
    return dealt.mapInArrow(run, RECORDS)


def round_trip(pages: DataFrame, folder: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` as packages and read every record back.

    Null html is an empty payload; a null ``page_id`` is written as such, is always a response and never named by
    another record; of rows that share an id and a payload each is a record of the same kind, and an id with several
    payloads is judged for each of them. Characters of a url that no header can hold are percent-encoded. Other columns are
    ignored; an empty table writes no package. ``folder`` is by default a new one below the shared checkpoint
    folder.
    """
    folder = folder or scratch_path(pages.sparkSession, "warc")
    return read_records(places(write_packages(pages, folder, least_bytes), folder), folder, with_payload=False)
