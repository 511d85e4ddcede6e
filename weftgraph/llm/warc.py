"""WARC files packaged in ZIP archives: written in place, read back through the directories alone.

An archive holds WARC files (archive/N.warc) and an index of each (indexes/N.cdxj), all
stored uncompressed, so that a record is the bytes of a range of the archive. The reader
parses the end record, the ZIP64 records where there are any, and the central directory,
locates the indexes and the WARC files they name, and reads the records by ranges;
nothing is extracted. A WARC file without an index is walked record by record.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import shared_dir, stored

_LIMIT = 0xFFFFFFFF
#: An archive is closed at this size, a WARC file in it at MEMBER_BYTES, or one record; ranges read at once are at most RANGE bytes, or one record.
ARCHIVE_BYTES = 256 << 20
MEMBER_BYTES = 8 << 20
RANGE = 4 << 20
MIN_REVISIT = 1000


@dataclass
class Member:
    name: str
    offset: int
    size: int
    crc: int


class ZipWriter:
    """Stored members one after another into an open file; ZIP64 where a number is too large."""

    def __init__(self, file, zip64: bool = False) -> None:
        self._file, self._at, self._members, self._zip64 = file, 0, [], zip64

    @property
    def size(self) -> int:
        return self._at

    def add(self, name: str, *data: bytes) -> None:
        crc, length, coded = 0, sum(map(len, data)), name.encode()
        for part in data:
            crc = zlib.crc32(part, crc)
        wide = self._zip64 or length >= _LIMIT
        extra = struct.pack("<HHQQ", 1, 16, length, length) if wide else b""
        size = _LIMIT if wide else length
        head = struct.pack("<IHHHHHIIIHH", 0x04034B50, 45 if wide else 20, 0x800, 0, 0, 0x21, crc, size, size, len(coded), len(extra))
        self._members.append(Member(name, self._at, length, crc))
        for part in (head, coded, extra, *data):
            self._file.write(part)
            self._at += len(part)

    def close(self) -> None:
        start = self._at
        for m in self._members:
            coded = m.name.encode()
            big = self._zip64 or m.size >= _LIMIT or m.offset >= _LIMIT
            extra = struct.pack("<HHQQQ", 1, 24, m.size, m.size, m.offset) if big else b""
            size, offset = (_LIMIT, _LIMIT) if big else (m.size, m.offset)
            entry = struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45 if big else 20, 0x800, 0, 0, 0x21, m.crc, size, size, len(coded), len(extra), 0, 0, 0, 0, offset)
            self._file.write(entry + coded + extra)
            self._at += len(entry) + len(coded) + len(extra)
        length, n = self._at - start, len(self._members)
        if self._zip64 or n >= 0xFFFF or start >= _LIMIT or length >= _LIMIT:
            self._file.write(struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, n, n, length, start))
            self._file.write(struct.pack("<IIQI", 0x07064B50, 0, self._at, 1))
        self._file.write(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, min(n, 0xFFFF), min(n, 0xFFFF), min(length, _LIMIT), min(start, _LIMIT), 0))


class ZipReader:
    """Members of an archive by its directory; file offers seek, read and size."""

    def __init__(self, file, size: int) -> None:
        self._file, self._size = file, size

    def _range(self, at: int, n: int) -> bytes:
        self._file.seek(at)
        data = self._file.read(n)
        if len(data) != n:
            raise ValueError("the archive is cut off")
        return data

    def members(self) -> Iterator[Member]:
        tail = min(self._size, 22 + 0xFFFF)
        data = self._range(self._size - tail, tail)
        end = data.rfind(b"PK\x05\x06")
        if end < 0:
            raise ValueError("no end of a central directory")
        _, _, _, _, n, length, start, _ = struct.unpack_from("<IHHHHIIH", data, end)
        place = self._size - tail + end - 20
        if place >= 0 and (locator := self._range(place, 20))[:4] == b"PK\x06\x07":
            (at,) = struct.unpack_from("<Q", locator, 8)
            n, length, start = struct.unpack_from("<QQQ", self._range(at, 56), 32)
        held, at, stop = b"", start, start + length
        for _ in range(n):
            if len(held) < 46 + 3 * 0xFFFF and at < stop:
                more = self._range(at, min(RANGE, stop - at))
                held, at = held + more, at + len(more)
            f = struct.unpack_from("<IHHHHHHIIIHHHHHII", held)
            if f[0] != 0x02014B50 or f[4] != 0:
                raise ValueError("not a stored member")
            crc, size, offset = f[7], f[9], f[16]
            name = held[46 : 46 + f[10]].decode()
            extra, i = held[46 + f[10] : 46 + f[10] + f[11]], 0
            while i + 4 <= len(extra):
                kind, m = struct.unpack_from("<HH", extra, i)
                if kind == 1:
                    wide = list(struct.unpack_from(f"<{m // 8}Q", extra, i + 4))
                    size = wide.pop(0) if f[9] == _LIMIT else size
                    if f[8] == _LIMIT:
                        wide.pop(0)
                    offset = wide.pop(0) if offset == _LIMIT else offset
                i += 4 + m
            held = held[46 + f[10] + f[11] + f[12] :]
            yield Member(name, offset, size, crc)

    def read(self, wanted: list[Member]) -> Iterator[tuple[Member, bytes]]:
        """The data of members in order of offset, neighbours in one range."""
        first = 0
        while first < len(wanted):
            last = first + 1
            while last < len(wanted) and wanted[last].offset + wanted[last].size - wanted[first].offset < RANGE:
                last += 1
            low = wanted[first].offset
            high = min(self._size, wanted[last - 1].offset + wanted[last - 1].size + 30 + 2 * 0xFFFF)
            block = self._range(low, high - low)
            for m in wanted[first:last]:
                at = m.offset - low
                head = struct.unpack_from("<IHHHHHIIIHH", block, at)
                if head[0] != 0x04034B50:
                    raise ValueError("no member at its offset")
                at += 30 + head[9] + head[10]
                data = block[at : at + m.size]
                if len(data) != m.size or zlib.crc32(data) != m.crc:
                    raise ValueError(f"{m.name} is damaged")
                yield m, data
            first = last

    def ranges(self, member: Member, entries: list[tuple[int, int]]) -> Iterator[bytes]:
        """The records of a WARC file at (offset, length) in it, in order of offset, neighbours in one range.

        If the entries cover the whole file, its checksum is verified as well.
        """
        head = struct.unpack("<IHHHHHIIIHH", self._range(member.offset, 30))
        if head[0] != 0x04034B50:
            raise ValueError("no member at its offset")
        start = member.offset + 30 + head[9] + head[10]
        first, at, crc = 0, 0, 0
        while first < len(entries):
            low, last = entries[first][0], first + 1
            while last < len(entries) and sum(entries[last]) - low <= RANGE:
                last += 1
            high = max(sum(x) for x in entries[first:last])
            if high > member.size:
                raise ValueError(f"a record reaches over the end of {member.name}")
            block = self._range(start + low, high - low)
            if at == low:
                at, crc = high, zlib.crc32(block, crc)
            for offset, length in entries[first:last]:
                yield block[offset - low : offset - low + length]
            first = last
        if at == member.size and crc != member.crc:
            raise ValueError(f"{member.name} is damaged")

    def walked(self, member: Member) -> Iterator[tuple[int, int]]:
        """(offset, length) of every record of a WARC file, by the lengths that the records state."""
        head = struct.unpack("<IHHHHHIIIHH", self._range(member.offset, 30))
        start, at = member.offset + 30 + head[9] + head[10], 0
        while at < member.size:
            n = 1 << 12
            while (end := (fields := self._range(start + at, min(n, member.size - at))).find(b"\r\n\r\n")) < 0:
                if n >= member.size - at:
                    raise ValueError(f"{member.name} is cut off")
                n *= 2
            length = end + 4 + int(_fields(fields[:end])["content-length"]) + 4
            yield at, length
            at += length

    def records(self) -> Iterator[bytes]:
        """Every record of the WARC files of this archive: of those an index names, where it says, of the others as they come."""
        indexes, files = [], {}
        for m in self.members():
            if m.name.startswith("indexes/") and m.name.endswith(".cdxj"):
                indexes.append(m)
            elif m.name.startswith("archive/") and m.name.endswith(".warc"):
                files[m.name] = m
        left = dict(files)
        for index, data in self.read(indexes):
            entries: dict[str, list[tuple[int, int]]] = {}
            for line in data.decode().splitlines():
                place = json.loads(line.split(" ", 2)[2])
                entries.setdefault("archive/" + place["filename"], []).append((int(place["offset"]), int(place["length"])))
            for name, found in entries.items():
                if name not in files:
                    raise ValueError(f"{index.name} names {name}, which is not in the archive")
                left.pop(name, None)
                yield from self.ranges(files[name], sorted(found))
        for m in left.values():
            yield from self.ranges(m, list(self.walked(m)))


def index_line(url: str, digest: str, filename: str, offset: int, length: int) -> str:
    """A line of an index: the key with the host reversed, the time, and where the record is."""
    parts = re.fullmatch(r"[A-Za-z][A-Za-z+.-]*://([^/?#:]*)(?::[0-9]*)?(.*)", url, re.DOTALL)
    key = ",".join(reversed(parts[1].lower().split("."))) + ")" + parts[2] if parts else url
    key = re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), key) or "-"
    return f"{key} 19700101000000 {json.dumps({'url': url, 'digest': f'sha1:{digest}', 'offset': str(offset), 'length': str(length), 'filename': filename})}\n"


class WarcWriter:
    """Records into WARC files of an archive, with an index beside each; holds one file's records until it is full."""

    def __init__(self, file, zip64: bool = False, member_bytes: int = MEMBER_BYTES) -> None:
        self._zip, self._limit, self._n = ZipWriter(file, zip64), member_bytes, 0
        self._held, self._lines, self._size = [], [], 0

    @property
    def size(self) -> int:
        return self._zip.size + self._size

    def add(self, url: str, digest: str, data: bytes) -> None:
        if self._held and self._size + len(data) > self._limit:
            self._flush()
        self._lines.append(index_line(url, digest, f"{self._n}.warc", self._size, len(data)))
        self._held.append(data)
        self._size += len(data)

    def _flush(self) -> None:
        self._zip.add(f"archive/{self._n}.warc", *self._held)
        self._zip.add(f"indexes/{self._n}.cdxj", "".join(sorted(self._lines)).encode())
        self._held, self._lines, self._size, self._n = [], [], 0, self._n + 1

    def close(self) -> None:
        if self._held:
            self._flush()
        self._zip.close()


def record_id(number: int | None, url: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{number} {url} {digest}')}>"


def record(kind: str, url: str, payload: bytes, number: int | None, size: int, digest: str, refers: int | None, refers_url: str = "") -> bytes:
    """One WARC/1.1 record; a revisit has the digest and size of the full payload but not its bytes, and names its response's record."""
    body = payload if kind == "response" else b""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(number, url, digest)}", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-ID: {'' if number is None else number}", f"X-Payload-Length: {size}",
    ]
    if kind == "revisit":
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers, refers_url, digest)}",
            f"WARC-Refers-To-Target-URI: {refers_url}", "WARC-Refers-To-Date: 1970-01-01T00:00:00Z", f"X-Refers-To-Page-ID: {refers}",
        ]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(body)}", "", ""]
    return "\r\n".join(lines).encode() + http + body + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields, names in lower case, and the payload."""
    end = data.index(b"\r\n\r\n")
    fields = _fields(data[:end])
    block = data[end + 4 : end + 4 + int(fields["content-length"])]
    return fields, block[block.index(b"\r\n\r\n") + 4 :]


def _plain(url: str | None) -> str:
    """The url with characters that a header line cannot hold percent-coded."""
    return "".join(c if c.isprintable() else "%{:02X}".format(ord(c)) for c in url or "")


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _written(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _open(folder)
        files.create_dir(base, recursive=True)
        name = uuid.uuid4().hex  # another attempt at this task writes other files; only the winner's are listed
        count, out, stream, writer = 0, [], None, None
        for batch in batches:
            for x in batch.to_pylist():
                if writer is None:
                    stream = files.open_output_stream(f"{base}/{name}-{count}.warc.zip")
                    writer = WarcWriter(stream)
                    out.append(f"{name}-{count}.warc.zip")
                    count += 1
                url, payload = _plain(x["url"]), (x["html"] or "").encode()
                writer.add(url, x["digest"], record(x["kind"], url, payload, x["page_id"], x["size"], x["digest"], x["refers_to"], _plain(x["refers_url"])))
                if writer.size >= ARCHIVE_BYTES:
                    writer.close()
                    stream.close()
                    writer = None
        if writer is not None:
            writer.close()
            stream.close()
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["archive"])

    return run


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        html = [(t or "").encode() for t in batch.column("html").to_pylist()]
        more = [pa.array([len(h) for h in html], pa.int64()), pa.array([hashlib.sha1(h).hexdigest() for h in html], pa.string())]
        yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "size", "digest"])


def write_archives(pages: DataFrame, folder: str | None = None, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Write every row of pages(page_id, url, html) as a record; (archive), the URIs of the archives written.

    Of rows with equal payloads of at least min_revisit bytes the largest page_id is the
    response, the others revisit it; rows that repeat that page_id are all responses.
    Null html is an empty payload, a null url an empty one. If no row of a group has a
    page_id, all are responses. Control characters of a url are percent-coded.
    """
    spark = pages.sparkSession
    folder = folder or shared_dir(spark, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    hashed = rows.mapInArrow(_hashed, "page_id long, url string, html string, size long, digest string")
    first = hashed.where(F.col("size") >= min_revisit).groupBy("digest", "size").agg(F.max(F.struct("page_id", "url")).alias("top"), F.count("*").alias("n"))
    first = first.select("digest", "size", F.col("top.page_id").alias("first"), F.col("top.url").alias("first_url"), "n").where("n > 1 and first is not null")
    first = stored(first.drop("n"), "first")
    kinds = hashed.join(first, ["digest", "size"], "left").withColumn("kind", F.when(F.col("first").isNull() | F.col("page_id").eqNullSafe(F.col("first")), "response").otherwise("revisit"))
    kinds = kinds.withColumn("refers_to", F.when(F.col("kind") == "revisit", F.col("first")))
    kinds = kinds.withColumn("refers_url", F.when(F.col("kind") == "revisit", F.col("first_url")))
    body = kinds.select("page_id", "url", F.when(F.col("kind") == "response", F.col("html")).alias("html"), "size", "digest", "kind", "refers_to", "refers_url")
    done = stored(body.mapInArrow(_written(folder), "archive string"), "archives")
    return done.select(F.concat(F.lit(folder + "/"), "archive").alias("archive"))


_RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.strip().split(" ")[0] for x in _RECORD.split(",")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    for given in batches:
        for uri in given.column(0).to_pylist():
            files, path = _open(uri)
            size = files.get_file_info(path).size
            with files.open_input_file(path) as file:
                reader = ZipReader(file, size)
                rows, held = [], 0
                for data in reader.records():
                    f, payload = parsed(data)
                    kind = f["warc-type"]
                    digest = f["warc-payload-digest"].removeprefix("sha1:")
                    n = int(f["x-payload-length"])
                    if kind == "response" and (len(payload) != n or hashlib.sha1(payload).hexdigest() != digest):
                        raise ValueError(f"a payload in {uri} differs from its digest")
                    rows.append((int(f["x-page-id"]) if f["x-page-id"] else None, f["warc-target-uri"], n, digest, kind, int(f["x-refers-to-page-id"]) if kind == "revisit" else None, payload if kind == "response" else None))
                    held += len(payload)
                    if held > RANGE:
                        yield batch(rows)
                        rows, held = [], 0
                yield batch(rows)


def read_archives(archives: DataFrame) -> DataFrame:
    """Every record of archives(archive): page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null: revisit)."""
    spark: SparkSession = archives.sparkSession
    tasks = max(1, spark.sparkContext.defaultParallelism)
    return archives.select("archive").repartition(max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions"))), "archive").mapInArrow(_read, _RECORD)


WARC_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS m, count(*) OVER (PARTITION BY payload_digest) AS n FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND n > 1 AND page_id <> m THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND n > 1 AND page_id <> m THEN m END AS refers_to
FROM g
"""
