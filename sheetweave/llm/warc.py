"""WARC archives as a Spark data source: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Reading.  The driver lists the committed files under ``path`` and packs them into
partitions of about ``split`` bytes.  A task reads a record's WARC headers
first and tests them against the pushed predicates (on ``record_type``,
``record_id``, ``target_uri``, ``date``, ``refers_to`` and ``payload_digest``)
and against options ``header.<name>``, which ask for an equal header.  A record
that isn't wanted is skipped undecoded: by its ``Content-Length``, or, in an
archive with a gzip member for each record, by the lengths that the member's
extra field ``sl`` tells; a member without that field has to be inflated to
find its end, but nothing of it is kept.  With ``payload`` false no payload is
decoded.  With ``verify`` true a payload that doesn't have its digest is an error.

Writing.  Each task writes files of its own, about ``roll`` bytes each; their
names are listed in a manifest once all tasks have ended, and a reader keeps to
the manifests where there are any, so what a lost or repeated task leaves isn't
read.  Records come from a table of ``record_id, record_type, target_uri, date,
refers_to, payload_bytes, payload_digest, payload``; other columns are ignored
and missing ones are null.  A null payload is an empty one, a null URI or
reference has no header, a null type is ``resource``.  Paths may be on any file
system that ``pyarrow.fs`` opens.

Line ends within a header's value are written as a space.  A foreign file may
hold any record types; a record without a length, or a file cut within a record,
is an error that names the file and the place.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, In, InputPartition, IsNotNull, IsNull, Not, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage

from .cluster import shared_folder, stored

SPLIT, ROLL, BATCH = 64 << 20, 256 << 20, 8 << 20
_HEADERS = ("record_type", "record_id", "target_uri", "date", "refers_to", "payload_digest")
_FIELDS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}
_ARROW = pa.schema([*((n, pa.string()) for n in _HEADERS), ("payload_bytes", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()), ("file", pa.string()), ("offset", pa.int64())])
SCHEMA = f"{', '.join(f'{n} string' for n in _HEADERS)}, payload_bytes bigint, headers map<string,string>, payload binary, file string, offset bigint"
#: Below this many bytes a table is sent to every executor, beyond it is joined by a shuffle.
BROADCAST = 64 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path within it."""
    local = re.match(r"file:/*(/.*)", path)
    if local or "://" not in path:
        return fs.LocalFileSystem(), local[1] if local else path
    return fs.FileSystem.from_uri(path)


class _Bytes:
    """A file read forwards in pieces, with jumps."""

    def __init__(self, file, at: int, piece: int = 1 << 16):
        self.file, self.at, self.piece, self.held = file, at, piece, b""

    def need(self, n: int) -> bool:
        """Hold n bytes from here on, if the file has them."""
        while len(self.held) < n:
            self.file.seek(self.at + len(self.held))
            got = self.file.read(max(self.piece, n - len(self.held)))
            if not got:
                return False
            self.held += got
        return True

    def until(self, mark: bytes) -> int:
        """Bytes before ``mark``, or -1 if it doesn't come."""
        tried = 0
        while (found := self.held.find(mark, max(0, tried - len(mark)))) < 0:
            tried = len(self.held)
            if not self.need(tried + 1):
                return -1
        return found

    def skip(self, n: int) -> None:
        self.held = self.held[n:]
        self.at += n

    def take(self, n: int) -> bytes:
        if not self.need(n):
            raise EOFError(f"cut within a record, at {self.at}")
        got = self.held[:n]
        self.skip(n)
        return got


class _Member:
    """One gzip member of a file, inflated as far as asked for."""

    def __init__(self, source: _Bytes):
        self.source, self.begin, self.inflate, self.out, self.size = source, source.at, zlib.decompressobj(31), b"", None
        if not source.need(10) or source.held[:3] != b"\x1f\x8b\x08":
            raise ValueError(f"no gzip member at {source.at}")
        if source.held[3] & 4 and source.need(12) and source.need(12 + struct.unpack("<H", source.held[10:12])[0]):
            extra = source.held[12 : 12 + struct.unpack("<H", source.held[10:12])[0]]
            while len(extra) >= 4:
                n = struct.unpack("<H", extra[2:4])[0]
                if extra[:2] == b"sl" and n == 8:
                    self.size = struct.unpack("<I", extra[4:8])[0] or None
                extra = extra[4 + n :]

    def more(self) -> bool:
        if self.inflate.eof or not self.source.need(1):
            return False
        piece = self.source.held[: 1 << 14]
        self.out += self.inflate.decompress(piece)
        self.source.skip(len(piece) - len(self.inflate.unused_data))
        return True

    def until(self, mark: bytes) -> int:
        while (found := self.out.find(mark)) < 0:
            if not self.more():
                return -1
        return found

    def rest(self) -> bytes:
        while self.more():
            pass
        if not self.inflate.eof:
            raise EOFError(f"cut within a record, at {self.begin}")
        return self.out

    def leave(self) -> None:
        """Go to the next member."""
        if self.size:
            self.source.skip(self.begin + self.size - self.source.at)
        else:
            while self.more():
                self.out = b""


def parsed(head: bytes) -> dict[str, str]:
    """Headers by lower-case name; a line that begins with white space goes on with the one before."""
    lines = re.sub(rb"\r?\n[ \t]+", b" ", head).split(b"\n")
    fields = (x.partition(b":") for x in lines[1:])
    return {k.strip().decode("utf-8", "replace").lower(): v.strip().decode("utf-8", "replace") for k, _, v in fields if k.strip()}


def _unchunked(body: bytes) -> bytes:
    out = []
    while (line := body.find(b"\r\n")) >= 0 and (n := int(body[:line].split(b";")[0] or b"0", 16)):
        out.append(body[line + 2 : line + 2 + n])
        body = body[line + 4 + n :]
    return b"".join(out)


def _entity(headers: dict[str, str], block: bytes) -> tuple[bytes, int | None]:
    """The payload of a record's block, and the length that HTTP headers tell."""
    if not headers.get("content-type", "").startswith("application/http"):
        return block, None
    head, _, body = block.partition(b"\r\n\r\n")
    http = parsed(head)
    told = http.get("content-length", "")
    return (_unchunked(body) if http.get("transfer-encoding", "").lower() == "chunked" else body), int(told) if told.isdigit() else None


def records(file, wanted, payloads: bool, verify: bool, name: str = "") -> Iterator[dict]:
    """The records of an open file of which ``wanted`` accepts the headers."""
    source = _Bytes(file, 0)
    while source.need(1):
        begin = source.at
        if source.held[:1] in b"\r\n":
            source.skip(1)
            continue
        member = None
        try:
            if source.need(2) and source.held[:2] == b"\x1f\x8b":
                member = _Member(source)
                end = member.until(b"\r\n\r\n")
                head = member.out[:end]
            else:
                end = source.until(b"\r\n\r\n")
                head = source.held[:end]
            if end < 0 or not head.startswith(b"WARC/"):
                raise ValueError("no WARC record")
            headers = parsed(head)
            length = int(headers["content-length"])
            row = {n: headers.get(f) for n, f in _FIELDS.items()}
            row["payload_digest"] = row["payload_digest"] and row["payload_digest"].removeprefix("sha1:")
            keep = wanted(row, headers)
            if member:
                block = member.rest()[end + 4 : end + 4 + length] if keep and payloads else None
                if block is None:
                    member.leave()
                elif len(block) < length:
                    raise EOFError("a block shorter than its length")
            else:
                source.skip(end + 4)
                block = source.take(length) if keep and payloads else None
                if block is None:
                    source.skip(length)
        except (KeyError, ValueError, EOFError, zlib.error) as e:
            raise ValueError(f"{name} at {begin}: {e}") from e
        if not keep:
            continue
        payload = None
        row["payload_bytes"] = None
        if block is not None:
            payload, told = _entity(headers, block)
            hollow = row["record_type"] == "revisit"
            row["payload_bytes"] = told if hollow else len(payload)
            payload = None if hollow else payload
        if verify and payload is not None and row["payload_digest"] and row["payload_digest"] != base32_sha1(payload):
            raise ValueError(f"{name} at {begin}: the payload doesn't have its digest")
        yield row | {"headers": list(headers.items()), "payload": payload, "file": name, "offset": begin}


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _test(f):
    """A pushed filter as a function of the header columns, or none."""
    if isinstance(f, Not):
        inner = _test(f.child)
        return inner and (lambda row: (got := inner(row)) is not None and not got)
    column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
    if column not in _HEADERS:
        return None
    value = getattr(f, "value", None)

    def on(g):
        return lambda row: None if row[column] is None else g(row[column])

    for kind, g in ((EqualTo, lambda x: x == value), (In, lambda x: x in value), (StringStartsWith, lambda x: x.startswith(value)), (StringEndsWith, lambda x: x.endswith(value)), (StringContains, lambda x: value in x)):
        if isinstance(f, kind):
            return on(g) if value is not None and not (kind is In and None in value) else None
    if isinstance(f, EqualNullSafe):
        return lambda row: row[column] == value
    return (lambda row: row[column] is None) if isinstance(f, IsNull) else (lambda row: row[column] is not None) if isinstance(f, IsNotNull) else None


def _header(name: str, value: str | None) -> bytes:
    return b"" if value is None else f"{name}: {' '.join(value.split())}\r\n".encode()


def written(row: dict, packed: bool) -> bytes:
    """A record: HTTP headers that tell the length and, unless it's a revisit, the payload."""
    kind, payload = row.get("record_type") or "resource", row.get("payload") or b""
    digest = row.get("payload_digest") or base32_sha1(payload)
    http = kind in ("response", "revisit")
    size = row.get("payload_bytes") if kind == "revisit" and row.get("payload_bytes") is not None else len(payload)
    block = f"HTTP/1.1 200 OK\r\nContent-Length: {size}\r\n\r\n".encode() if http else b""
    block += b"" if kind == "revisit" else payload
    head = b"WARC/1.1\r\n" + _header("WARC-Type", kind) + _header("WARC-Record-ID", row.get("record_id") or f"<urn:uuid:{uuid.uuid4()}>") + _header("WARC-Date", row.get("date") or "1970-01-01T00:00:00Z")
    head += _header("WARC-Target-URI", row.get("target_uri")) + _header("WARC-Payload-Digest", f"sha1:{digest}") + _header("WARC-Refers-To", row.get("refers_to"))
    if kind == "revisit":
        head += _header("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    head += _header("Content-Type", f"application/http; msgtype={'response' if http else 'request'}" if http else "application/octet-stream") + _header("Content-Length", str(len(block)))
    whole = head + b"\r\n" + block + b"\r\n\r\n"
    return member(whole) if packed else whole


def member(data: bytes) -> bytes:
    """A gzip member that tells its packed and its own length in the extra field ``sl``."""
    deflate = zlib.compressobj(5, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    size = 24 + len(body) + 8
    fits = size < 1 << 32 and len(data) < 1 << 32
    extra = b"sl" + struct.pack("<HII", 8, size if fits else 0, len(data) if fits else 0)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


@dataclass
class Done(WriterCommitMessage):
    names: tuple[str, ...]


def _flag(options, name: str, default: str = "false") -> bool:
    return str(options.get(name, default)).lower() == "true"


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.options, self.filters = dict(options), []
        self.asked = {k[7:].lower(): v for k, v in self.options.items() if k.lower().startswith("header.")}

    def pushFilters(self, filters):
        for f in filters:
            if _test(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self):
        system, root = opened(self.options["path"])
        one = system.get_file_info(root)
        if one.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.options["path"])
        found = [one] if one.is_file else [x for x in system.get_file_info(fs.FileSelector(root, recursive=True)) if x.is_file]
        listed = [x for x in found if x.base_name.startswith("_manifest-")]
        if listed:
            names = {line for x in listed for line in system.open_input_stream(x.path).read().decode().split("\n")}
            found = [x for x in found if x.base_name in names]
        else:
            found = [x for x in found if one.is_file or x.base_name.endswith((".warc", ".warc.gz"))]
        split, out, held = int(self.options.get("split", SPLIT)), [], 0
        for x in sorted(found, key=lambda x: x.path):
            if not out or held + x.size > split:
                out.append([])
                held = 0
            out[-1].append(x.path)
            held += x.size
        return [Files(tuple(x)) for x in out]

    def read(self, partition):
        if not isinstance(partition, Files):
            return
        system, _ = opened(self.options["path"])
        tests = [_test(f) for f in self.filters]
        payloads, verify = _flag(self.options, "payload", "true"), _flag(self.options, "verify")

        def wanted(row, headers):
            return all(headers.get(k) == v for k, v in self.asked.items()) and all(t(row) for t in tests)

        rows, size = [], 0
        for path in partition.paths:
            with system.open_input_file(path) as file:
                for row in records(file, wanted, payloads, verify, path):
                    rows.append(row)
                    size += 500 + len(row["payload"] or b"")
                    if size >= BATCH:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.options = dict(options)

    def write(self, iterator):
        system, root = opened(self.options["path"])
        packed, roll = _flag(self.options, "gzip", "true"), int(self.options.get("roll", ROLL))
        system.create_dir(root, recursive=True)
        names, out, size = [], None, 0
        for batch in iterator:
            for i in range(batch.num_rows):
                if out is None or size >= roll:
                    if out:
                        out.close()
                    names.append(f"{uuid.uuid4().hex}.warc{'.gz' * packed}")
                    out, size = system.open_output_stream(f"{root}/{names[-1]}", compression=None), 0
                data = written({n: batch.column(j)[i].as_py() for j, n in enumerate(batch.schema.names)}, packed)
                out.write(data)
                size += len(data)
        if out:
            out.close()
        return Done(tuple(names))

    def commit(self, messages):
        system, root = opened(self.options["path"])
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/_manifest-{uuid.uuid4().hex}") as f:
            f.write("\n".join(n for m in messages if m for n in m.names).encode())

    def abort(self, messages):
        """Files of tasks that ended stay unlisted, so nobody reads them."""


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        if overwrite:
            raise ValueError("an archive is only appended to")
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    """``warc`` as a format of this session, with predicates pushed into it."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def base32(hexadecimal):
    """Base32 of 40 hexadecimal digits as a column expression: five digits make four."""
    parts = [F.lpad(F.conv(F.substr(hexadecimal, F.lit(5 * i + 1), F.lit(5)), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def archive(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write a record for each row of ``pages(page_id, url, html)``.

    Of rows whose payloads are equal and have ``min_bytes`` bytes or more, those
    with the smallest id are responses and the others revisit it; rows that
    repeat that id and payload are responses each.  Null html is an empty
    payload.  A null id revisits a row with an id, and is a response where its
    group has none; a null URL has no header.
    """
    register(pages.sparkSession)
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumns({"payload_bytes": F.length("payload").cast("long"), "sha": F.sha1("payload"), "key": F.sha2("payload", 256)})
    groups = stored(rows.where(F.col("payload_bytes") >= min_bytes).groupBy("key", "sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "sha", "first"))
    small = groups.count() * 256 <= BROADCAST
    told = rows.join(F.broadcast(groups) if small else groups, ["key", "sha"], "left")
    revisits = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    urn = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))
    told.select(
        urn.alias("record_id"),
        F.when(revisits, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.when(revisits, F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">"))).alias("refers_to"),
        "payload_bytes",
        base32(F.col("sha")).alias("payload_digest"),
        F.when(~revisits, F.col("payload")).alias("payload"),
    ).write.format("warc").mode("append").option("path", path).save()


def page_of(record_id):
    return F.regexp_extract(record_id, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` as read back from archives of ``pages``, each payload held against its digest."""
    spark = pages.sparkSession
    path = f"{shared_folder(spark)}/archives/{uuid.uuid4().hex}"
    archive(pages, path, min_bytes)
    back = spark.read.format("warc").option("verify", "true").load(path)
    return back.select(page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of(F.col("refers_to")).alias("refers_to"))
