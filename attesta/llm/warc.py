"""WARC archives with a two-level capture index.

Tasks write records (one gzip member each) to files of their own in the shared folder and return one capture row per
record. The rows are sorted by reversed-host URL key over the cluster; each task writes its run as compressed blocks of
``LINES`` index lines and returns one directory row per block. A lookup sorts its keys the same way: a task reads the
part of the directory that its keys span, finds a key's block by binary search, reads that block's range, searches the
lines, and reads the record's range. Files of a task that is run again have new names; only rows of the attempt that
succeeded reach the index, so a lost executor leaves at most files that nothing refers to.

The key ends in the page id, so one URL with very many captures spreads over tasks like any other rows.

Defined cases: a null payload is empty; a null URL has an empty key; of equal payloads of ``least`` bytes or more, the
rows with the smallest id are responses and the others revisit it; rows without an id revisit it too, and are responses
where no id is known; repeated rows are repeated records; empty tables give empty archives; other columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm.common import stored
from attesta.session import shared_folder

LINES = 3_000
FILE_BYTES = 1 << 30
LEVEL = 5
# fixed values: names of the WARC 1.1 format
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Archive:
    """Where an archive is: its record files, its index files, and the table of index blocks."""

    folder: str
    directory: str


def url_key(url: str, page_id: str) -> Column:
    """Reversed host, path and query, then the id; blanks and control characters cannot split a line."""
    text = F.coalesce(F.col(url), F.lit(""))
    host = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)"
    turned = F.array_join(F.reverse(F.split(F.lower(F.regexp_extract(text, host, 1)), r"\.")), ",")
    key = F.when(text.rlike(host), F.concat(turned, F.lit(")"), F.regexp_replace(text, host, ""))).otherwise(text)
    place = F.coalesce(F.lpad((F.col(page_id).cast("decimal(20,0)") + F.lit(str(2**63)).cast("decimal(20,0)")).cast("string"), 20, "0"), F.lit("-"))
    return F.concat(F.regexp_replace(key, r"[\x00-\x20\x7F]", "%20"), F.lit(" "), place)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = [VERSION, f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields), f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes, level: int = LEVEL) -> bytes:
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def _captures(pages: DataFrame, least: int) -> DataFrame:
    """``(page_id, url, key, payload, refers_to)``: a revisit names the response with the same payload."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", url_key("url", "page_id").alias("key"),
        F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("sha", F.sha1("payload"))
    shared = (
        rows.filter(F.octet_length("payload") >= least).groupBy("sha")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("sha").alias("_sha"), "first")
    )
    joined = rows.join(stored(shared, "warc-shared"), F.col("sha") == F.col("_sha"), "left")
    other = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "key", "payload", F.when(other, F.col("first")).alias("refers_to"))


def _record_of(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> tuple[bytes, str]:
    digest = base32_sha1(payload)
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    fields = [
        ("WARC-Record-ID", f"<urn:capture:{'none' if page_id is None else page_id}>"), ("WARC-Target-URI", target), ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Payload-Length", str(len(payload))),
    ]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    content = ("Content-Type", "application/http; msgtype=response")
    if refers_to is None:
        return record("response", [*fields, content], http + payload), digest
    revisit = [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:capture:{refers_to}>"), content]
    return record("revisit", [*fields, *revisit], http), digest


def _written(captures: DataFrame, folder: str, date: str) -> DataFrame:
    """Writes the records; one row ``(key, line)`` per record, the line as the index keeps it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(folder)
        out, name, at = None, "", 0
        for batch in batches:
            keys, lines = [], []
            columns = (batch.column(c).to_pylist() for c in ("page_id", "url", "key", "payload", "refers_to"))
            for page_id, url, key, payload, refers_to in zip(*columns, strict=True):
                if out is None or at >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"records-{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                    info = _member(record("warcinfo", [("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                    out.write(info)
                    at = len(info)
                data, digest = _record_of(page_id, url, payload, refers_to, date)
                packed = _member(data)
                out.write(packed)
                keys.append(key)
                lines.append(json.dumps({"id": page_id, "url": url, "digest": digest, "file": name, "offset": at, "length": len(packed)}, ensure_ascii=True))
                at += len(packed)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(lines, pa.string())], names=["key", "line"])
        if out is not None:
            out.close()

    return captures.mapInArrow(run, "key string, line string")


DIRECTORY = "first_key string, last_key string, file string, offset long, length long, lines long"


def _indexed(lines: DataFrame, folder: str, size: int) -> DataFrame:
    """Sorted lines as compressed blocks; one directory row per block. A key's order is that of its UTF-8 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(folder)
        name, at = f"index-{uuid.uuid4().hex}.gz", 0
        out, held = None, []

        def block() -> dict:
            nonlocal at, out
            if out is None:
                out = store.open_output_stream(f"{base}/{name}", compression=None)
            data = _member("".join(f"{k} {line}\n" for k, line in held).encode())
            out.write(data)
            row = {"first_key": held[0][0], "last_key": held[-1][0], "file": name, "offset": at, "length": len(data), "lines": len(held)}
            at += len(data)
            held.clear()
            return row

        for batch in batches:
            rows = []
            for pair in zip(batch.column("key").to_pylist(), batch.column("line").to_pylist(), strict=True):
                held.append(pair)
                if len(held) >= size:
                    rows.append(block())
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_DIRECTORY)
        if held:
            yield pa.RecordBatch.from_pylist([block()], schema=_DIRECTORY)
        if out is not None:
            out.close()

    return lines.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(run, DIRECTORY)


_DIRECTORY = pa.schema([("first_key", pa.string()), ("last_key", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("lines", pa.int64())])


def write_archive(pages: DataFrame, least: int = 0, lines: int = LINES, date: str = "1970-01-01T00:00:00Z") -> Archive:
    """Writes ``pages(page_id, url, html)`` as WARC files with their index below the shared folder."""
    folder = shared_folder(pages.sparkSession, "warc")
    store, base = _open(folder)
    store.create_dir(base, recursive=True)
    rows = stored(_written(_captures(pages, least), folder, date), "warc-captures")
    directory = shared_folder(pages.sparkSession, "warc-directory")
    _indexed(rows, folder, lines).write.parquet(directory)
    return Archive(folder, directory)


class _Reader:
    """Range reads over the files of an archive, with the last files kept open."""

    def __init__(self, folder: str, most: int = 32) -> None:
        self.store, self.base = _open(folder)
        self.most, self.files = most, OrderedDict()

    def range(self, name: str, offset: int, length: int) -> bytes:
        if name not in self.files:
            if len(self.files) >= self.most:
                self.files.popitem(last=False)[1].close()
            self.files[name] = self.store.open_input_file(f"{self.base}/{name}")
        self.files.move_to_end(name)
        handle = self.files[name]
        handle.seek(offset)
        return zlib.decompress(handle.read(length), 31)


def read_record(data: bytes) -> dict:
    """Headers and payload of one record; a revisit has no payload of its own."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    return {**fields, "payload": block.partition(b"\r\n\r\n")[2]}


def _directory(path: str, low: str, high: str):
    """The directory rows that may hold keys between two keys, by row-group statistics."""
    import pyarrow.compute as pc
    import pyarrow.dataset as ds

    store, base = _open(path)
    rows = ds.dataset(base, filesystem=store, format="parquet", schema=_DIRECTORY)
    near = rows.to_table(filter=(pc.field("last_key") >= low) & (pc.field("first_key") <= high))
    return near.sort_by([("first_key", "ascending"), ("last_key", "ascending")]).to_pylist()


def lookup(keys: DataFrame, archive: Archive) -> DataFrame:
    """All captures of the given distinct ``key`` values, read from the record files.

    Of a record the stored payload is checked against the digest that its header and its index line state.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(archive.folder)
        opened: tuple[int, list[str], list[str]] = (-1, [], [])
        for batch in batches:
            wanted = batch.column("key").to_pylist()
            if not wanted:
                continue
            blocks = _directory(archive.directory, wanted[0], wanted[-1])
            lasts = [b["last_key"].encode() for b in blocks]
            opened = (-1, [], [])
            out = []
            for key in wanted:
                raw = key.encode()
                at = bisect.bisect_left(lasts, raw)
                while at < len(blocks) and blocks[at]["first_key"].encode() <= raw:
                    if opened[0] != at:
                        text = reader.range(blocks[at]["file"], blocks[at]["offset"], blocks[at]["length"]).decode()
                        pairs = [_pair(line) for line in text.split("\n")[:-1]]
                        opened = (at, [k.encode() for k, _ in pairs], [x for _, x in pairs])
                    i = bisect.bisect_left(opened[1], raw)
                    while i < len(opened[1]) and opened[1][i] == raw:
                        out.append(_row(key, json.loads(opened[2][i]), reader))
                        i += 1
                    at += 1
            yield pa.RecordBatch.from_pylist(out, schema=_FOUND)

    # a stated number: a key is a few bytes, yet each stands for the reading of a record, so small partitions stay apart
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keys.select("key").distinct().repartitionByRange(parts, "key").sortWithinPartitions("key").mapInArrow(run, FOUND)


def _pair(line: str) -> tuple[str, str]:
    surt, place, rest = line.split(" ", 2)
    return f"{surt} {place}", rest


FOUND = "key string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
_FOUND = pa.schema(
    [("key", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
     ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]
)


def _row(key: str, line: dict, reader: _Reader) -> dict:
    found = read_record(reader.range(line["file"], line["offset"], line["length"]))
    kind, digest = found["WARC-Type"], found["WARC-Payload-Digest"].removeprefix("sha1:")
    if digest != line["digest"] or kind == "response" and base32_sha1(found["payload"]) != digest:
        raise ValueError(f"record at {line['file']}:{line['offset']} does not match its digest")
    name = lambda field: None if "none" in found[field] else int(found[field].rstrip(">").rpartition(":")[2])
    return {
        "key": key, "page_id": name("WARC-Record-ID"), "url": line["url"], "record_type": kind,
        "refers_to": name("WARC-Refers-To") if kind == "revisit" else None,
        "payload_bytes": int(found["WARC-Payload-Length"]), "payload_digest": digest, "payload": found["payload"] if kind == "response" else None,
    }


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes an archive and reads every capture back through its index."""
    archive = write_archive(pages)
    return lookup(pages.select(url_key("url", "page_id").alias("key")), archive)
