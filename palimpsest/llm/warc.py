"""Web pages as WARC 1.1 archives: written in page order by a deterministic sharded writer, and read back.

Records are dealt by ranges of page_id and sorted within them, so files follow each other in page order. Every record is a
gzip member of its own with headers and digests made anew, and every file begins with a warcinfo record; a file is rolled when
its compressed size reaches a bound. Files are written under temporary names and renamed when whole; what counts is the
manifest, which Spark commits last."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import shared

MANIFEST = "part long, seq long, path string, n_records long, n_bytes long, first_page long, last_page long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Fixed, so that equal tables give equal files.
DATE = "2020-01-01T00:00:00Z"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122's name space of URLs


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(url: str) -> str:
    """White space and control characters would break a header."""
    return re.sub(r"[\x00-\x20\x7f-\x9f  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)


def _member(head: list[tuple[str, str]], block: bytes, compress: int) -> bytes:
    head = [*head, ("Content-Length", str(len(block)))]
    return gzip.compress("WARC/1.1\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n", compress, mtime=0)


def information(name: str, compress: int = 6) -> bytes:
    """The warcinfo record of a file."""
    block = b"software: palimpsest\r\nformat: WARC File Format 1.1\r\n"
    head = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(SPACE, name)}>"), ("WARC-Date", DATE), ("WARC-Filename", name), ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Type", "application/warc-fields")]
    return _member(head, block, compress)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, copy: int = 0, compress: int = 6) -> bytes:
    """A gzip member: a response, or a revisit where refers_to is given. copy numbers rows alike in page and payload. A page
    without a url gets a name of its own, as these records must have one, and a header that says so."""
    sha = digest(payload)
    name = lambda page, n: f"<urn:uuid:{uuid.uuid5(SPACE, f'{page}/{sha}/{n}')}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", name(page_id, copy)), ("WARC-Date", DATE)]
    head += [("WARC-Target-URI", _uri(url))] if url is not None else [("WARC-Target-URI", f"urn:page:{'none' if page_id is None else page_id}"), ("X-No-Url", "true")]
    head += [("WARC-Payload-Digest", f"sha1:{sha}"), ("WARC-Block-Digest", f"sha1:{digest(block)}")]
    if refers_to is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", name(refers_to, 0)), ("X-Refers-To-Page", str(refers_to))]
    if page_id is not None:
        head.append(("X-Page", str(page_id)))
    head += [("X-Payload-Length", str(len(payload))), ("Content-Type", "application/http;msgtype=response")]
    return _member(head, block, compress)


class _Files:
    """The files of one task."""

    def __init__(self, folder: str, part: int, roll_bytes: int):
        self.folder, self.part, self.roll, self.seq, self.out = folder, part, roll_bytes, 0, None
        self.fs, self.path = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.path, recursive=True)

    def add(self, page_id: int | None, member: bytes) -> dict | None:
        if self.out is None:
            self.temp = f"{self.path}/.{uuid.uuid4().hex}.tmp"
            self.name = f"records-{self.part:06d}-{self.seq:06d}.warc.gz"  # any attempt writes the same bytes
            self.out, self.records, self.first, self.last = self.fs.open_output_stream(self.temp, compression=None), 0, page_id, page_id
            self.bytes = self.out.write(information(self.name))
        self.out.write(member)
        self.records, self.bytes = self.records + 1, self.bytes + len(member)
        self.first = page_id if self.first is None else self.first
        self.last = page_id if page_id is not None else self.last
        return self.close() if self.bytes >= self.roll else None

    def close(self) -> dict | None:
        if self.out is None:
            return None
        self.out.close()
        self.out = None
        self.fs.move(self.temp, f"{self.path}/{self.name}")
        self.seq += 1
        return {"part": self.part, "seq": self.seq - 1, "path": f"{self.folder}/{self.name}", "n_records": self.records, "n_bytes": self.bytes, "first_page": self.first, "last_page": self.last}


def _writer(folder: str, roll_bytes: int, compress: int):
    schema = pa.schema([(n, pa.string() if k == "string" else pa.int64()) for n, k in (x.split() for x in MANIFEST.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files(folder, TaskContext.get().partitionId(), roll_bytes)
        key, first, seen = object(), None, 0
        for part, pages in shared.chunks(batches, "html"):
            done = []
            for page, sha, kind, url, refers, payload in zip(*(part.column(i).to_pylist() for i in range(4)), part.column("refers").to_pylist(), pages, strict=True):
                if (page, sha) != key:
                    key, first, seen = (page, sha), None, 0
                if kind == 0:
                    first = refers
                    continue
                to = None if first is None or first == page and not seen else first
                done.append(files.add(page, record(page, url, payload.as_py().encode(), to, seen, compress)))
                seen += 1
            if done := [d for d in done if d]:
                yield pa.RecordBatch.from_pylist(done, schema)
        if last := files.close():
            yield pa.RecordBatch.from_pylist([last], schema)

    return run


def write(pages: DataFrame, folder: str, *, least_bytes: int = 0, roll_bytes: int = 64 << 20, compress: int = 6, page_id: str = "page_id", url: str = "url", content: str = "html") -> DataFrame:
    """Writes every row as a record and returns the manifest, a row for each file in the order (part, seq).

    Of records with equal payloads of least_bytes or more, that with the smallest page_id is a response and the others
    revisit it; smaller ones are all responses. Defined results: a null page is an empty payload; of rows alike in page_id
    and payload the first is the response and the others revisit it; rows without page_id come first, revisit a page that
    has one, and are all responses if none has; a null url is read back as null; an empty table gives an empty manifest; other
    columns are ignored. folder: a URI that executors reach."""
    shared.bounded_batches(pages.sparkSession)
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.coalesce(F.col(content).cast("string"), F.lit("")).alias("html"), F.col(url).cast("string").alias("url"))
    rows = rows.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    large = rows.where(F.octet_length("html") >= least_bytes).select("page_id", "sha")
    twins = large.groupBy("sha").agg(F.min("page_id").alias("refers"), F.count("*").alias("n")).where("n > 1 and refers is not null").drop("n")
    # who revisits whom travels to the record's place as a small row of its own, so pages are dealt out once
    told = large.join(twins, "sha").select("page_id", "sha", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit("").alias("html"), "refers").distinct()
    both = rows.select("page_id", "sha", F.lit(1).alias("kind"), "url", "html", F.lit(None).cast("long").alias("refers")).unionByName(told)
    sorted_rows = both.repartitionByRange("page_id").sortWithinPartitions("page_id", "sha", "kind", "url")
    return shared.written(sorted_rows.mapInArrow(_writer(f"{folder}/files", roll_bytes, compress), MANIFEST), folder, "manifest")


def members(stream) -> Iterator[bytes]:
    """The gzip members of a file, each decompressed."""
    left = b""
    while True:
        left = left or stream.read(1 << 20)
        if not left:
            return
        member, body = zlib.decompressobj(31), []
        while not member.eof:
            if not left:
                left = stream.read(1 << 20)
                if not left:
                    raise ValueError("a member is cut off")
            body.append(member.decompress(left))
            left = member.unused_data
        yield b"".join(body)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers, and the payload ('' in a revisit); digests and lengths are verified."""
    head, _, rest = member.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError(f"no WARC record: {version[:40]!r}")
    headers = dict(x.split(": ", 1) for x in lines)
    block, tail = rest[: int(headers["Content-Length"])], rest[int(headers["Content-Length"]) :]
    payload = block.partition(b"\r\n\r\n")[2]
    response = headers["WARC-Type"] == "response"
    if tail != b"\r\n\r\n" or headers["WARC-Block-Digest"] != f"sha1:{digest(block)}" or response and (headers["WARC-Payload-Digest"] != f"sha1:{digest(payload)}" or len(payload) != int(headers["X-Payload-Length"])):
        raise ValueError(f"damaged record {headers.get('WARC-Record-ID')}")
    return headers, payload


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(n, pa.string() if k == "string" else pa.int64()) for n, k in (x.split() for x in RECORDS.split(", "))])
    number = lambda x: None if x is None else int(x)
    for batch in batches:
        for path in batch.column(0).to_pylist():
            fs, at = pafs.FileSystem.from_uri(path)
            rows = []
            with fs.open_input_stream(at, compression=None) as f:
                for member in members(f):
                    h, _ = parse(member)
                    if h["WARC-Type"] == "warcinfo":
                        continue
                    rows.append({"page_id": number(h.get("X-Page")), "url": None if "X-No-Url" in h else h["WARC-Target-URI"], "payload_bytes": int(h["X-Payload-Length"]), "payload_digest": h["WARC-Payload-Digest"].removeprefix("sha1:"), "record_type": h["WARC-Type"], "refers_to": number(h.get("X-Refers-To-Page"))})
                    if len(rows) == 5000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)


def read(manifest: DataFrame) -> DataFrame:
    """A row for every record of the manifest's files, its digests verified."""
    shared.bounded_batches(manifest.sparkSession)
    return manifest.select("path").repartition("path").mapInArrow(_reader, RECORDS)
