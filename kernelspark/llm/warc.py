"""WARC archives as seekable Zstandard bundles (operator 4).

A bundle is a file of independent Zstandard frames, each a group of whole WARC
records of about FRAME bytes, followed by a seek table in a skippable frame (the
seekable format: magic 0x184D2A5E, an entry of two 32-bit sizes a frame, footer
with the number of frames, a descriptor byte and magic 0x8F92EAB1).  A frame of
more than 4 GB would not fit its entry, so a record larger than FRAME is a frame
of its own.  Beside it, ``*.idx.parquet`` maps record ids to (frame, offset in
the frame, length), so that one record costs one frame.

Payloads that occur more than once are stored once: the record with the
smallest page_id is the response, the others are revisits that name it.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kernelspark.llm._util import new_dir
from kernelspark.llm.tokenbin import filesystem

FRAME = 1 << 20
SKIP_MAGIC, SEEK_MAGIC = 0x184D2A5E, 0x8F92EAB1
#: One date in every record: archives of the same pages are the same bytes.
DATE = "2000-01-01T00:00:00Z"
SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()  # noqa: S324  the format asks for SHA-1


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """One WARC record; a revisit has the full payload's digest and length in its header, and no payload."""
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": " ".join((url or "").split()),
        "WARC-Payload-Digest": f"sha1:{digest(payload)}",
        "X-Payload-Length": str(len(payload)),
    }
    if revisit:
        head |= {"WARC-Refers-To": f"<urn:page:{refers_to}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
    body = b"" if revisit else payload
    head["Content-Length"] = str(len(body))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + body + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(header, block, end) of the record that begins at ``at``."""
    if data[at : at + 10] != b"WARC/1.1\r\n":
        raise ValueError("no WARC record here")
    end = data.index(b"\r\n\r\n", at)
    head = dict(line.split(": ", 1) for line in data[at + 10 : end].decode().split("\r\n"))
    body, n = end + 4, int(head["Content-Length"])
    return head, data[body : body + n], body + n + 4


class Writer:
    """Writes records to a seekable bundle; ``index`` has (record id, frame, offset, length) of each."""

    def __init__(self, out, level: int = 3, frame: int = FRAME):
        import zstandard

        self.out, self.frame, self.compress = out, frame, zstandard.ZstdCompressor(level=level).compress
        self.waiting, self.size, self.frames, self.index = [], 0, [], []

    def add(self, record_id: int | None, data: bytes) -> None:
        if self.size and self.size + len(data) > self.frame:
            self.flush()
        self.index.append((record_id, len(self.frames), self.size, len(data)))
        self.waiting.append(data)
        self.size += len(data)

    def flush(self) -> None:
        if self.waiting:
            packed = self.compress(b"".join(self.waiting))
            self.out.write(packed)
            self.frames.append((len(packed), self.size))
            self.waiting, self.size = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIP_MAGIC, len(table)) + table)
        self.out.close()


class Bundle:
    """Random access to a bundle: frames by the seek table, records by id."""

    def __init__(self, at: str, name: str):
        fs, base = filesystem(at)
        self.fs, self.base, self.name = fs, base, name
        self.file = fs.open_input_file(f"{base}/{name}.warc.zst")
        size = self.file.size()
        n, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEK_MAGIC:
            raise ValueError(f"{name} has no seek table")
        table, at_ = self.file.read_at(8 * n, size - 9 - 8 * n), 0
        self.frames = []
        for packed, plain in struct.iter_unpack("<II", table):
            self.frames.append((at_, packed, plain))
            at_ += packed

    def frame(self, k: int) -> bytes:
        import zstandard

        start, packed, plain = self.frames[k]
        return zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, start), max_output_size=plain)

    def records(self) -> Iterator[tuple[dict[str, str], bytes]]:
        for k in range(len(self.frames)):
            data, at = self.frame(k), 0
            while at < len(data):
                head, body, at = parse(data, at)
                yield head, body

    def find(self, page_id: int) -> Iterator[tuple[dict[str, str], bytes]]:
        """The records with this id, by the index: only their frames are read."""
        import pyarrow.parquet as pq

        with self.fs.open_input_file(f"{self.base}/{self.name}.idx.parquet") as f:
            for r in pq.read_table(f, filters=[("record_id", "=", page_id)]).to_pylist():
                head, body, _ = parse(self.frame(r["frame"]), r["offset"])
                yield head, body


def with_first(pages: DataFrame) -> DataFrame:
    """(page_id, url, html as bytes, first): first is the smallest page_id with the same payload where there are several such pages, else null."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("html"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("html")))
    same = rows.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    return rows.join(same, "digest", "left").select("page_id", "url", "html", "first")


def write(pages: DataFrame, at: str, least: int = 0, level: int = 3) -> DataFrame:
    """Write pages (page_id, url, html) as bundles below ``at``; the table of bundles (at, name, records)."""

    def bundle(batches):
        import pyarrow.parquet as pq
        from pyspark import TaskContext

        context, writer = TaskContext.get(), None
        name = f"pages-{context.partitionId():06d}-{context.taskAttemptId()}"
        for batch in batches:
            for page, url, html, first in zip(*(batch.column(c) for c in ("page_id", "url", "html", "first")), strict=True):
                if writer is None:
                    fs, base = filesystem(at)
                    fs.create_dir(base, recursive=True)
                    writer = Writer(fs.open_output_stream(f"{base}/{name}.warc.zst", compression=None), level)
                page, first, payload = page.as_py(), first.as_py(), html.as_py()
                revisit = first is not None and first != page and len(payload) >= least
                writer.add(page, record(page, url.as_py(), payload, first, revisit))
        if writer is not None:
            writer.close()
            cols = zip(*writer.index, strict=True)
            with fs.open_output_stream(f"{base}/{name}.idx.parquet") as out:
                pq.write_table(pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["record_id", "frame", "offset", "length"]), out)
            yield pa.RecordBatch.from_pydict({"at": [at], "name": [name], "records": pa.array([len(writer.index)], pa.int64())})

    schema, table = "at string, name string, records long", f"{at}/bundles"
    with_first(pages).mapInArrow(bundle, schema).write.parquet(table)
    return pages.sparkSession.read.schema(schema).parquet(table)


def read(bundles: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record, from the files.

    A response's length and digest are taken of its stored payload and held
    against its header; a revisit's come from its header.
    """

    def number(urn: str) -> int | None:
        x = urn.removeprefix("<urn:page:").removesuffix(">")
        return int(x) if x else None

    def scan(batches):
        for batch in batches:
            for at, name in zip(batch.column("at").to_pylist(), batch.column("name").to_pylist(), strict=True):
                out = []
                for head, body in Bundle(at, name).records():
                    kind, n, sha = head["WARC-Type"], int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and (len(body) != n or digest(body) != sha):
                        raise ValueError(f"{name}: the payload of {head['WARC-Record-ID']} is damaged")
                    out.append((number(head["WARC-Record-ID"]), n, sha, kind, number(head["WARC-Refers-To"]) if kind == "revisit" else None))
                    if len(out) == 5000:
                        yield made(out)
                        out = []
                if out:
                    yield made(out)

    def made(rows):
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    n = max(1, min(bundles.count(), 4 * bundles.sparkSession.sparkContext.defaultParallelism))
    return bundles.repartition(n).mapInArrow(scan, SCHEMA)


def archive(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write pages to bundles in a new shared folder and read them back, a row for each page.

    Null html is an empty payload.  Of equal payloads of at least ``least``
    bytes the rows with the smallest page_id are responses (all of them, where
    that id repeats), the others revisits; pages without id refer to it too,
    and are responses where no page of the payload has an id.  White space in a
    url becomes one space in the header.  An empty table gives no files and no
    rows.  Other columns are not read.
    """
    return read(write(pages, new_dir(pages.sparkSession, "warc"), least))


def decompress_all(data: bytes) -> bytes:
    """A whole bundle as any Zstandard reader sees it: frames joined, the seek table skipped."""
    import zstandard

    return zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()


ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM {pages}),
d AS (SELECT page_id, strlen(html) AS n, sha1(html) AS h FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM d),
b AS (SELECT *, array_to_string(list_transform(range(0, 40), lambda i: CASE WHEN substr(h, i + 1, 1) BETWEEN '0' AND '9' THEN ascii(substr(h, i + 1, 1)) - 48 ELSE ascii(substr(h, i + 1, 1)) - 87 END), ',') AS x,
  list_transform(range(0, 40), lambda i: CASE WHEN substr(h, i + 1, 1) BETWEEN '0' AND '9' THEN ascii(substr(h, i + 1, 1)) - 48 ELSE ascii(substr(h, i + 1, 1)) - 87 END) AS q FROM f)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((q[(j * 5 // 4) + 1] * 16 + coalesce(q[(j * 5 // 4) + 2], 0)) >> (3 - (j * 5) % 4)) & 31)::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN first IS NOT NULL AND first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS NOT NULL AND first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM b
"""
