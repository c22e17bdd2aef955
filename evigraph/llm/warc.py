"""WARC records in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames; a bundle ends with a seek table in a skippable frame (the format of Zstandard's
``contrib/seekable_format``), so any frame can be found from the file's end and read alone. The index maps a record's identifier to its
bundle, frame and place within the unpacked frame. A page's first row has an identifier made of its page_id; further rows of the same page_id and
rows without one have the row's number in it, so no two records share an identifier.

Of records with equal payloads of at least ``LEAST`` bytes the one with the smallest page_id is the response and the others are
revisits without payload, which name it. Only digests and ids are shuffled for that decision; digests that stand on several pages go to
all tasks if they are few, else pages are joined with them by digest.
"""

from __future__ import annotations

import hashlib
import struct
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm.common import filesystem, put_file, table_at, workdir

LEAST = 100
#: Unpacked bytes after which a frame is closed, and packed bytes after which a bundle is.
FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 64 << 20
#: Repeated digests up to which they are sent to all tasks.
SMALL = 1_000_000
INDEX = "page_id long, record_id string, bundle string, frame int, frame_at long, frame_size long, at long, size long"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1


def page_record(page_id: int) -> str:
    """The record identifier of a page: the one that revisits refer to."""
    return f"urn:evigraph:page:{page_id}"


def record(record_id: str, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit whose HTTP head gives the payload's length."""
    uri = "" if url is None else "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    kind = "response" if refers_to is None else "revisit"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{record_id}>",
        f"WARC-Target-URI: {uri}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head[2:2] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{page_record(refers_to)}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC head, HTTP head, payload) of one record; its length must agree."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines)
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("the record's length differs")
    http, _, payload = rest[:n].partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


class BundleWriter:
    """Collects records into frames and the frames of one bundle."""

    def __init__(self, level: int = 3, frame_bytes: int = FRAME_BYTES):
        import zstandard

        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.limit, self.open, self.open_size = frame_bytes, [], 0
        self.frames: list[bytes] = []
        self.table: list[tuple[int, int]] = []
        self.size = 0

    def add(self, raw: bytes) -> tuple[int, int, int]:
        """(frame, place in it, size) of the record."""
        at = (len(self.table), self.open_size, len(raw))
        self.open.append(raw)
        self.open_size += len(raw)
        if self.open_size >= self.limit:
            self.close_frame()
        return at

    def close_frame(self) -> None:
        if self.open:
            frame = self.pack.compress(b"".join(self.open))
            self.frames.append(frame)
            self.table.append((len(frame), self.open_size))
            self.size += len(frame)
            self.open, self.open_size = [], 0

    def finished(self) -> list[bytes]:
        """The bundle's parts with the seek table."""
        self.close_frame()
        body = b"".join(struct.pack("<II", *x) for x in self.table) + struct.pack("<IBI", len(self.table), 0, _SEEKABLE)
        return [*self.frames, struct.pack("<II", _SKIPPABLE, len(body)), body]


class BundleReader:
    """Reads single frames of a bundle by its seek table."""

    def __init__(self, uri: str):
        import zstandard

        where, path = filesystem(uri)
        self.file = where.open_input_file(path)
        size = self.file.size()
        self.file.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", self.file.read(9))
        if magic != _SEEKABLE:
            raise ValueError("no seek table")
        each = 12 if flags & 0x80 else 8
        self.file.seek(size - 9 - n * each)
        raw = self.file.read(n * each)
        self.table, at = [], 0
        for k in range(n):
            packed, unpacked = struct.unpack_from("<II", raw, k * each)
            self.table.append((at, packed, unpacked))
            at += packed
        self.unpack = zstandard.ZstdDecompressor()

    @lru_cache(maxsize=4)  # noqa: B019  readers live as long as a task
    def frame(self, k: int) -> bytes:
        at, packed, unpacked = self.table[k]
        self.file.seek(at)
        out = self.unpack.decompress(self.file.read(packed))
        if len(out) != unpacked:
            raise ValueError("a frame's size differs from the seek table")
        return out

    def record(self, k: int, at: int, size: int) -> bytes:
        return self.frame(k)[at : at + size]


def marked(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)`` as page_id, record_id, url, payload, digest and refers_to (null for responses).

    Null html is an empty payload. Rows with a null page_id are responses and nothing refers to them; repeated rows of the smallest
    page_id are responses too.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.monotonically_increasing_id().alias("row")).withColumn("digest", F.sha2("payload", 256))
    named = rows.where("page_id is not null").where(F.octet_length("payload") >= LEAST)
    first = named.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("of"), "first")
    first = table_at(first, workdir(pages.sparkSession, "repeats"))
    few = first.count() <= SMALL
    out = rows.join(F.broadcast(first) if few else first, F.col("digest") == F.col("of"), "left")
    again = rows.where("page_id is not null").groupBy("page_id").agg(F.min("row").alias("head"), F.count("*").alias("n")).where("n > 1").select(F.col("page_id").alias("again"), "head")
    again = table_at(again, workdir(pages.sparkSession, "again"))
    out = out.join(F.broadcast(again) if again.count() <= SMALL else again, F.col("page_id") == F.col("again"), "left")
    page = F.concat(F.lit("urn:evigraph:page:"), F.col("page_id").cast("string"))
    name = F.when(F.col("page_id").isNull(), F.concat(F.lit("urn:evigraph:row:"), F.col("row").cast("string"))).when(F.col("head") != F.col("row"), F.concat(page, F.lit(":row:"), F.col("row").cast("string"))).otherwise(page)
    return out.select("page_id", name.alias("record_id"), "url", "payload", "digest", F.when(F.col("first") < F.col("page_id"), F.col("first")).alias("refers_to"))


def write_bundles(rows: DataFrame, where: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write the records of :func:`marked` rows below the shared folder ``where``; returns the index, a written table.

    Each task writes bundles of its own by temporary names, so a repeated task only leaves further files that no index names.
    """
    import pyarrow as pa

    def run(batches):
        import uuid

        bundle, held = BundleWriter(frame_bytes=frame_bytes), []

        def close():
            nonlocal bundle, held
            uri = f"{where}/bundles/{uuid.uuid4().hex}.warc.zst"
            put_file(uri, bundle.finished())
            starts, at = [], 0
            for packed, _ in bundle.table:
                starts.append(at)
                at += packed
            cols = list(zip(*((p, r, uri, k, starts[k], bundle.table[k][0], a, n) for p, r, (k, a, n) in held), strict=True))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in INDEX.split(", ")])
            bundle, held = BundleWriter(frame_bytes=frame_bytes), []
            return out

        for batch in batches:
            cols = [batch.column(c) for c in range(6)]
            for k in range(batch.num_rows):
                page, name, url, digest, refers = (cols[c][k].as_py() for c in (0, 1, 2, 4, 5))
                held.append((page, name, bundle.add(record(name, url, cols[3][k].as_py(), digest, refers))))
                if bundle.size >= bundle_bytes:
                    yield close()
        if held:
            yield close()

    return table_at(rows.mapInArrow(run, INDEX), f"{where}/index")


def read_records(index: DataFrame) -> DataFrame:
    """Read the records of an index back from their bundles, in the order of the index's partitions, and describe each payload.

    A response's digest is computed anew and must agree with its head; a revisit has what its head says.
    """
    import pyarrow as pa

    def run(batches):
        uri, reader = None, None
        for batch in batches:
            out = []
            for page, name, bundle, frame, at, size in zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, 3, 6, 7)), strict=True):
                if bundle != uri:
                    uri, reader = bundle, BundleReader(bundle)
                head, http, payload = parsed(reader.record(frame, at, size))
                digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                if head["WARC-Record-ID"] != f"<{name}>":
                    raise ValueError(f"another record stands where {name} should")
                if head["WARC-Type"] == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != int(http["Content-Length"])):
                    raise ValueError(f"the payload of page {page} differs")
                refers = head.get("WARC-Refers-To")
                out.append((page, int(http["Content-Length"]), digest, head["WARC-Type"], int(refers.rpartition(":")[2][:-1]) if refers else None))
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in READ.split(", ")])

    return index.mapInArrow(run, READ)


def find_records(index: DataFrame, record_ids: list[str]) -> DataFrame:
    """The records with these identifiers (page_id, record_id, raw bytes), read by their frames alone."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            raw = [BundleReader(b).record(k, at, n) for b, k, at, n in zip(*(batch.column(c).to_pylist() for c in (2, 3, 6, 7)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(raw, pa.binary())], names=["page_id", "record_id", "raw"])

    return index.where(F.col("record_id").isin(*record_ids)).mapInArrow(run, "page_id long, record_id string, raw binary")


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Write all of ``pages(page_id, url, html)`` and read the archives back; no rows give no rows."""
    where = workdir(pages.sparkSession, "warc")
    return read_records(write_bundles(marked(pages), where))
