"""Interleaved document sequences: ordered text and media references of HTML pages, joined with payloads by digest.

A page is parsed to an array of parts in page order; a part is a text or a media reference with its digest and caption. Payloads are
kept once for each digest, losslessly, as 8-bit grey PNG images 64 samples wide, and are decoded and described before the join, so
that only small feature rows meet the references: a payload that a third of all references name costs one row on its side.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 64
PARTS = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"
FEATURES = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_PNG = b"\x89PNG\r\n\x1a\n"
#: Digests that an encoding task remembers.
MEMORY = 200_000
_PREFIX = "sha256:"
_BLOCK = {"p", "div", "article", "section", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "table", "tr", "td", "blockquote", "pre", "figure", "figcaption", "body", "html"}


def padded(raw: bytes) -> bytes:
    """``raw`` with zero bytes up to a positive multiple of WIDTH."""
    return raw + b"\0" * (max(WIDTH, -(-len(raw) // WIDTH) * WIDTH) - len(raw))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(payload: bytes, level: int = 6) -> bytes:
    """The PNG file whose samples, row by row, are the payload's bytes; its length must be a positive multiple of WIDTH."""
    rows = len(payload) // WIDTH
    if not rows or len(payload) % WIDTH:
        raise ValueError(f"a payload of {len(payload)} bytes doesn't fill rows of {WIDTH}")
    lines = np.zeros((rows, WIDTH + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)
    return _PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def decode(media: bytes) -> np.ndarray:
    """The samples (rows by WIDTH) of a file that :func:`encode` wrote; check sums are verified."""
    if media[:8] != _PNG:
        raise ValueError("not a PNG file")
    at, data, shape = 8, [], None
    while at < len(media):
        n, kind = struct.unpack(">I4s", media[at : at + 8])
        body = media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a chunk's check sum differs")
        if kind == b"IHDR":
            w, h, depth, colour, *rest = struct.unpack(">IIBBBBB", body)
            if (depth, colour, *rest) != (8, 0, 0, 0, 0):
                raise ValueError("not 8-bit grey without interlace")
            shape = (h, w)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(shape[0], shape[1] + 1)
    if lines[:, 0].any():
        raise ValueError("rows are filtered")
    return lines[:, 1:]


def feature(samples: np.ndarray) -> str:
    """Size, mean, deviation, entropy, a 16-bin histogram in thousandths, and a 64-bit average hash of an image."""
    flat = samples.ravel()
    hist = np.bincount(flat, minlength=256)
    total = len(flat)
    level = np.arange(256)
    mean = float(hist @ level) / total
    std = float(np.sqrt(max(0.0, float(hist @ level**2) / total - mean * mean)))
    p = hist[hist > 0] / total
    edges = np.arange(9) * samples.shape[0] // 8
    cells = [float(samples[edges[r] : max(edges[r + 1], edges[r] + 1), 8 * c : 8 * c + 8].mean()) if edges[r] < samples.shape[0] else 0.0 for r in range(8) for c in range(8)]
    bits = sum(1 << k for k, x in enumerate(cells) if x > mean)
    shares = "-".join(str(int(x) * 1000 // total) for x in hist.reshape(16, 16).sum(1))
    return f"grey8:{samples.shape[1]}x{samples.shape[0]};mean={mean:.3f};std={std:.3f};entropy={float(-(p * np.log2(p)).sum()):.4f};hist={shares};ahash={bits:016x}"


class _Sequence(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[dict] = []
        self.text: list[str] = []
        self.skip = 0
        self.caption: list[str] | None = None
        self.open: list[dict] = []  # media of the figure that is open

    def flush(self):
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.parts.append({"position": len(self.parts), "kind": "text", "text": text, "digest": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        elif tag in ("img", "video", "audio", "source"):
            found = dict(attrs)
            src = found.get("src") or ""
            if src:
                self.flush()
                part = {"position": len(self.parts), "kind": "media", "text": None, "digest": src.removeprefix(_PREFIX), "caption": found.get("alt")}
                self.parts.append(part)
                self.open.append(part)
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in _BLOCK:
            self.flush()
            if tag == "figure":
                self.open = []

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag == "figcaption" and self.caption is not None:
            text = " ".join("".join(self.caption).split())
            for part in self.open:
                part["caption"] = text
            self.caption = None
        elif tag in _BLOCK:
            self.flush()
            if tag == "figure":
                self.open = []

    def handle_data(self, data):
        if not self.skip:
            (self.text if self.caption is None else self.caption).append(data)


def parse(html: str | None) -> list[dict]:
    """The parts of a page in order; a figure's caption goes with each of its media, else the alt text does."""
    p = _Sequence()
    p.feed(html or "")
    p.close()
    p.flush()
    return p.parts


def sequences(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """``pages`` by ``key`` with their parts; null html has none. Repeated rows and null keys are carried on."""
    import pyarrow as pa

    kind = pages.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            parts = pa.array([parse(x) for x in batch.column(1).to_pylist()], pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), parts], names=["key", "parts"])

    return pages.select(F.col(key).alias("key"), F.col(html).alias("html")).mapInArrow(run, f"key {kind}, parts {PARTS}")


def store(payloads: DataFrame) -> DataFrame:
    """(digest, media) of the distinct payloads in ``payloads(payload binary)``; nulls and lengths that fill no rows are errors.

    A task encodes a payload once, however often it has it (it remembers the last MEMORY digests).
    """
    import pyarrow as pa

    def run(batches):
        done: dict[bytes, None] = {}
        for batch in batches:
            for a in range(0, batch.num_rows, 128):
                once = {}
                for x in batch.column(0).slice(a, 128):
                    x = x.as_py()
                    digest = hashlib.sha256(x)
                    if digest.digest() not in done:
                        done[digest.digest()] = None
                        once[digest.hexdigest()] = x
                while len(done) > MEMORY:
                    del done[next(iter(done))]
                yield pa.RecordBatch.from_arrays([pa.array(list(once)), pa.array([encode(x) for x in once.values()], pa.binary())], names=["digest", "media"])

    return payloads.mapInArrow(run, "digest string, media binary").dropDuplicates(["digest"])


def described(media: DataFrame) -> DataFrame:
    """Read the stored files of ``media(digest, media)`` back, and describe payload, file and image."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            out = []
            for digest, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = raw.as_py()
                samples = decode(raw)
                payload = samples.tobytes()
                out.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(raw), hashlib.sha256(raw).hexdigest(), feature(samples)))
            cols = list(zip(*out, strict=True)) if out else [()] * 7
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[c.split()[0] for c in FEATURES.split(", ")])

    return media.mapInArrow(run, FEATURES)


def resolve(parts: DataFrame, about: DataFrame) -> DataFrame:
    """The media parts of ``parts(key, parts)``, a row each, with what ``about`` has for their digests (nulls where it has none)."""
    refs = parts.select("key", F.explode("parts").alias("part")).where("part.kind = 'media'").select("key", "part.position", "part.caption", F.col("part.digest").alias("ref"))
    return refs.join(about, refs.ref == about.digest, "left").drop("digest")


def documents_as_media(docs: DataFrame) -> DataFrame:
    """Store each whole text of ``docs(doc_id, text)`` as an image of a page of its own, and describe what is read back.

    Null texts count as empty: 64 zero bytes. The page names the text's payload by digest and gives its length as the caption.
    Equal texts have equal values; repeated rows and null ids are kept; other columns are ignored.
    """
    import pyarrow as pa

    def payloads(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([padded(x.encode()) for x in batch.column(0).to_pylist()], pa.binary())], names=["payload"])

    def page(batches):
        for batch in batches:
            out = []
            for x in batch.column(1).to_pylist():
                raw = x.encode()
                out.append(f'<article><p>A stored text.</p><figure><img src="{_PREFIX}{hashlib.sha256(padded(raw)).hexdigest()}"><figcaption>{len(raw)}</figcaption></figure></article>')
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["page_id", "html"])

    text = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    about = described(store(text.select("text").mapInArrow(payloads, "payload binary")))
    seen = resolve(sequences(text.mapInArrow(page, "page_id long, html string")), about)
    return seen.select(F.col("key").alias("doc_id"), F.col("caption").cast("long").alias("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "ref")
