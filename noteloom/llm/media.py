"""Interleaved documents: ordered text and media references from HTML, payloads joined by digest.

``parse_interleaved`` turns each HTML text into segments in reading order: a segment is either
text or a reference to a medium, with its caption beside it, and keeps its position, so any
later join can be put back in order. Payloads live in a store table under the SHA-256 of their
bytes, as 8-bit greyscale PNG images 64 samples wide (lossless). ``read_media`` decodes stored
bytes again and measures them; ``resolve`` joins references to what the store holds.

One payload may be referred to by a third of all rows: digests with more than a thousandth of
the references (a thousand digests at most) are joined by broadcast, the rest by shuffle.

Nulls and edge cases: a null or empty HTML text has no segments; markup that isn't closed ends
with its text; a null payload is the empty one (64 zero bytes); equal payloads are stored once
a task or more often, and joined once; a reference to an unknown digest keeps its row with
nulls; repeated rows keep their references each; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteloom.llm.shared import only, slices, text_buffers, written

WIDTH = 64
_PNG = b"\x89PNG\r\n\x1a\n"
_SILENT = {"script", "style", "template", "noscript", "title"}
_BREAKS = {"p", "div", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "figure", "figcaption", "section", "article", "table", "tr", "br", "blockquote", "nav", "footer", "header", "head", "body"}
SEGMENTS = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"


class _Reader(HTMLParser):
    """Collects (kind, text, source, caption) in reading order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[list] = []
        self.words: list[str] = []
        self.caption: list[str] | None = None
        self.silent, self.figure = 0, None

    def flush(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            self.out.append(["text", text, None, None])

    def handle_starttag(self, tag, attrs) -> None:
        if tag in _SILENT:
            self.silent += 1
        if tag in _BREAKS:
            self.flush()
        if tag == "figure":
            self.figure = len(self.out)
        elif tag == "figcaption":
            self.caption = []
        elif tag in ("img", "audio", "video", "source"):
            found = dict(attrs)
            if found.get("src"):
                self.flush()
                self.out.append(["media", None, found["src"], found.get("alt") or found.get("title")])

    def handle_startendtag(self, tag, attrs) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag) -> None:
        if tag in _SILENT and self.silent:
            self.silent -= 1
        if tag == "figcaption" and self.caption is not None:
            text = " ".join("".join(self.caption).split())
            media = [x for x in self.out[self.figure or 0 :] if x[0] == "media"] if self.figure is not None else []
            for x in media:
                x[3] = text or x[3]
            if not media and text:
                self.out.append(["text", text, None, None])
            self.caption = None
        elif tag == "figure":
            self.figure = None
        if tag in _BREAKS:
            self.flush()

    def handle_data(self, data) -> None:
        if not self.silent:
            (self.words if self.caption is None else self.caption).append(data)


def segments(html: str | None) -> list[dict]:
    """Ordered segments of one HTML text; media sources of the form ``sha256:HEX`` give the digest."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    if reader.caption is not None:
        reader.handle_endtag("figcaption")
    reader.flush()
    return [
        {"position": i, "kind": kind, "text": text, "digest": source.removeprefix("sha256:") if source else None, "caption": caption}
        for i, (kind, text, source, caption) in enumerate(reader.out)
    ]


def parse_interleaved(pages: DataFrame, key: str, html: str, texts: bool = True) -> DataFrame:
    """(key, segments) of every row; without ``texts`` text segments keep their places but not their text."""
    kind = pages.select(key).dtypes[0][1]
    target = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2000):
            found = [segments(x) for x in batch.column(1).to_pylist()]
            if not texts:
                found = [[x | {"text": None} for x in page] for page in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, target)], [key, "segments"])

    return only(pages, key, html).mapInArrow(run, f"`{key}` {kind}, segments {SEGMENTS}")


def to_png(payload: bytes) -> bytes:
    """Bytes (a positive multiple of 64) as an 8-bit greyscale image, one row per 64 bytes."""
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _PNG + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The samples of such an image; raises if its checksums or its layout are wrong."""
    if media[:8] != _PNG:
        raise ValueError("not a PNG image")
    at, body, width, height = 8, [], 0, 0
    while at < len(media):
        size, name = struct.unpack(">I4s", media[at : at + 8])
        data = media[at + 8 : at + 8 + size]
        if zlib.crc32(name + data) != struct.unpack(">I", media[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("broken chunk")
        if name == b"IHDR":
            width, height, depth, colour, _, _, laced = struct.unpack(">IIBBBBB", data)
            if (width, depth, colour, laced) != (WIDTH, 8, 0, 0):
                raise ValueError("another layout")
        elif name == b"IDAT":
            body.append(data)
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("another filter")
    return rows[:, 1:].tobytes()


def padded(raw: bytes) -> bytes:
    return raw + bytes((-len(raw)) % WIDTH or (WIDTH if not raw else 0))


def feature(payload: bytes) -> str:
    """Mean, deviation, entropy in bits and an 8-bin histogram in permille of the samples."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    p = counts / counts.sum()
    mean = float(p @ np.arange(256))
    deviation = float(np.sqrt(max(p @ (np.arange(256) ** 2) - mean**2, 0)))
    some = p[p > 0]
    bins = (counts.reshape(8, 32).sum(axis=1) * 1000 // counts.sum()).tolist()
    return f"{mean:.4f} {deviation:.4f} {float(-(some @ np.log2(some))):.4f} " + " ".join(map(str, bins))


def document_page(text: Column, digest: Column, caption: Column) -> Column:
    """A text as an HTML page: a paragraph a line, after the first one the figure that refers to its payload."""
    safe = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    first = F.substring_index(safe, "\n", 1)
    rest = F.replace(F.substr(safe, F.length(first) + 2, F.length(safe)), F.lit("\n"), F.lit("</p><p>"))
    figure = F.concat(F.lit('<figure><img src="sha256:'), digest, F.lit('"><figcaption>'), caption, F.lit("</figcaption></figure>"))
    return F.concat(F.lit("<article><p>"), first, F.lit("</p>"), figure, F.lit("<p>"), rest, F.lit("</p></article>"))


def payload_digest(text: Column) -> Column:
    """SHA-256 of a text's bytes, padded with zero bytes to a positive multiple of 64."""
    raw = F.coalesce(text, F.lit("")).cast("binary")
    n = F.octet_length(raw)
    padding = F.substr(F.lit(bytes(WIDTH)), F.lit(1), F.when(n == 0, WIDTH).otherwise(F.pmod(-n, F.lit(WIDTH))))
    return F.sha2(F.concat(raw, padding), 256)


def store_payloads(documents: DataFrame) -> DataFrame:
    """Written rows (doc_id, n_bytes, digest, media): each text's payload by its digest, and the
    stored form beside the first row of each digest in a batch (else null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1000):
            data, at = text_buffers(batch.column(1))
            sizes, digests, media, seen = [], [], [], set()
            for i in range(batch.num_rows):
                raw = data[at[i] : at[i + 1]].tobytes()
                payload = padded(raw)
                digest = hashlib.sha256(payload).hexdigest()
                sizes.append(len(raw))
                digests.append(digest)
                media.append(None if digest in seen else to_png(payload))
                seen.add(digest)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "digest", "media"])

    return written(only(documents, "doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, digest string, media binary"), "media-store")


def read_media(store: DataFrame) -> DataFrame:
    """(digest, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) from the stored bytes, once each."""
    names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500):
            rows = []
            for digest, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                payload = from_png(media)
                rows.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)))
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 7, kinds)], names)

    read = store.where("media is not null").select("digest", "media").mapInArrow(run, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return read.dropDuplicates(["digest"])


def resolve(references: DataFrame, resolved: DataFrame, digest: str = "digest") -> DataFrame:
    """Left join of references to one row per digest; very common digests go by broadcast."""
    counts = references.groupBy(digest).agg(F.count("*").alias("n_refs"))
    total = references.count()
    # More than total / 1000 references each: a thousand digests at most, at any size.
    common = counts.where((F.col("n_refs") > max(1000, total // 1000)) & F.col(digest).isNotNull()).select(digest)
    hot = F.broadcast(common)
    few = references.join(hot, digest, "left_semi").join(F.broadcast(resolved.join(hot, digest, "left_semi")), digest, "left")
    return references.join(hot, digest, "left_anti").join(resolved, digest, "left").unionByName(few)


def media_documents(documents: DataFrame) -> DataFrame:
    """Every text through the store and back, as the interleaved page of its lines that refers to it:
    (doc_id, n_bytes, position and caption of the reference, n_segments, the columns of ``read_media``)."""
    store = store_payloads(documents)
    text, caption = F.col("`text`"), F.concat(F.lit("document "), F.coalesce(F.col("`doc_id`").cast("string"), F.lit("null")))
    row = F.struct(F.col("`doc_id`"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    pages = documents.select(row.alias("row"), document_page(text, payload_digest(text), caption).alias("html"))
    parsed = parse_interleaved(pages, "row", "html", texts=False)
    media = parsed.select("row.*", F.size("segments").alias("n_segments"), F.explode(F.filter("segments", lambda s: s["kind"] == "media")).alias("s"))
    references = media.select("doc_id", "n_bytes", "n_segments", F.col("s.position").alias("position"), F.col("s.caption").alias("caption"), F.col("s.digest").alias("digest"))
    references = written(references, "media-references")
    return resolve(references, read_media(store)).drop("digest")
