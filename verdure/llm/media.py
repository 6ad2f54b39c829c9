"""Media columns: ordered sequences of text and media references, with payloads joined in by digest.

Pages are parsed into structs in reading order: text blocks, and media references that carry a digest and a caption. A
figure's caption goes to all its references, before or after it; without one a reference has its alternative text. A
caption outside a figure, or in one without references, is a text block. Payloads live once per digest in a media table, as 8-bit grey PNG images with one sample per byte; a digest
join resolves references, and positions and captions stay with their reference.

NULL payload texts count as empty: one row of zero samples. Equal payloads share a digest and all features. References
without a stored payload resolve to NULL features. Repeated rows repeat their result; extra columns are ignored. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_text, cut

#: Samples in an image row; payloads are padded to a positive multiple of it.
WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SEQUENCE = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"
SEQUENCE_TYPE = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))
FEATURES = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def padded(data: bytes, width: int = WIDTH) -> bytes:
    return data + b"\0" * (-len(data) % width if data else width)


def to_png(payload: bytes, width: int = WIDTH) -> bytes:
    """An 8-bit grey image whose samples are the payload's bytes, row by row."""
    height = len(payload) // width
    rows = bytearray((width + 1) * height)  # each row is led by filter type 0
    for x in range(width):
        rows[x + 1 :: width + 1] = payload[x::width]
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(bytes(rows), 1)) + chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The samples of an image that :func:`to_png` wrote."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG image")
    at, width, data = 8, 0, []
    while at < len(media):
        (size,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            width = struct.unpack_from(">I", body)[0]
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    rows = zlib.decompress(b"".join(data))
    out = bytearray(len(rows) - len(rows) // (width + 1))
    for x in range(width):
        out[x::width] = rows[x + 1 :: width + 1]
    return bytes(out)


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, digest, media): each text's bytes as a stored image; the digest is the padded payload's SHA-256."""

    def make():
        def rows(texts):
            data = [(t or "").encode("utf-8") for t in texts]
            return [(len(d), hashlib.sha256(p := padded(d)).hexdigest(), to_png(p)) for d in data]

        return rows

    return by_text(docs, ["doc_id"], "n_bytes long, digest string, media binary", make)


def features(media: DataFrame) -> DataFrame:
    """One row per digest: what the stored images hold, read back from their bytes."""
    import numpy as np

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for digest, blob in zip(batch["digest"], batch["media"]):
                blob = bytes(blob)
                p = from_png(blob)
                samples = np.frombuffer(p, np.uint8)
                bins = np.bincount(samples >> 5, minlength=8)
                feature = f"{WIDTH}x{len(p) // WIDTH};mean={samples.mean():.6f};std={samples.std():.6f};hist={'/'.join(map(str, bins))}"
                rows.append((digest, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-WIDTH:]), len(blob), hashlib.sha256(blob).hexdigest(), feature))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in FEATURES.split(", ")])

    return media.select("digest", "media").mapInPandas(run, FEATURES).dropDuplicates(["digest"])


class _Reader(HTMLParser):
    """Text blocks and media references in reading order; a figure's caption goes to all references in it."""

    BLOCKS = {"p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "br", "tr", "td", "article", "section", "blockquote", "pre", "title"}
    MEDIA = {"img", "audio", "video", "source", "embed"}
    SKIPPED = {"script", "style", "noscript"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.caption: list[str] | None = None
        self.skipped = 0
        self.figures: list[dict] = []  # open ones: the indices of their references, and their caption

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.items.append({"kind": "text", "text": text, "digest": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIPPED:
            self.skipped += 1
        elif tag == "figcaption":
            self.end_caption()
            self.flush()
            self.caption = []
        elif tag == "figure":
            self.end_caption()
            self.flush()
            self.figures.append({"media": [], "caption": None})
        elif tag in self.MEDIA:
            self.flush()
            given = dict(attrs)
            source = given.get("src") or ""
            self.items.append({"kind": "media", "text": None, "digest": source.removeprefix("sha256:") if source.startswith("sha256:") else hashlib.sha256(source.encode()).hexdigest(), "caption": given.get("alt")})
            if self.figures:
                self.figures[-1]["media"].append(len(self.items) - 1)
        elif tag in self.BLOCKS:
            self.flush()

    def handle_endtag(self, tag):
        if tag in self.SKIPPED:
            self.skipped = max(0, self.skipped - 1)
        elif tag == "figcaption":
            self.end_caption()
        elif tag == "figure" and self.figures:
            self.end_figure()
        elif tag in self.BLOCKS:
            self.flush()

    def end_caption(self) -> None:
        if self.caption is None:
            return
        words, self.caption = " ".join("".join(self.caption).split()), None
        if self.figures and self.figures[-1]["caption"] is None:
            self.figures[-1]["caption"] = (len(self.items), words)
        elif words:
            self.text.append(words)
            self.flush()

    def end_figure(self) -> None:
        self.end_caption()
        self.flush()
        figure = self.figures.pop()
        if figure["caption"] is None:
            return
        at, words = figure["caption"]
        for n in figure["media"]:
            self.items[n]["caption"] = words
        if words and not figure["media"]:
            self.items.insert(at, {"kind": "text", "text": words, "digest": None, "caption": None})

    def handle_data(self, data):
        if not self.skipped:
            (self.text if self.caption is None else self.caption).append(data)


def parse(html: str | None) -> list[dict]:
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    while reader.figures:
        reader.end_figure()
    reader.end_caption()
    reader.flush()
    return [{"position": n, **item} for n, item in enumerate(reader.items)]


def sequences(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, items): each page as an ordered array of text and media-reference structs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parsed = pa.array([parse(h) for h in batch.column(1).to_pylist()], SEQUENCE_TYPE)
            yield pa.RecordBatch.from_arrays([batch.column(0), parsed], [key, "items"])

    return pages.select(key, html).mapInArrow(run, f"{key} {dict(pages.dtypes)[key]}, items {SEQUENCE}")


def resolved(sequence: DataFrame, media_features: DataFrame, key: str = "page_id") -> DataFrame:
    """One row per item, in place: text blocks as they are, references joined with what is stored under their digest."""
    others = [c for c in media_features.columns if c != "digest"]
    kept = [key, "position", "kind", "text", "caption", "digest", *others]
    items = sequence.select(key, F.explode("items").alias("i")).select(key, "i.*")
    media = items.filter("kind = 'media'").join(media_features, "digest", "left").select(*kept)
    none = [F.lit(None).cast(t).alias(c) for c, t in media_features.dtypes if c != "digest"]
    return media.unionByName(items.filter("kind != 'media'").select("*", *none).select(*kept))  # text need not be moved


def digest_of(text: Column, width: int = WIDTH) -> Column:
    """The digest of a text's padded payload."""
    data = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    size = F.octet_length(data)
    pad = F.when(size == 0, width).otherwise(F.pmod(-size, F.lit(width)))
    return F.sha2(F.concat(data, F.substring(F.lit(bytearray(width)), F.lit(1), pad)), 256)


def page_of(text: Column) -> Column:
    """A page of a text's lines as paragraphs, with a figure behind the first that refers to the text's stored form."""
    safe = F.coalesce(text, F.lit(""))
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        safe = F.replace(safe, F.lit(char), F.lit(name))
    lines = F.split(safe, "\n")
    figure = F.concat(F.lit('<figure><img src="sha256:'), digest_of(text), F.lit('"><figcaption>'), F.octet_length(F.coalesce(text, F.lit(""))).cast("string"), F.lit("</figcaption></figure>"))
    rest = F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), "</p><p>")
    return F.concat(F.lit("<article><p>"), lines[0], F.lit("</p>"), figure, F.lit("<p>"), rest, F.lit("</p></article>"))


def documents_as_media(docs: DataFrame) -> DataFrame:
    """Stores every text, refers to it from a page of its lines, and resolves the page's sequence: one row per document.

    n_blocks counts the page's text blocks, position is the reference's place among them."""
    known = cut(features(store(docs)))  # apart from its aggregation, the join can split a digest that many documents share
    pages = sequences(docs.select("doc_id", page_of(F.col("text")).alias("html")), "doc_id")
    blocks = F.size(F.filter("items", lambda i: i["kind"] == "text")).cast("long")
    own = pages.select(F.struct("doc_id", blocks.alias("n_blocks")).alias("page"), F.filter("items", lambda i: i["kind"] == "media").alias("items"))
    rows = resolved(own, known, "page").filter("kind = 'media'")
    columns = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    return rows.select("page.doc_id", F.col("caption").cast("long").alias("n_bytes"), *columns, "page.n_blocks", "position")
