"""Media columns: interleaved document sequences whose media references a digest join resolves.

A payload is stored as a grey PNG picture, ROW samples of 8 bits wide; its last row is filled up with bytes 255.
"""

from __future__ import annotations

import hashlib
import html
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.llm.common import dealt, fresh, partitions
from auditloom.llm.markup import BLOCKS, Node, attributes, tree

ROW = 576
#: Digests that a task remembers.
KEPT = 100_000
_MAGIC = b"\x89PNG\r\n\x1a\n"
SEQUENCE = T.ArrayType(T.StructType().add("position", T.IntegerType()).add("kind", "string").add("text", "string").add("ref", "string"))


def padded(payload: bytes) -> bytes:
    """A payload with bytes 255 up to a positive multiple of ROW."""
    return payload + b"\xff" * (-len(payload) % ROW or (0 if payload else ROW))


def to_png(samples: bytes) -> bytes:
    """Samples, a multiple of ROW, as an 8-bit grey picture."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), np.uint8)  # a row starts with the number of its filter: none
    lines[:, 1:] = rows
    out = [_MAGIC]
    for kind, data in ((b"IHDR", struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)), (b"IDAT", zlib.compress(lines.tobytes(), 1)), (b"IEND", b"")):
        out += [struct.pack(">I", len(data)), kind, data, struct.pack(">I", zlib.crc32(kind + data))]
    return b"".join(out)


def from_png(stored: bytes) -> bytes:
    """The samples of a picture that to_png made; raises ValueError if a checksum is wrong."""
    if stored[:8] != _MAGIC:
        raise ValueError("not a PNG picture")
    at, data, width = 8, [], 0
    while at < len(stored):
        (n,), kind = struct.unpack(">I", stored[at : at + 4]), stored[at + 4 : at + 8]
        body = stored[at + 8 : at + 8 + n]
        if struct.unpack(">I", stored[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + body):
            raise ValueError("a chunk is damaged")
        if kind == b"IHDR":
            width = struct.unpack(">I", body[:4])[0]
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    return np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(-1, width + 1)[:, 1:].tobytes()


def feature(samples: bytes) -> str:
    """Rows, sum, histogram of 16 levels, and of each of 8 column bands whether it is brighter than the one before."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, ROW)
    levels = np.bincount(rows.ravel() >> 4, minlength=16)
    bands = rows.sum(0, dtype=np.int64).reshape(8, -1).sum(1)
    return f"rows={len(rows)};sum={int(bands.sum())};levels={','.join(map(str, levels))};bands={''.join('1' if b > a else '0' for a, b in zip(bands, bands[1:]))}"


def sequence(source: str | None) -> list[dict]:
    """Text and media references of a page in page order.

    position counts from 0 over both kinds. A media item's text is its caption: the figcaption of its figure, else its
    alt text, else ''. Its ref is the src without a leading 'sha256:'. Neighbouring text is one item; none is empty.
    """
    items: list[dict] = []
    text: list[str] = []

    def flush() -> None:
        words = " ".join("".join(text).split())
        text.clear()
        if words:
            items.append({"kind": "text", "text": words, "ref": None})

    stack: list[Node | str] = [tree(source or "")]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            text.append(x)
        elif x.tag in ("script", "style", "head", "template"):
            continue
        elif x.tag in ("img", "audio", "video", "source", "embed"):
            a = attributes(x.attrs)
            if a.get("src"):
                flush()
                items.append({"kind": "media", "text": caption(x) or a.get("alt", ""), "ref": a["src"].removeprefix("sha256:")})
            stack.extend(reversed(x.children))
        elif x.tag != "figcaption" or not any(y.tag == "figure" for y in _up(x)):
            if x.tag in BLOCKS:
                text.append(" ")
                stack.append(" ")
            stack.extend(reversed(x.children))
    flush()
    return [{"position": i} | x for i, x in enumerate(items)]


def _up(node: Node | None) -> Iterator[Node]:
    while node is not None:
        yield node
        node = node.parent


def caption(node: Node) -> str:
    """Text of the figcaption in the figure around an element."""
    figure = next((x for x in _up(node) if x.tag == "figure"), None)
    found: list[str] = []
    stack: list[tuple[Node | str, bool]] = [(figure, False)] if figure is not None else []
    while stack:
        x, within = stack.pop()
        if isinstance(x, str):
            if within:
                found.append(x)
        else:
            stack.extend((y, within or x.tag == "figcaption") for y in reversed(x.children))
    return " ".join("".join(found).split())


def interleave(pages: DataFrame, source: str = "html") -> DataFrame:
    """Adds sequence, an array of (position, kind 'text' or 'media', text, ref), to each row. Null and empty pages have an empty one. Rows are independent."""
    kept = [c for c in pages.columns if c.lower() != "sequence"]
    at = kept.index(source)
    kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(map(sequence, batch.column(at).to_pylist()), kind)], names=[*kept, "sequence"])

    return pages.select(*kept).mapInArrow(run, pages.select(*kept).schema.add("sequence", SEQUENCE))


def store(payloads: DataFrame, payload: str) -> DataFrame:
    """One row (ref, media) for each different payload: its SHA-256 after padding, and the stored picture. Null counts as empty.

    A task remembers the digests that it saw last, KEPT at most, and lets those payloads through once; so a payload that a
    third of all rows hold is sent a few times a task. Behind the exchange by digest, equal digests are neighbours.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, None] = {}
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                refs, media = [], []
                for p in whole.slice(start, 500).column(0).to_pylist():
                    samples = padded(p or b"")
                    digest = hashlib.sha256(samples)
                    known = digest.digest() in seen
                    seen.pop(digest.digest(), None)
                    seen[digest.digest()] = None  # the last one seen is the last to be forgotten
                    if len(seen) > KEPT:
                        del seen[next(iter(seen))]
                    if not known:
                        refs.append(digest.hexdigest())
                        media.append(to_png(samples))
                yield pa.RecordBatch.from_arrays([pa.array(refs, pa.string()), pa.array(media, pa.binary())], names=["ref", "media"])

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            keep = []
            for ref in batch.column(0).to_pylist():
                keep.append(ref != last)
                last = ref
            yield batch.filter(pa.array(keep, pa.bool_()))

    sent = payloads.select(F.col(payload).cast("binary").alias("payload")).mapInArrow(write, "ref string, media binary")
    return dealt(sent, partitions(payloads.sparkSession), "ref").sortWithinPartitions("ref").mapInArrow(once, "ref string, media binary")


def read_back(media: DataFrame) -> DataFrame:
    """Reads stored pictures and computes (ref, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) from what they hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                rows: list[tuple] = []
                for stored in batch.column(1).to_pylist():
                    samples = from_png(stored)
                    rows.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(samples)))
                n, sha, crc, m, msha, f = zip(*rows) if rows else [()] * 6
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(crc, pa.int64()), pa.array(m, pa.int64()), pa.array(msha, pa.string()), pa.array(f, pa.string())], names=["ref", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.select("ref", "media").mapInArrow(run, "ref string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def resolve(sequences: DataFrame, found: DataFrame) -> DataFrame:
    """Joins the media items of sequences with what is known of their payloads, by digest.

    One row for each media item: the columns of sequences but sequence, then position, caption, ref and the columns of
    found (null where a ref has no payload). found has one row a ref; columns of sequences that clash with the new ones
    are left out.
    """
    new = {"position", "caption", "ref", *(c.lower() for c in found.columns)}
    kept = [c for c in sequences.columns if c != "sequence" and c.lower() not in new]
    (item,) = fresh(kept, "_item")
    items = sequences.select(*kept, F.explode(F.filter("sequence", lambda x: x["kind"] == "media")).alias(item))
    flat = items.select(*kept, F.col(f"{item}.position").alias("position"), F.col(f"{item}.text").alias("caption"), F.col(f"{item}.ref").alias("ref"))
    return flat.join(found, "ref", "left").select(*kept, "position", "caption", "ref", *[c for c in found.columns if c != "ref"])


def documents_as_pages(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Each text as a page (key, n_bytes, html): a figure whose picture is the text's padded payload, with the key as its caption, then the text itself in short form, its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                sizes, pages = [], []
                for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    data = (t or "").encode()
                    sizes.append(len(data))
                    pages.append(f'<p>{len(data)} bytes</p><figure><img src="sha256:{hashlib.sha256(padded(data)).hexdigest()}"><figcaption>{html.escape(str(k))}</figcaption></figure>')
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(pages, pa.string())], names=[key, "n_bytes", "html"])

    schema = docs.select(key).schema.add("n_bytes", "long").add("html", "string")
    return docs.select(key, text).mapInArrow(run, schema)
