"""Media columns: documents as lossless WebP images, and WebP columns as pixel arrays.

A text's UTF-8 bytes, blanked to a multiple of 192, are the red, green and blue samples of images
64 pixels wide and at most 64 high, small enough to decode many side by side in bounded memory; a longer
text is a sequence of images, one file after the other. Reading splits the files at their RIFF lengths.

Null text counts as empty: one row of blanks. Repeated rows are repeated rows of the result; an
empty table gives an empty result. Extra columns are left out by ``encode_documents`` and kept by
``decode_images`` (where ``pixels`` gets an underscore if there is such a column). A null image is a null array.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from talentloom.llm.common import field_sql, fresh
from talentloom.llm.webp import OPAQUE, decode_many, encode_best

ROW_BYTES, WIDTH, MOST_ROWS = 192, 64, 64
#: Bytes of payload that are worked on together.
TOGETHER = 16 << 20


def payload_of(raw: bytes) -> bytes:
    return raw + b" " * (-len(raw) % ROW_BYTES or (ROW_BYTES if not raw else 0))


def to_images(payload: bytes) -> bytes:
    """The payload's WebP files, one after the other."""
    page = ROW_BYTES * MOST_ROWS
    out = []
    for a in range(0, len(payload), page):
        rgb = np.frombuffer(payload[a : a + page], np.uint8).reshape(-1, WIDTH, 3).astype(np.uint32)
        out.append(encode_best(OPAQUE | rgb[..., 0] << 16 | rgb[..., 1] << 8 | rgb[..., 2]))
    return b"".join(out)


def split_files(media: bytes) -> list[bytes]:
    files, at = [], 0
    while at < len(media):
        end = at + 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        files.append(media[at:end])
        at = end
    return files


def samples(pixels: np.ndarray) -> np.ndarray:
    """Red, green and blue of each pixel, row by row."""
    return np.ascontiguousarray(pixels).view(np.uint8).reshape(*pixels.shape, 4)[..., 2::-1]


def encode_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (binary)."""

    def run(batches):
        for batch in batches:
            ids, at, n, media, size = batch.column("doc_id"), 0, [], [], 0
            for k, text in enumerate(batch.column("text").to_pylist()):
                raw = (text or "").encode("utf-8", "surrogatepass")
                n.append(len(raw))
                media.append(to_images(payload_of(raw)))
                size += len(raw) + ROW_BYTES
                if size >= TOGETHER or k + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([ids.slice(at, len(n)), pa.array(n, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])
                    at, n, media, size = k + 1, [], [], 0

    return docs.select("doc_id", "text").mapInArrow(run, f"{field_sql(docs, 'doc_id')}, n_bytes long, media binary")


def decode_images(media: DataFrame, column: str = "media") -> DataFrame:
    """The other columns and pixels: for each file its height, width and samples (red, green, blue)."""
    kept = [c for c in media.columns if c != column]
    pixels = fresh(media.select(kept), "pixels")

    def run(batches):
        for batch in batches:
            for at, columns, pages in _decoded(batch, column):
                rows = [None if p is None else [{"height": x.shape[0], "width": x.shape[1], "samples": samples(x).tobytes()} for x in p] for p in pages]
                kind = pa.list_(pa.struct([("height", pa.int32()), ("width", pa.int32()), ("samples", pa.binary())]))
                yield pa.RecordBatch.from_arrays([*(columns.column(c) for c in kept), pa.array(rows, kind)], [*kept, pixels])

    return media.mapInArrow(run, ", ".join([*(field_sql(media, c) for c in kept), f"{pixels} array<struct<height:int,width:int,samples:binary>>"]))


def _decoded(batch: pa.RecordBatch, column: str):
    """(first row, rows, their images), a bounded number of bytes at a time."""
    media = batch.column(column)
    at, size = 0, 0
    for k in range(batch.num_rows):
        size += len(media[k].as_buffer()) if media[k].is_valid else 0
        if size >= TOGETHER // 2 or k + 1 == batch.num_rows:
            own = media.slice(at, k + 1 - at).to_pylist()
            files = [split_files(m) if m else [] for m in own]
            images = iter(decode_many([f for fs in files for f in fs]))
            pages = [None if m is None else [next(images) for _ in fs] for m, fs in zip(own, files, strict=True)]
            yield at, batch.slice(at, k + 1 - at), pages
            at, size = k + 1, 0


def media_digest(media: DataFrame) -> DataFrame:
    """Reads each document's images back; features and checksums of what was read."""

    def run(batches):
        for batch in batches:
            for _, rows, pages in _decoded(batch, "media"):
                columns: list[list] = [[] for _ in range(6)]
                for stored, images in zip(rows.column("media").to_pylist(), pages, strict=True):
                    data = b"".join(samples(x).tobytes() for x in images)
                    values = np.frombuffer(data, np.uint8)
                    means = (values.reshape(-1, 3).sum(axis=0) // max(1, len(values) // 3)).tolist()
                    feature = f"{len(images)}x{WIDTH}x{sum(x.shape[0] for x in images)};mean={means[0]},{means[1]},{means[2]};levels={np.count_nonzero(np.bincount(values, minlength=256))}"
                    for c, v in zip(columns, (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature), strict=True):
                        c.append(v)
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("n_bytes"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.mapInArrow(run, f"{field_sql(media, 'doc_id')}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
