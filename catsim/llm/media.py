"""Media columns: texts stored losslessly as PNG images, read back with checks, and hashed by low frequencies.

A payload is an image of 8-bit gray samples, ``WIDTH`` wide. Each row takes that of three filters (none, sub, up) whose
sum of absolute values is least; the rows are compressed by zlib and framed in chunks. The reader tests signature, chunk checksums and sizes,
and undoes all five filters in numpy. The feature is the sign pattern of the lowest frequencies of the two-dimensional
cosine transform of the image, averaged down to 32 x 32.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from catsim.llm.storage import bounded, doc_type, id_and_text

WIDTH = 576
PAD = b"\xff"
SIDE, LOW = 32, 8
SIGNATURE = b"\x89PNG\r\n\x1a\n"
MEDIA_SCHEMA = "n_bytes long, media binary, feature binary"
DIGEST_SCHEMA = (
    "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string"
)


def to_payload(text: bytes) -> bytes:
    """A text's bytes, filled up to a positive multiple of ``WIDTH``."""
    return text + PAD * (-len(text) % WIDTH if text else WIDTH)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes, level: int = 1) -> bytes:
    """A gray PNG of the payload. Each row takes the filter none, sub or up whose result is nearest to zero."""
    image = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    sub, up = image.copy(), image.copy()
    sub[:, 1:] -= image[:, :-1]
    up[1:] -= image[:-1]
    tries = np.stack([image, sub, up])
    best = np.abs(tries.view(np.int8).astype(np.int16)).sum(axis=2).argmin(axis=0)
    rows = np.empty((len(image), WIDTH + 1), np.uint8)
    rows[:, 0] = best
    rows[:, 1:] = tries[best, np.arange(len(image))]
    head = struct.pack(">IIBBBBB", WIDTH, len(image), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def unfilter(kinds: np.ndarray, rows: np.ndarray, step: int = 1) -> np.ndarray:
    """Undo PNG's filters; ``step`` is the number of bytes of a pixel."""
    out = np.zeros((len(rows) + 1, rows.shape[1] + step), np.uint8)
    plain = np.isin(kinds, (0, 1))
    out[1:][kinds == 0, step:] = rows[kinds == 0]
    for k in range(step):
        out[1:][kinds == 1, step + k :: step] = np.cumsum(rows[kinds == 1][:, k::step], axis=1, dtype=np.uint8)
    for y in np.flatnonzero(~plain).tolist():
        line, above, kind = out[y + 1], out[y], kinds[y]
        if kind == 2:
            line[step:] = rows[y] + above[step:]
        elif kind in (3, 4):
            for x in range(step, len(line)):
                a, b, c = int(line[x - step]), int(above[x]), int(above[x - step])
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c
                line[x] = (int(rows[y, x - step]) + guess) & 255
        else:
            raise ValueError(f"unknown filter {kind}")
    return out[1:, step:]


def decode_png(media: bytes) -> np.ndarray:
    """The samples of an 8-bit gray PNG without interlace; ValueError where signature, checksum or size is wrong."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, data, size = 8, [], None
    while True:
        if at + 12 > len(media):
            raise ValueError("the file ends early")
        n, kind = struct.unpack(">I4s", media[at : at + 8])
        body = media[at + 8 : at + 8 + n]
        if media[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(kind + body)):
            raise ValueError(f"wrong checksum of {kind!r}")
        at += 12 + n
        if kind == b"IHDR":
            *size, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", body)
            if (depth, colour, interlace) != (8, 0, 0):
                raise ValueError("only 8-bit gray without interlace")
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"IEND":
            break
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    except zlib.error as e:
        raise ValueError("broken data") from e
    if size is None or len(raw) != size[1] * (size[0] + 1):
        raise ValueError("wrong size")
    rows = raw.reshape(size[1], size[0] + 1)
    return unfilter(rows[:, 0], rows[:, 1:])


def _cosines(n: int, k: int) -> np.ndarray:
    return np.cos(np.pi * (np.arange(n)[None, :] + 0.5) * np.arange(k)[:, None] / n)


def _shrink(n: int, to: int) -> np.ndarray:
    """(to, n) weights of area averages."""
    edge = np.linspace(0, n, to + 1)
    lo, hi = np.maximum(edge[:-1, None], np.arange(n)), np.minimum(edge[1:, None], np.arange(n) + 1)
    return np.maximum(hi - lo, 0) / (n / to)


_ACROSS = _shrink(WIDTH, SIDE).T @ _cosines(SIDE, LOW + 1).T


def cosine_hash(image: np.ndarray) -> bytes:
    """64 bits: which of the 8 x 8 lowest frequencies, the constant row and column left out, exceed their median."""
    down = _cosines(SIDE, LOW + 1) @ _shrink(len(image), SIDE)
    low = np.round(down @ (image.astype(np.float64) @ _ACROSS), 3)[1:, 1:].ravel()
    return np.packbits(low > np.median(low)).tobytes()


def _read(batch: pa.RecordBatch) -> list[bytes]:
    return [x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()]


def media_columns(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media, feature): each text as a PNG, and the hash of what is read back from it.

    A null text counts as empty and gives one row of padding; a very long one is one tall image. Equal texts, and so
    repeated rows, give equal values; columns other than doc_id and text are ignored; an empty table gives no rows.
    """

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            texts = _read(batch)
            media = [encode_png(to_payload(t)) for t in texts]
            columns = [
                batch.column(0),
                pa.array(map(len, texts), pa.int64()),
                pa.array(media, pa.binary()),
                pa.array([cosine_hash(decode_png(m)) for m in media], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "media", "feature"])

    return id_and_text(docs).mapInArrow(store, f"doc_id {doc_type(docs)}, {MEDIA_SCHEMA}")


def media_digests(media: DataFrame) -> DataFrame:
    """What a reader of `media_columns` finds: sizes and digests of the stored bytes and of the payload in them."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, text=2):
            blobs = batch.column(2).to_pylist()
            payloads = [decode_png(m).tobytes() for m in blobs]
            columns = [
                batch.column(0),
                batch.column(1),
                pa.array(map(len, payloads), pa.int64()),
                pa.array([hashlib.sha256(p).hexdigest() for p in payloads], pa.string()),
                pa.array([zlib.crc32(p[-32:]) for p in payloads], pa.int64()),
                pa.array(map(len, blobs), pa.int64()),
                pa.array([hashlib.sha256(m).hexdigest() for m in blobs], pa.string()),
                pa.array([f.hex() for f in batch.column(3).to_pylist()], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *(f.split()[0] for f in DIGEST_SCHEMA.split(", "))])

    return media.select("doc_id", "n_bytes", "media", "feature").mapInArrow(read, f"doc_id {doc_type(media)}, {DIGEST_SCHEMA}")
