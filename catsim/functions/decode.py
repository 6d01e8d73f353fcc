"""Pixels from the bytes of an image file, for use inside tasks: PNG and BMP by numpy, other formats by Pillow where it is installed."""

from __future__ import annotations

import io
import zlib
from collections.abc import Callable
from importlib.util import find_spec

import numpy as np

#: Bytes -> pixels (height, width, channels) as uint8: gray, gray and alpha, RGB or RGBA. Any exception means undecodable.
Decoder = Callable[[bytes], np.ndarray]
#: Pixels of a picture that is decoded at all, so that a small file can't fill the memory.
MAX_PIXELS = 100_000_000
_PNG = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: Adam7: first row, first column, and steps of both, for each pass.
_PASSES = ((0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1))


def file_format(content: bytes) -> str | None:
    """The format by the leading bytes."""
    if content[:4] == b"RIFF":
        return "WEBP"
    heads = {b"\x89PNG": "PNG", b"\xff\xd8\xff": "JPEG", b"BM": "BMP", b"GIF8": "GIF"}
    return next((name for head, name in heads.items() if content.startswith(head)), None)


def _chunks(content: bytes) -> dict[bytes, bytes]:
    """Chunks of a PNG by their type, those of one type joined; each has to match its checksum."""
    found: dict[bytes, list[bytes]] = {}
    at, kind = len(_PNG), b""
    while kind != b"IEND":
        if len(content) < at + 12:
            raise ValueError("cut off")
        size, kind = int.from_bytes(content[at : at + 4], "big"), content[at + 4 : at + 8]
        data = content[at + 8 : at + 8 + size]
        if zlib.crc32(kind + data) != int.from_bytes(content[at + 8 + size : at + 12 + size], "big") or len(data) < size:
            raise ValueError("a chunk is damaged")
        found.setdefault(kind, []).append(data)
        at += 12 + size
    return {k: b"".join(v) for k, v in found.items()}


def _unfilter(lines: np.ndarray, filters: np.ndarray, step: int) -> np.ndarray:
    """Undo the filters of the lines (height, bytes): each byte is predicted by those to its left, above, and above left.

    All bytes of a diagonal depend on earlier diagonals only, so a diagonal is undone at once, whatever the lines' filters.
    """
    if filters.max(initial=0) > 4:
        raise ValueError("unknown filter")
    height, width = lines.shape
    if not filters.any():
        return lines
    columns = -(-width // step)
    raw = np.zeros((height, columns, step), np.int16)
    raw.reshape(height, -1)[:, :width] = lines
    done = np.zeros((height + 1, columns + 1, step), np.int16)
    for d in range(height + columns - 1):
        y = np.arange(max(0, d - columns + 1), min(height, d + 1))
        x = d - y
        left, up, corner = done[y + 1, x], done[y, x + 1], done[y, x]
        guess = left + up - corner
        far = [np.abs(guess - p) for p in (left, up, corner)]
        paeth = np.where((far[0] <= far[1]) & (far[0] <= far[2]), left, np.where(far[1] <= far[2], up, corner))
        kind = filters[y][:, None]
        predicted = np.choose(kind, [np.zeros_like(left), left, up, (left + up) >> 1, paeth])
        done[y + 1, x + 1] = (raw[y, x] + predicted) & 255
    return done[1:, 1:].reshape(height, -1)[:, :width].astype(np.uint8)


def _samples(lines: np.ndarray, width: int, channels: int, depth: int) -> np.ndarray:
    """Samples (height, width, channels) of lines of bytes; those of 16 bits keep their high byte."""
    if depth == 16:
        return lines[:, ::2].reshape(len(lines), width, channels)
    if depth == 8:
        return lines.reshape(len(lines), width, channels)
    bits = np.unpackbits(lines, axis=1)[:, : width * channels * depth].reshape(len(lines), width * channels, depth)
    return (bits @ (1 << np.arange(depth)[::-1])).astype(np.uint8).reshape(len(lines), width, channels)


def decode_png(content: bytes) -> np.ndarray:
    """Pixels of a PNG of any colour type, depth and interlacing."""
    chunks = _chunks(content)
    head = chunks[b"IHDR"]
    width, height = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big")
    depth, colour, interlaced = head[8], head[9], head[12]
    channels = _CHANNELS[colour]
    if not 0 < width * height <= MAX_PIXELS or depth not in (1, 2, 4, 8, 16):
        raise ValueError("unfit size")
    bits = channels * depth
    areas = [(y, x, dy, dx) for y, x, dy, dx in (_PASSES if interlaced else ((0, 0, 1, 1),)) if y < height and x < width]
    sizes = [(-(-(height - y) // dy), -(-(width - x) // dx)) for y, x, dy, dx in areas]
    need = sum(h * (1 + (w * bits + 7) // 8) for h, w in sizes)
    data = zlib.decompressobj().decompress(chunks[b"IDAT"], need)
    if len(data) < need:
        raise ValueError("too few samples")
    made, at = np.zeros((height, width, channels), np.uint8), 0
    for (y, x, dy, dx), (h, w) in zip(areas, sizes, strict=True):
        row = 1 + (w * bits + 7) // 8
        lines = np.frombuffer(data, np.uint8, h * row, at).reshape(h, row)
        made[y::dy, x::dx] = _samples(_unfilter(lines[:, 1:], lines[:, 0], max(1, bits // 8)), w, channels, depth)
        at += h * row
    if colour == 3:
        palette = np.frombuffer(chunks[b"PLTE"], np.uint8).reshape(-1, 3)[made[..., 0]]
        if b"tRNS" not in chunks:
            return palette
        alpha = np.full(256, 255, np.uint8)
        alpha[: len(chunks[b"tRNS"])] = np.frombuffer(chunks[b"tRNS"], np.uint8)
        return np.concatenate([palette, alpha[made]], axis=2)
    return made * np.uint8(255 // ((1 << depth) - 1)) if depth < 8 else made


def decode_bmp(content: bytes) -> np.ndarray:
    """Pixels of an uncompressed BMP of 8 (with palette), 24 or 32 bits."""
    number = lambda at, n=4, signed=True: int.from_bytes(content[at : at + n], "little", signed=signed)
    start, head, width, height, bits, packed = number(10), number(14), number(18), number(22), number(28, 2), number(30)
    if packed or bits not in (8, 24, 32) or not 0 < width * abs(height) <= MAX_PIXELS:
        raise ValueError("unfit kind of BMP")
    row = (width * bits + 31) // 32 * 4
    lines = np.frombuffer(content, np.uint8, row * abs(height), start).reshape(abs(height), row)
    lines = lines[::-1] if height > 0 else lines
    if bits == 8:
        table = np.frombuffer(content, np.uint8, start - 14 - head, 14 + head).reshape(-1, 4)
        return table[lines[:, :width]][..., 2::-1]
    return lines[:, : width * bits // 8].reshape(abs(height), width, bits // 8)[..., 2::-1]


def decode(content: bytes) -> np.ndarray:
    """Pixels of a picture, or an exception."""
    kind = file_format(content)
    if kind == "PNG":
        return decode_png(content)
    if kind == "BMP":
        return decode_bmp(content)
    if find_spec("PIL") is None:
        raise ValueError("this format needs Pillow")
    from PIL import Image

    picture = Image.open(io.BytesIO(content))
    if picture.width * picture.height > MAX_PIXELS:
        raise ValueError("unfit size")
    return np.atleast_3d(np.asarray(picture if picture.mode in ("L", "LA", "RGB", "RGBA") else picture.convert("RGBA")))
