"""Vectorised word splitting and hashing over the UTF-8 bytes of many texts at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Words are runs of anything but these bytes: space and \t \n \v \f \r.
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x5851F42D4C957F2D
#: Bytes of the longest span that is hashed together with others, and of a piece of a longer one.
LONG, _PIECE = 256, 1 << 20
_LOW = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


@dataclass
class Words:
    """Words of several texts, in order: byte offsets in ``buf`` and the number of the text of each."""

    buf: bytes
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    doc_starts: np.ndarray
    counts: np.ndarray


def split_words(texts: list[bytes], separators: np.ndarray = WHITE) -> Words:
    """Split every text into words. Texts are joined with a line feed, which is a separator in every table used."""
    buf = b"\n".join(texts) + b"\n" + bytes(8)
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    doc_starts = np.concatenate([[0], np.cumsum(lens + 1)])
    n = int(doc_starts[-1])
    inside = np.empty(n + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(separators[np.frombuffer(buf, np.uint8, n)], out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    upto = np.searchsorted(starts, doc_starts)
    counts = np.diff(upto)
    return Words(buf, starts, ends, np.repeat(np.arange(len(texts)), counts), doc_starts[:-1], counts)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64 bits over 64 bits, one to one."""
    h = (h ^ (h >> np.uint64(30))) * _M2
    h = (h ^ (h >> np.uint64(27))) * _M3
    return h ^ (h >> np.uint64(31))


def _hash_long(buf: bytes, start: int, end: int) -> int:
    """A 64-bit hash of one long span: its numbered eight-byte chunks, each mixed, are added up a piece at a time."""
    total = np.zeros(1, np.uint64)
    for at in range(start, end, _PIECE):
        piece = buf[at : min(at + _PIECE, end)]
        chunks = np.frombuffer(piece + bytes(-len(piece) % 8), "<u8")
        first = (at - start) // 8
        total += mix(chunks ^ mix(np.arange(first, first + len(chunks), dtype=np.uint64) * _M1)).sum(dtype=np.uint64)
    return int(mix(total ^ np.array([end - start], np.uint64) * _M1)[0])


def hash_spans(buf: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span. Spans of up to 8 bytes and equal length never collide.

    Spans of up to ``LONG`` bytes are hashed together, eight bytes at a time; each longer one is hashed by itself, in a
    few passes over its bytes.
    """
    view = np.ndarray((max(len(buf) - 7, 0),), "<u8", buf, 0, (1,))
    lens = ends - starts
    h = lens.astype(np.uint64) * _M1
    live = np.flatnonzero(lens <= LONG)
    at, left = starts[live], lens[live]
    while len(live):
        h[live] = mix(h[live] ^ (view[at] & _LOW[np.minimum(left, 8)]))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(lens > LONG).tolist():
        h[i] = _hash_long(buf, int(starts[i]), int(ends[i]))
    return h


def window_hashes(codes: np.ndarray, width: int, base: int = _BASE) -> np.ndarray:
    """Rabin-Karp: the polynomial hash, modulo 2**64, of every ``width`` consecutive codes (prefix sums, so O(n))."""
    n = len(codes)
    if n < width:
        return np.empty(0, np.uint64)
    up = np.full(n, base, np.uint64)
    down = np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    np.multiply.accumulate(up, out=up)
    np.multiply.accumulate(down, out=down)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(codes * down, out=total[1:])
    return mix((total[width:] - total[:-width]) * up[: n - width + 1])


def doc_windows(words: Words, codes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of every window that lies inside one text."""
    h = window_hashes(codes, width)
    at = np.flatnonzero(words.doc[: len(h)] == words.doc[width - 1 :]) if len(h) else np.empty(0, np.int64)
    return h[at], at
