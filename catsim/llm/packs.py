"""Corpus-wide counts of window hashes.

A corpus of n words has about n windows, so one Spark row for each would cost many times the input in shuffles. Here
rows are *packs*: a few MB of whole documents (`pack_documents`). Each pack sends its sorted, distinct hashes to the
bucket that owns their range, as difference-coded byte planes; a bucket adds up the counts and answers every pack with
one byte for each hash. A hash that occurs everywhere arrives once from each pack, so no bucket is hot.

Hashes have up to 56 bits. Where equal hashes must mean equal windows, each comes with a check of `CHECK_BITS` more, and
only hashes that agree in both are one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catsim.llm.storage import doc_type, id_and_text, write_table

PACK_BYTES = 4 << 20
#: Hashes that one bucket is planned for.
BUCKET_HASHES = 2 << 20
MAX_BUCKETS = 1 << 24
#: Hashes that a row of an exchange should hold at least.
ROW_HASHES = 256
#: Bits of a check, and the bytes that they take.
CHECK_BITS = 40
_CHECK_BYTES = CHECK_BITS // 8
BLOB_SCHEMA = "bucket int, src long, n int, hashes binary, checks binary, many binary"
CODE_SCHEMA = "src long, bucket int, codes binary"

#: Texts of a pack -> hash of each item (low ``bits`` bits used), its check or None, and the number of its text.
Hasher = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray | None, np.ndarray]]


def pack_documents(docs: DataFrame, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """Write ``docs`` (doc_id, text) as packs of whole documents, at most ``pack_bytes`` each or one longer document.

    Null texts count as empty. The number of a pack is stored, so every later read sees the same packs. Ids keep their type.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        src = TaskContext.get().partitionId() << 32
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            blobs = [x or b"" for x in texts.cast(pa.binary()).to_pylist()]
            first, held = 0, 0
            for i in range(len(blobs) + 1):
                if i == len(blobs) or (i > first and held + len(blobs[i]) > pack_bytes):
                    if i > first:
                        part = blobs[first:i]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([src], pa.int64()),
                                pa.array([ids[first:i].to_pylist()], pa.list_(ids.type)),
                                pa.array([[len(x) for x in part]], pa.list_(pa.int64())),
                                pa.array([squeeze.compress(b"".join(part))], pa.binary()),
                            ],
                            ["src", "doc_ids", "lens", "payload"],
                        )
                        src += 1
                    first, held = i, 0
                if i < len(blobs):
                    held += len(blobs[i])

    schema = f"src long, doc_ids array<{doc_type(docs)}>, lens array<long>, payload binary"
    return write_table(id_and_text(docs).mapInArrow(pack, schema), "packs", "uncompressed")


def unpack(lens: list[int], payload: bytes) -> list[bytes]:
    """The texts of a pack."""
    raw = zstandard.ZstdDecompressor().decompress(payload, max_output_size=max(sum(lens), 1)) if sum(lens) else b""
    ends = np.cumsum([0, *lens]).tolist()
    return [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def _planes(values: np.ndarray) -> bytes:
    """Differences of sorted hashes, byte by byte position: the high planes are zeros, which every codec removes."""
    first = np.diff(values, prepend=np.uint64(0))
    return np.ascontiguousarray(first.astype("<u8").view(np.uint8).reshape(-1, 8).T[:7]).tobytes()


def _from_planes(blob: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :7] = np.frombuffer(blob, np.uint8).reshape(7, n).T
    return np.cumsum(out.view("<u8").reshape(-1), dtype=np.uint64)


def ranked(h: np.ndarray, check: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Order of items by hash and then check, and in that order where a new hash or check begins."""
    order = np.argsort(h, kind="stable")
    new = np.concatenate([np.ones(min(1, len(h)), bool), h[order][1:] != h[order][:-1]])
    if check is not None and (other := check[order][1:] != check[order][:-1])[~new[1:]].any():
        order = np.lexsort((check, h))
        new[1:] = (h[order][1:] != h[order][:-1]) | (check[order][1:] != check[order][:-1])
    return order, new


def distinct_counts(h: np.ndarray, doc: np.ndarray, per_document: bool, check: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of distinct items, by hash and then check; the items, or documents, that have each; and each item's place."""
    order, new = ranked(h, check)
    place = np.cumsum(new) - 1
    counted = place
    if per_document and len(h):
        # The order is stable, so the items of one document are neighbours inside equal hashes.
        counted = place[new | np.concatenate([[True], doc[order][1:] != doc[order][:-1]])]
    where = np.empty(len(h), np.int64)
    where[order] = place
    return order[new], np.bincount(counted, minlength=int(new.sum())), where


def encode_count(count: np.ndarray) -> np.ndarray:
    """A count as one byte, in eighths of a doubling: 0 is exactly one, 8 is two.

    So counts are exact to 4.5 percent, and from 2**31.9 on the code no longer rises: enough to tell repeats from single
    items, and for a document frequency, whose logarithm alone is used.
    """
    return np.minimum(np.rint(8 * np.log2(np.maximum(count, 1))), 255).astype(np.uint8)


def decode_count(code: np.ndarray) -> np.ndarray:
    """The count that a byte stands for."""
    return np.exp2(code.astype(np.float64) / 8)


def count_buckets(packs: DataFrame) -> int:
    """A power of two that gives each bucket about ``BUCKET_HASHES`` hashes, from the bytes of all texts."""
    total = packs.select(F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x).alias("b")).agg(F.sum("b")).first()[0] or 0
    return min(MAX_BUCKETS, 1 << max(4, int(np.ceil(np.log2(max(1, total / 5 / BUCKET_HASHES))))))


def _blobs(h: np.ndarray, check: np.ndarray | None, count: np.ndarray, src: int, buckets: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Sorted, distinct hashes of ``bits`` bits with their checks and counts, as one row for each bucket that has any."""
    edges = np.arange(buckets + 1, dtype=np.uint64) << np.uint64(bits - int(np.log2(buckets)))
    at = np.searchsorted(h, edges)
    at[-1] = len(h)
    used = np.flatnonzero(np.diff(at))
    low = None if check is None else check.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_CHECK_BYTES]
    blobs, checks, many = [], [], []
    for b in used.tolist():
        own = slice(at[b], at[b + 1])
        blobs.append(_planes(h[own] - edges[b]))
        checks.append(b"" if low is None else low[own].tobytes())
        k = np.flatnonzero(count[own] > 1)
        many.append(np.stack([k, count[own][k]]).astype("<i8").tobytes())
    if len(used):
        columns = [pa.array(used, pa.int32()), pa.array(np.full(len(used), src), pa.int64()), pa.array(np.diff(at)[used], pa.int32()), *(pa.array(x, pa.binary()) for x in (blobs, checks, many))]
        yield pa.RecordBatch.from_arrays(columns, ["bucket", "src", "n", "hashes", "checks", "many"])


def _read_blobs(table: pa.Table) -> tuple[np.ndarray, np.ndarray | None, np.ndarray, np.ndarray]:
    """Hashes, checks and counts of all rows, and where each row's begin."""
    ns = table["n"].to_numpy()
    h = np.concatenate([np.empty(0, np.uint64), *(_from_planes(x.as_py(), n) for x, n in zip(table["hashes"], ns.tolist(), strict=True))])
    low = np.frombuffer(b"".join(table["checks"].to_pylist()), np.uint8).reshape(-1, _CHECK_BYTES)
    check = np.pad(low, ((0, 0), (0, 8 - _CHECK_BYTES))).view("<u8").reshape(-1) if len(low) else None
    count, start = np.ones(len(h), np.int64), np.cumsum(np.append(0, ns))
    for x, at in zip(table["many"], start.tolist(), strict=False):
        k, c = np.frombuffer(x.as_py(), "<i8").reshape(2, -1)
        count[at + k] = c
    return h, check, count, start


def _code_table(table: pa.Table, codes: np.ndarray, start: np.ndarray) -> pa.Table:
    parts = pa.array([codes[a:b].tobytes() for a, b in zip(start, start[1:], strict=False)], pa.binary())
    return pa.table({"src": table["src"], "bucket": table["bucket"], "codes": parts})


def _add_up(blobs: DataFrame) -> DataFrame:
    """(src, bucket, codes): for each row of ``blobs`` the counts of its hashes over all rows of its bucket."""

    def add(table: pa.Table) -> pa.Table:
        table = table.sort_by("src").combine_chunks()
        h, check, count, start = _read_blobs(table)
        order, new = ranked(h, check)
        at = np.flatnonzero(new)
        total = np.add.reduceat(count[order], at)
        codes = np.empty(len(h), np.uint8)
        codes[order] = np.repeat(encode_count(total), np.diff(np.append(at, len(h))))
        return _code_table(table, codes, start)

    return blobs.groupBy("bucket").applyInArrow(add, CODE_SCHEMA)


def _by_way_of_groups(blobs: DataFrame, n_packs: int, buckets: int, bits: int) -> DataFrame:
    """As `_add_up`, by a second exchange: ``blobs`` have few coarse buckets, and ``buckets`` finer ones follow inside each.

    About as many packs as there are finer buckets form a group inside a coarse bucket. A group is to the finer buckets
    what a pack is to the coarse ones, and splits their answer among its packs again. So a row of either exchange holds
    about as many hashes whatever the size of the corpus, and rows grow in proportion to it.
    """
    chunks = max(1, -(-n_packs // buckets))
    grouped = blobs.withColumn("group", F.col("bucket").cast("long") * chunks + F.pmod(F.xxhash64("src"), F.lit(chunks)))
    grouped = write_table(grouped, "grouped", "uncompressed")

    def refine(table: pa.Table) -> pa.Table:
        coarse, group = table["bucket"][0].as_py(), table["group"][0].as_py()
        h, check, count, _ = _read_blobs(table)
        first, _, place = distinct_counts(h, np.empty(0, np.int64), False, check)
        rows = list(_blobs(h[first], None if check is None else check[first], np.bincount(place, count, len(first)).astype(np.int64), group, buckets, bits))
        made = pa.Table.from_batches(rows)
        return made.set_column(0, "bucket", pc.add(made["bucket"], pa.scalar(coarse * buckets, pa.int32())))

    def hand_back(table: pa.Table, codes: pa.Table) -> pa.Table:
        table = table.sort_by("src").combine_chunks()
        h, check, _, start = _read_blobs(table)
        answer = np.frombuffer(b"".join(codes.sort_by("bucket")["codes"].to_pylist()), np.uint8)
        return _code_table(table, answer[distinct_counts(h, np.empty(0, np.int64), False, check)[2]], start)

    codes = _add_up(grouped.groupBy("group").applyInArrow(refine, BLOB_SCHEMA)).withColumnRenamed("src", "group")
    return grouped.groupBy("group").cogroup(codes.groupBy("group")).applyInArrow(hand_back, CODE_SCHEMA)


def count_hashes(packs: DataFrame, hasher: Hasher, bits: int, per_document: bool) -> DataFrame:
    """(src, bucket, codes): for each pack the corpus-wide counts of its distinct hashes, ascending by hash and check.

    ``per_document`` counts documents, else occurrences. Hashes are below ``2**bits``, at most 56 bits. Where packs times
    buckets would make rows of fewer than ``ROW_HASHES`` hashes, hashes go to their buckets in two exchanges.
    """
    if bits > 56:
        raise ValueError("at most 56 bits")
    buckets = count_buckets(packs)
    coarse = buckets if PACK_BYTES / 5 / buckets >= ROW_HASHES else 1 << (int(np.log2(buckets)) + 1) // 2

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                h, check, doc = hasher(unpack(row["lens"], row["payload"]))
                first, count, _ = distinct_counts(h, doc, per_document, check)
                yield from _blobs(h[first], None if check is None else check[first], count, row["src"], coarse, bits)

    blobs = packs.select("src", "doc_ids", "lens", "payload").mapInArrow(spread, BLOB_SCHEMA)
    if coarse < buckets:
        codes = _by_way_of_groups(blobs, packs.count(), buckets // coarse, bits - int(np.log2(coarse)))
    else:
        codes = _add_up(blobs)
    return write_table(codes, "counts")


def with_counts(packs: DataFrame, counts: DataFrame, fn: Callable[[list, list[bytes], np.ndarray], pa.Table], schema: str) -> DataFrame:
    """Apply ``fn(doc_ids, texts, codes)`` to each pack; ``codes`` are those of its distinct hashes, by hash and check."""

    def apply(pack: pa.Table, codes: pa.Table) -> pa.Table:
        found = codes.sort_by("bucket")["codes"].to_pylist()
        merged = np.frombuffer(b"".join(found), np.uint8)
        parts = [fn(r["doc_ids"], unpack(r["lens"], r["payload"]), merged) for r in pack.to_pylist()]
        return pa.concat_tables(parts) if parts else None

    return packs.groupBy("src").cogroup(counts.groupBy("src")).applyInArrow(apply, schema)
