"""Removal of word sequences that occur more than once in a corpus.

Every window of ``width`` consecutive words gets two Rabin-Karp hashes of different bases, 96 bits in all, and Spark counts
them over the whole corpus. Two different windows agree by chance once in 2**96 pairs: with the 6e9 windows of 30 GB, or
the 2e13 of 100 TB, not one is expected to be taken for a repeat (2e-10 and 0.003).
Windows counted twice or more are repeated; those of one document that touch or overlap merge into maximal removal
intervals. All copies go, the first included.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from catsim.llm.packs import CHECK_BITS, count_hashes, distinct_counts, pack_documents, with_counts
from catsim.llm.storage import doc_type
from catsim.llm.tokens import Words, doc_windows, hash_spans, mix, split_words, window_hashes

WINDOW = 35
BITS = 56
_MASK, _CHECK_MASK = np.uint64((1 << BITS) - 1), np.uint64((1 << CHECK_BITS) - 1)
_CHECK_BASE = 0x369DEA0F31A53F85
DIGEST_SCHEMA = "n_words long, n_removed long, kept_sha256 string"
TEXT_SCHEMA = "n_words long, n_removed long, intervals array<struct<start:long,end:long>>, text string"


def _windows(texts: list[bytes], width: int) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """The words of some texts, and hash, check and first word of every window."""
    words = split_words(texts)
    codes = hash_spans(words.buf, words.starts, words.ends)
    h, at = doc_windows(words, codes, width)
    return words, h & _MASK, window_hashes(mix(codes), width, _CHECK_BASE)[at] & _CHECK_MASK, at


def _removed(texts: list[bytes], codes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Word counts of the texts, and for every word whether a repeated window covers it."""
    words, h, check, at = _windows(texts, width)
    gone = np.zeros(len(words.starts) + 1, np.int64)
    if codes.any():
        first = at[(codes > 0)[distinct_counts(h, words.doc[at], False, check)[2]]]
        gone[first] += 1
        gone[first + width] -= 1
    return words.counts, np.cumsum(gone[:-1]) > 0


def _counted(docs: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    if width < 1:
        raise ValueError("width must be at least 1")
    packs = pack_documents(docs)

    def hasher(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words, h, check, at = _windows(texts, width)
        return h, check, words.doc[at]

    return packs, count_hashes(packs, hasher, BITS, per_document=False)


def remove_repeats(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, intervals, text): each document without its repeated passages.

    ``intervals`` are the removed runs in word positions, end exclusive; ``text`` has the kept words joined by one space.
    A null or empty text gives zero words and an empty text; a text shorter than the window loses nothing; a very long one
    is a pack of its own; repeated rows repeat each other's windows, and all copies go alike; columns other than doc_id and text are ignored; an empty table gives no rows.
    """

    kind = to_arrow_type(docs.schema["doc_id"].dataType)

    def rows(ids: list, texts: list[bytes], codes: np.ndarray) -> pa.Table:
        counts, gone = _removed(texts, codes, width)
        out: dict[str, list] = {"doc_id": [], "n_words": [], "n_removed": [], "intervals": [], "text": []}
        at = 0
        for doc_id, text, n in zip(ids, texts, counts.tolist(), strict=True):
            mask = gone[at : at + n]
            at += n
            edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
            out["doc_id"].append(doc_id)
            out["n_words"].append(n)
            out["n_removed"].append(int(mask.sum()))
            out["intervals"].append([{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()])
            out["text"].append(b" ".join(compress(text.split(), (~mask).tolist())).decode())
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        kinds = [kind, pa.int64(), pa.int64(), pa.list_(span), pa.string()]
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds, strict=True)})

    return with_counts(*_counted(docs, width), rows, f"doc_id {doc_type(docs)}, {TEXT_SCHEMA}")


def removal_digests(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """As `remove_repeats`, with the SHA-256 of the kept words joined by one space instead of the text itself."""

    kind = to_arrow_type(docs.schema["doc_id"].dataType)

    def rows(ids: list, texts: list[bytes], codes: np.ndarray) -> pa.Table:
        counts, gone = _removed(texts, codes, width)
        ends = np.cumsum(counts)
        removed = np.add.reduceat(np.append(gone, False).astype(np.int64), np.minimum(ends - counts, len(gone))) if len(ids) else ends
        removed = np.where(counts > 0, removed, 0)
        digests = []
        for text, n, end, lost in zip(texts, counts.tolist(), ends.tolist(), removed.tolist(), strict=True):
            kept = text.split()
            if lost:
                kept = compress(kept, (~gone[end - n : end]).tolist())
            digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        return pa.table(
            {
                "doc_id": pa.array(ids, kind),
                "n_words": pa.array(counts, pa.int64()),
                "n_removed": pa.array(removed, pa.int64()),
                "kept_sha256": pa.array(digests, pa.string()),
            }
        )

    return with_counts(*_counted(docs, width), rows, f"doc_id {doc_type(docs)}, {DIGEST_SCHEMA}")


#: Windows as the texts of their words; a word holds no white space, so the joined words tell windows apart.
ORACLE_SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), w AS (
    SELECT row, i, array_to_string(words[i:i + 34], ' ') AS win FROM (SELECT row, words, unnest(range(1, len(words) - 33)) AS i FROM d WHERE len(words) >= 35)
), twice AS (
    SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY win) AS n FROM w) WHERE n > 1
), gone AS (
    SELECT row, list(DISTINCT i + k) AS places FROM (SELECT row, i, unnest(range(0, 35)) AS k FROM twice) GROUP BY row
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(len(places), 0)::BIGINT AS n_removed,
    sha256(array_to_string(CASE WHEN places IS NULL THEN words ELSE list_select(words, list_filter(range(1, len(words) + 1), lambda j: NOT list_contains(places, j))) END, ' ')) AS kept_sha256
FROM d LEFT JOIN gone USING (row)
"""
