"""Periodic runs of words: stretches that repeat their first words again and again.

A run is a stretch of consecutive words with smallest period q (words q apart are the same) that no neighbouring word
extends, of at least ``min_length`` words and ``min_exponent`` periods. Runs come from the vocabulary of tandem repeats
(`catsim.llm.repeats`) of those stretches of a text that could hold a run at all: each word of a run occurs at least
``min_exponent`` times in its text, and each three neighbouring words at least once less. Words are compared as they are.

A text is handled whole, in one task. Python needs about 10 microseconds and some hundred bytes for each word of the
stretches that are left, and little for the others.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catsim.llm.crc_sql import TABLE, crc32
from catsim.llm.repeats import runs
from catsim.llm.storage import bounded, doc_type, id_and_text

MIN_LENGTH, MIN_EXPONENT = 6, 4
WORD = r"[^\x20\x09-\x0D]+"
RUN = "struct<start: bigint, length: bigint, period: bigint>"
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _stretches(codes: np.ndarray, min_length: int, min_exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of ``codes`` that may hold runs.

    Three words are counted by buckets of a hash, and then by the hash itself: collisions only keep more.
    """
    often = np.bincount(codes)[codes] >= min_exponent
    at = np.flatnonzero(often[:-2] & often[1:-1] & often[2:])
    least = min(min_exponent - 1, min_length - 2)
    key = sum(codes[at + i].astype(np.uint64) * m for i, m in enumerate(_MIX))
    bits = min(22, max(10, len(at).bit_length() + 1))
    bucket = (key >> np.uint64(64 - bits)).astype(np.int64)
    some = np.bincount(bucket, minlength=1 << bits)[bucket] >= least
    at, key = at[some], key[some]
    _, which, n = np.unique(key, return_inverse=True, return_counts=True)
    at = at[n[which] >= least]
    covered = np.zeros(len(codes) + 2, np.int8)
    for i in range(3):
        covered[at + 1 + i] = 1
    edges = np.flatnonzero(np.diff(covered))
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= min_length
    return starts[long], ends[long]


def text_runs(words: list[list[bytes]], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[np.ndarray]:
    """Rows (start, length, period), by start and period, of the runs of each list of words."""
    parts, firsts, fresh, at = [], [], 0, 0
    for w in words:
        # Each text has codes of its own, and one more at its end that is nowhere else.
        known = dict(zip(dict.fromkeys(w), count(fresh)))
        fresh += len(known) + 1
        parts += [np.fromiter(map(known.__getitem__, w), np.int64, len(w)), np.array([fresh - 1])]
        firsts.append(at)
        at += len(w) + 1
    none = np.empty((0, 3), np.int64)
    if at < 3:
        return [none] * len(words)
    codes = np.concatenate(parts)
    starts, ends = _stretches(codes, min_length, min_exponent)
    if not len(starts):
        return [none] * len(words)
    found = runs([codes[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], min_length, min_exponent)
    place = found[:, 1] + starts[found[:, 0]]
    of = np.searchsorted(firsts, place, "right") - 1
    rows = np.stack([place - np.array(firsts)[of], found[:, 2], found[:, 3]], axis=1)
    return np.split(rows, np.searchsorted(of, np.arange(1, len(words))))


def _kept(words: list[bytes], found: np.ndarray) -> list[bytes]:
    """Words that no run holds after its first period."""
    if not len(found):
        return words
    drop = np.zeros(len(words) + 1, np.int64)
    start, length, period = found.T
    np.add.at(drop, start + period, 1)
    np.add.at(drop, start + length, -1)
    return [w for w, d in zip(words, np.cumsum(drop[:-1]).tolist(), strict=True) if not d]


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for each row of ``docs`` (doc_id, text): the runs of its text as an array of (start,
    length, period) by start and period, start counting words from 0, and the text that keeps only the first period of
    each run, its words joined by one space.

    A null or blank text has no words, no runs and an empty collapsed text. Rows that share an id, and equal rows, are
    handled one by one; a very long text is one row of work. Empty tables give no rows and further columns are ignored.
    """
    if min_exponent < 2 or min_length < 4:
        raise ValueError("min_exponent is 2 or more and min_length 4 or more")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            words = [(t or b"").split() for t in batch.column(1).cast(pa.binary()).to_pylist()]
            found = text_runs(words, min_length, min_exponent)
            every = np.concatenate(found)
            structs = pa.StructArray.from_arrays([pa.array(c) for c in every.T], ["start", "length", "period"])
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])])
            texts = [b" ".join(_kept(w, f)) for w, f in zip(words, found, strict=True)]
            columns = [batch.column(0), pa.array(map(len, words), pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    return id_and_text(docs).mapInArrow(work, f"doc_id {doc_type(docs)}, n_words long, runs array<{RUN}>, collapsed string")


def most_repeated(runs: str | Column) -> Column:
    """The run of the greatest length over period, compared exactly; of equals the first, then that of the least period."""
    before = lambda a, b: F.when(a["length"] * b["period"] != b["length"] * a["period"], F.signum(b["length"] * a["period"] - a["length"] * b["period"])).when(
        a["start"] != b["start"], F.signum(a["start"] - b["start"])).otherwise(F.signum(a["period"] - b["period"]))
    return F.get(F.array_sort(runs, lambda a, b: before(a, b).cast("int")), F.lit(0))


def with_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where the words of every tenth text, by the CRC-32 of its id, run on periodically from one of them.

    With h the CRC, g = h div 10 and n words, the word numbers from a = g mod n on become a + (i - a) mod p, where
    p = 1 + (n - a) div (3 + g mod 8). Other texts, texts without words and rows without id stay as they are.
    """
    div = lambda a, b: F.call_function("div", a, b)
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = F.when(h % 10 == 0, words)
    # Through a list of one, so that the words are split once.
    made = F.transform(F.filter(F.array(chosen), lambda w: F.size(w) > 0), lambda w: _tail(w, div(h, F.lit(10)), div))
    return id_and_text(docs).select("doc_id", F.coalesce(F.get(made, F.lit(0)), "text").alias("text"))


def _tail(words: Column, g: Column, div) -> Column:
    n = F.size(words).cast("long")
    first = g % n
    period = div(n - first, g % 8 + 3) + 1
    at = F.struct(first.alias("a"), period.alias("p"), words.alias("w"))
    place = lambda s, i: F.when(i < s["a"], i).otherwise(s["a"] + (i - s["a"]) % s["p"]).cast("int")
    return F.get(F.transform(F.array(at), lambda s: F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.size(s["w"]).cast("long") - 1), lambda i: F.get(s["w"], place(s, i))), " ")), F.lit(0))


def run_digests(docs: DataFrame) -> DataFrame:
    """One row for each document, of its text as `with_tails` makes it: number and digest of its runs, the most repeated one,
    and the digest of the collapsed text."""
    found = periodic_runs(with_tails(docs)).withColumn("best", most_repeated("runs"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    milli = F.call_function("div", F.col("best.length") * 1000, F.col("best.period"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", milli.alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


#: Every stretch of equal words q apart holds three equal neighbours, so pairs of places come from three words at a time.
ORACLE_SQL = rf"""
WITH {TABLE}, hashed AS (
    SELECT doc_id, {crc32("doc_id::VARCHAR")} AS h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents, crc
), chosen AS (
    SELECT *, h % 10 = 0 AND len(w) > 0 AS tail, (h // 10) % greatest(len(w), 1) AS a, 3 + (h // 10) % 8 AS parts FROM hashed
), word AS (
    SELECT doc_id, i, w[CASE WHEN tail AND i >= a THEN a + (i - a) % (1 + (len(w) - a) // parts) ELSE i END + 1] AS word
    FROM chosen, LATERAL (SELECT unnest(range(len(w))) AS i)
), three AS (
    SELECT doc_id, i, hash(word) AS one, hash(lead(word) OVER o) AS two, hash(lead(word, 2) OVER o) AS three FROM word WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), same AS (
    SELECT x.doc_id, x.i, y.i - x.i AS q FROM three x JOIN three y USING (doc_id, one, two, three)
    WHERE y.i > x.i AND 4 * (y.i - x.i) <= (SELECT len(w) FROM hashed WHERE hashed.doc_id = x.doc_id)
), island AS (
    SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS part FROM same
), stretch AS (
    SELECT doc_id, q, min(i) AS start, count(*) + 2 + q AS length FROM island GROUP BY doc_id, q, part
), run AS (
    SELECT doc_id, start, length, min(q) AS period FROM stretch WHERE length >= greatest(6, 4 * q) GROUP BY doc_id, start, length
), told AS (
    SELECT doc_id, count(*) AS n, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM run GROUP BY doc_id
), best AS (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) AS nth FROM run
), dropped AS (
    SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM run
), kept AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM word ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, coalesce(n, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
    sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM hashed LEFT JOIN told USING (doc_id) LEFT JOIN (SELECT * FROM best WHERE nth = 1) USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
