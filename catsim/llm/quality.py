"""Quality rules as a short-circuit cascade.

Base figures of every text are counted first. The rules that follow are run one after the other, each only on the
documents that no earlier rule has rejected, in the order of rejections per second of cost, which are measured for every
rule on a bounded sample spread over the whole table by a hash of id and text. The order changes cost alone: a document is
kept if no rule rejects it.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catsim.llm.storage import bounded, bounded_sample, doc_type, id_and_text
from catsim.llm.tokens import Words, doc_windows, hash_spans, mix, split_words

WINDOW = 5
SAMPLE_DOCS = 2000
SYMBOLS = b"#*$%&|<>"
_IS_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS, np.uint8))
_IS_START = (np.arange(256) & 0xC0) != 0x80
_IS_LETTER = np.array([chr(b).isalpha() if b < 128 else True for b in range(256)])
SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean"
)


@dataclass
class Batch:
    """Texts, their words, hashes of those, and the base figures of each text."""

    texts: list[bytes]
    words: Words
    codes: np.ndarray
    figures: dict[str, np.ndarray]

    def of(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the words of some texts."""
        ends = np.cumsum(self.words.counts)
        return np.concatenate([np.arange(e - n, e) for e, n in zip(ends[rows], self.words.counts[rows], strict=True)] or [np.empty(0, np.int64)])


def _per_text(words: Words, texts: list[bytes], marks: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(marks)])
    return total[words.doc_starts + np.fromiter(map(len, texts), np.int64, len(texts))] - total[words.doc_starts]


def _repeated(words: Words, codes: np.ndarray, width: int) -> np.ndarray:
    """For each text the words inside windows that the text has twice or more, the first included."""
    h, at = doc_windows(words, codes, width)
    key = mix(h + words.doc[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = at[order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]] if len(key) else at
    cover = np.zeros(len(codes) + 1, np.int64)
    cover[twice] += 1
    cover[twice + width] -= 1
    return np.bincount(words.doc[np.cumsum(cover[:-1]) > 0], minlength=len(words.counts))


def _dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def measure(texts: list[bytes]) -> Batch:
    """Base figures of some texts."""
    words = split_words(texts)
    codes = hash_spans(words.buf, words.starts, words.ends)
    raw = np.frombuffer(words.buf, np.uint8)
    white = np.zeros(256, bool)
    white[[9, 10, 11, 12, 13, 32]] = True
    return Batch(
        texts,
        words,
        codes,
        {
            "n_words": words.counts,
            "word_chars": _per_text(words, texts, (_IS_START & ~white)[raw]),
            "n_symbols": _per_text(words, texts, _IS_SYMBOL[raw]),
            "n_dup_lines": np.fromiter(map(_dup_lines, texts), np.int64, len(texts)),
            "n_repeat_words": _repeated(words, codes, WINDOW),
        },
    )


def base_failed(figures: dict[str, np.ndarray]) -> np.ndarray:
    return (figures["n_words"] < 10) | (100 * figures["n_repeat_words"] > 20 * figures["n_words"])


def _symbols(batch: Batch, rows: np.ndarray) -> np.ndarray:
    return 5 * batch.figures["n_symbols"][rows] > batch.figures["n_words"][rows]


def _dup_line_words(batch: Batch, rows: np.ndarray) -> np.ndarray:
    lines = np.array([sum(1 for x in batch.texts[r].split(b"\n") if x.strip()) for r in rows.tolist()], np.int64)
    return 2 * batch.figures["n_dup_lines"][rows] > lines


def _word_length(batch: Batch, rows: np.ndarray) -> np.ndarray:
    n, chars = batch.figures["n_words"][rows], batch.figures["word_chars"][rows]
    return (chars < 2 * n) | (chars > 15 * n)


def _letters(batch: Batch, rows: np.ndarray) -> np.ndarray:
    words, raw, got = batch.words, np.frombuffer(batch.words.buf, np.uint8), np.zeros(len(rows), np.int64)
    ends = np.cumsum(words.counts)
    for i, r in enumerate(rows.tolist()):
        at, begin = slice(ends[r] - words.counts[r], ends[r]), words.doc_starts[r]
        total = np.concatenate([[0], np.cumsum(_IS_LETTER[raw[begin : begin + len(batch.texts[r])]], dtype=np.int64)])
        got[i] = np.count_nonzero(total[words.ends[at] - begin] > total[words.starts[at] - begin])
    return 2 * got < batch.figures["n_words"][rows]


def _variety(batch: Batch, rows: np.ndarray) -> np.ndarray:
    at = batch.of(rows)
    key = np.unique(mix(batch.codes[at] + batch.words.doc[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), return_index=True)[1]
    distinct = np.bincount(batch.words.doc[at][key], minlength=len(batch.texts))[rows]
    return 20 * distinct < batch.figures["n_words"][rows]


#: Whether a rule rejects each of some rows of a batch. More than one symbol to five words; more than half of the lines
#: copies of earlier ones; words of under 2 or over 15 characters on average; fewer than half of the words with an ASCII
#: letter or any character beyond ASCII; fewer distinct words than a twentieth of all.
RULES: dict[str, Callable[[Batch, np.ndarray], np.ndarray]] = {
    "symbols": _symbols,
    "duplicate_lines": _dup_line_words,
    "word_length": _word_length,
    "letters": _letters,
    "variety": _variety,
}


def _texts(batch: pa.RecordBatch, column: int) -> list[bytes]:
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def rule_report(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(rule, seen, rejected, seconds) on a sample of at most ``sample_docs`` rows, drawn by a hash of doc_id and text.

    Every rule is run on each sampled row that passes the base rule. Rows that share an id, or have none, are drawn by
    their texts; equal rows count once.
    """

    def trial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            got = measure(_texts(batch, 1))
            rows = np.flatnonzero(~base_failed(got.figures))
            out: list[tuple[str, int, int, float]] = []
            for name, rule in RULES.items():
                began = time.perf_counter()
                rejected = int(rule(got, rows).sum())
                out.append((name, len(rows), rejected, time.perf_counter() - began))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.float64()]
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["rule", "seen", "rejected", "seconds"])

    rows = bounded_sample(id_and_text(docs), ["doc_id", "text"], sample_docs, 17)
    trials = rows.mapInArrow(trial, "rule string, seen long, rejected long, seconds double")
    return trials.groupBy("rule").agg(F.sum("seen").alias("seen"), F.sum("rejected").alias("rejected"), F.sum("seconds").alias("seconds"))


def rule_order(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> list[str]:
    """Rules by rejections per second on the sample, the best first; those that the sample says nothing of come last."""
    found = {r["rule"]: r["rejected"] / max(r["seconds"], 1e-9) for r in rule_report(docs, sample_docs).collect()}
    return sorted(RULES, key=lambda name: -found.get(name, 0.0))


def judge(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """(doc_id, base figures, base_failed, kept) for each row of ``docs``, as in `SCHEMA`.

    A null or empty text has no words and fails the base rule; a very long one is measured whole. Rows are independent of each other, so repeated rows give
    equal results; columns other than doc_id and text are ignored; an empty table gives no rows.
    """
    order = rule_order(docs) if order is None else order

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            got = measure(_texts(batch, 1))
            failed = base_failed(got.figures)
            kept = ~failed
            for name in order:
                rows = np.flatnonzero(kept)
                if len(rows):
                    kept[rows[RULES[name](got, rows)]] = False
            figures = [pa.array(got.figures[k], pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
            names = ["doc_id", *(f.split()[0] for f in SCHEMA.split(", "))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *figures, pa.array(failed), pa.array(kept)], names)

    return id_and_text(docs).mapInArrow(run, f"doc_id {doc_type(docs)}, {SCHEMA}")


ORACLE_SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
    SELECT row, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
    FROM d
), g AS (
    SELECT row, i, words[i] || chr(10) || words[i + 1] || chr(10) || words[i + 2] || chr(10) || words[i + 3] || chr(10) || words[i + 4] AS win
    FROM (SELECT row, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)
), twice AS (
    SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, win) AS n FROM g) WHERE n > 1
), covered AS (
    SELECT row, count(DISTINCT i + k) AS n_repeat_words FROM twice, (SELECT unnest(range(0, 5)) AS k) GROUP BY row
), base AS (
    SELECT w.row, doc_id, len(words) AS n_words,
        coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        len(lines) - len(list_distinct(lines)) AS n_dup_lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines,
        len(list_distinct(words)) AS n_distinct,
        len(list_filter(words, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS n_letters
    FROM w LEFT JOIN covered USING (row)
), judged AS (
    SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND NOT (5 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR word_chars < 2 * n_words
        OR word_chars > 15 * n_words OR 2 * n_letters < n_words OR 20 * n_distinct < n_words) AS kept
FROM judged
"""
