"""Packing documents into sequences of fixed length: bounded-space online best fit.

Each task tokenizes its documents and cuts off whole sequences of ``length`` tokens. The rest of a document goes into
the fullest of at most ``windows`` open windows that has room; if none has and all are in use, the fullest is emitted
and a new one opened. What is still open when a task ends is merged across tasks, best fit in descending order, some
dozens of tasks at a time.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catsim.llm.storage import bounded, doc_type, id_and_text, write_table
from catsim.llm.tokens import hash_spans, split_words

LENGTH = 4096
WINDOWS = 64
END_ID = 2
MERGE_TASKS = 64
#: Texts tokenized at once.
TEXTS = 1000
#: A text with which a tokenizer shows whether its ids are those of the words one by one.
PROBE = "Hello, world's 42 naïve cafés\tO'Neil don't x1y2 ...\n\nÉTÉ 日本語 👍 a_b  end"
#: White space that separates words here; what else the tokenizer takes for white space stays inside a word.
_SPACE = np.zeros(256, bool)
_SPACE[[10, 32]] = True
#: Parts of words kept with their ids in a task.
CACHE_WORDS = 300_000
PIECE_SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, left boolean"
#: Words on which normalizing is lower-casing alone, and the tokenizer's way to cut them.
_PLAIN_LINE = re.compile(r"[ -~À-ÖØ-öø-ÿ]+")
_PARTS = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


class WordIds:
    """Token ids of texts as little-endian unsigned 32-bit bytes, by way of the ids of their words.

    The tokenizer drops white space and never joins over it, so the ids of a text are those of its words. Words of common
    Latin letters are cut where the tokenizer cuts them, and new parts go to its model in lines, where a part ends with
    each token that the vocabulary marks as an end; all other words take the tokenizer's own way, one by one. A tokenizer
    of another kind, as `PROBE` shows, gets whole texts.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.model = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.model.normalizer = normalizers.Sequence([])
        split = [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        self.model.pre_tokenizer = pre_tokenizers.Sequence(split)
        vocabulary = self.tokenizer.get_vocab()
        self.is_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.is_end[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.parts: dict[str, bytes] = {}
        probe = [w for line in (PROBE, PROBE.lower(), " ".join(reversed(PROBE.split()))) for w in (line, line + " ")]
        self.by_word = self._by_word([t.encode() for t in probe]) == self._whole(probe)

    def _whole(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _learn_parts(self, parts: list[str]) -> None:
        lines = [parts[k : k + 500] for k in range(0, len(parts), 500)]
        encoded = self.model.encode_batch_fast([" ".join(x) for x in lines], add_special_tokens=False)
        for line, e in zip(lines, encoded, strict=True):
            ids = np.array(e.ids, "<u4")
            ends = (4 * (np.flatnonzero(self.is_end[ids]) + 1)).tolist()
            if len(ends) == len(line) and ends[-1] == 4 * len(ids):
                raw = ids.tobytes()
                self.parts.update(zip(line, (raw[a:b] for a, b in zip([0, *ends], ends, strict=False)), strict=True))
            else:
                self.parts.update(zip(line, self._whole(line), strict=True))

    def of_words(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words."""
        if not words:
            return []
        if len(self.parts) > CACHE_WORDS:
            self.parts = {}
        joined = " ".join(words)
        if _PLAIN_LINE.fullmatch(joined) and "<|" not in joined:
            cut = list(map(_PARTS.findall, joined.lower().split(" ")))
            self._learn_parts(list(set().union(*cut).difference(self.parts)))
            known = self.parts
            return [known[c[0]] if len(c) == 1 else b"".join([known[p] for p in c]) for c in cut]
        plain = [bool(_PLAIN_LINE.fullmatch(w)) and "<|" not in w for w in words]
        odd = iter(self._whole([w for w, p in zip(words, plain, strict=True) if not p]))
        even = iter(self.of_words([w for w, p in zip(words, plain, strict=True) if p]))
        return [next(even) if p else next(odd) for p in plain]

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """Ids of UTF-8 texts."""
        return self._by_word(texts) if self.by_word else self._whole([t.decode() for t in texts])

    def _by_word(self, texts: list[bytes]) -> list[bytes]:
        """Ids of texts by their words, each distinct word handled once."""
        words = split_words(texts, _SPACE)
        h = hash_spans(words.buf, words.starts, words.ends)
        _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        spans = zip(words.starts[first].tolist(), words.ends[first].tolist(), strict=True)
        got = self.of_words([words.buf[a:b].decode() for a, b in spans])
        sizes = np.fromiter(map(len, got), np.int64, len(got)) // 4
        store = np.frombuffer(b"".join(got), "<u4")
        n = sizes[inverse]
        upto = np.concatenate([[0], np.cumsum(n)])
        at = np.repeat((np.cumsum(sizes) - sizes)[inverse] - upto[:-1], n)
        raw = store[at + np.arange(len(at))].tobytes()
        ends = (4 * upto[np.concatenate([[0], np.cumsum(words.counts)])]).tolist()
        return [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def best_fit(open_: list[list], size: int, length: int) -> int:
    """Position of the fullest open window, given as [used, ...], that has room for ``size``; -1 if none has."""
    best, room = -1, length + 1
    for k, w in enumerate(open_):
        left = length - w[0] - size
        if 0 <= left < room:
            best, room = k, left
    return best


def pack_documents(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, windows: int = WINDOWS) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): the pieces of every row of ``docs``.

    A document is its token ids and then the id ``END_ID``, so a null or empty text is that id alone. Each id is in one
    piece, and the pieces of a sequence lie in it without gaps. Rows with equal or null doc_id, repeated rows included, are
    packed as separate documents; of windows that fit equally well the oldest is taken; a very long text is cut into whole
    sequences and a rest; columns other than doc_id and text are ignored; an empty table gives no rows.
    """
    end = np.array([END_ID], "<u4").tobytes()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(tokenizer_path)
        next_id = TaskContext.get().partitionId() << 32
        open_: list[list] = []
        rows: list[tuple] = []
        kinds: list[pa.DataType] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[] for _ in range(8)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "left"]
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
            rows.clear()
            return batch

        def close(window: list, left: bool) -> None:
            nonlocal next_id
            at = 0
            for piece in window[1]:
                rows.append((*piece, next_id, at, left))
                at += piece[2]
            next_id += 1

        for batch in bounded(batches):
            kinds = [batch.column(0).type, *[pa.int64()] * 6, pa.bool_()]
            docs_ids, texts = batch.column(0).to_pylist(), [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            for lo in range(0, len(texts), TEXTS):
                for doc_id, ids in zip(docs_ids[lo : lo + TEXTS], words.ids(texts[lo : lo + TEXTS]), strict=True):
                    ids += end
                    total = len(ids) // 4
                    cut = total - total % length
                    for at in range(0, total, length):
                        part = ids[4 * at : 4 * (at + length)]
                        piece = (doc_id, at, len(part) // 4, zlib.crc32(part), total)
                        if at < cut:
                            close([length, [piece]], False)
                            continue
                        k = best_fit(open_, piece[2], length)
                        if k < 0:
                            if len(open_) == windows:
                                close(open_.pop(max(range(windows), key=lambda i: open_[i][0])), False)
                            open_.append([0, []])
                            k = len(open_) - 1
                        open_[k][0] += piece[2]
                        open_[k][1].append(piece)
                        if open_[k][0] == length:
                            close(open_.pop(k), False)
            yield flush()
        for window in open_:
            close(window, True)
        if rows:
            yield flush()

    pieces = write_table(id_and_text(docs).mapInArrow(pack, f"doc_id {doc_type(docs)}, {PIECE_SCHEMA}"), "pieces")
    left = pieces.where("left")
    group = F.shiftright("sequence_id", 32).cast("long") / MERGE_TASKS
    sizes = left.groupBy("sequence_id").agg(F.sum("length").alias("used")).withColumn("group", F.floor(group))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["used", "sequence_id"], ascending=[False, True])
        bins: list[list] = []
        room: dict[int, list[int]] = {}
        to, base = [], []
        for seq, used in zip(pdf["sequence_id"], pdf["used"], strict=True):
            fit = next((r for r in range(used, length + 1) if room.get(r)), None)
            if fit is None:
                bins.append([0, seq])
                k = len(bins) - 1
            else:
                k = room[fit].pop()
            to.append(bins[k][1])
            base.append(bins[k][0])
            bins[k][0] += used
            room.setdefault(length - bins[k][0], []).append(k)
        return pd.DataFrame({"from": pdf["sequence_id"].to_numpy(), "to": to, "base": base})

    moved = sizes.groupBy("group").applyInPandas(merge, "from long, to long, base long")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    merged = left.join(moved, F.col("sequence_id") == F.col("from")).select(*columns, F.col("to").alias("sequence_id"), (F.col("base") + F.col("offset")).alias("offset"))
    return pieces.where("not left").select(*columns, "sequence_id", "offset").unionByName(merged)
