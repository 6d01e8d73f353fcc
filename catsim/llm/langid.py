"""Language identification by a small convolutional network over bytes.

Texts are cut into windows of ``WINDOW`` bytes. Filters of several widths run over the embedded bytes of a window, each
keeps its maximum, and a softmax layer turns the maxima into languages; a document averages the log-odds of its windows
by their bytes. The network is trained in numpy on a bounded sample of labelled texts. To apply it, embedding and filters
are folded into tables over byte pairs, so that a window costs look-ups and maxima instead of products.
"""

from __future__ import annotations

import zlib
from collections.abc import Collection, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catsim.llm.storage import bounded, bounded_sample, column, doc_type, free_name, id_and_text

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS, EMBEDDING = 16, 8
#: Labelled documents that training sees at most, and windows from each.
TRAIN_DOCS, TRAIN_WINDOWS = 4000, 4
STEPS, BATCH, RATE = 600, 96, 4e-3
UNKNOWN = "und"
#: Between text in a known language, short ones of a word or two left out, and noise, which gets a hundredth.
MIN_SCORE = 0.3
#: One window in no language is made up for so many of the labelled ones.
NOISE_SHARE = 4
#: Windows that one look-up handles.
BLOCK = 48


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, WINDOW) bytes, filled up with zeros, with the text and the used bytes of each. An empty text has none."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    n = -(-lens // WINDOW)
    buf = np.frombuffer(b"".join(t + bytes(-len(t) % WINDOW) for t in texts), np.uint8).reshape(-1, WINDOW)
    doc = np.repeat(np.arange(len(texts)), n)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    return buf, doc, np.minimum(lens[doc] - nth * WINDOW, WINDOW)


def train(windows: np.ndarray, labels: np.ndarray, n_labels: int, seed: int = 0) -> dict[str, np.ndarray]:
    """Adam on the cross-entropy of random batches, in which half of the windows are cut to a random length."""
    rng = np.random.default_rng(seed)
    m = {"emb": rng.normal(0, 0.3, (256, EMBEDDING))}
    for w in WIDTHS:
        m[f"w{w}"] = rng.normal(0, 0.3, (w * EMBEDDING, FILTERS))
        m[f"b{w}"] = np.zeros(FILTERS)
    m["out"] = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, n_labels))
    m["bias"] = np.zeros(n_labels)
    first, second = ({k: np.zeros_like(v) for k, v in m.items()} for _ in range(2))
    share = np.bincount(labels, minlength=n_labels) ** -0.5
    odds = share[labels] / share[labels].sum()
    for step in range(1, STEPS + 1):
        pick = rng.choice(len(windows), BATCH, p=odds)
        x, y = windows[pick].copy(), labels[pick]
        cut = np.where(rng.random(BATCH) < 0.5, rng.integers(12, WINDOW, BATCH), WINDOW)
        x[np.arange(WINDOW)[None, :] >= cut[:, None]] = 0
        e = m["emb"][x]
        grad = {k: np.zeros_like(v) for k, v in m.items()}
        tops, kept = [], []
        for w in WIDTHS:
            cols = np.concatenate([e[:, j : WINDOW - w + 1 + j] for j in range(w)], axis=2)
            act = cols @ m[f"w{w}"] + m[f"b{w}"]
            at = act.argmax(axis=1)
            top = np.take_along_axis(act, at[:, None, :], 1)[:, 0]
            tops.append(np.maximum(top, 0))
            kept.append((at, cols))
        hidden = np.concatenate(tops, axis=1)
        logits = hidden @ m["out"] + m["bias"]
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(BATCH), y] -= 1
        p /= BATCH
        grad["out"], grad["bias"] = hidden.T @ p, p.sum(axis=0)
        back = (p @ m["out"].T) * (hidden > 0)
        rows = np.arange(BATCH)[:, None]
        for k, (w, (at, cols)) in enumerate(zip(WIDTHS, kept, strict=True)):
            d = back[:, k * FILTERS : (k + 1) * FILTERS]
            grad[f"b{w}"] = d.sum(axis=0)
            seen = cols[rows, at]
            grad[f"w{w}"] = np.einsum("nfc,nf->cf", seen, d)
            to = d[:, :, None] * m[f"w{w}"].T[None]
            for j in range(w):
                np.add.at(grad["emb"], x[rows, at + j].ravel(), to[:, :, j * EMBEDDING : (j + 1) * EMBEDDING].reshape(-1, EMBEDDING))
        rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
        for k in m:
            first[k] = 0.9 * first[k] + 0.1 * grad[k]
            second[k] = 0.999 * second[k] + 0.001 * grad[k] ** 2
            m[k] = m[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return {k: v.astype(np.float32) for k, v in m.items()}


class Network:
    """A trained network as look-up tables."""

    def __init__(self, m: dict[str, np.ndarray]) -> None:
        part = {(w, j): m["emb"] @ m[f"w{w}"][j * EMBEDDING : (j + 1) * EMBEDDING] for w in WIDTHS for j in range(w)}
        pair = lambda w, j: (part[w, j][:, None] + part[w, j + 1][None, :]).reshape(65536, FILTERS)
        self.pairs = np.ascontiguousarray(np.concatenate([pair(2, 0), pair(3, 0), pair(4, 0), pair(4, 2)], axis=1))
        self.third = np.ascontiguousarray(part[3, 2])
        self.bias = np.concatenate([m[f"b{w}"] for w in WIDTHS])
        self.out, self.out_bias = m["out"], m["bias"]

    def logits(self, windows: np.ndarray) -> np.ndarray:
        """(windows, languages) log-odds."""
        f = FILTERS
        hidden = np.empty((len(windows), 3 * f), np.float32)
        for lo in range(0, len(windows), BLOCK):
            x = windows[lo : lo + BLOCK].astype(np.intp)
            g = np.take(self.pairs, (x[:, :-1] << 8) | x[:, 1:], axis=0)
            top = hidden[lo : lo + BLOCK]
            top[:, :f] = g[:, :, :f].max(axis=1)
            top[:, f : 2 * f] = (g[:, :-1, f : 2 * f] + np.take(self.third, x[:, 2:], axis=0)).max(axis=1)
            top[:, 2 * f :] = (g[:, :-2, 2 * f : 3 * f] + g[:, 2:, 3 * f :]).max(axis=1)
        return np.maximum(hidden + self.bias, 0) @ self.out + self.out_bias


def held_out_row(mod: int, rest: int) -> Column:
    """Whether crc32 of doc_id as text leaves ``rest``; false without doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % mod == rest, F.lit(False))


def training_windows(docs: DataFrame, max_docs: int = TRAIN_DOCS) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows, label numbers and languages from at most ``max_docs`` labelled rows, drawn by a hash of doc_id and text.

    The windows of a row are seeded by its text, and rows come in the order of their hash, so that the model doesn't hang
    on the partitioning. Rows that share an id, or have none, are drawn by their texts; equal rows count once.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, text=0):
            texts = [x or b"" for x in batch.column(0).cast(pa.binary()).to_pylist()]
            starts = [np.random.default_rng(zlib.crc32(t)).integers(0, max(1, len(t) - WINDOW // 2), TRAIN_WINDOWS) for t in texts]
            parts = [[t[a : a + WINDOW] for a in s.tolist()] for t, s in zip(texts, starts, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.list_(pa.binary())), *batch.columns[1:]], ["parts", "lang", "draw"])

    labelled = docs.where(F.col("lang").isNotNull() & (F.length("text") > 0)).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    some = bounded_sample(labelled, ["doc_id", "text"], max_docs).select("text", "lang", F.xxhash64("doc_id", "text").alias("draw"))
    got = some.mapInArrow(cut, "parts array<binary>, lang string, draw long").toArrow().sort_by([("draw", "ascending"), ("lang", "ascending")])
    langs = sorted(set(got["lang"].to_pylist()))
    blobs = [b for parts in got["parts"].to_pylist() for b in parts]
    windows = np.frombuffer(b"".join(b + bytes(WINDOW - len(b)) for b in blobs), np.uint8).reshape(-1, WINDOW)
    labels = np.repeat(np.array([langs.index(x) for x in got["lang"].to_pylist()], np.int64), TRAIN_WINDOWS)
    return windows, labels, langs


def fit(docs: DataFrame, max_docs: int = TRAIN_DOCS) -> tuple[dict[str, np.ndarray], list[str]]:
    """A network and its languages from ``docs`` (doc_id, text, lang); without labelled rows, no languages.

    The network has one output more than languages, which stands for text in none of them.
    """
    windows, labels, langs = training_windows(docs, max_docs)
    if not langs:
        return {}, langs
    none = noise_windows(windows[:: NOISE_SHARE])
    return train(np.concatenate([windows, none]), np.concatenate([labels, np.full(len(none), len(langs))]), len(langs) + 1), langs


def noise_windows(windows: np.ndarray, seed: int = 1) -> np.ndarray:
    """Windows in no language, three in turn for ``windows``: their bytes shuffled, few random bytes, random signs of a script."""
    rng = np.random.default_rng(seed)
    out = []
    for k, window in enumerate(windows):
        if k % 3 == 0:
            made = rng.permutation(window[window > 0])
        elif k % 3 == 1:
            made = rng.choice(rng.choice(np.arange(32, 127, dtype=np.uint8), rng.integers(4, 70), replace=False), WINDOW)
        else:
            signs = rng.integers(0, rng.integers(20, 400), WINDOW) + rng.integers(0x370, 0xD000)
            spaced = np.where(rng.random(WINDOW) < 0.15, 32, signs)
            made = np.frombuffer("".join(map(chr, spaced.tolist())).encode()[:WINDOW], np.uint8)
        out.append(np.pad(made, (0, WINDOW - len(made))))
    return np.stack(out) if out else np.empty((0, WINDOW), np.uint8)


_NETWORKS: dict[bytes, Network] = {}


def _network(model: dict[str, np.ndarray]) -> Network:
    """The tables of a model, made once in a Python process."""
    key = b"".join(v.tobytes() for v in model.values())
    if key not in _NETWORKS:
        _NETWORKS.clear()
        _NETWORKS[key] = Network(model)
    return _NETWORKS[key]


def score_texts(texts: list, model: dict[str, np.ndarray], langs: list[str], none: bool = False) -> tuple[list[str], np.ndarray]:
    """Language and probability of each text; ``und`` and 0 where it is null or has no letter.

    The probability is that among the languages, or with ``none`` among those and text in none of them.
    """
    known = np.array([bool(langs) and t is not None and any(map(str.isalpha, t)) for t in texts], bool)
    if not known.any():
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    x, doc, used = windows_of([t.encode() if k else b"" for t, k in zip(texts, known.tolist(), strict=True)])
    logits = _network(model).logits(x).astype(np.float64)
    sums = np.stack([np.bincount(doc, used * c, len(texts)) for c in logits.T], axis=1)
    mean = sums / np.maximum(np.bincount(doc, used, len(texts)), 1)[:, None]
    p = np.exp(mean - mean.max(axis=1, keepdims=True))
    p = p[:, : len(langs)] / p[:, : None if none else len(langs)].sum(axis=1, keepdims=True)
    names = [langs[k] if ok else UNKNOWN for k, ok in zip(p.argmax(axis=1).tolist(), known.tolist(), strict=True)]
    return names, np.where(known, p.max(axis=1), 0.0)


def predict(docs: DataFrame, model: dict[str, np.ndarray], langs: list[str]) -> DataFrame:
    """(doc_id, lang_pred, score) for each row of ``docs`` (doc_id, text).

    A text that is null or has no letter gets ``und`` and score 0, as does every text if no language was learned; of
    languages that are equally likely the first by name is taken. A very long text is all its windows. Equal texts, and so
    repeated rows, get equal results; further columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            names, scores = score_texts(batch.column(1).to_pylist(), model, langs)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return id_and_text(docs).mapInArrow(run, f"doc_id {doc_type(docs)}, lang_pred string, score double")


def identify(docs: DataFrame, mod: int = 4, rest: int = 2, max_docs: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): a network learned from the rows not held out, applied to all rows."""
    model, langs = fit(docs.where(~held_out_row(mod, rest)), max_docs)
    return predict(docs, model, langs).select("doc_id", held_out_row(mod, rest).alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, languages: Collection[str] | None = None, min_score: float = MIN_SCORE, **params) -> DataFrame:
    """Rows of ``docs`` whose text gets a language, one of ``languages`` if they are given, with at least ``min_score``.

    Noise and text in other scripts or languages has a class of its own, which no row is kept for.

    ``lang`` is filled in where it was null; all other columns, whatever their names, are unchanged. Null and empty texts,
    texts without a letter and, if no language was learned, all rows go. Equal texts, and so repeated rows, stay or go
    together; a very long text is judged by all its windows; an empty table gives no rows.
    """
    model, langs = fit(docs.where(~held_out_row(4, 2)), **params)

    @F.pandas_udf("string")
    def told(texts):
        import pandas as pd

        out: list[str | None] = []
        for batch in bounded(iter([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])]), text=0):
            names, scores = score_texts(batch.column(0).to_pylist(), model, langs, none=True)
            sure = [n != UNKNOWN and s >= min_score and (languages is None or n in languages) for n, s in zip(names, scores.tolist(), strict=True)]
            out += [n if ok else None for n, ok in zip(names, sure, strict=True)]
        return pd.Series(out, dtype=object)

    name = free_name("told", docs)
    # Said to be nondeterministic, so that Spark doesn't run the network once for the filter and once for the column.
    kept = docs.withColumn(name, told.asNondeterministic()("text")).where(F.col(name).isNotNull())
    kind = docs.schema["lang"].dataType
    return kept.withColumn("lang", F.coalesce("lang", F.col(name).cast(kind))).select(*map(column, docs.columns))
