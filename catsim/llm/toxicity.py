"""Toxic spans by a linear-chain conditional random field.

Labels are given for documents, and the field learns from labelled tokens. A bounded sample of labelled documents gives
the tokens their labels: a word or word beginning that many different contexts of toxic documents have, and almost none
of the others, marks its tokens in toxic documents. The field has a hashed weight for a word and for its beginnings,
half of the tokens showing only the short ones in training so that new endings are known, and a 2 x 2 transition matrix.
Chains of clean text that share a beginning with marked tokens come first among the negative ones. Forward-backward over
the whole text gives each token's marginal, block by block of tokens with what the blocks before and after say of their borders; runs of tokens at 0.5 or more are the offending spans, and a logistic layer turns the largest
marginal, their sum and their share into the document's score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catsim.llm.storage import bounded, bounded_sample, doc_type, id_and_text
from catsim.llm.tokens import Words, hash_spans, mix, split_words

#: Labelled documents of the sample, at most; longer ones are left out of it (never out of scoring).
TRAIN_DOCS, TRAIN_BYTES = 4000, 1 << 15
#: A marking feature has at least so many contexts in toxic documents, and at most this share as many in others.
MIN_CONTEXTS, MAX_CLEAN = 6, 0.02
BUCKETS = 1 << 20
PREFIXES = (4, 5, 6, 7)
#: Tokens of a block. Training takes blocks as chains of their own; scoring carries the messages of a text over its blocks.
CHAIN = 64
CHAINS, EPOCHS, BATCH, RATE, DECAY = 20_000, 6, 256, 0.3, 1e-5
#: Words are runs of letters, digits and all characters beyond ASCII.
_SEPARATORS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
SCHEMA = "score double, spans array<struct<start:long,end:long>>"


def _words(texts: list[str]) -> tuple[Words, np.ndarray]:
    """Words in lower case; the one letter that would become two characters stays one, so that offsets hold."""
    words = split_words([t.replace("\u0130", "i").lower().encode() for t in texts], _SEPARATORS)
    return words, hash_spans(words.buf, words.starts, words.ends)


def _features(words: Words, at: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Feature hashes (words, 1 + prefixes) of some words; a word too short for a beginning repeats its own hash."""
    out = np.empty((len(at), 1 + len(PREFIXES)), np.uint64)
    out[:, 0] = h
    for k, n in enumerate(PREFIXES, 1):
        long_ = words.ends[at] - words.starts[at] > n
        start = words.starts[at]
        cut = mix(hash_spans(words.buf, start, np.minimum(start + n, words.ends[at])) + np.uint64(n))
        out[:, k] = np.where(long_, cut, h)
    return out


def _chains(counts: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chain and position of each word, and the lengths of the chains."""
    n = -(-counts // CHAIN)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    chain = np.repeat(np.cumsum(n) - n, counts) + nth // CHAIN
    return chain, nth % CHAIN, np.bincount(chain, minlength=int(n.sum()))


def _potentials(scores: np.ndarray) -> np.ndarray:
    return np.stack([np.ones_like(scores), np.exp(np.clip(scores, -30, 30))], axis=2)


def marginals(scores: np.ndarray, lengths: np.ndarray, trans: np.ndarray, enter: np.ndarray | None = None, leave: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over chains (chains, CHAIN) of scores of label 1: its marginals, and expected transitions.

    ``enter`` and ``leave`` (chains, 2) are the messages from before the first token and from behind the last one.
    """
    n, size = scores.shape
    psi = _potentials(scores)
    a = np.exp(trans)
    alpha, beta = np.empty((n, size, 2)), np.ones((n, size, 2))
    last = np.ones((n, 2)) if leave is None else leave
    beta[:, -1] = last
    alpha[:, 0] = psi[:, 0] if enter is None else psi[:, 0] * enter
    alpha[:, 0] /= alpha[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, size):
        step = (alpha[:, t - 1] @ a) * psi[:, t]
        alpha[:, t] = step / step.sum(axis=1, keepdims=True)
    expected = np.zeros((2, 2))
    for t in range(size - 2, -1, -1):
        live = (t + 1 < lengths)[:, None]
        ahead = psi[:, t + 1] * beta[:, t + 1]
        both = alpha[:, t, :, None] * a[None] * ahead[:, None, :]
        expected += (both / both.sum(axis=(1, 2), keepdims=True) * live[:, :, None]).sum(axis=0)
        step = ahead @ a.T
        beta[:, t] = np.where(live, step / step.sum(axis=1, keepdims=True), last)
    both = alpha * beta
    return both[:, :, 1] / both.sum(axis=2), expected


def _transfer(scores: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """For each block (blocks, CHAIN) of scores, what labels of its first token make of those of its last, up to a factor."""
    psi, a = _potentials(scores), np.exp(trans)
    out = np.zeros((len(scores), 2, 2))
    out[:, [0, 1], [0, 1]] = psi[:, 0]
    for t in range(1, scores.shape[1]):
        live = np.flatnonzero(lengths > t)
        step = (out[live] @ a) * psi[live, t, None, :]
        out[live] = step / step.sum(axis=(1, 2), keepdims=True)
    return out


def messages(transfer: np.ndarray, counts: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What enters each block from before and from behind, of texts of so many blocks (``counts``) one after the other."""
    a = np.exp(trans)
    enter, leave = np.ones((len(transfer), 2)), np.ones((len(transfer), 2))
    first = np.cumsum(counts) - counts
    for b in range(1, int(counts.max(initial=0))):
        forward = first[counts > b] + b
        step = np.einsum("ni,nij->nj", enter[forward - 1], transfer[forward - 1]) @ a
        enter[forward] = step / step.sum(axis=1, keepdims=True)
        back = (first + counts)[counts > b] - 1 - b
        step = np.einsum("nij,nj->ni", transfer[back + 1], leave[back + 1]) @ a.T
        leave[back] = step / step.sum(axis=1, keepdims=True)
    return enter, leave


def _token_labels(features: np.ndarray, before: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Whether each token carries a marking feature in a toxic document. Copies of a text share contexts and count once."""
    ratio = max((~toxic).sum(), 1) / max(toxic.sum(), 1)
    out = np.zeros(len(features), bool)
    for column in features.T:
        names, which = np.unique(column, return_inverse=True)
        context = mix(column ^ mix(before))
        counts = []
        for side in (toxic, ~toxic):
            _, first = np.unique(context[side], return_index=True)
            counts.append(np.bincount(which[side][first], minlength=len(names)))
        out |= ((counts[0] >= MIN_CONTEXTS) & (counts[1] <= MAX_CLEAN * ratio * counts[0]))[which]
    return out & toxic


def train(texts: list[str], toxic: np.ndarray, seed: int = 0) -> dict[str, np.ndarray]:
    """Weights of the field and of the logistic layer."""
    rng = np.random.default_rng(seed)
    words, h = _words(texts)
    features = _features(words, np.arange(len(h)), h)
    before = np.where(np.concatenate([[False], words.doc[1:] == words.doc[:-1]]), np.roll(h, 1), np.uint64(0)) if len(h) else h
    y = _token_labels(features, before, toxic[words.doc].astype(bool))
    slot = (features & np.uint64(BUCKETS - 1)).astype(np.int32)
    del features, before
    chain, pos, lengths = _chains(words.counts, words.doc)
    weight, trans, bias = np.zeros(BUCKETS), np.zeros((2, 2)), np.array([-2.0])
    speed = [np.full_like(w, 1e-3) for w in (weight, trans, bias)]
    marked = np.unique(chain[y])
    like = np.zeros(BUCKETS, bool)
    like[slot[y]] = True
    hard = np.setdiff1d(chain[like[slot].any(axis=1)], marked)
    rest = np.setdiff1d(np.arange(len(lengths)), np.concatenate([marked, hard]))
    others = np.concatenate([rng.permutation(hard), rng.permutation(rest)])
    pick = np.concatenate([rng.permutation(marked)[: CHAINS // 2], others[: CHAINS // 2]])
    starts = np.searchsorted(chain, np.arange(len(lengths) + 1))
    for epoch in range(EPOCHS if y.any() else 0):
        order = rng.permutation(pick)
        for lo in range(0, len(order), BATCH):
            own = order[lo : lo + BATCH]
            at = np.concatenate([np.arange(starts[c], starts[c + 1]) for c in own.tolist()])
            row = np.repeat(np.arange(len(own)), lengths[own])
            grid = np.zeros((len(own), CHAIN))
            seen_by = np.ones(slot[at].shape, bool)
            seen_by[rng.random(len(at)) < 0.5] = [n in (4, 5) for n in (0, *PREFIXES)]
            grid[row, pos[at]] = (weight[slot[at]] * seen_by).sum(axis=1) + bias[0]
            p, expected = marginals(grid, lengths[own], trans)
            off = p[row, pos[at]] - y[at]
            same = np.flatnonzero(row[1:] == row[:-1])
            seen = np.zeros((2, 2))
            np.add.at(seen, (y[at][same].astype(int), y[at][same + 1].astype(int)), 1)
            used, where = np.unique(slot[at], return_inverse=True)
            g = np.bincount(where.ravel(), (off[:, None] * seen_by).ravel(), len(used)) + DECAY * len(own) * weight[used]
            speed[0][used] += g**2
            weight[used] -= RATE * g / np.sqrt(speed[0][used])
            for k, (w, g) in enumerate(((trans, expected - seen), (bias, np.array([off.sum()]))), 1):
                speed[k] += g**2
                w -= RATE * g / np.sqrt(speed[k])
    used = np.flatnonzero(weight)
    model = {"slots": used, "weights": weight[used].astype(np.float32), "trans": trans, "bias": bias}
    x = _document_features(words, h, model)[0]
    model["top"] = _logistic(x, toxic.astype(float))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton's method with a ridge that leaves out the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(x.shape[1]), ridge * np.append(np.ones(x.shape[1] - 1), 1e-3)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
    return w


def _document_features(words: Words, h: np.ndarray, model: dict, table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Per document the largest marginal, the logarithm of one plus their sum, and their mean; and all marginals."""
    n = len(words.counts)
    if not len(h):
        return np.zeros((n, 3)), np.empty(0)
    table = _table(model) if table is None else table
    _, first, which = np.unique(h, return_index=True, return_inverse=True)
    slots = (_features(words, first, h[first]) & np.uint64(BUCKETS - 1)).astype(np.int64)
    score = (table[slots].sum(axis=1) + model["bias"][0])[which]
    chain, pos, lengths = _chains(words.counts, words.doc)
    p = np.empty(len(h))
    starts = np.searchsorted(chain, np.arange(len(lengths) + 1))
    blocks = [(lo, min(lo + 4096, len(lengths))) for lo in range(0, len(lengths), 4096)]

    def grid(lo: int, hi: int) -> tuple[np.ndarray, slice]:
        own = slice(starts[lo], starts[hi])
        made = np.zeros((hi - lo, CHAIN))
        made[chain[own] - lo, pos[own]] = score[own]
        return made, own

    transfer = np.concatenate([_transfer(grid(lo, hi)[0], lengths[lo:hi], model["trans"]) for lo, hi in blocks])
    enter, leave = messages(transfer, -(-words.counts // CHAIN), model["trans"])
    for lo, hi in blocks:
        scores, own = grid(lo, hi)
        p[own] = marginals(scores, lengths[lo:hi], model["trans"], enter[lo:hi], leave[lo:hi])[0][chain[own] - lo, pos[own]]
    total = np.bincount(words.doc, p, n)
    top = np.zeros(n)
    some = np.flatnonzero(words.counts)
    top[some] = np.maximum.reduceat(p, (np.cumsum(words.counts) - words.counts)[some])
    return np.column_stack([top, np.log1p(total), total / np.maximum(words.counts, 1)]), p


def _table(model: dict) -> np.ndarray:
    table = np.zeros(BUCKETS, np.float32)
    table[model["slots"]] = model["weights"]
    return table


def _spans(words: Words, p: np.ndarray) -> list[list[dict]]:
    """Runs of neighbouring tokens at 0.5 or more of each text, in code points."""
    out: list[list[dict]] = [[] for _ in words.counts]
    at = np.flatnonzero(p >= 0.5)
    for own in np.split(at, np.flatnonzero(np.diff(words.doc[at])) + 1) if len(at) else []:
        d = int(words.doc[own[0]])
        base = int(words.doc_starts[d])
        raw = np.frombuffer(words.buf, np.uint8, int(words.ends[own[-1]]) - base, base)
        upto = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        new = np.diff(own) > 1
        first, last = own[np.concatenate([[True], new])], own[np.concatenate([new, [True]])]
        edges = zip(upto[words.starts[first] - base].tolist(), upto[words.ends[last] - base].tolist(), strict=True)
        out[d] = [{"start": a, "end": b} for a, b in edges]
    return out


def held_out_row(mod: int = 5, rest: int = 0) -> Column:
    """Whether crc32 of doc_id as text leaves ``rest``; false without doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % mod == rest, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, max_docs: int = TRAIN_DOCS, max_bytes: int = TRAIN_BYTES) -> tuple[list[str], np.ndarray]:
    """Texts and labels of at most ``max_docs`` labelled rows, drawn by a hash of doc_id, and then of doc_id and text.

    An id whose labels contradict each other teaches nothing. Many rows with one id are drawn by their texts.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.min(F.col("toxic") == 1).alias("toxic"), F.max(F.col("toxic") == 1).alias("also"))
    some = bounded_sample(known.where("toxic = also").select("doc_id", F.col("toxic").cast("int").alias("toxic")), ["doc_id"], max_docs, 5)
    rows = docs.where(F.octet_length("text") <= max_bytes).select("doc_id", "text").join(F.broadcast(some), "doc_id")
    draw = F.xxhash64("doc_id", "text", F.lit(5))
    got = rows.withColumn("draw", draw).dropDuplicates(["draw"]).orderBy("draw").limit(max_docs).select("text", "toxic").toArrow()
    return got["text"].to_pylist(), got["toxic"].to_numpy().astype(np.int64)


def score_documents(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """(doc_id, score, spans) for each row of ``docs`` (doc_id, text).

    A null or empty text has no spans and the score of a text without toxic tokens; a very long one is one
    chain like any other, in time and memory in proportion to it. Equal texts, and so repeated rows, get equal results; further columns are ignored; an empty table
    gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(model)
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        for batch in bounded(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            words, h = _words(texts)
            x, p = _document_features(words, h, model, table)
            score = 1 / (1 + np.exp(-np.clip(np.column_stack([x, np.ones(len(x))]) @ model["top"], -30, 30)))
            columns = [batch.column(0), pa.array(score, pa.float64()), pa.array(_spans(words, p), pa.list_(span))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "spans"])

    return id_and_text(docs).mapInArrow(run, f"doc_id {doc_type(docs)}, {SCHEMA}")


def toxicity(docs: DataFrame, labels: DataFrame, mod: int = 5, rest: int = 0, **params) -> DataFrame:
    """(doc_id, held_out, score, predicted, spans): a field learned from labelled rows not held out, applied to all.

    Without labelled rows every score is that of an untrained layer, 0.
    """
    texts, toxic = training_sample(docs.where(~held_out_row(mod, rest)), labels, **params)
    model = train(texts, toxic)
    if not toxic.any():
        model["top"] = np.array([0.0, 0.0, 0.0, -30.0])
    scored = score_documents(docs, model)
    return scored.select("doc_id", held_out_row(mod, rest).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")
