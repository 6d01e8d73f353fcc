import itertools
import random

import numpy as np

from catsim.llm import toxicity


def test_marginals_against_enumeration():
    rng = np.random.default_rng(1)
    scores, lengths, trans = np.zeros((3, toxicity.CHAIN)), np.array([1, 4, 6]), rng.normal(size=(2, 2))
    for i, n in enumerate(lengths):
        scores[i, :n] = rng.normal(size=n)
    p, expected = toxicity.marginals(scores, lengths, trans)
    want, total = np.zeros((2, 2)), 0
    for i, n in enumerate(lengths):
        mass, one, pair = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(scores[i, k] for k in range(n) if y[k]) + sum(trans[a, b] for a, b in zip(y, y[1:])))
            mass += w
            one += w * np.array(y)
            for a, b in zip(y, y[1:]):
                pair[a, b] += w
        assert np.allclose(p[i, :n], one / mass)
        want += pair / mass
        total += n - 1
    assert np.allclose(expected, want) and np.isclose(expected.sum(), total)


def test_marginals_carry_over_blocks():
    """Texts of 1 to 200 tokens, against forward-backward over the whole text with logarithms, token by token."""
    rng = np.random.default_rng(3)
    lengths = np.array([200, 1, 64, 65, 0, 128, 131])
    trans = np.array([[2.5, -2.0], [-2.0, 2.5]])
    scores = [rng.normal(size=n) * 1.5 for n in lengths]
    counts = -(-lengths // toxicity.CHAIN)
    blocks = [s[i : i + toxicity.CHAIN] for s in scores for i in range(0, len(s), toxicity.CHAIN)]
    grid = np.array([np.pad(b, (0, toxicity.CHAIN - len(b))) for b in blocks])
    sizes = np.array([len(b) for b in blocks])
    enter, leave = toxicity.messages(toxicity._transfer(grid, sizes, trans), counts, trans)
    p = toxicity.marginals(grid, sizes, trans, enter, leave)[0]
    got = np.split(np.concatenate([row[:n] for row, n in zip(p, sizes)]), np.cumsum(lengths)[:-1])
    apart = 0.0
    for s, own in zip(scores, got, strict=True):
        n = len(s)
        psi = np.column_stack([np.zeros(n), s])
        f, b = np.zeros((n, 2)), np.zeros((n, 2))
        for t in range(n):
            f[t] = psi[t] + (np.logaddexp.reduce(f[t - 1][:, None] + trans, axis=0) if t else 0)
        for t in range(n - 2, -1, -1):
            b[t] = np.logaddexp.reduce(trans + (psi[t + 1] + b[t + 1])[None, :], axis=1)
        want = np.exp((f + b)[:, 1] - np.logaddexp.reduce(f + b, axis=1)) if n else np.empty(0)
        assert np.allclose(own, want)
        if n == 200:
            alone = toxicity.marginals(grid[:4], sizes[:4], trans)[0]
            apart = np.abs(np.concatenate([row[:k] for row, k in zip(alone, sizes[:4])]) - want).max()
    assert apart > 0.05


def test_spans_in_code_points():
    texts = ["", "İé bad, worse ok İ bad", "ok", "bad " * 200_000]
    words, h = toxicity._words(texts)
    names = [words.buf[a:b].decode() for a, b in zip(words.starts, words.ends)]
    got = toxicity._spans(words, np.array([float(n in ("bad", "worse")) for n in names]))
    assert got[:3] == [[], [{"start": 3, "end": 13}, {"start": 19, "end": 22}], []]
    assert got[3] == [{"start": 0, "end": len(texts[3]) - 1}]
    assert toxicity._spans(words, np.zeros(len(names))) == [[], [], [], []]


def corpus(n=900, seed=2):
    r = random.Random(seed)
    bad = ["Trash", "idiot", "moron!", *("chlla" + e for e in "vero ndo ta tes nu dad mo so gu ze".split())]
    rows, labels = [], []
    for i in range(n):
        w = ["".join(r.choice(["the", "ing", "er", "on"]) for _ in range(r.randint(1, 3))) for _ in range(r.randint(3, 120))]
        toxic = int(r.random() < 0.25)
        for _ in range(r.randint(1, 4) * toxic):
            w.insert(r.randint(0, len(w)), r.choice(bad))
        rows.append((i, " ".join(w), "x"))
        if r.random() < 0.8:
            labels.append((i, toxic))
    return rows, labels


def test_held_out_accuracy_spans_and_cases(spark):
    rows, labels = corpus()
    extra = [(9000, None, "x"), (9001, "", "x"), (9002, "é the idiot", "x"), (None, "the", "x"), (9003, "the er " * 20000 + "idiot", "x"), rows[0], (9004, "chllaxyz er on the", "x")]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string, toxic string").repartition(3)
    marks = spark.createDataFrame([*labels, (1, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, marks).collect()
    assert len(got) == len(rows) + len(extra) and all(0 <= g.score <= 1 and g.predicted == int(g.score >= 0.5) for g in got)
    truth, by = dict(labels), {g.doc_id: g for g in got}
    held = [g for g in got if g.held_out and g.doc_id in truth]
    assert len(held) > 80 and sum(g.predicted == truth[g.doc_id] for g in held) >= 0.97 * len(held)
    assert by[9002].predicted == 1 and [tuple(s) for s in by[9002].spans] == [(6, 11)]
    assert by[9003].predicted == 1 and [tuple(s) for s in by[9004].spans] == [(0, 8)]
    assert by[9000].predicted == by[9001].predicted == 0 and by[9000].score == by[9001].score and by[9001].spans == []


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [g.predicted for g in toxicity.toxicity(docs, none).collect()] == [0]
    assert toxicity.toxicity(docs.limit(0), none).collect() == []
