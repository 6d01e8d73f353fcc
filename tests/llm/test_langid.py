import random

import numpy as np
import pytest

from catsim.llm import langid


def direct(m, windows):
    out = []
    for x in windows:
        e = m["emb"][x].astype(float)
        tops = []
        for w in langid.WIDTHS:
            cols = np.stack([e[i : i + w].ravel() for i in range(langid.WINDOW - w + 1)])
            tops.append(np.maximum((cols @ m[f"w{w}"] + m[f"b{w}"]).max(axis=0), 0))
        out.append(np.concatenate(tops) @ m["out"] + m["bias"])
    return np.array(out)


def corpus(n=400, seed=1):
    r = random.Random(seed)
    words = {"en": "the and with ing tion of that".split(), "de": "der und ung schön für keit über".split(), "fr": "le et éque aux ç ment être".split()}
    return [(i, " ".join("".join(r.choice(words[lang]) for _ in range(r.randint(1, 2))) for _ in range(r.randint(3, 200))), lang, "s") for i in range(n) for lang in [r.choice(list(words))]]


def test_tables_equal_the_network():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 256, (70, langid.WINDOW), dtype=np.uint8)
    m = langid.train(x, rng.integers(0, 3, 70), 3)
    assert np.allclose(langid.Network(m).logits(x), direct(m, x), atol=1e-3)


def test_held_out_accuracy_and_cases(spark):
    rows = corpus()
    rows += [(9000, None, "en", "s"), (9001, "", "en", "s"), (9002, "12 !? \n", "de", "s"), (9003, rows[0][1], None, "s"), (None, "the and", "en", "s"), (9004, "der und " * 20000, "de", "s"), rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").repartition(3)
    got = langid.identify(df).collect()
    truth = {r[0]: r[2] for r in rows}
    held = [g for g in got if g.held_out and g.doc_id < 9000]
    assert len(held) > 60 and sum(g.lang_pred == truth[g.doc_id] for g in held) > 0.97 * len(held)
    by = {g.doc_id: g for g in got}
    assert all((by[i].lang_pred, by[i].score) == ("und", 0.0) for i in (9000, 9001, 9002))
    assert by[9004].lang_pred == "de" and by[9003].lang_pred == by[0].lang_pred
    assert all(0 <= g.score <= 1 for g in got) and len(got) == len(rows)
    kept = langid.keep_known(df)
    assert kept.columns == df.columns and not {9000, 9001, 9002} & {k.doc_id for k in kept.collect()} and kept.count() >= 0.98 * (len(rows) - 3)


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [tuple(g)[2:] for g in langid.identify(df).collect()] == [("und", 0.0)]
    assert langid.identify(df.limit(0)).collect() == []


def test_windows():
    x, doc, used = langid.windows_of([b"a" * 300, b"", b"b"])
    assert x.shape == (3, 256) and doc.tolist() == [0, 0, 2] and used.tolist() == [256, 44, 1]
    assert x[1, 44] == 0 and x[2, 0] == 98


@pytest.mark.parametrize("n", [1])
def test_one_language(spark, n):
    df = spark.createDataFrame([(i, "the and of", "en") for i in range(8)], "doc_id long, text string, lang string")
    assert {g.lang_pred for g in langid.identify(df).collect()} == {"en"}
