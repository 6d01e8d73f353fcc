"""Near words against comparing all pairs, with and without common segments; slips, ties, chains and odd texts."""

import random
import re
import zlib
from collections import Counter

import pytest

from catsim.llm import spelling


def near(a, b):
    """One edit apart, by trying all edits."""
    if len(a) < len(b):
        a, b = b, a
    gone = {a[:i] + a[i + 1 :] for i in range(len(a))}
    return a != b and (b in gone if len(a) == len(b) + 1 else len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1)


def brute(counts, ratio=5):
    found = {}
    for w, n in counts.items():
        others = [(-m, o) for o, m in counts.items() if near(w, o)]
        best = min(others, default=None)
        form = best[1] if best and -best[0] >= ratio * n else None
        found[w] = [form, n, len(others), -best[0] if form else None]
    rows = []
    for w, (form, n, n_near, form_n) in found.items():
        root = w
        while found[root][0]:
            root = found[root][0]
        rows.append((w, form, root, n, n_near, form_n))
    return sorted(rows, key=str)


def _vocabulary(seed, size, letters="abé", long=(6, 9)):
    r = random.Random(seed)
    words = {"".join(r.choice(letters) for _ in range(r.randint(*long))) for _ in range(size)}
    return {w: r.choice([5, 5, 6, 30, 40, 200, 1000, 6000]) for w in sorted(words)}


@pytest.mark.parametrize(("shard_segments", "common"), [(20_000, 5_000), (40, 5), (7, 1)])
def test_near_words_against_all_pairs(spark, shard_segments, common):
    counts = _vocabulary(common, 350)
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = spelling.spelling_forms(words, shard_segments=shard_segments, common=common)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(counts)


def test_common_segments_are_held_with_more_letters(spark):
    """A third of all words begin alike; each is held by its beginning and half of what follows, and none is lost."""
    r = random.Random(1)
    counts = {"prefix" + "".join(r.choice("abcd") for _ in range(6)): r.choice([5, 9, 60]) for _ in range(300)} | _vocabulary(2, 200, "abcdefgh")
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    held, hot = spelling._held(words, 20)
    assert [k.key for k in hot.collect()] == ["12/prefix/"]
    shapes = {r.word: [tuple(s) for s in r.shapes] for r in held.collect()}
    assert all(s == [(9, 0), (6, 3), (0, 6)] for w, s in shapes.items() if w.startswith("prefix"))
    assert sorted(map(tuple, spelling.spelling_forms(words, shard_segments=50, common=20).collect()), key=str) == brute(counts)


def test_one_edit():
    r = random.Random(4)
    for _ in range(3000):
        a, b = ("".join(r.choice("ab") for _ in range(r.randint(0, 6))) for _ in range(2))
        assert spelling.one_edit(a, b) == near(a, b) == spelling.one_edit(b, a)


def test_ties_chains_and_words_left_out(spark):
    counts = {"planet": 5, "planer": 25, "planed": 25, "plaed": 125, "plaedx": 625, "plaedxy": 3125, "single": 7}
    got = {r.word: r for r in spelling.spelling_forms(spark.createDataFrame([*counts.items(), (None, 3)], "word string, n long")).collect()}
    assert got["planet"].form == "planed" and got["planet"].n_near == 2 and got["planet"].root == "plaedxy"
    assert got["single"].form is None and got["single"].root == "single" and got["single"].n_near == 0
    none = spark.createDataFrame([], "word string, n long")
    assert spelling.spelling_forms(none).count() == 0


def test_report_of_whole_texts(spark):
    r = random.Random(3)
    base = [w for w in _vocabulary(3, 25, "abcdéÿ×", (5, 8))]
    texts = [None, "", " 1 2 ", "É" * 7 + " Ünder"] + [" ".join(r.choice(base).capitalize() + r.choice(["", ",", "1"]) for _ in range(r.randint(1, 900))) for _ in range(120)]
    texts.append("Windows " * 100_000)
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7])] * 9 + [(None, "Nothing more nothing")]
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            low = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{low}".encode())
            counts[low if h % 199 else low[: h % len(low)] + low[h % len(low) + 1 :]] += 1
    want = brute({w: n for w, n in counts.items() if len(w) >= 6 and n >= 5})
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS word", "'y' AS run", "1 AS n")
    got = sorted(map(tuple, spelling.variant_report(docs).collect()), key=str)
    assert got == want and sum(w[1] is not None for w in want) > 5
