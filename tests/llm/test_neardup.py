import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from catsim.llm import neardup, packs
from catsim.llm.graph import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(text or "")
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def brute(rows, threshold=0.8):
    vec = [shingles(t) for _, t in rows]
    df = Counter(s for v in vec for s in v)
    log_n = math.log1p(len(rows))
    seen = {s: float(packs.decode_count(packs.encode_count(np.array([n])))[0]) for s, n in df.items()}
    idf = {s: 1 + neardup.IDF_DAMPING * (log_n - math.log1p(n)) / log_n for s, n in seen.items()}
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is None or rows[j][0] is None or not vec[i] or not vec[j]:
                continue
            lo = sum(n * idf[s] for s, n in (vec[i] & vec[j]).items())
            hi = sum(n * idf[s] for s, n in (vec[i] | vec[j]).items())
            if lo / hi >= threshold:
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, least[find(k)] if i is not None else None) for k, (i, _) in enumerate(rows)), key=str)


def corpus(seed=5):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 6)))
    rows, n = [], 0
    passage = [word() for _ in range(60)]
    for _ in range(25):
        base = [word() for _ in range(r.randint(30, 200))] + (passage if r.random() < 0.4 else [])
        for _ in range(r.choice([1, 1, 2, 4, 14])):
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 60))):
                copy[r.randrange(len(copy))] = word()
            rows.append((n, " ".join(copy)))
            n += 1
    return [*rows, (900, None), (901, ""), (902, " \n"), (903, "hi there"), (904, "hi  there"), (905, "there hi"), (3, rows[3][1]), (None, rows[3][1]), (906, "long " * 20000)]


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 5)
    monkeypatch.setattr(neardup, "COLUMNS", 50)
    rows = corpus()
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, fp int").repartition(3)
    got = sorted(map(tuple, neardup.near_duplicate_classes(df).collect()), key=str)
    assert got == brute(rows)
    kept = neardup.keep_one(df).collect()
    assert sorted(k.doc_id for k in kept if k.doc_id is not None) == sorted({c for _, c in got if c is not None})
    assert sum(k.doc_id is None for k in kept) == 1
    assert set(kept[0].asDict()) == {"doc_id", "text", "fp"}


@pytest.mark.parametrize("part", [1, 3, 1000])
def test_hubs_in_parts(spark, monkeypatch, part):
    """A top of many members meets them in several parts; links are the same, and each holds for the vectors."""
    monkeypatch.setattr(neardup, "HUB_PART", part)
    r = random.Random(4)
    base = [f"w{k}" for k in range(120)]
    rows = [(i, " ".join(f"x{r.random()}" if k == i % 120 else w for k, w in enumerate(base))) for i in range(90)]
    rows += [(200 + i, " ".join(f"y{i}_{k}" for k in range(40))) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, neardup.near_duplicate_classes(df).collect()), key=str) == brute(rows)


def test_crossing_links_of_a_dense_bucket(spark):
    """With one band of one row, buckets hold several components, which only the block comparison can join."""
    rows = corpus(8)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    many = neardup.near_duplicate_classes(df, bands=60, rows=1).collect()
    assert sorted(map(tuple, many), key=str) == brute(rows)


def test_overlaps_are_sums_of_minima():
    rng = np.random.default_rng(2)
    idf = rng.random(400).astype(np.float32).astype(float) + 1
    pick = lambda: (lambda k: (k.astype(np.uint64), rng.integers(1, 4, len(k)), idf[k]))(np.sort(rng.choice(400, 60, replace=False)))
    left, right = [pick() for _ in range(7)], [pick() for _ in range(5)]
    got = neardup._overlaps(left, right)
    for i, a in enumerate(left):
        for j, b in enumerate(right):
            _, x, y = np.intersect1d(a[0], b[0], return_indices=True)
            assert got[i, j] == pytest.approx((np.minimum(a[1][x], b[1][y]) * a[2][x]).sum(), rel=1e-5)


def test_sample_agreement_estimates_weighted_jaccard():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**56, 300, dtype=np.uint64)
    wa, wb = rng.random(300) + 0.5, rng.random(300) + 0.5
    tables = neardup.sampling_tables()
    s = neardup.weighted_samples(np.concatenate([h, h]), np.concatenate([wa, wb]), np.array([0, 300]), 4000, tables)
    assert abs((s[0] == s[1]).mean() - np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()) < 0.04


def test_components(spark):
    edges = [(a, a + 1) for a in range(20)] + [(100, 101), (101, 102), (7, 7), (None, 3)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(21)}, 100: 100, 101: 100, 102: 100}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.near_duplicate_classes(df).collect() == []
    assert neardup.keep_one(df).collect() == []
