"""Runs against brute force: the vocabulary method on random strings, whole texts, tails, and the digests."""

import hashlib
import random
import time
import zlib
from fractions import Fraction

import numpy as np
import pytest

from catsim.llm import periods, repeats


def brute(s, min_length=6, exponent=4):
    """Maximal stretches for every period; of those that agree the least period."""
    found, seen = [], set()
    for q in range(1, len(s) // 2 + 1):
        i = 0
        while i + q < len(s):
            j = i
            while j + q < len(s) and s[j] == s[j + q]:
                j += 1
            if j > i and j - i + q >= max(min_length, exponent * q) and (i, j - i + q) not in seen:
                seen.add((i, j - i + q))
                found.append([i, j - i + q, q])
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def _string(r, n, kinds):
    s = [r.randrange(kinds) for _ in range(n)]
    if r.random() < 0.6:
        a = r.randrange(n)
        p = r.randint(1, max(1, (n - a) // 2))
        s = [s[i] if i < a else s[a + (i - a) % p] for i in range(n)]
    return s


@pytest.mark.parametrize(("min_length", "exponent"), [(6, 4), (2, 2), (4, 3)])
def test_runs_of_random_strings(min_length, exponent):
    r = random.Random(min_length)
    for _ in range(400):
        strings = [_string(r, r.randint(1, 45), r.randint(1, 4)) for _ in range(r.randint(1, 4))]
        want = [[i, *run] for i, s in enumerate(strings) for run in brute(s, min_length, exponent)]
        assert repeats.runs([np.array(s, np.int64) for s in strings], min_length, exponent).tolist() == want


def test_vocabulary_is_complete():
    """Every square with a primitive root is marked, and nothing else, on Fibonacci words and on random ones."""
    a, b = [0], [0, 1]
    while len(b) < 90:
        a, b = b, b + a
    r = random.Random(5)
    for s in [b, *(_string(r, 60, 2) for _ in range(60))]:
        text = np.array([*s, 9])
        names = repeats.Names(text)
        blocks = repeats.lz_blocks(repeats.longest_previous(names), np.array([0]), np.array([len(s)]))
        tree = repeats.SuffixTree(text, names)
        node, k = repeats.vocabulary(tree, *repeats.covering_pairs(names, blocks))
        got = [tuple(s[(at := int(names.order[tree.low[v]])) : at + 2 * q]) for v, q in zip(node.tolist(), k.tolist(), strict=True)]
        power = lambda w: any(w == w[:d] * (len(w) // d) for d in range(1, len(w)) if len(w) % d == 0)
        want = {tuple(s[i : i + 2 * q]) for q in range(1, len(s) // 2 + 1) for i in range(len(s) - 2 * q + 1) if s[i : i + q] == s[i + q : i + 2 * q] and not power(s[i : i + q])}
        assert set(got) == want and len(got) == len(want)


def _tail(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def _digests(doc_id, text):
    words = _tail(doc_id, (text or "").encode().split())
    found = brute(words)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    drop = {i for s, n, q in found for i in range(s + q, s + n)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(found), *best, None if best[0] is None else 1000 * best[1] // best[2],
            sha("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in drop)))


def test_digests_of_whole_texts(spark):
    r = random.Random(2)
    words = "a b c dé 手 e f the of and".split(" ")
    texts = [None, "", " \t\n", "x", "a a a a a a", "A a a a a a a b", "a " * 700, "la di " * 50 + "da " * 40 + "la di " * 9]
    texts += ["\n\v\f ".join(r.choice(words) for _ in range(r.randint(1, 400))) for _ in range(150)]
    texts += [" ".join(map(str, _string(r, r.randint(1, 300), r.choice([2, 3, 50])))) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7])] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS runs", "1 AS n_words", "'y' AS best")
    got = [tuple(x) for x in periods.run_digests(docs).collect()]
    assert sorted(got, key=str) == sorted((_digests(i, t) for i, t in rows), key=str)


def test_collapsed_text_and_parameters(spark):
    docs = spark.createDataFrame([("p", "go  on go on go on go on stop"), (None, None)], "doc_id string, text string")
    got = {r.doc_id: r for r in periods.periodic_runs(docs).collect()}
    assert got["p"].collapsed == "go on stop" and [tuple(x) for x in got["p"].runs] == [(0, 8, 2)] and got["p"].n_words == 9
    assert got[None].collapsed == "" and got[None].runs == [] and got[None].n_words == 0
    assert periods.periodic_runs(docs, 10).where("size(runs) > 0").count() == 0
    assert periods.periodic_runs(docs.limit(0)).count() == 0 and periods.run_digests(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periods.periodic_runs(docs, 3)


def test_a_document_without_id_gets_no_tail(spark):
    docs = spark.createDataFrame([(None, "a b c")], "doc_id long, text string")
    assert periods.with_tails(docs).first().text == "a b c"


def test_long_texts_take_time_in_proportion():
    took = {}
    for n in (20_000, 80_000):
        s = [b"%d" % (i % 3001) for i in range(n)]
        began = time.process_time()
        assert [x.tolist() for x in periods.text_runs([s, [b"x"] * n])] == [[[0, n, 3001]], [[0, n, 1]]]
        took[n] = time.process_time() - began
    assert took[80_000] < 8 * took[20_000] + 1
