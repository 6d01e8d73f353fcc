import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pytest

from catsim.llm import packs, substring, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, width):
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    seen = Counter(tuple(w[k : k + width]) for _, w in split for k in range(len(w) - width + 1))
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - width + 1):
            if seen[tuple(w[k : k + width])] > 1:
                gone.update(range(k, k + width))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed=3):
    r = random.Random(seed)
    vocab = ["a", "bb", "ccc", "é", "日本語のことば", "x" * 30, "z" * 9, "Zz.", "0"]
    line = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    shared = [line(n) for n in (5, 6, 9, 40)]
    rows = [(i, "\n".join(r.choice([line(r.randint(0, 12)), r.choice(shared)]) for _ in range(r.randint(0, 6)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \t\n "), (103, shared[3]), (103, shared[3]), (None, shared[3] + " x"), (104, line(20000))]
    return rows


@pytest.mark.parametrize("width,pack_bytes", [(5, 300), (35, 8 << 20), (1, 100)])
def test_against_brute_force(spark, monkeypatch, width, pack_bytes):
    rows = corpus()
    packed = packs.pack_documents
    monkeypatch.setattr(substring, "pack_documents", lambda d: packed(d, pack_bytes))
    df = spark.createDataFrame([(i, t, "e") for i, t in rows], "doc_id long, text string, intervals string").repartition(3)
    got = sorted(map(tuple, substring.removal_digests(df, width).collect()), key=str)
    assert got == brute(rows, width)
    full = substring.remove_repeats(df, width).collect()
    again = sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.text.encode()).hexdigest()) for r in full), key=str)
    assert again == got
    assert all(sum(s.end - s.start for s in r.intervals) == r.n_removed for r in full)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert substring.removal_digests(df).collect() == []


def test_span_hashes_tell_words_apart():
    texts = [" ".join(f"w{i}" * (i % 7 + 1) for i in range(5000)).encode()]
    w = tokens.split_words(texts)
    h = tokens.hash_spans(w.buf, w.starts, w.ends)
    assert len(np.unique(h)) == len({w.buf[a:b] for a, b in zip(w.starts, w.ends, strict=True)})


def test_long_spans_are_hashed_in_few_passes():
    n = tokens.LONG
    words = [b"a" * k for k in (n - 1, n, n + 1, n + 7, n + 8, n + 9)] + [b"a" * n + b"b", b"b" + b"a" * n, b"a" * n + bytes(1)]
    swapped = [b"x" * n + b"12345678" + b"abcdefgh", b"x" * n + b"abcdefgh" + b"12345678"]
    big = [b"q" * (1 << 22), b"q" * ((1 << 22) - 1) + b"r", b"r" + b"q" * ((1 << 22) - 1)]
    w = tokens.split_words([b" ".join(words + swapped + big) + b" " + b" ".join(words + swapped + big), words[0] + b" ab"])
    began = time.perf_counter()
    h = tokens.hash_spans(w.buf, w.starts, w.ends)
    assert time.perf_counter() - began < 2
    half = len(words + swapped + big)
    assert len(np.unique(h[:half])) == half and (h[:half] == h[half : 2 * half]).all() and h[2 * half] == h[0]


def test_counts_survive_a_byte():
    n = np.array([1, 2, 3, 1000, 10**6])
    assert packs.encode_count(n)[:2].tolist() == [0, 8]
    assert np.all(np.abs(packs.decode_count(packs.encode_count(n)) / n - 1) < 0.05)
