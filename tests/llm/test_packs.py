"""Two exchanges of window hashes give what one gives, and hashes are told apart by their checks."""

import random

import numpy as np
import pytest

from catsim.llm import neardup, packs, substring


@pytest.fixture
def docs(spark):
    r = random.Random(7)
    passage = " ".join(f"p{i}" for i in range(50))
    rows = [(i, " ".join(r.choice("abcde") for _ in range(r.randint(0, 60))) + (f" {passage}" if i % 3 == 0 else "")) for i in range(80)]
    return spark.createDataFrame([*rows, (900, None), (901, ""), (902, "w " * 3000)], "doc_id long, text string").repartition(3)


def test_two_exchanges_equal_one(docs, monkeypatch):
    packed = packs.pack_documents
    for module in (substring, neardup):
        monkeypatch.setattr(module, "pack_documents", lambda d: packed(d, 300))
    monkeypatch.setattr(packs, "BUCKET_HASHES", 10)
    monkeypatch.setattr(packs, "ROW_HASHES", 0)
    one = [sorted(map(tuple, f(docs).collect())) for f in (substring.removal_digests, neardup.near_duplicate_classes)]
    monkeypatch.setattr(packs, "ROW_HASHES", 1 << 40)
    assert packs.count_buckets(packed(docs, 300)) >= 64
    two = [sorted(map(tuple, f(docs).collect())) for f in (substring.removal_digests, neardup.near_duplicate_classes)]
    assert one == two and sum(r[2] for r in one[0]) > 1000


def test_equal_hashes_with_other_checks_are_different():
    h, check = np.array([5, 5, 9, 5, 9], np.uint64), np.array([1, 2, 7, 1, 7], np.uint64)
    first, count, place = packs.distinct_counts(h, np.zeros(5, np.int64), False, check)
    assert h[first].tolist() == [5, 5, 9] and check[first].tolist() == [1, 2, 7] and count.tolist() == [2, 1, 2] and place.tolist() == [0, 1, 2, 0, 2]


def test_repeats_survive_colliding_hashes(docs, monkeypatch):
    """With all first hashes equal, the checks alone tell windows apart."""
    want = sorted(map(tuple, substring.removal_digests(docs).collect()))
    monkeypatch.setattr(substring, "_MASK", np.uint64(0))
    assert sorted(map(tuple, substring.removal_digests(docs).collect())) == want


def test_one_document_counts_once():
    h, doc = np.array([3, 3, 3, 4], np.uint64), np.array([0, 0, 1, 1])
    assert packs.distinct_counts(h, doc, True)[1].tolist() == [2, 1] and packs.distinct_counts(h, doc, False)[1].tolist() == [3, 1]
