import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from catsim.llm import media


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=3000))
def test_round_trip(data):
    payload = media.to_payload(data)
    assert len(payload) % 576 == 0 and payload.startswith(data) and len(payload) - len(data) <= 576
    assert media.decode_png(media.encode_png(payload)).tobytes() == payload


def test_all_filters():
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (40, 12), dtype=np.uint8)
    for step in (1, 3):
        kinds = rng.integers(0, 5, 40).astype(np.uint8)
        rows = np.zeros_like(image)
        full = np.zeros((41, 12 + step), int)
        full[1:, step:] = image
        for y in range(40):
            for x in range(12):
                a, b, c = full[y + 1, x], full[y, x + step], full[y, x]
                p = a + b - c
                near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                rows[y, x] = (int(image[y, x]) - [0, a, b, (a + b) // 2, near][kinds[y]]) % 256
        assert np.array_equal(media.unfilter(kinds, rows, step), image)


def test_damage_is_found():
    good = media.encode_png(media.to_payload(b"hello"))
    for k in range(0, len(good), 3):
        with pytest.raises(ValueError):
            media.decode_png(good[:k] + bytes([good[k] ^ 1]) + good[k + 1 :])
    with pytest.raises(ValueError):
        media.decode_png(good[:-5])


def test_documents(spark):
    r = random.Random(3)
    rows = [(i, "".join(r.choice("abc é日\n") for _ in range(r.choice([0, 1, 575, 576, 577, 5000])))) for i in range(30)]
    rows += [(50, None), (51, ""), (1, rows[1][1]), (None, "x"), (52, "é" * 200000)]
    df = spark.createDataFrame([(i, t, "m") for i, t in rows], "doc_id long, text string, media string").repartition(3)
    got = sorted(map(tuple, media.media_digests(media.media_columns(df)).collect()), key=str)
    want = []
    for i, t in rows:
        raw = (t or "").encode()
        p = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        want.append((i, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])))
    assert [g[:5] for g in got] == sorted(want, key=str)
    by = {}
    for g in got:
        by.setdefault(g[3], set()).add(g[1:])
    assert all(len(v) == 1 or len({x[0] for x in v}) > 1 for v in by.values())
    assert media.media_columns(df.limit(0)).collect() == []


def test_hash_is_stable_under_small_noise():
    rng = np.random.default_rng(0)
    image = np.cumsum(rng.integers(-3, 4, (60, 576)), axis=1).clip(-100, 100).astype(np.int64) + 128
    noisy = (image + rng.integers(-2, 3, image.shape)).clip(0, 255)
    bits = np.unpackbits(np.frombuffer(media.cosine_hash(image.astype(np.uint8)), np.uint8) ^ np.frombuffer(media.cosine_hash(noisy.astype(np.uint8)), np.uint8))
    assert bits.sum() <= 6
