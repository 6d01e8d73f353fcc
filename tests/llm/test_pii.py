import hashlib
import random
import re
import tracemalloc

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from catsim.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = [int(c) for c in m[0] if c.isdigit()]
        total = sum(v if k % 2 == 0 else (v * 2 - 9 if v > 4 else v * 2) for k, v in enumerate(d[::-1]))
        if 12 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


@settings(max_examples=2000, deadline=None)
@given(st.lists(st.sampled_from(["1", "0", "255", "256", "4111111111111111", ".", "-", " ", "+", "@", "a", "é", "(", ")", "a@b.c", "1.2.3.4", "+1 (555) 123-4567", "://", "token", "\n", "_"]), max_size=14))
def test_base_equals_the_patterns(parts):
    text = "".join(parts)
    assert [s for s in pii.find_spans(text) if s[0] in pii.BASE] == brute(text)


def test_added_spans():
    text = 'see ftp://me:pw@host.org/x and token = "a1b2c3d4e5" or IBAN: DE44500105175407324931, account holder'
    got = {(k, text[a:b]) for k, a, b in pii.find_spans(text)}
    assert {("url", "ftp://me:pw@host.org/x"), ("account", "a1b2c3d4e5"), ("account", "DE44500105175407324931")} <= got
    assert pii.redact("mail a@b.cc now") == "mail <EMAIL> now"
    assert pii.redact("plain") == "plain"


def test_documents(spark):
    r = random.Random(1)
    bits = ["a@b.c", "10.0.0.1", "4111 1111 1111 1111", "+1 (555) 123-4567", "é", "x", "999.1.1.1"]
    rows = [(i, " ".join(r.choice(bits) for _ in range(r.randint(0, 30)))) for i in range(40)]
    rows += [(50, None), (51, ""), (0, rows[0][1]), (None, "a@b.c"), (52, "9" * 6000 + " a@b.c")]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, spans int")
    got = sorted(map(tuple, pii.span_digests(df).collect()), key=str)
    want = []
    for i, t in rows:
        b = [("email", 6001, 6006)] if t and len(t) > 5000 else brute(t or "")
        sha = hashlib.sha256(",".join(f"{k}:{x}:{y}" for k, x, y in b).encode()).hexdigest()
        want.append((i, *(sum(s[0] == k for s in b) for k in pii.BASE), sha))
    assert [g[:6] for g in got] == sorted(want, key=str)
    clean = pii.redact_documents(df).collect()
    assert len(clean) == len(rows) and not any("@" in (c.text or "") for c in clean)
    assert pii.span_digests(df.limit(0)).collect() == []


@pytest.mark.parametrize("block", [1, 3, 10])
def test_anchors_over_the_border_of_a_block(block, monkeypatch):
    text = "mail a@b.cc, http://me:pw@host.org/x, PASSWORD: ab12cd34ef \u0130 4111 1111 1111 1111 and 10.20.30.40 +1 (555) 123-4567"
    whole = pii.find_spans(text)
    assert {k for k, *_ in whole} == set(pii.KINDS)
    monkeypatch.setattr(pii, "BLOCK", block)
    assert pii.find_spans(text) == whole


@pytest.mark.parametrize("unit", ["w38291 x9 ", "1 ", "@", "7"])
def test_memory_is_a_few_times_the_text(unit):
    text = unit * (2_000_000 // len(unit))
    pii.find_spans(unit)
    tracemalloc.start()
    try:
        assert pii.find_spans(text) == []
        assert tracemalloc.get_traced_memory()[1] < 10 * len(text) + 8 * pii.BLOCK
    finally:
        tracemalloc.stop()


def test_one_letter_has_a_longer_lower_case():
    assert [c for c in map(chr, range(0x110000)) if len(c.lower()) != 1] == [pii._TWO]
