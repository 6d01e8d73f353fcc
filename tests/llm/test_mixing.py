import hashlib
import random

import pytest

from catsim.llm import mixing


def targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        left = total - sum(2 * sizes[s] for s in capped)
        rest = sum(weight[s] for s in names if s not in capped)
        got = {s: 2 * sizes[s] if s in capped else left * weight[s] / rest for s in names}
        over = {s for s in names if s not in capped and got[s] > 2 * sizes[s]}
        if not over:
            return got
        capped |= over


def test_targets_and_copies(spark):
    r = random.Random(2)
    rows = []
    for k, (source, n) in enumerate([("b", 300), ("a", 40), ("é", 60), (None, 50), ("z", 500), ("empty", 3)]):
        rows += [(k * 1000 + i, "" if source == "empty" else " ".join(["w"] * r.randint(0, 60)), source, "x") for i in range(n)]
    rows += [(9000, None, "a", "x"), (9001, "w " * 20000, "z", "x"), (0, rows[0][1], "b", "x"), (None, "w w", "a", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string").repartition(3)
    got = mixing.mix_report(df).collect()
    again = mixing.mix_report(df.repartition(5)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want, source = targets(sizes), {(i, len((t or "").split())): s for i, t, s, _ in rows}
    taken = {}
    for g in got:
        s = source[(g.doc_id, g.size)]
        assert g.source_size == sizes[s] and g.target == pytest.approx(want[s])
        assert g.taken <= 2 * g.size
        taken[s] = taken.get(s, 0) + g.taken
    assert all(abs(taken[s] - want[s]) <= 0.02 * want[s] + 1 for s in ("a", "b", "é", None))
    mixed = mixing.mix_documents(df).collect()
    assert sum(len((m.text or "").split()) for m in mixed) == sum(taken.values())
    assert mixed[0].asDict().keys() == {"doc_id", "text", "source", "size"}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix_report(df).collect() == [] and mixing.mix_documents(df).collect() == []


def _draws(rows, seeds=32):
    """Copies of rows that differ in id or text, by the words of the docstring: for each source the seed that comes nearest."""
    sizes, got = {}, {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = targets(sizes)
    for s in sizes:
        rate = want[s] / sizes[s] if sizes[s] else 0.0
        part, own = rate - int(rate), [(i, t, int(hashlib.md5(f"{i}\n{t}".encode()).hexdigest()[:13], 16) / 2**52) for i, t, x in rows if x == s]
        extra = lambda u, k, part=part: int(part + (u + k / seeds) % 1.0)
        best = min(range(seeds), key=lambda k: (abs(sum(len(t.split()) * extra(u, k) for _, t, u in own) - part * sizes[s]), k))
        got |= {i: len(t.split()) * (int(rate) + extra(u, best)) for i, t, u in own}
    return got, want


def test_every_document_is_drawn_by_its_own_number(spark):
    """Few documents or many, short or long: each is drawn by its hash and its source's seed, and nothing else."""
    r = random.Random(6)
    rows = [(i, " ".join([str(i)] * min(400, int(r.paretovariate(0.8)))), s) for i, s in enumerate(["few"] * 12 + ["some"] * 80 + ["many"] * 900)]
    got = {g.doc_id: g.taken for g in mixing.mix_report(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    want, target = _draws(rows)
    assert got == want
    for source, near in (("some", 0.03), ("many", 0.003)):
        assert abs(sum(got[i] for i, _, s in rows if s == source) - target[source]) <= near * target[source]
