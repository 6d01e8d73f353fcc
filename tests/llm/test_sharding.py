"""The permutation is one to one and goes back; shards are even, whole and the same for every layout of the input."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from catsim.llm import sharding


def _places(n, seed):
    """The permutation in plain Python."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    b = max(1, -(-n // a))
    keys = [int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16) & 0x7FFFFFFF for i in range(8)]

    def once(x):
        left, right = x % a, x // a
        for i, key in enumerate(keys):
            h = right ^ key
            for m, s in ((1597334677, 15), (747796405, 13)):
                h = (h * m) & 0x7FFFFFFF
                h ^= h >> s
            left, right = right, (left + h) % (a, b)[i % 2]
        return right * a + left

    def walk(x):
        x = once(x)
        while x >= n:
            x = once(x)
        return x

    return [walk(x) for x in range(n)]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 10, 101, 997, 5000])
def test_permutation_and_back(spark, n):
    made = sharding.shuffle_of(spark, n, 7)
    rows = spark.range(n).withColumn("place", made.place("id")).withColumn("back", made.number("place")).orderBy("id").collect()
    assert [r.place for r in rows] == _places(n, 7)
    assert sorted(r.place for r in rows) == list(range(n)) and all(r.back == r.id for r in rows)


def test_shuffle_mixes_and_hangs_on_the_seed(spark):
    n = 5000
    one, two = _places(n, 0), _places(n, 1)
    assert sum(a == b for a, b in zip(one, two, strict=True)) < 20
    assert abs(sum(abs(a - b) for a, b in zip(one, one[1:])) / (n - 1) - n / 3) < n / 20
    shards = Counter((x % 24, i % 24) for i, x in enumerate(one))
    assert len(shards) == 576 and max(shards.values()) < 25


def _docs(spark, rows, parts=3):
    return spark.createDataFrame(rows, "doc_id long, text string, shard string, doc string, number int").repartition(parts)


ROWS = [(i, f"text {i} é" * (i % 5), f"s{i}", "d", i) for i in range(200)] + [(None, None, None, None, None), (7, "", "x", None, 0), (8, "z" * 300_000, "", "", 1)] + [(5, "same", "s", "d", 3)] * 150


def test_shards_are_whole_even_and_alike_for_every_layout(spark):
    seen = []
    for parts in (1, 7):
        got = sharding.shard_digests(_docs(spark, ROWS, parts), 24, 3).collect()
        assert len(got) == len(ROWS) and {r.law for r in got} == {"rows"} and all(r.grown_shard is None for r in got)
        slots = defaultdict(list)
        for r in got:
            slots[r.shard].append(r.slot)
        assert set(slots) == set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
        seen.append(sorted(tuple(r)[1:3] + (r.doc_id or -1, r.shard, r.slot) for r in got))
    assert seen[0] == seen[1]
    want = sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t, *_ in ROWS)
    assert sorted((s, c) for s, c, *_ in seen[0]) == want
    order = sorted(((-1 if i is None else i), hashlib.md5((t or "").encode()).hexdigest()) for i, t, *_ in ROWS)
    places = _places(len(ROWS), 3)
    place = {}
    for (i, digest), p in zip(order, places, strict=True):
        place.setdefault((i, digest), set()).add(p)
    assert {p for i, d in place if i == 5 and d == hashlib.md5(b"same").hexdigest() for p in place[i, d]} == {r[4] * 24 + r[3] for r in seen[0] if r[0] == 12 and r[1] == zlib.crc32(b"same")}


def test_rows_keep_their_columns_and_new_ones_step_aside(spark):
    docs = _docs(spark, ROWS)
    got = sharding.assign_shards(docs, 5, 1)
    assert got.columns == [*docs.columns, "_shard", "slot"]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got.select(*docs.columns).collect())) == sorted(map(key, ROWS))


def test_written_shards_are_folders_in_slot_order(spark, tmp_path):
    docs = _docs(spark, ROWS).drop("shard")
    sharding.write_shards(docs, f"{tmp_path}/out", 4, 1)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == len(ROWS) and sorted(p.name for p in (tmp_path / "out").glob("shard=*")) == [f"shard={i}" for i in range(4)]
    files = back.select("shard", "slot", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("at")).orderBy("at").collect()
    for f in {r.f for r in files}:
        inside = [(r.shard, r.slot) for r in files if r.f == f]
        assert inside == sorted(inside)


def test_empty_table_and_text_ids(spark):
    none = spark.createDataFrame([], "doc_id string, text string")
    assert sharding.shard_digests(none).count() == 0
    some = spark.createDataFrame([("b", "x"), ("a", None), (None, "")], "doc_id string, text string")
    assert sorted((r.doc_id or "", r.size) for r in sharding.shard_digests(some, 2).collect()) == [("", 8), ("a", 8), ("b", 9)]
