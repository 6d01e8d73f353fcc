"""Filters of batches against sets, and what a batch of a sync reads of the batches before it."""

import re

import pytest
from pyspark.sql import functions as F

from catsim.operators import membership
from catsim.sources import shared
from catsim.streaming import sync


@pytest.mark.parametrize("n", [0, 1, 900, 5000])
def test_filters_know_their_keys_and_few_others(spark, n):
    keys = spark.range(n).select(F.concat(F.lit("k"), "id").alias("key"))
    made = membership.build_filter(keys.unionByName(spark.createDataFrame([(None,)], "key string")), n)
    assert {len(r.bits) for r in made.collect()} <= {4096} and made.count() <= membership.blocks_for(n)
    filters = made.withColumn("batch", F.lit(7))
    met = membership.may_hold(keys, filters, [1, membership.blocks_for(n)])
    assert met.select("key").distinct().count() == n and met.columns == ["key", "batch"]
    others = spark.range(20_000).select(F.concat(F.lit("other"), "id").alias("key"))
    assert membership.may_hold(others, filters, [membership.blocks_for(n)]).count() <= 2


def test_sizes_are_powers_of_two():
    sizes = [membership.blocks_for(n) for n in (0, 1, 1024, 1025, 2048, 2049, 100_000)]
    assert sizes == [1, 1, 1, 2, 2, 4, 128] and all(s * membership.BLOCK_BITS >= n * membership.BITS for s, n in zip(sizes, (0, 1, 1024, 1025, 2048, 2049, 100_000)))


def _urls(spark, ids):
    return spark.createDataFrame([(f"http://shop/{i}",) for i in ids], "image_url string")


def test_a_batch_reads_only_batches_that_may_hold_its_urls(spark, tmp_path):
    """Twenty batches; each brings new URLs, some of the batch before it and some of the first."""
    table, size, read, filters = f"file://{tmp_path}/t", 1000, [], []
    sync.create_table(spark, table, _urls(spark, range(500)).withColumn("faiss_id", F.monotonically_increasing_id() * 0 + 41))
    for batch in range(20):
        first = 1000 + batch * size
        new = list(range(first, first + size))
        old = [0, 1, 2] + (list(range(first - 10, first)) if batch else [])
        older = sync.older_batches(spark, table, before=batch)
        assert older.next_id == 42 + size * batch and set(older.blocks) == {-1, *range(batch)}
        known = sync.known_urls(_urls(spark, new + old), table, older)
        assert {r.image_url for r in known.collect()} == {f"http://shop/{i}" for i in old}
        plan = known._jdf.queryExecution().executedPlan().toString()
        assert "ReadSchema: struct<image_url:string>" in plan and re.search(r"PartitionFilters: \[.*batch", plan)
        batches = sync.suspects(_urls(spark, new + old), table, older)[1]
        assert set(batches) <= {-1, 0, batch - 1}
        read.append(sum(f.stat().st_size for b in batches for f in (tmp_path / "t" / f"batch={b}").glob("*.parquet")))
        rows = _urls(spark, new).withColumn("faiss_id", F.regexp_extract("image_url", r"(\d+)$", 1).cast("long") - 1000 + 42)
        sync._put(rows, sync.ROWS, table, batch)
        sync._index_batch(spark, table, batch, older.next_id)
        filters.append(sum(f.stat().st_size for f in (tmp_path / "t-index/seen" / f"batch={batch}").glob("*.parquet")))
    assert max(read[10:]) <= 1.1 * max(read[1:10]) and max(filters) < 6 * size


def test_no_table_is_left_and_a_rerun_gives_the_same(spark, tmp_path, monkeypatch):
    table, dead, work = f"file://{tmp_path}/t", f"file://{tmp_path}/dead", tmp_path / "work"
    work.mkdir()
    monkeypatch.setattr(shared, "shared_dir", lambda spark, own=shared.shared_dir: own(spark) if shared._SCOPES.get() else f"file://{work}/catsim-{len(list(work.iterdir()))}")
    sync.create_table(spark, table)
    sync.create_table(spark, dead, schema=sync.FAILED)
    cols = "page long, pos long, image_url string, product_name string, product_name_cn string, product_id string, category string"
    for batch in range(4):
        rows = [(0, i, f"u{batch * 3 + i}", "name", "", str(i), "c") for i in range(4)]
        sync.add_batch(spark.createDataFrame(rows, cols), batch, table, dead)
        assert list(work.iterdir()) == []
    before = sorted(map(tuple, sync.read_rows(spark, table).collect()))
    assert [r[-2] for r in before] and sorted(r[-2] for r in before) == list(range(13))
    sync.add_batch(spark.createDataFrame([(0, i, f"u{6 + i}", "name", "", str(i), "c") for i in range(4)], cols), 2, table, dead)
    assert sorted(map(tuple, sync.read_rows(spark, table).collect())) == before


def test_broken_pages_are_dead_letters(spark, tmp_path):
    feed = tmp_path / "feed"
    feed.mkdir()
    page = '{"page": 3, "items": [{"img": "a", "id": "1"}, {"img": "b?x", "id": "2"}]}'
    (feed / "1.json").write_text(f'{page}\n{page[:40]}\nnot json\n{{"page": "x", "items": 7}}\n{{"page": 4}}\n')
    at = {k: f"file://{tmp_path}/{k}" for k in ("table", "dead", "status", "state")}
    sync.create_table(spark, at["table"])
    sync.create_table(spark, at["dead"], schema=sync.FAILED)
    sync.sync_stream(spark, f"file://{feed}", at["table"], at["dead"], at["state"], extra=sync.Extra(status=at["status"])).awaitTermination()
    letters = sync.read_rows(spark, at["dead"], sync.FAILED).collect()
    assert len(letters) == 3 and all(r.image_url is None and r.error.startswith("malformed page: ") for r in letters)
    status = sync.read_rows(spark, at["status"], sync.STATUS).collect()
    assert sorted((r.page, r.status) for r in status) == [(-1, "failed")] * 2 + [(3, "failed"), (3, "ok"), (3, "ok")]
    assert sync.retry_failed(spark, at["table"], at["dead"]).count() == 0


def test_scopes_are_each_threads_own(spark):
    import threading

    seen = {}

    def job(name, entered, leave):
        with shared.table_scope(spark) as root:
            entered.set()
            leave.wait(20)
            seen[name] = shared.shared_dir(spark).startswith(root)

    events = [threading.Event() for _ in range(4)]
    one = threading.Thread(target=job, args=("one", events[0], events[1]))
    two = threading.Thread(target=job, args=("two", events[2], events[3]))
    one.start(), events[0].wait(20), two.start(), events[2].wait(20)
    events[1].set(), one.join(20), events[3].set(), two.join(20)
    assert seen == {"one": True, "two": True} and not shared._SCOPES.get()
