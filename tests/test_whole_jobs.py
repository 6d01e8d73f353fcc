"""Sync with vectors, status and retry; search by images; rebuilt stores; folding; scopes of tables."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from catsim.functions import images, text
from catsim.jobs.rebuild import rebuild_store
from catsim.jobs.search import image_search
from catsim.operators import categories, joins, names, reports, search
from catsim.sources import catalogue as tables
from catsim.sources import shared
from catsim.streaming import sync


def _factory():
    """A model factory that can be sent to tasks, which don't see this module."""

    def factory():
        import numpy as np

        def model(inputs):
            if any(len(x) != 64 for x in inputs):
                raise ValueError("odd image")
            fine = np.stack([np.frombuffer(bytes(x), np.uint8).astype(float) - 127 for x in inputs])
            return fine[:, :16], fine

        return model

    return factory


def _embed(spark, bad=()):
    content = F.unhex(F.lpad(F.hex(F.col("product_id").cast("long") + 1), 128, "0"))
    return lambda products: images.embed_images(products.where("product_id <> '5'").withColumn("content", F.when(F.col("product_id").isin(*bad), F.lit(b"x")).otherwise(content) if bad else content), "image_url", "content", _factory())


def test_whole_sync_and_a_retry_that_lands(spark, tmp_path):
    feed = tmp_path / "feed"
    feed.mkdir()
    at = {n: f"file://{tmp_path}/{n}" for n in ("table", "failed", "vectors", "status", "state")}
    sync.create_table(spark, at["table"], spark.createDataFrame([("known", 7)], "image_url string, faiss_id long"))
    sync.create_table(spark, at["failed"], schema=sync.FAILED)
    items = [{"img": u, "id": str(i), "nameEn": n} for i, (u, n) in enumerate([("a", "Canvas tote"), ("known", ""), ("a?2", "later"), ("b", "broken"), ("c", "fails in the model"), ("d", "has no image"), ("e", "")])]
    (feed / "0.json").write_text(json.dumps({"page": 0, "items": items}))
    check = lambda p: p.withColumns({"error": F.when(F.col("product_name") == "broken", "too_large"), "bytes": F.lit(10)})
    extra = sync.Extra(_embed(spark, ["4"]), at["vectors"], at["status"])
    sync.sync_stream(spark, f"file://{feed}", at["table"], at["failed"], at["state"], check, extra).awaitTermination()
    rows = {r.image_url: r for r in sync.read_rows(spark, at["table"]).collect()}
    assert {u: r.faiss_id for u, r in rows.items()} == {"known": 7, "a": 8, "e": 9} and rows["a"].keywords_en == "canvas tote"
    assert sorted((r.faiss_id, len(r.coarse), len(r.fine)) for r in sync.read_rows(spark, at["vectors"], sync.VECTORS).collect()) == [(8, 16, 64), (9, 16, 64)]
    failed = {r.image_url: r.error for r in sync.read_rows(spark, at["failed"], sync.FAILED).collect()}
    assert failed == {"b": "too_large", "c": "ValueError: odd image", "d": "no image"}
    report = {r.page: tuple(r)[1:] for r in reports.sync_report(sync.read_rows(spark, at["status"], sync.STATUS)).collect()}
    assert report == {0: (2, 2, 3, 50), None: (2, 2, 3, 50)}
    again = sync.Extra(_embed(spark), at["vectors"])
    for _ in range(2):
        second = sync.add_retried(spark, at["table"], at["failed"], sync.no_errors, again)
        assert {r.image_url: r.status for r in second.collect()} == {"b": "ok", "c": "ok", "d": "failed"}
        ids = {r.image_url: r.faiss_id for r in sync.read_rows(spark, at["table"]).collect()}
        assert ids == {"known": 7, "a": 8, "e": 9, "b": 10, "c": 11}
        assert {r.faiss_id for r in sync.read_rows(spark, at["vectors"], sync.VECTORS).collect()} == {8, 9, 10, 11}
    assert sync.add_retried(spark, at["table"], at["failed"], attempt=1).count() == 1
    assert len({r.faiss_id for r in sync.read_rows(spark, at["table"]).collect()}) == 6


def _requests(spark, tiles):
    image = lambda content, channels: (("", 8, 8, channels, 0, content))
    rows = [(1, tiles[0], 64, image(tiles[0], 1)), (2, tiles[1], 64, image(tiles[1], 1)), (3, tiles[0], 64, image(tiles[0], 1)), (4, b"", 0, image(b"", -1)), (5, b"\xc8" * 64, 64, image(b"\xc8" * 64, 1)), (6, b"x" * 64, 64, image(b"", -1)), (7, tiles[2][:63], 63, image(tiles[2], 1))]
    kind = "query_id long, content binary, length long, image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
    return spark.createDataFrame(rows, kind).withColumns({"category": F.lit(""), "auto_category": F.lit(False)})


def test_image_search_checks_folds_and_hands_back(spark):
    rng = np.random.default_rng(4)
    tiles = [bytes(rng.integers(0, 256, 64, dtype=np.uint8).tolist()) for _ in range(12)]
    stored = spark.createDataFrame(list(enumerate(tiles)), "faiss_id long, content binary")
    vectors = images.embed_images(stored, "faiss_id", "content", _factory()).drop("error")
    rows = spark.createDataFrame([(i, "c", "") for i in range(12)], "faiss_id long, category string, product_name string")
    got = image_search(_requests(spark, tiles), rows, vectors, _factory())
    assert {(r.query_id, r.faiss_id) for r in got.hits.where("rank = 1").collect()} == {(1, 0), (2, 1), (3, 0)}
    assert {r.query_id for r in got.summary.collect()} == {1, 2, 3}
    assert {r.query_id: r.reason for r in got.refused.collect()} == {4: "empty", 5: "blurred", 6: "undecodable", 7: "ValueError: odd image"}


def test_rebuilt_store(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"u{i}") for i in range(5)], "faiss_id long, image_url string")
    content = spark.createDataFrame([("u0", b"a" * 64), ("u1", b"b"), ("u2", b"c" * 64)], "image_url string, content binary")
    counts = rebuild_store(rows, content, _factory(), f"file://{tmp_path}/v")
    assert {r.status: r.n for r in counts.collect()} == {"ok": 2, "failed": 1, "missing": 2}
    assert [r.faiss_id for r in tables.read_vectors(spark, f"file://{tmp_path}/v").orderBy("faiss_id").collect()] == [0, 2]


def test_folding_keeps_requests_apart(spark):
    rows = [(5, b"x", None, 20), (3, b"x", None, 20), (4, b"x", "c", 20), (6, b"x", None, 10), (7, None, None, 20)]
    queries = spark.createDataFrame(rows, "query_id long, content binary, category string, top_k int")
    assert {r.query_id: r.representative for r in reports.fold_members(queries).collect()} == {5: 3, 3: 3, 4: 4, 6: 6, 7: 7}
    assert sorted((r.query_id, r.n) for r in reports.fold_queries(queries).collect()) == [(3, 2), (4, 1), (6, 1), (7, 1)]


@pytest.mark.parametrize("broadcast", [0, 100])
def test_restriction_before_the_cut(spark, monkeypatch, broadcast):
    monkeypatch.setattr(search, "BROADCAST_QUERIES", broadcast)
    monkeypatch.setattr(search, "QUERY_BLOCK", 2)
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(9)], "faiss_id long, coarse array<double>")
    rows = spark.createDataFrame([(i, "a" if i < 2 else "b") for i in range(8)], "faiss_id long, category string")
    queries = spark.createDataFrame([(q, [1.0, 0.0]) for q in range(4)], "query_id long, coarse array<double>")
    filters = spark.createDataFrame([(0, "a"), (1, "b"), (2, None), (3, "none")], "query_id long, only_category string")
    got = categories.before_cut(queries, filters, vectors, rows, 2).orderBy("query_id", "coarse_rank").collect()
    assert [(r.query_id, r.faiss_id) for r in got] == [(0, 1), (0, 0), (1, 7), (1, 6), (2, 8), (2, 7)]


def test_many_chunks_of_ties(spark, monkeypatch):
    monkeypatch.setattr(search, "VECTOR_BLOCK", 3)
    vectors = spark.createDataFrame([(i, [1.0 if i % 4 else 2.0]) for i in range(40)], "faiss_id long, coarse array<double>").repartition(3)
    got = search.coarse_topk(spark.createDataFrame([(1, [1.0])], "query_id long, coarse array<double>"), vectors, 12).orderBy("coarse_rank").collect()
    assert [r.faiss_id for r in got] == [0, 4, 8, 12, 16, 20, 24, 28, 32, 36, 1, 2]


def test_names_meet_on_the_rarest_gram(spark):
    texts = spark.createDataFrame([("procase the",)], "text string")
    plain = spark.createDataFrame([("the procase",), ("pro the case",), ("other",), ("pro",)], "product_name string")
    assert {r.product_name: r.keywords for r in names.match_names(texts, plain).collect()} == {"the procase": "procase the", "pro the case": "the", "other": "the"}


def test_tokens_of_odd_spaces_and_digits(spark):
    got = spark.createDataFrame([("alpha\x1cbeta　gamma ①②③④ ²²²² beta",)], "t string").select(text.tokens("t", 3)).first()[0]
    assert got == ["alpha", "beta", "gamma"]


def test_sharp_images_and_spread_join(spark):
    board = [8.0 * ((i // 8 + i) % 2) for i in range(64)]
    df = spark.createDataFrame([(1, board), (2, [1.0] * 64), (3, None)], "i int, p array<double>")
    assert [r.i for r in images.filter_sharp(df, "p", F.lit(8), F.lit(8)).collect()] == [1]
    many = spark.range(100).withColumn("k", F.lit(1)).withColumn("way", F.col("id"))
    one = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    assert joins.spread_join(many, one, ["k"], "id").where("v = 'x' and way = id").count() == 100


def test_tables_of_a_scope_are_deleted(spark):
    with shared.table_scope(spark) as root:
        table = shared.write_table(spark.range(5), "t")
        assert table.count() == 5 and root in table.inputFiles()[0]
        files = table.inputFiles()
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0])
    assert not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
    alone = shared.write_table(spark.range(3), "t")
    path = alone.inputFiles()[0]
    shared.drop_table(alone)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    assert not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
