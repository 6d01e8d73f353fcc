import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from catsim.functions import images
from catsim.jobs.search import batch_search
from catsim.operators import categories, ids, ingest, names
from catsim.sources import catalogue as tables
from catsim.streaming import sync

HITS = "query_id long, rank int, faiss_id long, fused_score double, product_name string"
ROWS = [(1, 1, 10, 0.9, "Xiaomi Redmi Note 12 Pro 5G Phone-Case (Black) 6.5"), (1, 2, 11, 0.8, "Phone Case Red"), (1, 3, 12, 0.7, "Phone Holder"), (1, 4, 13, 0.6, ""), (2, 1, 14, 0.9, "only"), (3, 1, 15, 0.9, None), (3, 2, 16, 0.8, "x")]


def test_name_anchor_and_consensus(spark):
    marked = names.mark_name_anchor(spark.createDataFrame(ROWS, HITS))
    kept = {(r.query_id, r.rank): r.kept for r in marked.collect()}
    assert kept == {(1, 1): True, (1, 2): True, (1, 3): False, (1, 4): False, (2, 1): True, (3, 1): True, (3, 2): True}
    assert {r.query_id: r.consensus_word for r in names.consensus_word(marked).collect()} == {1: "xiaomi", 2: "", 3: ""}


def test_text_boost(spark):
    keywords = spark.createDataFrame([(1, ["phone", "case", "note", "xiaomi"])], "query_id long, keywords array<string>")
    hits = [(1, 1, 10, 0.7, "holder"), (1, 2, 11, 0.65, "Phone Case Red"), (1, 3, 12, 0.6, "Xiaomi Note phone case"), (2, 1, 14, 0.9, "phone")]
    got = {r.faiss_id: (r.rank, r.fused_score, r.text_boost) for r in names.text_boost(spark.createDataFrame(hits, HITS), keywords).collect()}
    assert got == {12: (1, 0.75, 0.15), 11: (2, 0.75, 0.1), 10: (3, 0.7, 0.0), 14: (1, 0.9, 0.0)} or got == {11: (1, 0.75, 0.1), 12: (2, 0.75, 0.15), 10: (3, 0.7, 0.0), 14: (1, 0.9, 0.0)}
    assert got[11][0] == 1  # a tie keeps the former order


def test_match_names(spark):
    texts = spark.createDataFrame([("Case, PHONE 123 ab",), (None,), ("",)], "text string")
    plain = ["Phonecase", "phone", "xx", "", None, "123", "casework phone phone"]
    got = names.match_names(texts, spark.createDataFrame([(p,) for p in plain], "product_name string")).collect()
    assert {r.product_name: r.keywords for r in got} == {"Phonecase": "case phone", "phone": "phone", "casework phone phone": "case phone"}


@pytest.mark.parametrize("scores,want", [({"A": 0.80, "B": 0.79}, (None, 0.01)), ({"A": 0.80, "B": 0.78}, ("A", 0.02)), ({"A": 0.015}, (None, 0.015))])
def test_classify(spark, scores, want):
    prototypes = spark.createDataFrame([(c, [s, 0.0]) for c, s in scores.items()], "category string, prototype array<double>")
    got = categories.classify(spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, coarse array<double>"), prototypes).first()
    assert (got.predicted_category, got.confidence) == want


def test_category_filters(spark):
    queries = spark.createDataFrame([(1, "x", True), (2, "gone", True), (3, "", True), (4, None, True), (5, "", True), (6, "", False), (7, "", None)], "query_id long, category string, auto_category boolean")
    predicted = spark.createDataFrame([(3, "x", 0.5), (4, "z", 0.5), (5, None, 0.01), (6, "x", 0.5)], "query_id long, predicted_category string, confidence double")
    rows = spark.createDataFrame([(10, "x"), (11, "y"), (12, None)], "faiss_id long, category string")
    filters = categories.category_filters(queries, predicted, rows)
    assert {r.query_id: (r.filter_source, r.only_category) for r in filters.collect()} == {1: ("manual", "x"), 2: ("manual", "gone"), 3: ("auto", "x"), 4: ("auto_empty", None), 5: ("none", None), 6: ("none", None), 7: ("none", None)}
    hits = spark.createDataFrame([(q, f) for q in (1, 2, 4) for f in (10, 11, 12)], "query_id long, faiss_id long")
    assert {(r.query_id, r.faiss_id) for r in categories.restrict(hits, filters, rows).collect()} == {(1, 10), (4, 10), (4, 11), (4, 12)}


def test_ids_are_dense_over_partitions(spark):
    df = spark.range(1000, numPartitions=7).select((F.hash("id") % 100000).alias("k"), "id")
    got = ids.allocate_ids(df, ["k", "id"], start=5).orderBy("faiss_id").collect()
    assert [r.faiss_id for r in got] == list(range(5, 1005)) and [(r.k, r.id) for r in got] == sorted((r.k, r.id) for r in got)
    none = spark.createDataFrame([], "faiss_id long")
    assert ids.next_id(none) == 0 and ids.allocate_ids(none.withColumnRenamed("faiss_id", "k"), ["k"]).count() == 0


def test_backfill(spark):
    old = spark.createDataFrame([("u", "", "c"), ("v", None, None), ("w", "n", "c")], "image_url string, product_name string, product_name_cn string")
    old = old.withColumns({"product_id": F.lit(""), "keywords_cn": F.lit(""), "keywords_en": F.lit("")})
    feed = spark.createDataFrame([(0, 0, "u", "first", "", "1"), (1, 0, "u", "later word", "红", "2"), (0, 1, "w", "no", "", "3")], "page long, pos long, image_url string, product_name string, product_name_cn string, product_id string")
    got = ingest.backfill_names(old, feed)
    assert {r.image_url: (r.product_name, r.product_id, r.keywords_cn, r.keywords_en, r.status) for r in got.collect()} == {
        "u": ("later word", "2", "红", "later word", "updated"), "v": (None, "", "", "", "not_found"), "w": ("n", "", "", "", "complete")
    }
    assert {r.status: r.n for r in ingest.outcome_counts(got).collect()} == {"updated": 1, "not_found": 1, "complete": 1}


def test_manifest_and_migration(spark):
    lists = {"files": ["a.jpg", "", "c.jpg"], "image_urls": ["u0", "u1"], "product_names": ["n0"], "product_names_cn": [], "product_ids": [7], "keywords_cn_list": [], "keywords_en_list": []}
    made = spark.createDataFrame([tuple(map(json.dumps, lists.values())) + (" ",)], ", ".join(f"{c} string" for c in lists) + ", category string")
    rows = tables.explode_manifest(made)
    assert [(r.file_name, r.image_url, r.product_name, r.product_id, r.category) for r in rows.orderBy("pos").collect()] == [("a.jpg", "u0", "n0", "7", "其他"), ("c.jpg", "c.jpg", "", "", "其他")]
    whole = tables.migrate_catalogue(rows)
    assert whole.schema.names == tables.CATALOGUE.names and {r.file_size for r in whole.collect()} == {0}


def test_vectors_round_trip(spark, tmp_path):
    assert tables.read_vectors(spark, f"file://{tmp_path}/none").count() == 0
    tables.write_vectors(spark.createDataFrame([(2, [1.0], [2.0]), (1, [3.0], [4.0])], tables.VECTORS), f"file://{tmp_path}/v")
    assert sorted(r.faiss_id for r in tables.read_vectors(spark, f"file://{tmp_path}/v").collect()) == [1, 2]


def test_sharpness(spark):
    flat, dot = np.full(64, 200.0), np.zeros(64)
    dot[3 * 8 + 3] = 10
    board = np.array([8.0 * ((i // 8 + i) % 2) for i in range(64)])
    df = spark.createDataFrame([(0, flat.tolist()), (1, dot.tolist()), (2, board.tolist()), (3, None), (4, [1.0])], "i int, p array<double>")
    got = {r.i: r.s for r in df.select("i", images.sharpness("p", F.lit(8), F.lit(8)).alias("s")).collect()}
    assert got == {0: 0.0, 1: pytest.approx(0.7 * 110.9375), 2: 576.0, 3: None, 4: None}


def _png(pixels: np.ndarray) -> bytes:
    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    height, width, channels = pixels.shape
    lines = b"".join(b"\0" + row.tobytes() for row in pixels)
    head = struct.pack(">IIBBBBB", width, height, 8, {3: 2, 4: 6}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def test_image_files(spark, tmp_path):
    red = np.zeros((30, 50, 3), np.uint8)
    red[..., 0] = 255
    clear = np.zeros((224, 224, 4), np.uint8)
    (tmp_path / "sub").mkdir()
    (tmp_path / "red.png").write_bytes(_png(red))
    (tmp_path / "sub" / "clear.PNG").write_bytes(_png(clear))
    (tmp_path / "bad.jpg").write_bytes(b"no image")
    (tmp_path / "empty.png").write_bytes(b"")
    (tmp_path / "notes.txt").write_text("x")
    found = images.read_image_dir(spark, f"file://{tmp_path}").withColumn("name", F.regexp_extract("path", "([^/]+)$", 1)).cache()
    got = {r.name: (r.reason, r.info.format, r.info.width) for r in found.select("name", images.invalid_reason().alias("reason"), images.image_info().alias("info")).collect()}
    assert got["red.png"] == (None, "PNG", 50) and got["clear.PNG"] == (None, "PNG", 224)
    assert got["bad.jpg"][0] == "undecodable" and len(got) == 3
    sizes = found.where("name = 'red.png'").select(F.explode(F.array(F.lit(0), F.lit(images.MAX_BYTES), F.lit(images.MAX_BYTES + 1))).alias("length"), "image")
    assert [r[0] for r in sizes.orderBy("length").select(images.invalid_reason()).collect()] == ["empty", None, "too_large"]
    tensors = {r.name: r.t for r in found.select("name", images.model_tensor("image").alias("t")).collect()}
    unit = lambda rgb: [(v / 255 - m) / d for v, m, d in zip(rgb, images.MEAN, images.DEVIATION, strict=True)]
    assert np.allclose(np.reshape(tensors["red.png"], (3, -1)).T, unit((255, 0, 0)), atol=1e-5)
    assert np.allclose(np.reshape(tensors["clear.PNG"], (3, -1)).T, unit((255, 255, 255)), atol=1e-5) and tensors["bad.jpg"] is None


def test_embedding_isolates_bad_inputs(spark):
    def factory():
        def model(inputs):
            if "bad" in inputs:
                raise ValueError("bad input")
            made = np.array([[len(x), 1.0] for x in inputs])
            return made, made * 2

        return model

    df = spark.createDataFrame([(i, "bad" if i == 3 else "x" * i) for i in range(10)], "id long, x string")
    got = {r.id: r for r in images.embed_images(df, "id", "x", factory, batch_size=4).collect()}
    assert [i for i, r in got.items() if r.error] == [3] and got[3].error == "ValueError: bad input"
    assert np.allclose(np.linalg.norm(got[5].coarse), 1, atol=1e-5) and len(got) == 10
    rows = spark.createDataFrame([(1, "u"), (2, "v")], "faiss_id long, image_url string")
    again = images.rebuild_vectors(rows, spark.createDataFrame([("u", "xx")], "image_url string, content string"), factory)
    assert {r.faiss_id: r.error for r in again.collect()} == {1: None, 2: "missing"}


def _page(folder, page, items):
    (folder / f"{page}.json").write_text(json.dumps({"page": page, "items": items}))


def test_stream(spark, tmp_path):
    feed = tmp_path / "feed"
    feed.mkdir()
    table, failed, state = (f"file://{tmp_path}/{n}" for n in ("table", "failed", "state"))
    sync.create_table(spark, table)
    sync.create_table(spark, failed, schema=sync.FAILED)
    check = lambda p: p.withColumn("error", F.when(F.col("product_name") == "broken", "no image"))
    run = lambda: sync.sync_stream(spark, f"file://{feed}", table, failed, state, check).awaitTermination()
    _page(feed, 0, [{"img": "b?1", "nameEn": "B", "id": "1"}, {"img": "a", "nameEn": "A"}, {"img": "b?2", "nameEn": "later"}, {"img": "c", "nameEn": "broken"}, {"img": ""}])
    run()
    _page(feed, 1, [{"img": "a", "nameEn": "again"}, {"img": "d", "nameEn": "D", "tags": [{"nameEn": "T"}]}])
    run()
    rows = {r.image_url: (r.faiss_id, r.product_name, r.category) for r in sync.read_rows(spark, table).collect()}
    assert rows == {"a": (0, "A", "其他"), "b": (1, "B", "其他"), "d": (2, "D", "T")}
    # The same batch again, as after a lost driver, changes nothing.
    batch = ingest.project_products(tables.read_product_feed(spark, f"file://{feed}/1.json"))
    sync.add_batch(batch, 1, table, failed, check)
    assert {r.image_url: r.faiss_id for r in sync.read_rows(spark, table).collect()} == {"a": 0, "b": 1, "d": 2}
    assert [(r.image_url, r.error) for r in sync.retry_failed(spark, table, failed).collect()] == [("c", None)]


def test_batch_search_keeps_empty_answers(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(30, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    vectors = spark.createDataFrame([(i, x.tolist(), x.tolist()) for i, x in enumerate(v)], "faiss_id long, coarse array<double>, fine array<double>")
    rows = spark.createDataFrame([(i, f"c{i % 3}", f"phone case {i % 2}") for i in range(30)], "faiss_id long, category string, product_name string")
    queries = spark.createDataFrame([(i, v[i].tolist(), v[i].tolist(), c, True) for i, c in enumerate(["", "none", "c2"])], "query_id long, coarse array<double>, fine array<double>, category string, auto_category boolean")
    answer = batch_search(queries, rows, vectors)
    summary = {r.query_id: r for r in answer.summary.collect()}
    assert len(summary) == 3 and summary[1].n_before == 0 and summary[1].filter_source == "manual"
    best = {r.query_id: r.faiss_id for r in answer.hits.where("rank = 1").collect()}
    assert best[2] == 2 and 1 not in best
