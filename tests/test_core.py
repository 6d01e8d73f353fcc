import numpy as np
import pytest
from pyspark.sql import functions as F

from catsim.functions import text
from catsim.operators import ingest, reports, search


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column).first()[0]


@pytest.mark.parametrize("name,want", [("红色手机壳", "壳 手 手机 手机壳 机 机壳 红 红手 红手机"), ("abc", ""), ("", ""), ("大小", ""), ("鞋", "鞋"), (None, "")])
def test_keywords_cn(spark, name, want):
    assert one(spark, name, text.keywords_cn("t")) == want


def test_tokenizers(spark):
    name = "Xiaomi Redmi Note 12 Pro 5G Phone-Case (Black) 6.5"
    assert one(spark, name, text.keywords_en("t")) == "case note phone"
    assert set(one(spark, name, text.anchor_tokens("t"))) == {"note", "pro", "5g", "phone", "case"}
    assert set(one(spark, "手机壳 红", text.anchor_tokens("t"))) == {"手机壳", "手", "机", "壳"}
    assert "red" in one(spark, "Phone Case Red", text.anchor_tokens("t"))


def test_stretch(spark):
    rows = [(0.99, 0.9818), (0.85, 0.7273), (0.835, 0.7), (0.834, 0.6982), (0.72, 0.4909), (0.71, 0.4727), (0.45, 0.0), (0.1, 0.0)]
    got = spark.createDataFrame(rows, "raw double, want double").select(search.stretch("raw"), "want").collect()
    assert all(a == b for a, b in got)


@pytest.mark.parametrize("broadcast", [0, 100])
def test_coarse_topk_in_blocks(spark, monkeypatch, broadcast):
    monkeypatch.setattr(search, "BROADCAST_QUERIES", broadcast)
    monkeypatch.setattr(search, "QUERY_BLOCK", 7)
    monkeypatch.setattr(search, "VECTOR_BLOCK", 11)
    rng = np.random.default_rng(1)
    q, v = rng.normal(size=(20, 8)), rng.normal(size=(60, 8))
    v[7] = v[3]
    queries = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "query_id long, coarse array<double>")
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(None, [0.0] * 8), (99, None)], "faiss_id long, coarse array<double>")
    got = {(r.query_id, r.coarse_rank): r.faiss_id for r in search.coarse_topk(queries, vectors, 5).collect()}
    for i in range(20):
        order = sorted(range(60), key=lambda j: (-round(float(q[i] @ v[j]), 9), j))[:5]
        assert [got[(i, k + 1)] for k in range(5)] == order


def test_feed(spark):
    rows = [(0, 0, "http://x/a.jpg?x=1", "1", "n", " A ", " Shoes ", "Bags"), (0, 1, "http://x/b.jpg#t", None, None, None, " ", "Bags"), (0, 2, "http://x/c.jpg", "3", "", "C", None, " "), (0, 3, None, "4", "", "", None, None), (0, 4, "?q", "5", "", "", None, None), (1, 0, "http://x/a.jpg?y", "6", "", "later", None, None)]
    items = spark.createDataFrame(rows, "page long, pos long, img string, id string, name string, nameEn string, tag string, category string")
    products = ingest.project_products(items)
    first = {r.image_url: r for r in ingest.one_per_url(products).collect()}
    assert {u: r.category for u, r in first.items()} == {"http://x/a.jpg": "Shoes", "http://x/b.jpg#t": "Bags", "http://x/c.jpg": "其他"}
    assert first["http://x/a.jpg"].product_name == "A"
    assert {r.image_url: r.product_name for r in ingest.one_per_url(products, last=True).collect()}["http://x/a.jpg"] == "later"
    known = spark.createDataFrame([("http://x/a.jpg",)], "image_url string")
    assert ingest.new_products(ingest.one_per_url(products), known).count() == 2 and ingest.known_products(products, known).count() == 2


def test_detections(spark):
    rows = [(1, "Nike", 0.9), (1, " Nike ", 0.7), (1, "x", 0.49), (1, " ", 0.9), (1, "Air", 0.5)]
    got = reports.dedup_detections(spark.createDataFrame(rows, "image_id long, text string, confidence double")).collect()
    assert {(r.text, r.confidence) for r in got} == {("Nike", 0.9), ("Air", 0.5)}


def test_rerank_gate(spark):
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "query_id long, fine array<double>")
    vectors = spark.createDataFrame([(10, [0.85, 0.834]), (11, [0.72, 0.1]), (12, [0.71, 0.1])], "faiss_id long, fine array<double>")
    hits = spark.createDataFrame([(q, f, 0.5, k) for q in (1, 2) for k, f in enumerate((12, 11, 10, 99))], "query_id long, faiss_id long, clip_score double, coarse_rank int")
    got = search.rerank(hits, queries, vectors).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.faiss_id, r.rank) for r in got] == [(1, 10, 1), (1, 11, 2)]
