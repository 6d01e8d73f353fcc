"""Searches dealt over cells, and sums of arrays, against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from catsim.operators import categories, search
from catsim.operators.arrays import array_sums


def _side(spark, name, rows, width, seed, extra=""):
    rng = np.random.default_rng(seed)
    made = np.round(rng.normal(size=(rows, width)), 2)
    rows = [(i, v.tolist(), "abbbbbbb"[i % 8]) for i, v in enumerate(made)]
    return made, spark.createDataFrame(rows, f"{name} long, coarse array<double>, category string")


def _best(q, v, k):
    score = np.round(q @ v.T, 9)
    return {(i, j): n for i in range(len(q)) for n, j in enumerate(np.lexsort((np.arange(len(v)), -score[i]))[:k], 1)}


@pytest.mark.parametrize(("query_bytes", "vector_bytes"), [(1 << 30, 1 << 30), (800, 1500), (300, 1 << 30), (1 << 30, 700)])
def test_every_pair_meets_in_one_cell(spark, query_bytes, vector_bytes):
    q, asked = _side(spark, "query_id", 40, 4, 1)
    v, held = _side(spark, "faiss_id", 90, 4, 2)
    cells = search.deal_cells(search._sides(asked, "query_id", F.lit("")), search._sides(held, "faiss_id", F.lit("")), query_bytes, vector_bytes)
    rows = cells.collect()
    where = lambda kind: {(r.i, r.j): {x.id for x in rows if x.kind == kind and (x.i, x.j) == (r.i, r.j)} for r in rows}
    asks, holds = where(0), where(1)
    met = [(a, b) for c in asks for a in asks[c] for b in holds[c]]
    assert len(met) == len(set(met)) == 40 * 90
    n_rows, n_cols = max(r.i for r in rows) + 1, max(r.j for r in rows) + 1
    assert len(rows) == 40 * n_cols + 90 * n_rows and (n_rows > 1) == (query_bytes < 40 * 32) and (n_cols > 1) == (vector_bytes < 90 * 32)
    ranked = {}
    for r in search._cell_topk(cells.repartition(3), 5).collect():
        ranked.setdefault(r.query_id, []).append((-r.clip_score, r.faiss_id))
    want = _best(q, v, 5)
    assert {(i, j) for i, found in ranked.items() for _, j in sorted(found)[:5]} == set(want)


def test_fifty_thousand_queries(spark, monkeypatch):
    asked = spark.range(50_000).select(F.col("id").alias("query_id"), F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.sin(F.col("id") * i)).alias("coarse"))
    _, held = _side(spark, "faiss_id", 300, 6, 3)
    got = search.coarse_topk(asked, held, 3)
    assert "Cartesian" not in got._jdf.queryExecution().toString() and "BroadcastNestedLoop" not in got._jdf.queryExecution().toString()
    sums = lambda df: tuple(df.agg(F.count("*"), F.sum("faiss_id"), F.sum(F.xxhash64("query_id", "faiss_id", "coarse_rank") % 1_000_003)).first())
    one = sums(got)
    monkeypatch.setattr(search, "BROADCAST_QUERIES", 60_000)
    assert one == sums(search.coarse_topk(asked, held, 3)) and one[0] == 150_000


def test_a_query_meets_its_own_category_only(spark):
    """An eighth of the vectors has category a; its queries score that eighth, others with a category theirs, the rest all."""
    q, asked = _side(spark, "query_id", 24, 4, 5)
    v, held = _side(spark, "faiss_id", 160, 4, 6)
    asked = asked.withColumn("only_category", F.when(F.col("query_id") % 3 == 0, "a").when(F.col("query_id") % 3 == 1, "none"))
    own = search.deal_cells(search._sides(asked, "query_id", F.col("only_category")).where("area IS NOT NULL"), search._sides(held, "faiss_id", F.col("category")).where("area IS NOT NULL"), vector_bytes=200)
    per_cell = own.groupBy("area", "i", "j").agg(F.count_if(F.col("kind") == 0).alias("q"), F.count_if(F.col("kind") == 1).alias("v"))
    assert per_cell.agg(F.sum(F.col("q") * F.col("v"))).first()[0] == 8 * 20
    got = {}
    for r in search.coarse_topk(asked, held, 7, within=True).collect():
        got.setdefault(r.query_id, []).append((r.coarse_rank, r.faiss_id))
    kinds = np.array(["abbbbbbb"[i % 8] for i in range(160)])
    for i in range(24):
        among = np.flatnonzero(kinds == "a") if i % 3 == 0 else np.arange(160) if i % 3 == 2 else []
        score = np.round(q[i] @ v[among].T, 9) if len(among) else np.empty(0)
        assert [j for _, j in sorted(got.get(i, []))] == [int(among[x]) for x in np.lexsort((np.arange(len(among)), -score))[:7]]


def test_array_sums(spark):
    rng = np.random.default_rng(4)
    rows = [(["x", "y", None, "hot"][min(i % 8, 3)], rng.normal(size=5).tolist()) for i in range(900)]
    df = spark.createDataFrame([*rows, ("x", None), ("gone", None)], "kind string, v array<float>").repartition(5)
    got = {r.kind: r for r in array_sums(df, "kind", "v").collect()}
    assert set(got) == {"x", "y", None, "hot"}
    for kind, r in got.items():
        own = np.array([v for k, v in rows if k == kind])
        assert r.n == len(own) and np.allclose(r.sum, own.sum(axis=0), atol=1e-3)
    plan = array_sums(df, "kind", "v")._jdf.queryExecution().toString()
    assert "Generate" not in plan
    assert array_sums(df.limit(0), "kind", "v").collect() == []
    with pytest.raises(Exception, match="differ in length"):
        array_sums(spark.createDataFrame([("x", [1.0]), ("x", [1.0, 2.0])], "kind string, v array<float>").coalesce(1), "kind", "v").collect()


def test_prototypes_shuffle_one_row_for_each_category_and_task(spark):
    _, held = _side(spark, "faiss_id", 400, 6, 8)
    rows = held.select("faiss_id", "category").unionByName(spark.createDataFrame([(999, "alone")], "faiss_id long, category string"))
    vectors = held.select("faiss_id", "coarse").unionByName(spark.createDataFrame([(999, [3.0, 4.0, 0.0, 0.0, 0.0, 0.0])], "faiss_id long, coarse array<double>"))
    got = {r.category: r for r in categories.category_prototypes(rows, vectors).collect()}
    assert got["alone"].prototype == [3.0, 4.0, 0.0, 0.0, 0.0, 0.0] and got["a"].n == 50
    assert abs(sum(x * x for x in got["b"].prototype) - 1) < 1e-6
