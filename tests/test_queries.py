"""The registered queries on small tables whose answers are known."""

import numpy as np
import pytest

from catsim.jobs import queries


@pytest.fixture
def near_in_fine_only(spark, tmp_path):
    """Vector 101 is the best match of query 60, but comes last of 150 in the coarse search."""
    v = np.zeros((150, 64))
    v[:, 0], v[:, 32] = 1, -1
    v[[60, 101], 32] = 1
    v[101, 1] = 0.1
    rows = [(i, x.tolist(), i) for i, x in enumerate(v)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(i, "canvas tote", "travel", "Brand") for i in range(150)], "p_partkey long, p_name string, p_type string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


def test_coarse_candidates_are_not_cut(spark, near_in_fine_only):
    assert queries.coarse_topk(spark, near_in_fine_only).where("query_id = 60").count() == 150


@pytest.mark.parametrize("query", [queries.search_core, queries.search_category_filtered, queries.batch_hits])
def test_late_coarse_candidates_reach_the_fine_ranking(spark, near_in_fine_only, query):
    got = query(spark, near_in_fine_only).where("query_id = 60").orderBy("rank").collect()
    assert [r.faiss_id for r in got] == [60, 101]


def test_backfill_keeps_100_characters(spark, tmp_path):
    titles = {0: "sturdy canvas tote " * 4 + "lastword", 30: "x" * 150}
    rows = [(i, f"https://shop.example/bags/{i}", f"<html><title>{t}</title></html>") for i, t in titles.items()]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.faiss_id: r for r in queries.backfill_all(spark, str(tmp_path)).collect()}
    assert got[0].product_name == "v2 " + titles[0] and "lastword" in got[0].keywords_en.split()
    assert got[30].product_name == "v2 " + "x" * 97
    assert {len(r.product_name) for r in queries.feed_first_wins(spark, str(tmp_path)).collect()} == {60}
