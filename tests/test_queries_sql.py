"""A registered query against its SQL, in the ranks that the SQL has."""

import numpy as np
import pytest

from catsim.jobs import queries


def test_coarse_scores_are_those_of_the_sql(spark, tmp_path):
    """Vector 40 undoes the draw in float, so it has no length and scores 0; in double a rest is left, whose direction is noise."""
    duckdb = pytest.importorskip("duckdb")
    v = np.random.default_rng(5).normal(size=(80, 64)).astype(np.float32)
    v[40] = -(np.float32(1.5) * v[0])
    path = f"{tmp_path}/embeddings.parquet"
    spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(path)
    got = queries.coarse_topk(spark, str(tmp_path))
    rows = {(r.query_id, r.coarse_rank): (r.faiss_id, r.clip_score) for r in got.collect()}
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{path}/*.parquet')")
        want = con.execute(f"SELECT query_id, coarse_rank, faiss_id, clip_score FROM ({queries.ORACLE_SQL['coarse_topk']})").fetchall()
    assert len(rows) == 4 * 80 and len(want) == 4 * 50
    assert {k: x for k, x in rows.items() if k[1] <= 50} == {(q, k): (f, s) for q, k, f, s in want}
    assert {x[1] for k, x in rows.items() if k[0] == 40} == {0.0}
