"""Two-stage similarity search for many queries at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catsim.operators.joins import spread_join
from catsim.sources.shared import write_table

COARSE_K, TOP_K = 200, 20
STRETCH_MIN, MIN_FINE, MIN_RELATIVE, MIN_FUSED, MIN_TOP = 0.45, 0.50, 0.65, 0.30, 0.70
QUERY_BLOCK, VECTOR_BLOCK = 512, 2048
#: Limits of a broadcast: queries, and bytes of their matrix in double.
BROADCAST_QUERIES, BROADCAST_BYTES = 10_000, 64 << 20
#: Bytes of the vectors of a cell, in double, where both sides are dealt over a grid.
CELL_BYTES = 256 << 20


def dot(a: str | Column, b: str | Column) -> Column:
    """Inner product of two arrays, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def unit(v: str | Column) -> Column:
    """A vector divided by its length (plus 1e-8). The length is bound to a field first, so that it is computed once."""
    v = F.col(v) if isinstance(v, str) else v
    held = F.transform(F.array(v), lambda w: F.struct(w.alias("v"), (F.sqrt(dot(w, w)) + F.lit(1e-8)).alias("n")))
    return F.element_at(F.transform(held, lambda h: F.transform(h["v"], lambda x: x / h["n"])), 1)


def stretch(raw: str | Column, floor: float = STRETCH_MIN) -> Column:
    """A raw score from [floor, 1] to [0, 1], clipped and rounded to 4 places."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (raw - floor) / (1 - floor))), 4)


class _Best:
    """The best ``k`` of each query so far: scores rounded to 9 places, highest first, then the lower id."""

    def __init__(self, k: int) -> None:
        self.k, self.queries, self.limit = k, np.empty(0, np.int64), np.empty(0)
        self.kept = tuple(np.empty(0, kind) for kind in (np.int64, np.float64, np.int64))
        self.pending: list[tuple] = []
        self.size = 0

    def rows(self, queries: np.ndarray) -> np.ndarray:
        """Numbers of queries; new ones are added."""
        new = np.setdiff1d(queries, self.queries)
        if len(new):
            self.queries = np.append(self.queries, new)
            self.limit = np.append(self.limit, np.full(len(new), -np.inf))
        order = np.argsort(self.queries)
        return order[np.searchsorted(self.queries[order], queries)]

    def add(self, rows: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Scores (queries, vectors) of some vectors; one below the limit of its query can't be among the best."""
        q, v = np.nonzero((score >= self.limit[rows][:, None]) & (score > -np.inf))
        self.pending.append((rows[q], score[q, v], ids[v]))
        self.size += len(q)
        if self.size > max(1 << 20, 2 * self.k * len(self.queries)):
            self.settle()

    def settle(self) -> None:
        row, score, ids = (np.concatenate(x) for x in zip(self.kept, *self.pending, strict=True))
        order = np.lexsort((ids, -score, row))
        row = row[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        best = order[nth < self.k]
        full = nth == self.k - 1
        self.limit[row[full]] = score[order[full]]
        row, self.pending, self.size = row[nth < self.k], [], 0
        self.kept = (row, score[best], ids[best])

    def batch(self) -> pa.RecordBatch:
        self.settle()
        row, score, ids = self.kept
        columns = [pa.array(self.queries[row], pa.int64()), pa.array(ids, pa.int64()), pa.array(score, pa.float64())]
        return pa.RecordBatch.from_arrays(columns, ["query_id", "faiss_id", "clip_score"])


def _matrix(lists: pa.Array, rows: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def _meet(best: _Best, rows: np.ndarray, matrix: np.ndarray, ids: np.ndarray, part: np.ndarray) -> None:
    """All queries (rows of ``best`` and their matrix) with some vectors, block by block."""
    for at in range(0, len(ids), VECTOR_BLOCK):
        own = slice(at, at + VECTOR_BLOCK)
        for lo in range(0, len(rows), QUERY_BLOCK):
            block = slice(lo, lo + QUERY_BLOCK)
            best.add(rows[block], ids[own], np.round(matrix[block] @ part[own].T, 9))


def _sides(df: DataFrame, id_column: str, area: Column) -> DataFrame:
    """(area, id, v) of rows that have an id and a vector."""
    made = df.select(area.cast("string").alias("area"), F.col(id_column).cast("long").alias("id"), F.col("coarse").alias("v"))
    return made.where("id IS NOT NULL AND v IS NOT NULL")


def coarse_topk(queries: DataFrame, vectors: DataFrame, k: int = COARSE_K, within: bool = False) -> DataFrame:
    """(query_id, faiss_id, clip_score, coarse_rank): the ``k`` vectors of highest inner product for each query, exactly.

    Each task multiplies blocks of vectors with blocks of queries and keeps a running best ``k`` of each query, which it
    returns once; pairs are never rows. Up to BROADCAST_QUERIES queries of BROADCAST_BYTES in all are counted and then
    broadcast as one matrix, and vectors are never moved; more queries and the vectors are dealt over a grid of cells (see
    `deal_cells`). Scores are rounded to 9 places and ties go to the lower id. A row without id or vector takes no part.
    With ``within``, a query whose ``only_category`` is not null takes vectors of that ``category`` only, before the cut: its
    cells hold no others.
    """
    if within:
        own = deal_cells(_sides(queries, "query_id", F.col("only_category")).where("area IS NOT NULL"), _sides(vectors, "faiss_id", F.col("category")).where("area IS NOT NULL"))
        part = _cell_topk(own, k).unionByName(_all_topk(queries.where("only_category IS NULL"), vectors, k))
    else:
        part = _all_topk(queries, vectors, k)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("clip_score"), "faiss_id"))
    return part.withColumn("coarse_rank", rank).where(F.col("coarse_rank") <= k)


_SCHEMA = "query_id long, faiss_id long, clip_score double"


def _all_topk(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """The best ``k`` that each task finds of each query, among all vectors."""
    asked, held = _sides(queries, "query_id", F.lit("")), _sides(vectors, "faiss_id", F.lit(""))
    n, width = asked.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    if n > BROADCAST_QUERIES or n * width * 8 > BROADCAST_BYTES:
        return _cell_topk(deal_cells(asked, held), k)
    table = asked.select("id", "v").toArrow().combine_chunks()
    blob = queries.sparkSession.sparkContext.broadcast((table["id"].to_numpy(), _matrix(table["v"].combine_chunks(), n) if n else np.empty((0, width))))

    def against_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (ids, matrix), best = blob.value, _Best(k)
        for batch in batches:
            if len(batch) and len(ids):
                _meet(best, best.rows(ids), matrix, batch.column(0).to_numpy(), _matrix(batch.column(1), len(batch)))
        yield best.batch()

    return held.select("id", "v").mapInArrow(against_all, _SCHEMA)


def deal_cells(asked: DataFrame, held: DataFrame, query_bytes: int = BROADCAST_BYTES, vector_bytes: int = CELL_BYTES) -> DataFrame:
    """(area, i, j, kind, id, v): queries (kind 0) and vectors (kind 1), both (area, id, v), dealt over the cells of their area.

    An area is a grid of as many rows as keep its queries of one row below ``query_bytes``, and as many columns as keep the
    vectors of one column at about ``vector_bytes``. A query goes to all cells of its row and a vector to all cells of its
    column, so each side is shipped once for each row or column of the other, and every pair of an area meets in one cell.
    """
    size = lambda df, name: df.groupBy("area").agg(F.sum(F.size("v").cast("long") * 8).alias(name))
    ways = lambda c, most: F.greatest(F.ceil(F.col(c) / most), F.lit(1)).cast("int")
    grid = size(asked, "q").join(size(held, "v"), "area").select("area", ways("q", query_bytes).alias("rows"), ways("v", vector_bytes).alias("cols"))
    grid = write_table(grid, "grid")
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = spread_join(asked, grid, ["area"], "id").select("area", own("rows").alias("i"), every("cols").alias("j"), F.lit(0).alias("kind"), "id", F.col("v").cast("array<double>").alias("v"))
    v = spread_join(held, grid, ["area"], "id").select("area", every("rows").alias("i"), own("cols").alias("j"), F.lit(1).alias("kind"), "id", F.col("v").cast("array<double>").alias("v"))
    return q.unionByName(v)


def _cell_topk(cells: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each query in each cell. A task holds the queries of one cell, and its vectors come by in batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, best, queries, ready = None, _Best(k), [], None
        for batch in batches:
            areas = batch.column(0).dictionary_encode()
            marks = np.stack([areas.indices.to_numpy(), *(batch.column(c).to_numpy() for c in (1, 2, 3))]).astype(np.int64)
            cuts = [0, *(np.flatnonzero((np.diff(marks, axis=1) != 0).any(axis=0)) + 1).tolist(), len(batch)] if len(batch) else []
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                own = (areas.dictionary[int(marks[0, lo])].as_py(), int(marks[1, lo]), int(marks[2, lo]))
                if own != cell:
                    yield best.batch()
                    cell, best, queries, ready = own, _Best(k), [], None
                part = batch.slice(lo, hi - lo)
                ids, matrix = part.column(4).to_numpy(), _matrix(part.column(5), hi - lo)
                if not marks[3, lo]:
                    queries.append((ids, matrix))
                    continue
                if ready is None and queries:
                    names, rows = (np.concatenate(x) for x in zip(*queries, strict=True))
                    ready = (best.rows(names), rows)
                if ready is not None:
                    _meet(best, *ready, ids, matrix)
        yield best.batch()

    dealt = cells.repartition("area", "i", "j").sortWithinPartitions("area", "i", "j", "kind")
    return dealt.mapInArrow(run, _SCHEMA)


def rerank(hits: DataFrame, queries: DataFrame, vectors: DataFrame, top_k: int = TOP_K, min_fine: float = MIN_FINE, min_relative: float = MIN_RELATIVE, min_fused: float = MIN_FUSED, min_top: float = MIN_TOP) -> DataFrame:
    """Fine scores of coarse hits, the gate on a query's best one, three thresholds and the final rank.

    A hit without a fine vector scores 0.
    """
    fine_q = queries.select("query_id", F.col("fine").alias("fine_q"))
    fine_v = vectors.select("faiss_id", F.col("fine").alias("fine_v"))
    raw = F.coalesce(dot("fine_q", "fine_v"), F.lit(0.0))
    scored = hits.join(fine_v, "faiss_id", "left").join(fine_q, "query_id").withColumn("_raw", F.round(raw, 9))
    scored = scored.withColumn("resnet_score", F.round("_raw", 4)).withColumn("fused_score", stretch("_raw"))
    query = Window.partitionBy("query_id")
    best = scored.withColumn("_best", F.max("fused_score").over(query))
    kept = best.where((F.col("_best") >= min_top) & (F.col("resnet_score") >= min_fine) & (F.col("fused_score") >= F.col("_best") * min_relative) & (F.col("fused_score") >= min_fused))
    rank = F.row_number().over(query.orderBy(F.desc("fused_score"), "coarse_rank"))
    ranked = kept.withColumn("rank", rank).where(F.col("rank") <= top_k)
    return ranked.select("query_id", "faiss_id", "rank", F.round("clip_score", 4).alias("clip_score"), "resnet_score", "fused_score")


def resolve_hits(hits: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Hits with the catalogue's columns; hits without a row are dropped and ranks stay as they are."""
    return hits.join(catalogue, "faiss_id")
