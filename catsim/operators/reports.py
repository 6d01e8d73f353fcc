"""Counts and consistency reports of a catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catsim.operators.joins import spread_join


def category_stats(catalogue: DataFrame) -> DataFrame:
    """Rows of each category, largest first."""
    return catalogue.groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category")


def row_count(catalogue: DataFrame, category: str | None = None) -> DataFrame:
    """Number of rows, of one category if it is given and not empty, as one row."""
    return (catalogue.where(F.col("category") == category) if category else catalogue).agg(F.count("*").alias("n"))


def catalogue_stats(catalogue: DataFrame, vectors: DataFrame) -> DataFrame:
    """Records, vectors of both kinds and their widths, as one row."""
    size = lambda c: F.coalesce(F.max(F.size(c)), F.lit(0))
    counts = vectors.agg(F.count("coarse").alias("n_coarse"), F.count("fine").alias("n_fine"), size("coarse").alias("coarse_dim"), size("fine").alias("fine_dim"))
    return catalogue.agg(F.count("*").alias("n_records")).join(counts)


def orphans(catalogue: DataFrame, vectors: DataFrame) -> DataFrame:
    """(faiss_id, missing): vectors without a row, and rows without a vector."""
    no_row = vectors.join(catalogue, "faiss_id", "left_anti").select("faiss_id", F.lit("row").alias("missing"))
    return no_row.unionByName(catalogue.join(vectors, "faiss_id", "left_anti").select("faiss_id", F.lit("vector").alias("missing")))


def dedup_detections(detections: DataFrame, min_confidence: float = 0.5) -> DataFrame:
    """(image_id, text, confidence): one row for each text of an image, with its best confidence. `best_first` ranks them."""
    clean = detections.withColumn("text", F.regexp_replace("text", r"(?U)^\s+|\s+$", "")).where("text <> ''")
    return clean.where(F.col("confidence") >= min_confidence).groupBy("image_id", "text").agg(F.max("confidence").alias("confidence"))


def best_first(detections: DataFrame) -> DataFrame:
    """Detections with ``place``, their order in their image: highest confidence first, then by text."""
    order = Window.partitionBy("image_id").orderBy(F.desc("confidence"), "text")
    return detections.withColumn("place", F.row_number().over(order))


REQUEST = ("category", "top_k", "auto_category")


def fold_queries(queries: DataFrame) -> DataFrame:
    """(digest, category, query_id, n): identical queries answered once, under the least id.

    Queries are identical if content and those of the columns `REQUEST` that they have agree; null agrees with null.
    """
    keyed = queries.withColumn("digest", F.md5("content"))
    return keyed.groupBy("digest", *[c for c in REQUEST if c in queries.columns]).agg(F.min("query_id").alias("query_id"), F.count("*").alias("n"))


def fold_members(queries: DataFrame) -> DataFrame:
    """(query_id, representative): under which id each query is answered.

    The least id of a group is found by an aggregate, and joined back with very common contents dealt many ways.
    """
    keyed = queries.withColumn("_digest", F.coalesce(F.md5("content"), F.lit("")))
    # Nulls become a value of their own, because an equi-join drops them.
    keys = [F.to_json(F.struct(c)).alias(f"_{c}") for c in REQUEST if c in queries.columns]
    keyed = keyed.select("query_id", "_digest", *keys)
    on = [c for c in keyed.columns if c != "query_id"]
    least = keyed.groupBy(*on).agg(F.min("query_id").alias("representative"))
    return spread_join(keyed, least, on, "query_id").select("query_id", "representative")


def unfold(answers: DataFrame, members: DataFrame) -> DataFrame:
    """Answers of representatives handed to every query that they stand for."""
    named = answers.withColumnRenamed("query_id", "representative")
    # A request that very many made is dealt many ways, as in `fold_members`.
    return spread_join(members, named, ["representative"], "query_id").drop("representative")


def sync_report(status: DataFrame) -> DataFrame:
    """(page, n_ok, n_skipped, n_failed, bytes) for each page, and over all pages where page is null."""
    count = lambda s: F.count_if(F.col("status") == s)
    return status.rollup("page").agg(count("ok").alias("n_ok"), count("skipped").alias("n_skipped"), count("failed").alias("n_failed"), F.sum("bytes").alias("bytes"))


def delete_rows(catalogue: DataFrame, ids: DataFrame) -> DataFrame:
    """The catalogue without the rows of ``ids`` (faiss_id)."""
    return catalogue.join(ids, "faiss_id", "left_anti")


def deletion_count(catalogue: DataFrame, ids: DataFrame) -> DataFrame:
    """How many rows `delete_rows` takes away, as one row."""
    return catalogue.join(ids, "faiss_id", "left_semi").agg(F.count("*").alias("n_deleted"))


def duplicate_ids(catalogue: DataFrame) -> DataFrame:
    """(faiss_id, n) of ids that more than one row has."""
    return catalogue.groupBy("faiss_id").agg(F.count("*").alias("n")).where("n > 1")
