"""Jobs that change a published catalogue or vector store: back-fill of names, deletion, rebuilding.

Both are tables of versions (`catsim.sources.snapshots`): a job that dies leaves the old version, and readers change to the
new one when it is whole.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catsim.functions.images import rebuild_vectors
from catsim.operators import ingest, reports
from catsim.sources import snapshots
from catsim.sources.catalogue import CATALOGUE, VECTORS, migrate_catalogue
from catsim.sources.shared import write_table


class Outcome(NamedTuple):
    """The version that a job left, and (status, n): how many rows fared how."""

    version: int
    counts: DataFrame


def publish_catalogue(rows: DataFrame, path: str) -> int:
    """Add rows to a published catalogue, with the columns and defaults of the present schema."""
    return snapshots.append(migrate_catalogue(rows), path).number


def read_published(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a published catalogue."""
    return snapshots.read_table(spark, path, CATALOGUE, version)


def read_published_vectors(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The vectors of a published store."""
    return snapshots.read_table(spark, path, VECTORS, version)


def backfill_published(spark: SparkSession, path: str, products: DataFrame) -> Outcome:
    """Fill in the names of the rows that lack them from feed products (`ingest.backfill_names`).

    Only the parts that hold such a row are written again. Run again with the same products it makes no new version.
    """
    rows = read_published(spark, path)
    lacking = rows.where(ingest.needs_backfill()).select("image_url")
    found = write_table(lacking.join(products.select("image_url").distinct().withColumn("known", F.lit(True)), "image_url", "left"), "lacking")
    status = F.when(F.col("known"), "updated").otherwise("not_found")
    complete = rows.where(~ingest.needs_backfill()).select(F.lit("complete").alias("status"))
    counts = write_table(ingest.outcome_counts(found.select(status.alias("status")).unionByName(complete)), "counts")
    # A row whose product lacks a name too may stay as it is; its part then needs no new version.
    keys = _changes(rows.where(ingest.needs_backfill()), products)
    version = snapshots.rewrite(spark, path, CATALOGUE, keys, lambda part: ingest.backfill_names(part, products).drop("status"))
    return Outcome(version.number, counts)


def _changes(rows: DataFrame, products: DataFrame) -> DataFrame:
    """URLs of the rows that a back-fill would change."""
    before = rows.select("image_url", *[F.col(c).alias(f"was_{c}") for c in ingest.TEXTS], *ingest.TEXTS)
    after = ingest.backfill_names(before, products)
    same = [F.col(c).eqNullSafe(F.col(f"was_{c}")) for c in ingest.TEXTS]
    differs = ~same[0]
    for one in same[1:]:
        differs = differs | ~one
    return after.where((F.col("status") == "updated") & differs).select("image_url").distinct()


def delete_published(spark: SparkSession, path: str, ids: DataFrame) -> Outcome:
    """Delete the rows of ``ids`` (faiss_id). Only the parts that hold one are written again."""
    known = read_published(spark, path)
    counts = write_table(reports.deletion_count(known, ids).select(F.lit("deleted").alias("status"), F.col("n_deleted").alias("n")), "counts")
    version = snapshots.rewrite(spark, path, CATALOGUE, ids.select("faiss_id").distinct(), lambda part: reports.delete_rows(part, ids))
    return Outcome(version.number, counts)


def rebuild_published(spark: SparkSession, catalogue: str, images: DataFrame, model_factory, vectors: str, batch_size: int = 16) -> Outcome:
    """New vectors of all rows of a published catalogue whose image can be had, under their old ids, as the next version of the
    store ``vectors``. Rows whose image is missing, or on which the model fails, have no vector in it and are counted."""
    base = snapshots.latest(spark, vectors)
    made = write_table(rebuild_vectors(read_published(spark, catalogue), images, model_factory, batch_size), "rebuilt")
    good = made.where("error IS NULL").select(*VECTORS.names)
    version = snapshots.replace(good.repartitionByRange("faiss_id").sortWithinPartitions("faiss_id"), vectors, base)
    status = F.when(F.col("error").isNull(), "ok").when(F.col("error") == "missing", "missing").otherwise("failed")
    return Outcome(version.number, made.groupBy(status.alias("status")).agg(F.count("*").alias("n")))
