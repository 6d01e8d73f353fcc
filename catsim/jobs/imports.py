"""From a folder of images to a catalogue that can be searched."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catsim.functions import images
from catsim.jobs.maintain import Outcome, publish_catalogue, read_published
from catsim.operators import ids, ingest
from catsim.sources import snapshots
from catsim.sources.catalogue import VECTORS
from catsim.sources.shared import table_scope, write_table


def import_directory(spark: SparkSession, folder: str, category: str, catalogue: str, vectors: str, model_factory: Callable[[], images.Model], product_name: str = "", min_sharpness: float | None = None) -> Outcome:
    """Add the images below a folder to a published catalogue and vector store, under their paths as URLs.

    Files whose path the catalogue has are skipped and not read. The others are read and decoded once: checked, embedded and
    numbered after the catalogue's last id. Vectors are published before rows, so no row is ever without its vector. Returns the
    catalogue's version and how many files are ok, skipped, or failed by which reason.
    """
    with table_scope(spark):
        known = read_published(spark, catalogue)
        files = images.read_image_files(spark, folder)
        fresh = files.join(known.select(F.col("image_url").alias("path")), "path", "left_anti")
        made = write_table(images.examine(fresh, ["path"], min_sharpness=min_sharpness, model_factory=model_factory), "made")
        why = F.coalesce("reason", F.when(F.col("error").isNotNull(), "model"))
        outcomes = made.select(F.coalesce(why, F.lit("ok")).alias("status"))
        skipped = files.select("path").join(known.select(F.col("image_url").alias("path")), "path", "left_semi").select(F.lit("skipped").alias("status"))
        counts = spark.createDataFrame(ingest.outcome_counts(outcomes.unionByName(skipped)).collect(), "status string, n long")
        good = made.where(why.isNull()).select(F.col("path").alias("image_url"), F.col("size_bytes").alias("file_size"), "width", "height", "coarse", "fine")
        numbered = ids.allocate_ids(good, ["image_url"], ids.next_id(known))
        rows = numbered.drop("coarse", "fine").withColumns({"id": F.col("faiss_id"), "category": F.lit(category), "product_name": F.lit(product_name)})
        snapshots.append(numbered.select(*VECTORS.names), vectors)
        return Outcome(publish_catalogue(ingest.with_keywords(rows.withColumn("product_name_cn", F.lit(""))), catalogue), counts)
