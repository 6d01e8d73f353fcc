"""New vectors for a whole catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catsim.functions.images import rebuild_vectors
from catsim.sources.catalogue import write_vectors
from catsim.sources.shared import write_table


def rebuild_store(catalogue: DataFrame, images: DataFrame, model_factory, path: str, batch_size: int = 16) -> DataFrame:
    """Write new vectors of all rows whose image can be had to a store at ``path``, under their old ids.

    Returns (status, n): how many rows are ok, missing or failed. The old store isn't touched; readers change to the new
    path when it is whole.
    """
    made = write_table(rebuild_vectors(catalogue, images, model_factory, batch_size), "rebuilt")
    write_vectors(made.where("error IS NULL"), path)
    status = F.when(F.col("error").isNull(), "ok").when(F.col("error") == "missing", "missing").otherwise("failed")
    return made.groupBy(status.alias("status")).agg(F.count("*").alias("n"))
