"""Dense ids after the present maximum, without one task seeing all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catsim.sources.shared import write_table


def next_id(catalogue: DataFrame, id_column: str = "faiss_id") -> int:
    """One more than the greatest id; 0 for an empty catalogue."""
    top = catalogue.agg(F.max(id_column)).first()[0]
    return 0 if top is None else top + 1


def allocate_ids(df: DataFrame, order: list[str], start: int = 0, id_column: str = "faiss_id") -> DataFrame:
    """``df`` with ids start, start + 1, ... in the order of the columns ``order``, which should tell all rows apart.

    Rows are range-partitioned, numbered inside their partition and written once, so that a lost executor can't change
    the ranges; each partition's offset is the sum of the counts before it. Only those counts meet in one task.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = write_table(ranged.withColumns({"_part": F.spark_partition_id(), "_row": row}), "ranged")
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row per partition, so the side is as small as the number of tasks.
    offsets = F.broadcast(counts.select("_part", before.alias("_before")))
    return placed.join(offsets, "_part").withColumn(id_column, F.col("_before") + F.col("_row") + F.lit(start)).drop("_part", "_row", "_before")
