"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catsim.llm.storage import drop_table, write_table
from catsim.operators.joins import spread_join

def connected_components(edges: DataFrame) -> DataFrame:
    """(id, comp) for every end of ``edges`` (a, b); ``comp`` is the least id of its component.

    Each round takes the least label among the neighbours and then the label of the label, so paths shorten by doubling.
    Rounds stop when no label changes; their tables are written, those of a round deleted after the next, and nothing but
    a count reaches the driver. A hub, and a label that many share, are dealt many ways. Ids may be of any type that can
    be ordered. Null ends are ignored, repeated edges and loops are harmless, and no edges give no rows.
    """
    known = edges.where("a is not null and b is not null")
    both = write_table(known.select("a", "b").union(known.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = write_table(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("comp")), "labels")
    while True:
        near = spread_join(both, labels.select(F.col("id").alias("b"), "comp"), ["b"], "a").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("near"))
        step = labels.join(near, "id").select("id", F.least("comp", "near").alias("comp"), F.col("comp").alias("was"))
        # A label that is its own has nothing above it; only the others are looked up.
        up = step.where("comp <> id").select(F.col("id").alias("comp"), F.col("comp").alias("top"))
        new = write_table(spread_join(step, up, ["comp"], "id", "left").select("id", F.least("comp", "top").alias("comp"), "was"), "labels")
        drop_table(labels)
        labels = new.select("id", "comp")
        if new.where("comp <> was").isEmpty():
            drop_table(both)
            return labels
