"""Category prototypes, classification by them and the category filter of a search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catsim.operators.arrays import array_sums
from catsim.operators.ids import allocate_ids
from catsim.operators.search import COARSE_K, coarse_topk, unit

MIN_MARGIN = 0.02


def category_prototypes(catalogue: DataFrame, vectors: DataFrame) -> DataFrame:
    """(category, n, prototype): the unit mean of each category's coarse vectors; a single vector is taken as it is.

    Each task adds up its vectors, so sums and not vectors or their elements are shuffled.
    """
    joined = catalogue.select("faiss_id", "category").join(vectors.select("faiss_id", "coarse"), "faiss_id")
    sums = array_sums(joined, "category", "coarse")
    mean = F.transform("sum", lambda x: x / F.col("n"))
    return sums.select("category", "n", F.when(F.col("n") == 1, mean).otherwise(unit(mean)).alias("prototype"))


def classify(queries: DataFrame, prototypes: DataFrame, min_margin: float = MIN_MARGIN) -> DataFrame:
    """(query_id, predicted_category, confidence): the category of the nearest prototype, by its lead over the second.

    With one category the confidence is the score itself. Below ``min_margin`` the category is null. Prototypes go
    through the blocks of the coarse search, so neither side is broadcast.
    """
    known = allocate_ids(prototypes.select("category", F.col("prototype").alias("coarse")), ["category"], id_column="faiss_id")
    best = coarse_topk(queries, known, 2).join(known.select("faiss_id", "category"), "faiss_id")
    pick = lambda c, r: F.max(F.when(F.col("coarse_rank") == r, F.col(c)))
    pairs = best.groupBy("query_id").agg(pick("category", 1).alias("category"), pick("clip_score", 1).alias("s1"), pick("clip_score", 2).alias("s2"))
    scored = pairs.withColumn("confidence", F.coalesce(F.round(F.col("s1") - F.col("s2"), 4), F.col("s1")))
    return scored.select("query_id", F.when(F.col("confidence") >= min_margin, F.col("category")).alias("predicted_category"), "confidence")


def category_filters(queries: DataFrame, predicted: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(query_id, predicted_category, confidence, filter_source, only_category) for queries (query_id, category, auto_category).

    A category given by hand comes first, even if the catalogue has no such row (the answer is then empty). A predicted
    category counts where asked for; if it has no rows the whole catalogue is searched.
    """
    given = F.coalesce("category", F.lit(""))
    auto = F.coalesce("auto_category", F.lit(False)) & (given == "")
    asked = queries.join(predicted, "query_id", "left").select(
        "query_id", given.alias("_given"), F.when(auto, F.col("predicted_category")).alias("predicted_category"), F.when(auto, F.col("confidence")).alias("confidence")
    )
    wanted = asked.withColumn("_wanted", F.coalesce(F.nullif("_given", F.lit("")), "predicted_category"))
    present = catalogue.select(F.col("category").alias("_wanted")).distinct().withColumn("_rows", F.lit(True))
    known = wanted.join(present, "_wanted", "left")
    source = (
        F.when(F.col("_given") != "", "manual").when(F.col("predicted_category").isNull(), "none").when(F.col("_rows").isNull(), "auto_empty").otherwise("auto")
    )
    only = F.when(source.isin("manual", "auto"), F.col("_wanted"))
    return known.select("query_id", "predicted_category", "confidence", source.alias("filter_source"), only.alias("only_category"))


def before_cut(queries: DataFrame, filters: DataFrame, vectors: DataFrame, catalogue: DataFrame, k: int = COARSE_K) -> DataFrame:
    """Coarse hits as `restrict` gives them, but restricted before the cut: a small category still yields its ``k`` nearest.

    A query with a category meets the vectors of that category only.
    """
    asked = queries.select("query_id", "coarse").join(filters.select("query_id", "only_category"), "query_id")
    rows = vectors.select("faiss_id", "coarse").join(catalogue.select("faiss_id", "category"), "faiss_id", "left")
    return coarse_topk(asked, rows, k, within=True)


def restrict(hits: DataFrame, filters: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Coarse hits in the one category that their query allows, if it names one; coarse ranks stay as they are."""
    rows = catalogue.select("faiss_id", F.col("category").alias("_category"))
    joined = hits.join(filters.select("query_id", "only_category"), "query_id").join(rows, "faiss_id", "left")
    return joined.where(F.col("only_category").isNull() | (F.col("_category") == F.col("only_category"))).drop("only_category", "_category")
