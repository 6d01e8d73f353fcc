"""What product names add to a search: text boost, name anchor, consensus word, keyword matches and the summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catsim.functions import text
from catsim.operators.joins import spread_join

MIN_MATCH, MIN_RESULTS = 1, 2
BOOST, MAX_BOOST = 0.05, 0.15
GRAM = 3


def text_boost(hits: DataFrame, keywords: DataFrame) -> DataFrame:
    """Hits whose names hold keywords of their query (query_id, keywords) gain score, and ranks follow the new scores.

    A keyword in a hit's name is in some catalogue name, so keywords need no limit to known names first.
    """
    name = F.lower(F.coalesce("product_name", F.lit("")))
    held = F.size(F.filter(F.coalesce("keywords", F.array().cast("array<string>")), lambda k: F.contains(name, k)))
    boost = F.round(F.least(held * F.lit(BOOST), F.lit(MAX_BOOST)), 4)
    boosted = hits.join(keywords.select("query_id", "keywords"), "query_id", "left").withColumn("text_boost", boost).drop("keywords")
    score = F.when(F.col("text_boost") > 0, F.round(F.least(F.lit(1.0), F.col("fused_score") + F.col("text_boost")), 4)).otherwise(F.col("fused_score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("fused_score"), "rank"))
    return boosted.withColumn("fused_score", score).withColumn("rank", rank)


def mark_name_anchor(hits: DataFrame, min_match: int = MIN_MATCH, min_results: int = MIN_RESULTS) -> DataFrame:
    """Hits with ``kept``: whether a name shares enough tokens with the name of its query's top hit.

    A query with too few hits, or whose top name has no tokens, keeps all; the top hit always stays.
    """
    query = Window.partitionBy("query_id")
    own = hits.withColumn("_own", text.anchor_tokens("product_name"))
    seen = own.withColumn("_anchor", F.first("_own").over(query.orderBy("rank"))).withColumn("_n", F.count("*").over(query))
    seen = seen.withColumn("_first", F.min("rank").over(query))
    size = F.size("_anchor")
    needed = F.when(size <= 2, F.lit(min_match)).otherwise(F.greatest(F.lit(2), F.floor(size / 2)))
    shared = F.size(F.array_intersect("_own", "_anchor"))
    kept = (F.col("_n") < min_results) | (size == 0) | (F.col("rank") == F.col("_first")) | (shared >= needed)
    return seen.withColumn("kept", kept).drop("_own", "_anchor", "_n", "_first")


def consensus_word(marked: DataFrame) -> DataFrame:
    """(query_id, consensus_word): the longest word that names of kept hits have and names of removed hits lack.

    Ties go to the lower word; a query that lost nothing has the empty word. A query has at most top-k hits, so its words
    are few.
    """
    words = text.tokens("product_name", 3, text.CONSENSUS_STOP, text.PLAIN_SPLIT)
    sides = marked.select("query_id", "kept", words.alias("words")).groupBy("query_id").agg(
        F.array_distinct(F.flatten(F.collect_list(F.when(F.col("kept"), F.col("words"))))).alias("inside"),
        F.array_distinct(F.flatten(F.collect_list(F.when(~F.col("kept"), F.col("words"))))).alias("outside"),
        F.count_if(~F.col("kept")).alias("n_removed"),
    )
    ranked = F.array_sort(F.transform(F.array_except("inside", "outside"), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    word = F.when(F.col("n_removed") > 0, F.coalesce(F.get(ranked, F.lit(0))["w"], F.lit(""))).otherwise(F.lit(""))
    return sides.select("query_id", word.alias("consensus_word"))


def search_summary(queries: DataFrame, marked: DataFrame, filters: DataFrame) -> DataFrame:
    """One row per query, those without hits included: counts before and after the name anchor, best score, category and word."""
    counts = marked.groupBy("query_id").agg(F.count("*").alias("n_before"), F.count_if("kept").alias("n_after"), F.max("fused_score").alias("top_score"))
    joined = queries.select("query_id").join(filters, "query_id", "left").join(counts, "query_id", "left").join(consensus_word(marked), "query_id", "left")
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return joined.select(
        "query_id",
        number("n_before"),
        number("n_after"),
        F.coalesce("top_score", F.lit(0.0)).alias("top_score"),
        "predicted_category",
        "confidence",
        "filter_source",
        F.coalesce(F.col("n_after") < F.col("n_before"), F.lit(False)).alias("consensus_applied"),
        F.coalesce("consensus_word", F.lit("")).alias("consensus_word"),
    )


def _grams(column: str) -> Column:
    """Distinct runs of three characters; none for a shorter text."""
    starts = F.when(F.length(column) >= GRAM, F.sequence(F.lit(1), F.length(column) - (GRAM - 1)))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(F.col(column), i, F.lit(GRAM))))


def match_names(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(product_name, keywords): names that hold a keyword of recognised texts (column text), with the sorted keywords.

    A keyword has three characters at least, so a name that holds it holds each three of them in a row: names and keywords
    meet on those three of the keyword that fewest names have, and only such pairs are compared. Both sides are distinct
    first, and a gram of very many names is dealt many ways.
    """
    keywords = texts.select(F.explode(text.ocr_tokens("text")).alias("keyword")).distinct()
    plain = names.select("product_name").where(F.col("product_name") != "").distinct().withColumn("_low", F.lower("product_name"))
    pieces = plain.withColumn("_gram", F.explode(_grams("_low")))
    held = pieces.groupBy("_gram").agg(F.count("*").alias("_n"))
    rarest = keywords.withColumn("_gram", F.explode(_grams("keyword"))).join(held, "_gram", "left").groupBy("keyword").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)), "_gram")).alias("_rarest"))
    met = spread_join(pieces, rarest.select("keyword", F.col("_rarest._gram").alias("_gram")), ["_gram"], "product_name").where(F.contains("_low", "keyword"))
    return met.groupBy("product_name").agg(F.array_join(F.array_sort(F.collect_set("keyword")), " ").alias("keywords"))
