"""The whole batch search: check and fold requests, embed, classify, filter by category, recall, re-rank, resolve, boost, anchor and summarise."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catsim.functions import images
from catsim.operators import categories, names, reports, search
from catsim.sources.shared import write_table


class Answer(NamedTuple):
    """Hits that stay, ranked, and one summary row per query."""

    hits: DataFrame
    summary: DataFrame


class ImageAnswer(NamedTuple):
    """Hits and summaries of all good requests, and (query_id, reason) of the others."""

    hits: DataFrame
    summary: DataFrame
    refused: DataFrame


def batch_search(queries: DataFrame, catalogue: DataFrame, vectors: DataFrame, keywords: DataFrame | None = None, coarse_k: int = search.COARSE_K, top_k: int = search.TOP_K, before_cut: bool = False) -> Answer:
    """Answer queries (query_id, coarse, fine, category, auto_category); ``keywords`` (query_id, keywords) boosts names.

    Categories restrict the coarse hits after the cut, or with ``before_cut`` the vectors before it. Coarse hits and marked
    hits are written once, because both results read them.
    """
    prototypes = categories.category_prototypes(catalogue, vectors)
    filters = categories.category_filters(queries.select("query_id", "category", "auto_category"), categories.classify(queries, prototypes), catalogue)
    filters = write_table(filters, "filters")
    if before_cut:
        coarse = categories.before_cut(queries, filters, vectors, catalogue, coarse_k)
    else:
        coarse = categories.restrict(search.coarse_topk(queries, vectors, coarse_k), filters, catalogue)
    hits = search.resolve_hits(search.rerank(coarse, queries, vectors, top_k=top_k), catalogue)
    if keywords is not None:
        hits = names.text_boost(hits, keywords)
    marked = write_table(names.mark_name_anchor(hits), "marked")
    return Answer(marked.where("kept").drop("kept"), names.search_summary(queries, marked, filters))


def image_search(requests: DataFrame, catalogue: DataFrame, vectors: DataFrame, model_factory: Callable[[], images.Model], min_sharpness: float = images.MIN_SHARPNESS, **params) -> ImageAnswer:
    """Answer requests (query_id, content, length, image, category, auto_category) by the images themselves.

    Invalid and blurred images are refused with a reason. Identical requests are embedded and searched once, and the answer
    handed to each. An image on which the model fails is refused with its error.
    """
    width, height = F.col("image.width"), F.col("image.height")
    reason = F.coalesce(images.invalid_reason(), F.when(~F.coalesce(F.col("_sharp") >= min_sharpness, F.lit(False)), "blurred"))
    # Sharpness is computed once per request; an undecodable image has none.
    checked = requests.withColumn("_sharp", images.sharpness(images.gray_pixels("image"), width, height)).withColumn("reason", reason)
    checked = write_table(checked.drop("image", "_sharp", "length"), "checked")
    good = checked.where("reason IS NULL")
    members = write_table(reports.fold_members(good), "members")
    folded = good.join(members.select(F.col("representative").alias("query_id")).distinct(), "query_id")
    made = write_table(images.embed_images(folded, "query_id", "content", model_factory), "made")
    asked = folded.select("query_id", "category", "auto_category").join(made.where("error IS NULL").drop("error"), "query_id")
    answer = batch_search(asked, catalogue, vectors, **params)
    failed = reports.unfold(made.where("error IS NOT NULL").select("query_id", F.col("error").alias("reason")), members)
    refused = checked.where("reason IS NOT NULL").select("query_id", "reason").unionByName(failed.select("query_id", "reason"))
    return ImageAnswer(reports.unfold(answer.hits, members), reports.unfold(answer.summary, members), refused)
