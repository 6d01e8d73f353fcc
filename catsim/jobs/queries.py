"""Registered queries over the given tables, and their SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catsim.functions import images, text
from catsim.jobs import imports, maintain
from catsim.jobs.rebuild import rebuild_store
from catsim.jobs.search import Answer, ImageAnswer, batch_search, image_search
from catsim.operators import categories, ids, ingest, names, reports, search
from catsim.sources import catalogue as tables
from catsim.sources.shared import shared_dir, write_table
from catsim.streaming import sync

#: Twenty-six characters, some of them stop characters, that stand for the letters where a Chinese name is needed.
CN_LETTERS = "手机壳红鞋大衣裤小裙配饰的充电器线耳包表灯杯笔书桌椅"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _all_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding drawn towards the first one of its label, so that neighbours exist; coarse is its first half."""
    base = _read(spark, sf_dir, "embeddings")
    anchor = base.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("anchor"))
    # The product is one of floats, as in the SQL: in double, scores would differ from the ninth place on.
    drawn = F.zip_with("embedding", "anchor", lambda x, a: x.cast("double") + F.lit(1.5).cast("float") * a)
    fine = base.join(anchor, "label").select("vec_id", "label", search.unit(drawn).alias("fine"))
    # Written once: every query reads the vectors several times.
    return write_table(fine.withColumn("coarse", search.unit(F.slice("fine", 1, 32))), "vectors")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_vectors(spark, sf_dir).withColumnRenamed("vec_id", "faiss_id")


def _queries(vectors: DataFrame) -> DataFrame:
    """The query set of every search: ids divisible by 20, against all vectors."""
    return vectors.where("faiss_id % 20 = 0").withColumnRenamed("faiss_id", "query_id")


def _catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _read(spark, sf_dir, "part")
    made = _read(spark, sf_dir, "embeddings").join(part, F.col("vec_id") == F.col("p_partkey"))
    name = F.concat_ws(" ", "p_name", "p_type", "p_brand")
    return made.select(F.col("vec_id").alias("faiss_id"), F.concat(F.lit("cat"), "label").alias("category"), name.alias("product_name"))


def _feed(spark: SparkSession, sf_dir: str, en_len: int = 60) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    kind = F.split(F.regexp_replace(F.col("url"), r"^\w+://", ""), "/")[1]
    first = pages.select(
        F.floor(F.col("page_id") / 30).alias("page"), (F.col("page_id") % 30).alias("pos"), F.col("url").alias("img"), F.col("page_id").alias("id"),
        F.lit("").alias("name"), title.alias("nameEn"), F.when(F.col("page_id") % 4 != 0, kind).alias("tag"), kind.alias("category"),
    )
    again = first.where("id % 5 = 0").withColumns({"page": F.col("page") + 1000, "nameEn": F.concat(F.lit("v2 "), "nameEn"), "img": F.concat(F.substring_index("img", "?", 1), F.lit("?v=2"))})
    return ingest.project_products(first.unionByName(again), en_len)


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages").where("page_id % 3 = 0").select(F.substring_index("url", "?", 1).alias("image_url"))


def search_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    queries = _queries(vectors)
    return search.rerank(search.coarse_topk(queries, vectors), queries, vectors)


def coarse_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    got = search.coarse_topk(_queries(vectors), vectors)
    return got.withColumn("clip_score", F.round("clip_score", 4))


def keywords_en(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", text.keywords_en("text").alias("keywords_en"))


def category_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.category_stats(_catalogue(spark, sf_dir))


def catalogue_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.catalogue_stats(_catalogue(spark, sf_dir), _vectors(spark, sf_dir))


def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts as catalogue rows against all embeddings as vectors; neither table has all ids of the other."""
    rows = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("faiss_id"))
    return reports.orphans(rows, _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("faiss_id")))


def ocr_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _read(spark, sf_dir, "events")
    padded = F.when(F.col("event_id") % 2 == 1, F.concat(F.lit(" "), "event_type", F.lit(" "))).otherwise(F.col("event_type"))
    found = events.select((F.col("event_id") % 500).alias("image_id"), padded.alias("text"), ((F.col("event_id") % 100) / 100.0).alias("confidence"))
    return reports.dedup_detections(found)


def fold_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return reports.fold_queries(docs.select(F.col("doc_id").alias("query_id"), F.coalesce("text", F.lit("")).cast("binary").alias("content"), F.col("lang").alias("category")))


def feed_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.one_per_url(_feed(spark, sf_dir))


def feed_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.one_per_url(_feed(spark, sf_dir), last=True)


def new_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.new_products(feed_first_wins(spark, sf_dir), _known(spark, sf_dir)).select("image_url", "product_id")


def known_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.known_products(feed_first_wins(spark, sf_dir), _known(spark, sf_dir)).select("image_url", "product_id")


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.resolve_hits(search_core(spark, sf_dir), _catalogue(spark, sf_dir))


def resolved_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).select("query_id", "rank", "faiss_id", "category", "product_name")


def category_prototypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = categories.category_prototypes(_catalogue(spark, sf_dir), _vectors(spark, sf_dir))
    return got.select("category", "n", F.posexplode("prototype").alias("pos", "x")).select("category", "n", "pos", F.round("x", 4).alias("x"))


def sync_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("page_id") % 3 == 0, "skipped").when(F.col("page_id") % 7 == 0, "failed").otherwise("ok")
    pages = _read(spark, sf_dir, "pages")
    return reports.sync_report(pages.select(F.floor(F.col("page_id") / 30).alias("page"), state.alias("status"), F.length("html").cast("long").alias("bytes")))


def delete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = _read(spark, sf_dir, "embeddings").where("label = 3").select(F.col("vec_id").alias("faiss_id"))
    return reports.delete_rows(_catalogue(spark, sf_dir), gone)


def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _read(spark, sf_dir, "events")
    return reports.duplicate_ids(events.select(F.col("user_id").alias("faiss_id")))


def _cn(column: str) -> Column:
    return F.translate(column, "abcdefghijklmnopqrstuvwxyz", CN_LETTERS)


def _asked(vectors: DataFrame) -> DataFrame:
    """Queries in turn with their own category given, an unknown one given, automatic, and without any."""
    turn = F.floor(F.col("query_id") / 20) % 4
    given = F.when(turn == 0, F.concat(F.lit("cat"), "label")).when(turn == 1, "none").otherwise("")
    return _queries(vectors).withColumns({"category": given, "auto_category": turn == 2})


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.mark_name_anchor(_hits(spark, sf_dir))


def _answer(spark: SparkSession, sf_dir: str) -> Answer:
    vectors = _vectors(spark, sf_dir)
    return batch_search(_asked(vectors), _catalogue(spark, sf_dir), vectors)


def _old_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows for every third page, half of them without names."""
    pages = _read(spark, sf_dir, "pages").where("page_id % 3 = 0")
    name = F.when(F.col("page_id") % 2 == 0, "").otherwise(F.concat(F.lit("old "), "page_id"))
    blank = F.lit("")
    return pages.select(
        F.col("page_id").alias("faiss_id"), F.substring_index("url", "?", 1).alias("image_url"), name.alias("product_name"), name.alias("product_name_cn"),
        blank.alias("product_id"), blank.alias("keywords_cn"), blank.alias("keywords_en"),
    )


def _tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 127.5).cast("double"))
    return _read(spark, sf_dir, "embeddings").select("vec_id", pixels.alias("pixels"))


def keywords_cn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").select("p_partkey", text.keywords_cn(_cn("p_name")).alias("keywords_cn"))


def feed_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _feed(spark, sf_dir)


def classify_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries with structure, and raw ones (numbered from 1000000) that lie between categories."""
    raw = _read(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select((F.col("vec_id") + 1000000).alias("query_id"), F.transform(F.slice("embedding", 1, 32), lambda x: x.cast("double")).alias("v"))
    vectors = _vectors(spark, sf_dir)
    both = _queries(vectors).select("query_id", "coarse").unionByName(raw.select("query_id", search.unit("v").alias("coarse")))
    return categories.classify(both, categories.category_prototypes(_catalogue(spark, sf_dir), vectors))


def _filtered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Queries, catalogue, vectors and category filters."""
    vectors, rows = _vectors(spark, sf_dir), _catalogue(spark, sf_dir)
    asked = _asked(vectors)
    return asked, rows, vectors, categories.category_filters(asked, categories.classify(asked, categories.category_prototypes(rows, vectors)), rows)


def search_category_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, rows, vectors, filters = _filtered(spark, sf_dir)
    return search.rerank(categories.restrict(search.coarse_topk(asked, vectors), filters, rows), asked, vectors)


def search_before_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The categories restrict the vectors before the 200 candidates are cut."""
    asked, rows, vectors, filters = _filtered(spark, sf_dir)
    return search.rerank(categories.before_cut(asked, filters, vectors, rows), asked, vectors)


def name_anchor_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marked(spark, sf_dir).select("query_id", "rank", "faiss_id", "product_name", "kept")


def consensus_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.consensus_word(_marked(spark, sf_dir))


def text_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query's keywords are the tokens of the part that has its number."""
    hits = _hits(spark, sf_dir)
    part = _read(spark, sf_dir, "part")
    keywords = part.select(F.col("p_partkey").alias("query_id"), text.ocr_tokens(F.concat_ws(" ", "p_name", "p_brand")).alias("keywords"))
    return names.text_boost(hits, keywords).select("query_id", "faiss_id", "rank", "fused_score", "text_boost")


def batch_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answer(spark, sf_dir).hits.select("query_id", "rank", "faiss_id", "fused_score", "category", "product_name")


def search_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answer(spark, sf_dir).summary


def name_keyword_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _read(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("product_name"))
    return names.match_names(_read(spark, sf_dir, "benchmark"), part)


def allocated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = ids.next_id(_old_catalogue(spark, sf_dir))
    return ids.allocate_ids(new_products(spark, sf_dir), ["image_url"], start)


def manifest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as manifests: each line is a file, some without a name, with shorter lists of URLs and names."""
    line = F.struct(
        "l_linenumber", F.when(F.col("l_linenumber") != 2, F.concat_ws("-", "l_orderkey", "l_linenumber")).otherwise("").alias("file"), F.col("l_partkey").cast("string").alias("part")
    )
    lines = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("l"))
    some = lambda c, less: F.to_json(F.slice(F.transform("l", lambda x: x[c]), F.lit(1), F.greatest(F.size("l") - less, F.lit(0))))
    none = F.lit("[]")
    made = lines.select(
        "l_orderkey", some("file", 0).alias("files"), some("part", 1).alias("image_urls"), some("part", 2).alias("product_names"), none.alias("product_names_cn"),
        some("part", 0).alias("product_ids"), none.alias("keywords_cn_list"), none.alias("keywords_en_list"), F.when(F.col("l_orderkey") % 2 == 0, " shoes ").otherwise(" ").alias("category"),
    )
    return tables.explode_manifest(made)


def migrated_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = _catalogue(spark, sf_dir).select("faiss_id", "category")
    return tables.migrate_catalogue(old).select("faiss_id", "category", "product_name", "product_id", "keywords_en", "file_size", "width")


def sharpness(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.round(images.sharpness("pixels", F.lit(8), F.lit(8)), 4)
    return _tiles(spark, sf_dir).select("vec_id", score.alias("score")).withColumn("sharp", F.col("score") >= images.MIN_SHARPNESS)


def _tile_model():
    """Sums of four neighbours as the coarse vector, the pixels as the fine one."""

    def model(inputs):
        import numpy as np

        fine = np.stack([np.asarray(x, dtype=np.float64) for x in inputs])
        return fine.reshape(len(fine), 16, 4).sum(axis=2), fine

    return model


def embed_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = images.embed_images(_tiles(spark, sf_dir), "vec_id", "pixels", _tile_model)
    return made.select("vec_id", F.posexplode("coarse").alias("pos", "x"), "error").select("vec_id", "pos", F.round(F.col("x").cast("double"), 4).alias("x"), "error")


def _feed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages table as JSON feed pages."""
    pages = _read(spark, sf_dir, "pages")
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    kind = F.split(F.regexp_replace(F.col("url"), r"^\w+://", ""), "/")[1]
    item = F.struct(
        (F.col("page_id") % 30).alias("pos"), F.col("page_id").cast("string").alias("id"), F.col("url").alias("img"), F.lit("").alias("name"), title.alias("nameEn"),
        F.struct(kind.alias("nameEn")).alias("category"),
    )
    return pages.groupBy(F.floor(F.col("page_id") / 30).alias("page")).agg(F.array_sort(F.collect_list(item)).alias("items"))


def _synced(spark: SparkSession, sf_dir: str, check: sync.Check = sync.no_errors, embed: sync.Embed | None = None) -> str:
    """Run the feed through the stream, into a table that has the known products; returns the folder of all its tables."""
    root = shared_dir(spark)
    _feed_pages(spark, sf_dir).write.json(f"{root}/feed")
    sync.create_table(spark, f"{root}/table", _old_catalogue(spark, sf_dir).withColumn("category", F.lit("")))
    sync.create_table(spark, f"{root}/failed", schema=sync.FAILED)
    extra = sync.Extra(embed, f"{root}/vectors" if embed else None, f"{root}/status")
    sync.sync_stream(spark, f"{root}/feed", f"{root}/table", f"{root}/failed", f"{root}/checkpoint", check, extra).awaitTermination()
    return root


def _broken_sync(spark: SparkSession, sf_dir: str) -> str:
    """The sync of a feed in which a second copy of each page is cut off halfway; returns the folder of all its tables."""
    root, pages = shared_dir(spark), _feed_pages(spark, sf_dir)
    line = F.to_json(F.struct(*pages.columns))
    lines = pages.select(F.explode(F.array(line, F.left(line, F.call_function("div", F.length(line), F.lit(2)).cast("int")))).alias("value"))
    lines.write.text(f"{root}/feed")
    sync.create_table(spark, f"{root}/table", _old_catalogue(spark, sf_dir).withColumn("category", F.lit("")))
    sync.create_table(spark, f"{root}/failed", schema=sync.FAILED)
    extra = sync.Extra(status=f"{root}/status")
    sync.sync_stream(spark, f"{root}/feed", f"{root}/table", f"{root}/failed", f"{root}/checkpoint", _seventh_fails, extra).awaitTermination()
    return root


def broken_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a sync reports by page where every page comes whole and cut off: a cut one is a failure of its page."""
    root = _broken_sync(spark, sf_dir)
    return reports.sync_report(sync.read_rows(spark, f"{root}/status", sync.STATUS)).drop("bytes")


def broken_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dead letters of the same sync by reason, and how many of them a second pass takes."""
    root = _broken_sync(spark, sf_dir)
    retried = sync.add_retried(spark, f"{root}/table", f"{root}/failed").groupBy(F.lit("too_large").alias("reason")).agg(F.count_if(F.col("status") == "ok").alias("n_retried"))
    letters = sync.read_rows(spark, f"{root}/failed", sync.FAILED).groupBy(F.substring_index("error", ":", 1).alias("reason")).agg(F.count("*").alias("n"))
    return letters.join(retried, "reason", "left").select("reason", "n", F.coalesce("n_retried", F.lit(0)).alias("n_retried"))


def stream_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed as JSON pages through the stream, into a table that has the known products."""
    root = _synced(spark, sf_dir)
    return sync.read_rows(spark, f"{root}/table").where("batch >= 0").select("image_url", "product_name", "product_id", "category")


def _seventh_fails(products: DataFrame) -> DataFrame:
    return products.withColumn("error", F.when(F.col("product_id").cast("long") % 7 == 0, "too_large"))


def _tile_embed(spark: SparkSession, sf_dir: str) -> sync.Embed:
    """The model on the tile that has a product's number; a product without one has no image."""
    tiles = _tiles(spark, sf_dir).select(F.col("vec_id").cast("string").alias("product_id"), "pixels")
    return lambda products: images.embed_images(products.join(tiles, "product_id"), "image_url", "pixels", _tile_model)


def sync_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New products of the whole sync, with keywords and vectors; every seventh fails its check."""
    root = _synced(spark, sf_dir, _seventh_fails, _tile_embed(spark, sf_dir))
    vectors = sync.read_rows(spark, f"{root}/vectors", sync.VECTORS).select("faiss_id", F.size("coarse").alias("n_coarse"), F.size("fine").alias("n_fine"))
    rows = sync.read_rows(spark, f"{root}/table").where("batch >= 0")
    return rows.join(vectors, "faiss_id", "left").select("image_url", "product_name", "product_id", "category", "keywords_en", "n_coarse", "n_fine")


def sync_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report of the sync by page and over all pages."""
    root = _synced(spark, sf_dir, _seventh_fails, _tile_embed(spark, sf_dir))
    return reports.sync_report(sync.read_rows(spark, f"{root}/status", sync.STATUS)).drop("bytes")


def retried_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of new products in the first pass and in a second one without the check, and whether the table has them at last."""
    root = _synced(spark, sf_dir, _seventh_fails)
    retried = sync.add_retried(spark, f"{root}/table", f"{root}/failed")
    first = sync.read_rows(spark, f"{root}/status", sync.STATUS).where("status <> 'skipped'").select("image_url", "status", "error")
    held = sync.read_rows(spark, f"{root}/table").select("image_url").distinct().withColumn("held", F.lit(True))
    return ingest.both_passes(first, retried).join(held, "image_url", "left").select("image_url", "attempt", "status", "error", F.coalesce("held", F.lit(False)).alias("held"))


def coarse_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 200 coarse candidates that every search takes."""
    return coarse_topk(spark, sf_dir)


def search_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search over 200 coarse candidates."""
    return search_core(spark, sf_dir)


def search_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of the search over 200 coarse candidates with the mark of the name anchor."""
    return _marked(spark, sf_dir).select("query_id", "rank", "faiss_id", "fused_score", "category", "product_name", "kept")


def nearest_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    return search.coarse_topk(_queries(vectors), vectors, 3).withColumn("clip_score", F.round("clip_score", 4))


def _lacking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows for all pages, half of them without names, and as many that the feed lacks."""
    pages = _read(spark, sf_dir, "pages")
    name = F.when(F.col("page_id") % 2 == 0, "").otherwise(F.concat(F.lit("old "), "page_id"))
    gone = pages.select((F.col("page_id") + 1000000).alias("faiss_id"), F.concat(F.lit("http://gone.example/"), "page_id").alias("image_url"), F.lit("").alias("name"))
    rows = pages.select(F.col("page_id").alias("faiss_id"), F.substring_index("url", "?", 1).alias("image_url"), name.alias("name")).unionByName(gone)
    blank = F.lit("")
    return rows.select("faiss_id", "image_url", F.col("name").alias("product_name"), F.col("name").alias("product_name_cn"), blank.alias("product_id"), blank.alias("keywords_cn"), blank.alias("keywords_en"))


def _named_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed as a back-fill takes it, with Chinese names."""
    return _feed(spark, sf_dir, en_len=100).withColumn("product_name_cn", _cn("product_name"))


def backfill_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Back-fill of `_lacking`."""
    return ingest.backfill_names(_lacking(spark, sf_dir), _named_feed(spark, sf_dir))


def published_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows as a published catalogue of three parts, after its back-fill."""
    path, rows = f"{shared_dir(spark)}/catalogue", _lacking(spark, sf_dir)
    gone = F.col("faiss_id") >= 1000000
    for some in (gone, ~gone & (F.col("product_name") == ""), ~gone & (F.col("product_name") != "")):
        maintain.publish_catalogue(rows.where(some), path)
    maintain.backfill_published(spark, path, _named_feed(spark, sf_dir))
    return maintain.read_published(spark, path).select(*rows.columns)


def published_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the rows of a published catalogue fared in its back-fill."""
    path = f"{shared_dir(spark)}/catalogue"
    maintain.publish_catalogue(_lacking(spark, sf_dir), path)
    return maintain.backfill_published(spark, path, _named_feed(spark, sf_dir)).counts


def published_deletion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of a published catalogue of two parts after a deletion, with the version and how many rows went."""
    path, rows = f"{shared_dir(spark)}/catalogue", _catalogue(spark, sf_dir)
    for some in (F.col("category") > "cat5", F.col("category") <= "cat5"):
        maintain.publish_catalogue(rows.where(some), path)
    gone = _read(spark, sf_dir, "embeddings").where("label = 3").select(F.col("vec_id").alias("faiss_id"))
    made = maintain.delete_published(spark, path, gone)
    n = made.counts.select(F.col("n").alias("n_deleted"))
    return maintain.read_published(spark, path).select("faiss_id", "category", "product_name", F.lit(made.version).alias("version")).join(F.broadcast(n))


def published_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A published vector store after its rebuilding; every seventh row has no image, and of every eleventh the model can't make a vector."""
    root, tiles = shared_dir(spark), _tiles(spark, sf_dir).withColumn("image_url", F.concat(F.lit("http://img/"), "vec_id", F.lit(".jpg")))
    maintain.publish_catalogue(tiles.select(F.col("vec_id").alias("faiss_id"), "image_url"), f"{root}/catalogue")
    maintain.rebuild_published(spark, f"{root}/catalogue", tiles.select("image_url", F.col("pixels").alias("content")), _tile_model, f"{root}/vectors")
    content = F.when(F.col("vec_id") % 11 == 0, F.slice("pixels", 1, 5)).otherwise(F.col("pixels"))
    maintain.rebuild_published(spark, f"{root}/catalogue", tiles.where("vec_id % 7 <> 0").select("image_url", content.alias("content")), _tile_model, f"{root}/vectors")
    old, new = (maintain.read_published_vectors(spark, f"{root}/vectors", n).select("faiss_id", F.size("fine").alias("n_fine"), F.lit(n).alias("version")) for n in (1, 2))
    return old.unionByName(new)


def category_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.row_count(_catalogue(spark, sf_dir), "cat3")


def deletion_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = _read(spark, sf_dir, "embeddings").where("label = 3").select(F.col("vec_id").alias("faiss_id"))
    return reports.deletion_count(_catalogue(spark, sf_dir), gone)


def folded_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as queries; two kinds of requests for the same text are not folded."""
    docs = _read(spark, sf_dir, "documents")
    return reports.fold_members(docs.select(
        F.col("doc_id").alias("query_id"), F.coalesce("text", F.lit("")).cast("binary").alias("content"), F.col("lang").alias("category"), (F.col("source") == "src0").alias("auto_category")
    ))


def ocr_best_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.best_first(ocr_dedup(spark, sf_dir))


def sharp_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.filter_sharp(_tiles(spark, sf_dir), "pixels", F.lit(8), F.lit(8)).select("vec_id", F.round("sharpness", 4).alias("sharpness"))


def file_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages").select("page_id", images.extension(F.substring_index("url", "?", 1)).alias("extension"))


def _pixels_to_bytes(column: str) -> Column:
    """Pixels as bytes, by their hexadecimal digits."""
    return F.unhex(F.array_join(F.transform(column, lambda x: F.lpad(F.hex(x.cast("long")), 2, "0")), ""))


def _image(data: Column, side: int = 8, channels: int | Column = 1) -> Column:
    channels = F.lit(channels) if isinstance(channels, int) else channels
    return F.struct(F.lit("").alias("origin"), F.lit(side).alias("height"), F.lit(side).alias("width"), channels.alias("nChannels"), F.lit(0).alias("mode"), data.alias("data"))


def image_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validity and information of tiles, some of which count as empty, too large or undecodable; the leading bytes tell formats."""
    nth = F.col("vec_id") % 5
    head = F.unhex(F.element_at(F.array(*map(F.lit, ("FFD8FFE0", "89504E47", "52494646", "424D0000", "00000000"))), (nth + 1).cast("int")))
    size = F.when(nth == 0, 0).when(nth == 1, images.MAX_BYTES + 1).otherwise(images.MAX_BYTES)
    channels = F.element_at(F.array(*map(F.lit, (1, 3, 4, -1, 3))), (F.floor(F.col("vec_id") / 5) % 5 + 1).cast("int"))
    made = _tiles(spark, sf_dir).select("vec_id", head.alias("content"), size.alias("length"), _image(_pixels_to_bytes("pixels"), 8, channels).alias("image"))
    return made.select("vec_id", images.invalid_reason().alias("reason"), images.image_info().alias("i")).select("vec_id", "reason", "i.format", "i.mode", "i.channels", "i.width", "i.height", "i.size_bytes")


def _png(pixels, channels: int) -> bytes:
    """Gray values (height, width) as a PNG of 1 to 4 channels, opaque, its lines filtered by all filters in turn."""
    import zlib

    import numpy as np

    own = np.asarray(pixels, np.uint8)[..., None]
    own = np.concatenate([own] * (channels - 1 + channels % 2) + ([np.full_like(own, 255)] if channels % 2 == 0 else []), axis=2)
    height, width, step = *own.shape[:2], channels
    flat = np.pad(own.reshape(height, -1).astype(int), ((1, 0), (step, 0)))
    now, left, up, corner = flat[1:, step:], flat[1:, :-step], flat[:-1, step:], flat[:-1, :-step]
    near = np.stack([left, up, corner])
    paeth = np.take_along_axis(near, np.abs(near - (left + up - corner)).argmin(axis=0)[None], 0)[0]
    lines = [bytes([y % 5]) + ((now - (0, left, up, (left + up) // 2, paeth)[y % 5])[y] & 255).astype(np.uint8).tobytes() for y in range(height)]
    chunk = lambda kind, data: len(data).to_bytes(4, "big") + kind + data + zlib.crc32(kind + data).to_bytes(4, "big")
    head = width.to_bytes(4, "big") + height.to_bytes(4, "big") + bytes([8, (0, 4, 2, 6)[channels - 1], 0, 0, 0])
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")


def _as_png(side: int):
    """A function of pixels (side x side of them) and channels that makes PNG files."""

    @F.pandas_udf("binary")
    def made(pixels: pd.Series, channels: pd.Series) -> pd.Series:
        return pd.Series([_png(p.reshape(side, side), c) for p, c in zip(pixels, channels, strict=True)])

    return made


#: Files beyond this are too large in the image queries, where some are filled up.
SMALL = 4000


def _image_folder(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a PNG file for each tile, in one of four kinds, some damaged or too large, some of other extensions."""
    nth = F.col("vec_id") % 5
    name = F.concat(F.when(F.col("vec_id") % 4 == 2, "more/").otherwise(""), "vec_id", F.when(F.col("vec_id") % 10 == 9, ".txt").when(F.col("vec_id") % 4 == 1, ".PNG").otherwise(".png"))
    made = _tiles(spark, sf_dir).select("vec_id", name.alias("name"), _as_png(8)("pixels", F.element_at(F.array(*map(F.lit, (1, 3, 1, 2, 4))), (nth + 1).cast("int"))).alias("content"))
    half = F.call_function("div", F.length("content"), F.lit(2)).cast("int")
    damaged = F.concat(F.substring("content", F.lit(1), half), F.substring("content", half + 2, F.length("content")))
    filled = F.concat("content", F.unhex(F.lit("00" * SMALL)))
    files = made.select("name", F.when(nth == 2, damaged).when(nth == 3, filled).otherwise(F.col("content")).alias("content"))
    root = f"{shared_dir(spark)}/images"

    def write(batches):
        import pyarrow as pa
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(root)
        for batch in batches:
            for name, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store.create_dir(f"{at}/{name}".rpartition("/")[0])
                with store.open_output_stream(f"{at}/{name}") as out:
                    out.write(content)
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["name"])

    write_table(files.mapInArrow(write, "name string"), "written")
    return root


def _vec_id(path: str) -> Column:
    return F.regexp_extract(path, r"/(\d+)\.[^/]*$", 1).cast("long")


def image_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one pass over a folder of PNG files says of each."""
    files = images.read_image_files(spark, _image_folder(spark, sf_dir), max_bytes=SMALL)
    made = images.examine(files, ["path"], max_bytes=SMALL)
    return made.select(_vec_id("path").alias("vec_id"), "reason", "format", "mode", "channels", "width", "height", (F.col("size_bytes") > SMALL).alias("large"), F.round("sharpness", 4).alias("sharpness"))


#: Rows and columns of the tensors that the query returns.
LATTICE = (0, 13, 100, 223)


def model_tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model tensors of PNG files of 7 x 7 pixels, at some places of each channel."""
    pixels = _tiles(spark, sf_dir).select("vec_id", _as_png(7)(F.slice("pixels", 1, 49), F.when(F.col("vec_id") % 2 == 0, 1).otherwise(4)).alias("content"))
    made = images.examine(pixels.withColumn("length", F.length("content")), ["vec_id"], side=images.SIDE)
    axis = lambda *values: F.explode(F.array(*map(F.lit, values)))
    placed = made.withColumn("channel", axis(0, 1, 2)).withColumn("y", axis(*LATTICE)).withColumn("x", axis(*LATTICE))
    value = F.get("tensor", (F.col("channel") * images.SIDE + F.col("y")) * images.SIDE + F.col("x"))
    return placed.select("vec_id", "channel", "y", "x", F.round(value.cast("double"), 4).alias("value"))


def _tensor_model():
    """The middle of each 28 x 28 square of the first channel as the fine vector, its first row as the coarse one."""

    def model(inputs):
        import numpy as np

        fine = np.stack([t[0, 14::28, 14::28].ravel() for t in inputs]).astype(np.float64)
        return fine[:, :8] + 1e-3, fine + 1e-3

    return model


def _imported(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """Two imports of the image folder; returns where the tables are, and (run, status, n)."""
    root, folder = shared_dir(spark), _image_folder(spark, sf_dir)
    runs = [imports.import_directory(spark, folder, "cat", f"{root}/catalogue", f"{root}/vectors", _tensor_model, "tile").counts.withColumn("run", F.lit(i)) for i in (1, 2)]
    return root, runs[0].unionByName(runs[1]).select("run", "status", "n")


def imported_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue after two imports of one folder, with the sizes of the vectors."""
    root, _ = _imported(spark, sf_dir)
    vectors = maintain.read_published_vectors(spark, f"{root}/vectors").select("faiss_id", F.size("coarse").alias("n_coarse"), F.size("fine").alias("n_fine"))
    rows = maintain.read_published(spark, f"{root}/catalogue").join(vectors, "faiss_id", "left")
    return rows.select("faiss_id", _vec_id("image_url").alias("vec_id"), "category", "product_name", "width", "height", "n_coarse", "n_fine")


def import_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the files of a folder fared in two imports: what is there already is skipped, what failed fails again."""
    return _imported(spark, sf_dir)[1]


def stored_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One category of a catalogue that was written and read back, in the order of ids."""
    path = f"{shared_dir(spark)}/catalogue"
    tables.append_catalogue(_catalogue(spark, sf_dir).withColumn("id", F.col("faiss_id") + 1), path)
    return tables.read_catalogue(spark, path, "cat3", ordered=True).select("id", "faiss_id", "category", "product_name", "keywords_en", "width")


def stored_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector store that was written and read back, and one that isn't there, which is empty."""
    root = shared_dir(spark)
    tables.write_vectors(_vectors(spark, sf_dir).withColumns({c: F.col(c).cast("array<float>") for c in ("coarse", "fine")}), f"{root}/vectors")
    both = tables.read_vectors(spark, f"{root}/vectors").unionByName(tables.read_vectors(spark, f"{root}/none"))
    return both.select("faiss_id", F.size("coarse").alias("n_coarse"), F.round(F.col("fine")[0].cast("double"), 4).alias("x"))


def rebuilt_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New vectors for all embeddings; every seventh has no image, and of every eleventh the model can't make one."""
    tiles = _tiles(spark, sf_dir).withColumn("image_url", F.concat(F.lit("http://img/"), "vec_id", F.lit(".jpg")))
    rows = tiles.select(F.col("vec_id").alias("faiss_id"), "image_url")
    content = F.when(F.col("vec_id") % 11 == 0, F.slice("pixels", 1, 5)).otherwise(F.col("pixels"))
    counts = rebuild_store(rows, tiles.where("vec_id % 7 <> 0").select("image_url", content.alias("content")), _tile_model, f"{shared_dir(spark)}/vectors")
    return counts


def _byte_model():
    """Pixels around their middle as the fine vector, sums of four neighbours as the coarse one."""

    def model(inputs):
        import numpy as np

        fine = np.stack([np.frombuffer(x, np.uint8).astype(np.float64) - 127 for x in inputs])
        return fine.reshape(len(fine), 16, 4).sum(axis=2), fine

    return model


def _image_answer(spark: SparkSession, sf_dir: str) -> ImageAnswer:
    """Requests by tiles: each twice, once as a blank image and once undecodable, against the vectors of all tiles."""
    tiles = _tiles(spark, sf_dir).select("vec_id", _pixels_to_bytes("pixels").alias("content"))
    made = images.embed_images(tiles, "vec_id", "content", _byte_model).select(F.col("vec_id").alias("faiss_id"), "coarse", "fine")
    kinds = F.explode(F.sequence(F.lit(0), F.lit(3)))
    asked = tiles.where("vec_id % 20 = 0").withColumn("kind", kinds)
    blank = F.unhex(F.lit("C8" * 64))
    asked = asked.withColumn("content", F.when(F.col("kind") == 2, blank).otherwise(F.col("content")))
    requests = asked.select(
        (F.col("vec_id") + 1000000 * F.col("kind")).alias("query_id"), "content", F.length("content").alias("length"),
        _image(F.col("content"), 8, F.when(F.col("kind") == 3, -1).otherwise(1)).alias("image"), F.lit("").alias("category"), F.lit(False).alias("auto_category"),
    )
    return image_search(requests, _catalogue(spark, sf_dir), write_table(made, "vectors"), _byte_model)


def folded_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _image_answer(spark, sf_dir).hits.select("query_id", "rank", "faiss_id", "fused_score", "product_name")


def refused_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _image_answer(spark, sf_dir).refused


QUERIES = {f.__name__: f for f in (
    search_core, coarse_topk, keywords_en, category_stats, catalogue_stats, orphans, ocr_dedup, fold_queries, feed_first_wins, feed_last_wins, new_products, known_products,
    resolved_hits, category_prototypes, sync_report, delete_rows, duplicate_ids,
    keywords_cn, feed_projection, classify_queries, search_category_filtered, name_anchor_filter, consensus_word, text_boost, batch_hits, search_summary, name_keyword_matches,
    allocated_ids, manifest_rows, migrated_catalogue, sharpness, embed_tiles, stream_sync,
    coarse_candidates, search_ranked, search_named, search_before_cut, nearest_three, backfill_all, category_count, deletion_count, folded_members, ocr_best_first, sharp_tiles,
    file_extensions, image_checks, stored_catalogue, stored_vectors, rebuilt_store, sync_catalogue, sync_outcomes, retried_rows, folded_search, refused_requests,
    published_backfill, published_counts, published_deletion, published_rebuild, broken_pages, broken_letters,
    image_folder, model_tensors, imported_images, import_outcomes,
)}

_VEC = """
WITH anchor AS (SELECT label, arg_min(embedding, vec_id) AS a FROM embeddings GROUP BY label),
drawn AS (SELECT vec_id, list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE + 1.5 * a[i]) AS v FROM embeddings JOIN anchor USING (label)),
fined AS (SELECT vec_id, list_transform(v, lambda x: x / (sqrt(list_dot_product(v, v)) + 1e-8)) AS fine FROM drawn),
half AS (SELECT vec_id, fine, fine[1:32] AS h FROM fined),
vec AS (SELECT vec_id, fine, list_transform(h, lambda x: x / (sqrt(list_dot_product(h, h)) + 1e-8)) AS coarse FROM half),
scored AS (SELECT q.vec_id AS query_id, v.vec_id AS faiss_id, round(list_dot_product(q.coarse, v.coarse), 9) AS clip,
    round(list_dot_product(q.fine, v.fine), 9) AS raw FROM vec q, vec v WHERE q.vec_id % 20 = 0),
coarse AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY clip DESC, faiss_id) AS coarse_rank FROM scored QUALIFY coarse_rank <= 50)
"""
_FEED = """
WITH item AS (
    SELECT page_id // 30 AS page, page_id % 30 AS pos, url AS img, page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
        split_part(regexp_replace(url, '^\\w+://', ''), '/', 2) AS category FROM pages
), feed AS (
    SELECT * FROM item UNION ALL
    SELECT page + 1000, pos, split_part(img, '?', 1) || '?v=2', page_id, 'v2 ' || title, category FROM item WHERE page_id % 5 = 0
), product AS (
    SELECT page, pos, split_part(img, '?', 1) AS image_url, left(trim(title), 60) AS product_name, '' AS product_name_cn, page_id::VARCHAR AS product_id,
        left(coalesce(nullif(trim(category), ''), '其他'), 50) AS category FROM feed WHERE split_part(img, '?', 1) <> ''
)
"""
_FIRST = "SELECT * FROM product QUALIFY row_number() OVER (PARTITION BY image_url ORDER BY page, pos) = 1"
_KNOWN = "(SELECT split_part(url, '?', 1) FROM pages WHERE page_id % 3 = 0)"
_CATALOGUE = "SELECT vec_id AS faiss_id, 'cat' || label AS category FROM embeddings JOIN part ON vec_id = p_partkey"
_NAMED = "SELECT vec_id AS faiss_id, 'cat' || label AS category, p_name || ' ' || p_type || ' ' || p_brand AS product_name FROM embeddings JOIN part ON vec_id = p_partkey"
_quoted = lambda words: ", ".join(f"'{w}'" for w in words)
_WORDS = ", ".join(f"'{w}'" for w in [*text.EN_STOP, *text.EN_BRANDS])

_CORE = _VEC + """, fused AS (SELECT *, round(raw, 4) AS resnet_score, round(greatest(0.0, least(1.0, (raw - 0.45) / (1 - 0.45))), 4) AS fused_score FROM coarse),
best AS (SELECT *, max(fused_score) OVER (PARTITION BY query_id) AS top FROM fused)
SELECT query_id, faiss_id, row_number() OVER (PARTITION BY query_id ORDER BY fused_score DESC, coarse_rank) AS rank, round(clip, 4) AS clip_score, resnet_score, fused_score
FROM best WHERE top >= 0.7 AND resnet_score >= 0.5 AND fused_score >= top * 0.65 AND fused_score >= 0.3 QUALIFY rank <= 20"""


def _list(words: str, longer_than: int, stop: list[str], pipe: str = "") -> str:
    left_out = f" AND t NOT IN ({_quoted(stop)})" if stop else ""
    return rf"list_distinct(list_filter(regexp_split_to_array(lower(coalesce({words}, '')), '[\s\-/,.;:()\[\]{{}}{pipe}]+'), lambda t: length(t) > {longer_than}{left_out} AND NOT regexp_matches(t, '^[0-9]+$')))"


_EN = lambda c: f"array_to_string(list_sort({_list(c, 3, [*text.EN_STOP, *text.EN_BRANDS], '|')}), ' ')"
_LETTERS = "'abcdefghijklmnopqrstuvwxyz'"
_CN = lambda c: f"translate({c}, {_LETTERS}, '{CN_LETTERS}')"


def _chinese(key: str, source: str, table: str) -> str:
    """(key, keywords_cn) by lists of one to three characters."""
    grams = " || ".join(f"list_transform(range(1, len(c) - {n - 2}), lambda i: array_to_string(c[i:i + {n - 1}], ''))" for n in (1, 2, 3))
    return f"""SELECT {key}, array_to_string(list_sort(list_distinct({grams})), ' ') AS keywords_cn
        FROM (SELECT {key}, list_filter(regexp_extract_all({source}, '[一-鿿]'), lambda x: NOT contains('{text.CN_STOP}', x)) AS c FROM {table})"""


_CLASSIFY = """proto AS (SELECT category, list(CASE WHEN n = 1 THEN m ELSE m / (len + 1e-8) END ORDER BY pos) AS p FROM (
    SELECT *, sqrt(sum(m * m) OVER (PARTITION BY category)) AS len FROM (SELECT category, pos, avg(coarse[pos + 1]) AS m, count(*) AS n
        FROM (SELECT vec_id AS faiss_id, 'cat' || label AS category FROM embeddings JOIN part ON vec_id = p_partkey) JOIN vec ON faiss_id = vec_id, (SELECT unnest(range(0, 32)) AS pos)
        GROUP BY category, pos)) GROUP BY category),
raw AS (SELECT vec_id + 1000000 AS query_id, list_transform(embedding[1:32], lambda x: x::DOUBLE) AS h FROM embeddings WHERE vec_id % 20 = 0),
asked AS (SELECT vec_id AS query_id, coarse FROM vec WHERE vec_id % 20 = 0
    UNION ALL SELECT query_id, list_transform(h, lambda x: x / (sqrt(list_dot_product(h, h)) + 1e-8)) FROM raw),
near AS (SELECT query_id, category, round(list_dot_product(coarse, p), 9) AS s, row_number() OVER (PARTITION BY query_id ORDER BY round(list_dot_product(coarse, p), 9) DESC, category) AS r
    FROM asked, proto),
margin AS (SELECT query_id, max(category) FILTER (r = 1) AS category, coalesce(round(max(s) FILTER (r = 1) - max(s) FILTER (r = 2), 4), max(s) FILTER (r = 1)) AS confidence FROM near GROUP BY query_id),
classified AS (SELECT query_id, CASE WHEN confidence >= 0.02 THEN category END AS predicted_category, confidence FROM margin)
"""
_FILTERS = f"""filters AS (SELECT query_id, CASE turn WHEN 2 THEN predicted_category END AS predicted_category, CASE turn WHEN 2 THEN confidence END AS confidence,
    CASE WHEN turn < 2 THEN 'manual' WHEN turn = 3 OR predicted_category IS NULL THEN 'none' WHEN predicted_category IN (SELECT category FROM ({_NAMED})) THEN 'auto' ELSE 'auto_empty' END AS filter_source,
    CASE turn WHEN 0 THEN 'cat' || label WHEN 1 THEN 'none' WHEN 2 THEN predicted_category END AS only_category
    FROM (SELECT c.*, label, (query_id // 20) % 4 AS turn FROM classified c JOIN embeddings ON vec_id = query_id)),
coarse AS (SELECT a.* FROM every a JOIN filters USING (query_id) LEFT JOIN ({_NAMED}) n USING (faiss_id) WHERE only_category IS NULL OR only_category = n.category)
"""
_FILTERED = _CORE.replace("coarse AS (SELECT *, row", "every AS (SELECT *, row", 1).replace(", fused AS", ", " + _CLASSIFY + ", " + _FILTERS + ", fused AS", 1)


def _marked_sql(core: str) -> str:
    """WITH clauses up to ``marked``: resolved hits of a search with kept."""
    words = _list("product_name", 1, [*text.ANCHOR_STOP, *text.EN_BRANDS], "|")
    return f"""WITH hit AS (SELECT query_id, rank, h.faiss_id, fused_score, n.category, product_name, {words} AS own FROM ({core}) h JOIN ({_NAMED}) n USING (faiss_id)),
anchored AS (SELECT *, first_value(own) OVER w AS anchor, row_number() OVER w AS nth, count(*) OVER (PARTITION BY query_id) AS n FROM hit WINDOW w AS (PARTITION BY query_id ORDER BY rank)),
marked AS (SELECT * EXCLUDE (own, anchor, n), n < 2 OR len(anchor) = 0 OR nth = 1
    OR len(list_intersect(own, anchor)) >= CASE WHEN len(anchor) <= 2 THEN 1 ELSE greatest(2, len(anchor) // 2) END AS kept FROM anchored),
word AS (SELECT query_id, unnest({_list("product_name", 3, text.CONSENSUS_STOP)}) AS w, kept FROM marked),
consensus AS (SELECT query_id, w FROM word GROUP BY query_id, w HAVING bool_and(kept)),
longest AS (SELECT query_id, w FROM consensus QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY length(w) DESC, w) = 1)
"""


_WORD = "CASE WHEN bool_and(kept) THEN '' ELSE coalesce(any_value(w), '') END AS consensus_word"
_NEW = _FEED + f"SELECT image_url, product_id FROM ({_FIRST}) WHERE image_url NOT IN {_KNOWN}"
_LAP = "(t[i - 7] + t[i + 9] + t[i] + t[i + 2] - 4 * t[i + 1])"
_BACKFILL = f"""SELECT o.faiss_id, o.image_url, CASE WHEN taken THEN l.product_name ELSE o.name END AS product_name, CASE WHEN taken THEN {_CN("l.product_name")} ELSE o.name END AS product_name_cn,
    CASE WHEN taken THEN l.product_id ELSE '' END AS product_id, CASE WHEN taken THEN k.keywords_cn ELSE '' END AS keywords_cn, CASE WHEN taken THEN {_EN("l.product_name")} ELSE '' END AS keywords_en,
    CASE WHEN taken THEN 'updated' WHEN o.name = '' THEN 'not_found' ELSE 'complete' END AS status
FROM (SELECT o.*, name = '' AND image_url IN (SELECT image_url FROM latest) AS taken FROM (
    SELECT page_id AS faiss_id, split_part(url, '?', 1) AS image_url, CASE WHEN page_id % 2 = 0 THEN '' ELSE 'old ' || page_id END AS name FROM pages WHERE page_id % 3 = 0) o) o
LEFT JOIN latest l USING (image_url) LEFT JOIN ({_chinese("image_url", _CN("product_name"), "latest")}) k USING (image_url)"""
_LATEST = _FEED.rstrip() + ", latest AS (" + _FIRST.replace("page, pos", "page DESC, pos DESC") + ")\n"

#: The searches over 200 candidates and back-fill with 100 characters, as the queries above say; SQL of its own.
_VEC_200, _CORE_200, _FILTERED_200 = (x.replace("coarse_rank <= 50", "coarse_rank <= 200") for x in (_VEC, _CORE, _FILTERED))
_RANKED = "row_number() OVER (PARTITION BY query_id ORDER BY clip DESC, faiss_id) AS coarse_rank FROM scored"
_BEFORE_CUT = (
    _FILTERED_200.replace(f"every AS (SELECT *, {_RANKED} QUALIFY coarse_rank <= 200)\n, ", "", 1)
    .replace("coarse AS (SELECT a.* FROM every a", f"coarse AS (SELECT a.*, {_RANKED} a", 1)
    .replace("only_category = n.category)", "only_category = n.category QUALIFY coarse_rank <= 200)", 1)
)
_LATEST_100 = _LATEST.replace("left(trim(title), 60)", "left(trim(title), 100)")
_BACKFILL_ALL = _BACKFILL.replace("FROM pages WHERE page_id % 3 = 0) o) o", "FROM pages UNION ALL SELECT page_id + 1000000, 'http://gone.example/' || page_id, '' FROM pages) o) o")
_ITEMS = _FEED.replace("page_id % 5 = 0", "false")
_FRESH = f"SELECT * FROM ({_FIRST}) WHERE image_url NOT IN {_KNOWN}"
_FAILS = "product_id::BIGINT % 7 = 0"
_NO_IMAGE = "product_id::BIGINT NOT IN (SELECT vec_id FROM embeddings)"
_TILE_VEC = """
WITH tile AS (SELECT vec_id, list_transform(embedding, lambda x: floor((x::DOUBLE + 1) * 127.5) - 127) AS v FROM embeddings),
sums AS (SELECT vec_id, v, list_transform(range(0, 16), lambda i: list_sum(v[4 * i + 1:4 * i + 4])) AS h FROM tile),
vec AS (SELECT vec_id, list_transform(v, lambda x: (x / (sqrt(list_dot_product(v, v)) + 1e-8))::FLOAT::DOUBLE) AS fine,
    list_transform(h, lambda x: (x / (sqrt(list_dot_product(h, h)) + 1e-8))::FLOAT::DOUBLE) AS coarse FROM sums),
"""
_TILE_CORE = _TILE_VEC + _CORE_200[_CORE_200.index("scored AS"):]

ORACLE_SQL = {
    "coarse_candidates": _VEC_200 + "SELECT query_id, faiss_id, round(clip, 4) AS clip_score, coarse_rank FROM coarse",
    "search_ranked": _CORE_200,
    "search_named": _marked_sql(_CORE_200) + "SELECT query_id, rank, faiss_id, fused_score, category, product_name, kept FROM marked",
    "search_before_cut": _BEFORE_CUT,
    "nearest_three": _VEC_200 + "SELECT query_id, faiss_id, round(clip, 4) AS clip_score, coarse_rank FROM coarse WHERE coarse_rank <= 3",
    "backfill_all": _LATEST_100 + _BACKFILL_ALL,
    "published_backfill": f"SELECT * EXCLUDE (status) FROM ({_LATEST_100 + _BACKFILL_ALL})",
    "published_counts": f"SELECT status, count(*) AS n FROM ({_LATEST_100 + _BACKFILL_ALL}) GROUP BY status",
    "published_deletion": f"""SELECT faiss_id, category, product_name, 3 AS version, (SELECT count(*) FROM ({_NAMED}) WHERE category = 'cat3') AS n_deleted FROM ({_NAMED}) WHERE category <> 'cat3'""",
    "published_rebuild": """SELECT vec_id AS faiss_id, 64 AS n_fine, 1 AS version FROM embeddings
        UNION ALL SELECT vec_id, 64, 2 FROM embeddings WHERE vec_id % 7 <> 0 AND vec_id % 11 <> 0""",
    "category_count": f"SELECT count(*) AS n FROM ({_CATALOGUE}) WHERE category = 'cat3'",
    "deletion_count": "SELECT count(*) AS n_deleted FROM embeddings JOIN part ON vec_id = p_partkey WHERE label = 3",
    "folded_members": "SELECT doc_id AS query_id, min(doc_id) OVER (PARTITION BY coalesce(text, ''), lang, source = 'src0') AS representative FROM documents",
    "ocr_best_first": """SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY confidence DESC, text)::INT AS place FROM (
SELECT event_id % 500 AS image_id, trim(event_type) AS text, max((event_id % 100) / 100.0) AS confidence FROM events WHERE (event_id % 100) / 100.0 >= 0.5 AND trim(event_type) <> '' GROUP BY ALL)""",
    "file_extensions": r"SELECT page_id, lower(regexp_extract(split_part(url, '?', 1), '\.([^./\\]+)$', 1)) AS extension FROM pages",
    "image_checks": """WITH v AS (SELECT vec_id, vec_id % 5 AS nth, [1, 3, 4, -1, 3][(vec_id // 5) % 5 + 1] AS channels FROM embeddings)
SELECT vec_id, CASE WHEN nth = 0 THEN 'empty' WHEN nth = 1 THEN 'too_large' WHEN channels < 1 THEN 'undecodable' END AS reason,
    CASE nth WHEN 0 THEN 'JPEG' WHEN 1 THEN 'PNG' WHEN 2 THEN 'WEBP' WHEN 3 THEN 'BMP' END AS format,
    CASE channels WHEN 1 THEN 'L' WHEN 3 THEN 'RGB' WHEN 4 THEN 'RGBA' END AS mode, channels, 8 AS width, 8 AS height, 4 AS size_bytes FROM v""",
    "stored_catalogue": f"SELECT faiss_id + 1 AS id, faiss_id, category, product_name, '' AS keywords_en, 0::INT AS width FROM ({_NAMED}) WHERE category = 'cat3'",
    "stored_vectors": _VEC + "SELECT vec_id AS faiss_id, 32 AS n_coarse, round(fine[1]::FLOAT::DOUBLE, 4) AS x FROM vec",
    "rebuilt_store": """SELECT CASE WHEN vec_id % 7 = 0 THEN 'missing' WHEN vec_id % 11 = 0 THEN 'failed' ELSE 'ok' END AS status, count(*) AS n FROM embeddings GROUP BY 1""",
    "sync_catalogue": _ITEMS + f"SELECT image_url, product_name, product_id, category, {_EN('product_name')} AS keywords_en, 16 AS n_coarse, 64 AS n_fine FROM ({_FRESH}) WHERE NOT ({_FAILS} OR {_NO_IMAGE})",
    "sync_outcomes": _ITEMS + f""", fresh AS ({_FRESH}),
outcome AS (SELECT p.page, CASE WHEN f.image_url IS NULL THEN 'skipped' WHEN f.{_FAILS} OR f.{_NO_IMAGE} THEN 'failed' ELSE 'ok' END AS status
    FROM product p LEFT JOIN fresh f ON p.image_url = f.image_url AND p.page = f.page AND p.pos = f.pos)
SELECT page, count_if(status = 'ok') AS n_ok, count_if(status = 'skipped') AS n_skipped, count_if(status = 'failed') AS n_failed FROM outcome GROUP BY ROLLUP (page)""",
    "broken_pages": _ITEMS + f""", fresh AS ({_FRESH}),
outcome AS (SELECT p.page, CASE WHEN f.image_url IS NULL THEN 'skipped' WHEN f.{_FAILS} THEN 'failed' ELSE 'ok' END AS status
    FROM product p LEFT JOIN fresh f ON p.image_url = f.image_url AND p.page = f.page AND p.pos = f.pos
    UNION ALL SELECT DISTINCT page_id // 30, 'failed' FROM pages)
SELECT page, count_if(status = 'ok') AS n_ok, count_if(status = 'skipped') AS n_skipped, count_if(status = 'failed') AS n_failed FROM outcome GROUP BY ROLLUP (page)""",
    "broken_letters": _ITEMS + f"""SELECT 'too_large' AS reason, count(*) AS n, count(*) AS n_retried FROM ({_FRESH}) WHERE {_FAILS}
        UNION ALL SELECT 'malformed page', count(DISTINCT page_id // 30), 0 FROM pages""",
    "retried_rows": _ITEMS + f"""SELECT image_url, 1 AS attempt, CASE WHEN {_FAILS} THEN 'failed' ELSE 'ok' END AS status, CASE WHEN {_FAILS} THEN 'too_large' END AS error, true AS held FROM ({_FRESH})
UNION ALL SELECT image_url, 2, 'ok', NULL, true FROM ({_FRESH}) WHERE {_FAILS}""",
    "folded_search": _marked_sql(_TILE_CORE) + """SELECT query_id + 1000000 * copy AS query_id, rank, faiss_id, fused_score, product_name FROM marked, (SELECT unnest([0, 1]) AS copy) WHERE kept""",
    "refused_requests": """SELECT vec_id + 2000000 AS query_id, 'blurred' AS reason FROM embeddings WHERE vec_id % 20 = 0
UNION ALL SELECT vec_id + 3000000, 'undecodable' FROM embeddings WHERE vec_id % 20 = 0""",
    "keywords_cn": _chinese("p_partkey", _CN("p_name"), "part"),
    "feed_projection": _FEED + "SELECT * FROM product",
    "classify_queries": _VEC + ", " + _CLASSIFY + "SELECT * FROM classified",
    "search_category_filtered": _FILTERED,
    "name_anchor_filter": _marked_sql(_CORE) + "SELECT query_id, rank, faiss_id, product_name, kept FROM marked",
    "consensus_word": _marked_sql(_CORE) + f"SELECT query_id, {_WORD} FROM marked LEFT JOIN longest USING (query_id) GROUP BY query_id",
    "text_boost": f"""WITH hit AS (SELECT query_id, h.faiss_id, rank AS was, fused_score AS old, lower(product_name) AS low, {_list("p_name || ' ' || p_brand", 2, [])} AS keys
    FROM ({_CORE}) h JOIN ({_NAMED}) n USING (faiss_id) LEFT JOIN part ON p_partkey = query_id),
boosted AS (SELECT *, round(least(len(list_filter(keys, lambda k: contains(low, k))) * 0.05, 0.15), 4) AS b FROM hit),
scored AS (SELECT *, CASE WHEN b > 0 THEN round(least(1.0, old + b), 4) ELSE old END AS score FROM boosted)
SELECT query_id, faiss_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, was) AS rank, score::DOUBLE AS fused_score, b::DOUBLE AS text_boost FROM scored""",
    "batch_hits": _marked_sql(_FILTERED) + "SELECT query_id, rank, faiss_id, fused_score, category, product_name FROM marked WHERE kept",
    "search_summary": _marked_sql(_FILTERED).replace("WITH hit AS", _VEC.strip().replace("coarse AS (SELECT *, row", "every AS (SELECT *, row") + ", " + _CLASSIFY + ", " + _FILTERS + ", hit AS", 1)
    + f""", counted AS (SELECT query_id, count(*) AS n_before, count_if(kept) AS n_after, max(fused_score) AS top_score, {_WORD} FROM marked LEFT JOIN longest USING (query_id) GROUP BY query_id)
SELECT query_id, coalesce(n_before, 0)::BIGINT AS n_before, coalesce(n_after, 0)::BIGINT AS n_after, coalesce(top_score, 0.0) AS top_score, predicted_category, confidence, filter_source,
    coalesce(n_after < n_before, false) AS consensus_applied, coalesce(consensus_word, '') AS consensus_word FROM filters LEFT JOIN counted USING (query_id)""",
    "name_keyword_matches": f"""WITH keyword AS (SELECT DISTINCT unnest({_list("text", 2, [])}) AS k FROM benchmark),
name AS (SELECT DISTINCT p_name || ' ' || p_type || ' ' || p_brand AS product_name FROM part)
SELECT product_name, string_agg(k, ' ' ORDER BY k) AS keywords FROM name JOIN keyword ON contains(lower(product_name), k) GROUP BY product_name""",
    "allocated_ids": f"SELECT *, (SELECT max(page_id) FROM pages WHERE page_id % 3 = 0) + row_number() OVER (ORDER BY image_url) AS faiss_id FROM ({_NEW})",
    "manifest_rows": """WITH line AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY l_orderkey) AS n,
    CASE WHEN l_linenumber <> 2 THEN l_orderkey || '-' || l_linenumber ELSE '' END AS file_name FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey::VARCHAR))
SELECT l_orderkey, pos, file_name, CASE WHEN pos < n - 1 THEN l_partkey::VARCHAR ELSE file_name END AS image_url, CASE WHEN pos < n - 2 THEN l_partkey::VARCHAR ELSE '' END AS product_name,
    '' AS product_name_cn, l_partkey::VARCHAR AS product_id, '' AS keywords_cn, '' AS keywords_en, CASE WHEN l_orderkey % 2 = 0 THEN 'shoes' ELSE '其他' END AS category FROM line WHERE file_name <> ''""",
    "migrated_catalogue": f"SELECT faiss_id, category, '' AS product_name, '' AS product_id, '' AS keywords_en, 0::BIGINT AS file_size, 0::INT AS width FROM ({_NAMED})",
    "sharpness": f"""WITH tile AS (SELECT vec_id, list_transform(embedding, lambda x: floor((x::DOUBLE + 1) * 127.5)) AS t FROM embeddings),
cell AS (SELECT vec_id, i, {_LAP} AS e FROM tile, (SELECT unnest(range(0, 64)) AS i) WHERE i // 8 BETWEEN 1 AND 6 AND i % 8 BETWEEN 1 AND 6),
part_sum AS (SELECT vec_id, sum(e) AS s, sum(e * e) AS ss, sum(e) FILTER (mid) AS ms, sum(e * e) FILTER (mid) AS mss
    FROM (SELECT *, i // 8 BETWEEN 3 AND 4 AND i % 8 BETWEEN 3 AND 4 AS mid FROM cell) GROUP BY vec_id)
SELECT vec_id, score, score >= 20 AS sharp FROM (SELECT vec_id, round(greatest(ss / 64 - (s / 64) ** 2, 0.7 * (mss / 16 - (ms / 16) ** 2)), 4) AS score FROM part_sum)""",
    "embed_tiles": """WITH cell AS (SELECT vec_id, pos, list_sum(list_transform(embedding[4 * pos + 1:4 * pos + 4], lambda x: floor((x::DOUBLE + 1) * 127.5))) AS s FROM embeddings, (SELECT unnest(range(0, 16)) AS pos))
SELECT vec_id, pos::INT AS pos, round((s / (sqrt(sum(s * s) OVER (PARTITION BY vec_id)) + 1e-8))::FLOAT::DOUBLE, 4) AS x, NULL::VARCHAR AS error FROM cell""",
    "stream_sync": _FEED.replace("page_id % 5 = 0", "false") + f"SELECT image_url, product_name, product_id, category FROM ({_FIRST}) WHERE image_url NOT IN {_KNOWN}",

    "coarse_topk": _VEC + "SELECT query_id, faiss_id, round(clip, 4) AS clip_score, coarse_rank FROM coarse",
    "search_core": _CORE,
    "keywords_en": rf"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\s\-/,.;:()\[\]{{}}|]+'),
        lambda t: length(t) > 3 AND t NOT IN ({_WORDS}) AND NOT regexp_matches(t, '^[0-9]+$')))), ' ') AS keywords_en FROM documents""",
    "category_stats": f"SELECT category, count(*) AS n FROM ({_CATALOGUE}) GROUP BY category",
    "catalogue_stats": f"SELECT (SELECT count(*) FROM ({_CATALOGUE})) AS n_records, count(*) AS n_coarse, count(*) AS n_fine, 32 AS coarse_dim, 64 AS fine_dim FROM embeddings",
    "orphans": """SELECT vec_id AS faiss_id, 'row' AS missing FROM embeddings WHERE vec_id NOT IN (SELECT p_partkey FROM part)
UNION ALL SELECT p_partkey, 'vector' FROM part WHERE p_partkey NOT IN (SELECT vec_id FROM embeddings)""",
    "ocr_dedup": "SELECT event_id % 500 AS image_id, trim(event_type) AS text, max((event_id % 100) / 100.0) AS confidence FROM events WHERE (event_id % 100) / 100.0 >= 0.5 AND trim(event_type) <> '' GROUP BY ALL",
    "fold_queries": "SELECT md5(coalesce(text, '')) AS digest, lang AS category, min(doc_id) AS query_id, count(*) AS n FROM documents GROUP BY 1, 2",
    "feed_first_wins": _FEED + _FIRST,
    "feed_last_wins": _FEED + _FIRST.replace("page, pos", "page DESC, pos DESC"),
    "new_products": _FEED + f"SELECT image_url, product_id FROM ({_FIRST}) WHERE image_url NOT IN {_KNOWN}",
    "known_products": _FEED + f"SELECT image_url, product_id FROM ({_FIRST}) WHERE image_url IN {_KNOWN}",
    "resolved_hits": f"""SELECT query_id, rank, faiss_id, 'cat' || label AS category, p_name || ' ' || p_type || ' ' || p_brand AS product_name
FROM ({_CORE}) JOIN embeddings ON faiss_id = embeddings.vec_id JOIN part ON faiss_id = p_partkey""",
    "category_prototypes": _VEC + f"""SELECT category, n, pos, round(CASE WHEN n = 1 THEN m ELSE m / (sqrt(sum(m * m) OVER (PARTITION BY category)) + 1e-8) END, 4) AS x
FROM (SELECT category, pos, avg(coarse[pos + 1]) AS m, count(*) AS n FROM ({_CATALOGUE}) JOIN vec ON faiss_id = vec_id, (SELECT unnest(range(0, 32)) AS pos)
    GROUP BY category, pos)""",
    "sync_report": """SELECT page_id // 30 AS page, count_if(page_id % 3 <> 0 AND page_id % 7 <> 0) AS n_ok, count_if(page_id % 3 = 0) AS n_skipped,
    count_if(page_id % 3 <> 0 AND page_id % 7 = 0) AS n_failed, sum(length(html))::BIGINT AS bytes FROM pages GROUP BY ROLLUP (page_id // 30)""",
    "delete_rows": "SELECT vec_id AS faiss_id, 'cat' || label AS category, p_name || ' ' || p_type || ' ' || p_brand AS product_name FROM embeddings JOIN part ON vec_id = p_partkey WHERE label <> 3",
    "duplicate_ids": "SELECT user_id AS faiss_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) > 1",
}
ORACLE_SQL["image_folder"] = f"""SELECT vec_id, CASE n WHEN 2 THEN 'undecodable' WHEN 3 THEN 'too_large' END AS reason, CASE WHEN n <> 3 THEN 'PNG' END AS format,
    ['L', 'RGB', NULL, NULL, 'RGBA'][n + 1] AS mode, [1, 3, NULL, NULL, 4][n + 1]::INT AS channels, CASE WHEN n NOT IN (2, 3) THEN 8 END AS width, CASE WHEN n NOT IN (2, 3) THEN 8 END AS height,
    n = 3 AS large, CASE WHEN n NOT IN (2, 3) THEN score END AS sharpness
FROM (SELECT *, vec_id % 5 AS n FROM ({ORACLE_SQL['sharpness']})) WHERE vec_id % 10 <> 9"""
ORACLE_SQL["model_tensors"] = """
WITH tile AS (SELECT vec_id, list_transform(embedding[1:49], lambda x: floor((x::DOUBLE + 1) * 127.5)) AS t FROM embeddings),
edge AS (SELECT p, c - floor(c) AS w, greatest(floor(c), 0)::INT AS lo, least(floor(c) + 1, 6)::INT AS hi FROM (SELECT p, (p::DOUBLE + 0.5) / 32 - 0.5 AS c FROM (SELECT unnest([0, 13, 100, 223]) AS p))),
col AS (SELECT vec_id, p AS y, k, round_even((1 - w) * t[lo * 7 + k + 1] + w * t[hi * 7 + k + 1], 0) AS v FROM tile, edge, range(7) AS of(k)),
cell AS (SELECT a.vec_id, a.y, p AS x, round_even((1 - w) * a.v + w * b.v, 0) AS v FROM edge JOIN col a ON a.k = lo JOIN col b ON b.k = hi AND b.vec_id = a.vec_id AND b.y = a.y)
SELECT vec_id, channel, y, x, round(((v / 255 - mean) / deviation)::FLOAT::DOUBLE, 4) AS value
FROM cell, (VALUES (0, 0.485::DOUBLE, 0.229::DOUBLE), (1, 0.456::DOUBLE, 0.224::DOUBLE), (2, 0.406::DOUBLE, 0.225::DOUBLE)) AS c(channel, mean, deviation)"""
ORACLE_SQL["imported_images"] = """SELECT row_number() OVER (ORDER BY CASE WHEN vec_id % 4 = 2 THEN 'more/' ELSE '' END || vec_id || CASE WHEN vec_id % 4 = 1 THEN '.PNG' ELSE '.png' END) - 1 AS faiss_id,
    vec_id, 'cat' AS category, 'tile' AS product_name, 8 AS width, 8 AS height, 8 AS n_coarse, 64 AS n_fine FROM embeddings WHERE vec_id % 5 <> 2 AND vec_id % 10 <> 9"""
ORACLE_SQL["import_outcomes"] = """SELECT run, CASE WHEN vec_id % 5 = 2 THEN 'undecodable' WHEN run = 1 THEN 'ok' ELSE 'skipped' END AS status, count(*) AS n
    FROM embeddings, (VALUES (1), (2)) AS r(run) WHERE vec_id % 10 <> 9 GROUP BY ALL"""
ORACLE_SQL["sharp_tiles"] = f"SELECT vec_id, score AS sharpness FROM ({ORACLE_SQL['sharpness']}) WHERE sharp"
