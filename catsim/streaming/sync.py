"""Continuous catalogue sync: feed pages arrive as JSON files, new products are added with keywords, vectors and fresh ids.

Beside each table of rows lies its index: for each batch the id that follows its last one, and a filter of its URLs. A batch
asks the filters of the older ones which of them may hold its URLs and reads only those, and takes its first id from
their marks, so what it reads of the rows doesn't grow with the table; the filters take 4 bytes for a URL.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from catsim.operators import ingest, membership
from catsim.operators.ids import allocate_ids
from catsim.sources.catalogue import RAW_FEED, explode_feed, good_pages, malformed_pages
from catsim.sources.shared import table_scope, write_table

_NAMES = "image_url string, product_name string, product_name_cn string, product_id string, category string"
ROWS = f"{_NAMES}, keywords_cn string, keywords_en string, faiss_id long"
FAILED = f"{_NAMES}, error string"
VECTORS = "faiss_id long, coarse array<float>, fine array<float>"
STATUS = "page long, image_url string, status string, bytes long, error string"
MARKS = "next_id long, blocks int"
#: Products -> the same with ``error``, null where a product is good, and ``bytes`` if its image's size is known.
Check = Callable[[DataFrame], DataFrame]
#: Products (image_url and the rest) -> (image_url, coarse, fine, error).
Embed = Callable[[DataFrame], DataFrame]
#: The batch of what is known at the start, and of the second pass over dead letters.
FIRST, RETRY = -1, -2


class Extra(NamedTuple):
    """What a sync may write besides the rows: vectors by a model, and the status of every item."""

    embed: Embed | None = None
    vectors: str | None = None
    status: str | None = None


def no_errors(products: DataFrame) -> DataFrame:
    """The default check: every product is good."""
    return products.withColumn("error", F.lit(None).cast("string"))


def read_rows(spark: SparkSession, path: str, schema: str = ROWS) -> DataFrame:
    """All rows of a synced table, with the batch that wrote them."""
    return spark.read.schema(f"{schema}, batch long").parquet(path)


def create_table(spark: SparkSession, path: str, rows: DataFrame | None = None, schema: str = ROWS) -> None:
    """Start a synced table with the rows that are known already, as batch -1; columns that they lack are null."""
    none = spark.createDataFrame([], schema)
    first = none if rows is None else none.unionByName(rows.select(*[c for c in none.columns if c in rows.columns]), allowMissingColumns=True)
    first.write.mode("overwrite").parquet(f"{path}/batch={FIRST}")
    if "faiss_id" in none.columns and "image_url" in none.columns:
        _index_batch(spark, path, FIRST, 0)


def _put(rows: DataFrame, schema: str, path: str, batch: int) -> None:
    whole = rows.sparkSession.createDataFrame([], schema).unionByName(rows, allowMissingColumns=True)
    whole.select(*rows.sparkSession.createDataFrame([], schema).columns).write.mode("overwrite").parquet(f"{path}/batch={batch}")


def _index_path(table: str, what: str) -> str:
    return f"{table.rstrip('/')}-index/{what}"


def _index_batch(spark: SparkSession, table: str, batch: int, start: int) -> None:
    """Write the filter of a batch's URLs, and then its mark: the id after its last one, ``start`` if it has none."""
    rows = spark.read.schema(ROWS).parquet(f"{table}/batch={batch}")
    n, top = rows.agg(F.count("*"), F.max("faiss_id")).first()
    membership.build_filter(rows.select("image_url"), n).write.mode("overwrite").parquet(f"{_index_path(table, 'seen')}/batch={batch}")
    mark = spark.createDataFrame([(start if top is None else max(start, top + 1), membership.blocks_for(n))], MARKS)
    mark.coalesce(1).write.mode("overwrite").parquet(f"{_index_path(table, 'marks')}/batch={batch}")


class Older(NamedTuple):
    """What a batch knows of the batches before it: their numbers and sizes of filters, and the next free id."""

    blocks: dict[int, int]
    next_id: int


def older_batches(spark: SparkSession, table: str, before: int | None = None, apart: int | None = None) -> Older:
    """All batches, those before one, or all but one, by their marks: one small row for each."""
    marks = read_rows(spark, _index_path(table, "marks"), MARKS)
    marks = marks if before is None else marks.where(F.col("batch") < before)
    found = (marks if apart is None else marks.where(F.col("batch") != apart)).collect()
    return Older({m.batch: m.blocks for m in found}, max((m.next_id for m in found), default=0))


def suspects(urls: DataFrame, table: str, older: Older) -> tuple[DataFrame, list[int]]:
    """(image_url, batch) of different URLs and the older batches that may hold them, by their filters; and these batches, of
    which there are as many as batches at most."""
    filters = read_rows(urls.sparkSession, _index_path(table, "seen"), membership.SCHEMA).where(F.col("batch").isin(list(older.blocks)))
    found = write_table(membership.may_hold(urls, filters, sorted(set(older.blocks.values()))), "suspects")
    return found, sorted(r.batch for r in found.select("batch").distinct().collect())


def known_urls(urls: DataFrame, table: str, older: Older) -> DataFrame:
    """Those URLs of ``urls`` (image_url, all different) that the rows of older batches have: only batches that may hold some are
    read, and of these the URLs alone, which are compared."""
    found, batches = suspects(urls, table, older) if older.blocks else (urls, [])
    if not batches:
        return urls.limit(0)
    held = read_rows(urls.sparkSession, table).where(F.col("batch").isin(batches)).select("image_url")
    return held.join(found.select("image_url").distinct(), "image_url", "left_semi").distinct()


def _add(judged: DataFrame, batch: int, older: Older, table: str, extra: Extra) -> DataFrame:
    """Write the good ones of ``judged`` (products with error) as one batch; returns ``judged`` with the errors of the model."""
    if extra.embed is not None:
        made = write_table(extra.embed(judged.where("error IS NULL")), "made")
        told = made.select("image_url", F.col("error").alias("_why"), F.lit(True).alias("_made"))
        why = F.coalesce("error", "_why", F.when(F.col("_made").isNull(), "no image"))
        judged = write_table(judged.join(told, "image_url", "left").withColumn("error", why).drop("_why", "_made"), "judged")
    good = ingest.with_keywords(judged.where("error IS NULL"))
    numbered = allocate_ids(good.drop("error", "bytes", "page", "pos"), ["image_url"], start=older.next_id)
    _put(numbered, ROWS, table, batch)
    if extra.embed is not None and extra.vectors is not None:
        _put(made.join(numbered.select("image_url", "faiss_id"), "image_url"), VECTORS, extra.vectors, batch)
    _index_batch(judged.sparkSession, table, batch, older.next_id)
    return judged


def add_batch(products: DataFrame, batch: int, table: str, dead_letters: str, check: Check = no_errors, extra: Extra = Extra(), broken: DataFrame | None = None) -> None:
    """Add products of one batch: the first of each URL, if the table lacks it; those that fail go to the dead letters.

    A product fails by the check or by the model, and each page of ``broken`` (page, bytes, error) as a whole. Rows get the
    keywords of their names, and vectors under the same ids. A batch owns one folder of each table and looks at older batches
    only, so running it again gives the same rows and ids. The URLs seen are the table itself and not stream state,
    which would grow without bound. Tables written on the way are deleted at the end.
    """
    spark = products.sparkSession
    with table_scope(spark):
        older = older_batches(spark, table, batch)
        first = write_table(ingest.one_per_url(products), "first")
        known = known_urls(first.select("image_url"), table, older)
        fresh = write_table(check(ingest.new_products(first, known)), "fresh")
        judged = _add(fresh, batch, older, table, extra)
        failed = judged.where("error IS NOT NULL")
        _put(failed if broken is None else failed.unionByName(broken, allowMissingColumns=True), FAILED, dead_letters, batch)
        if extra.status is not None:
            # One item of a URL is taken; its later copies are known by then.
            taken = judged.withColumn("status", F.when(F.col("error").isNull(), "ok").otherwise("failed"))
            again = products.select("page", "pos", "image_url").join(judged.select("page", "pos", "image_url"), ["page", "pos", "image_url"], "left_anti")
            told = taken.unionByName(again.withColumn("status", F.lit("skipped")), allowMissingColumns=True)
            if broken is not None:
                # A page whose number can't be read counts as page -1, since null stands for all pages in reports.
                told = told.unionByName(broken.withColumns({"page": F.coalesce("page", F.lit(-1)), "status": F.lit("failed")}), allowMissingColumns=True)
            _put(told, STATUS, extra.status, batch)


def sync_stream(spark: SparkSession, feed_dir: str, table: str, dead_letters: str, checkpoint: str, check: Check = no_errors, extra: Extra = Extra()) -> StreamingQuery:
    """Take all feed files not taken yet, then stop. Both tables must exist (``create_table``)."""
    pages = spark.readStream.schema(RAW_FEED).json(feed_dir)

    def add(batch_pages: DataFrame, batch: int) -> None:
        products = ingest.project_products(explode_feed(good_pages(batch_pages)))
        add_batch(products, batch, table, dead_letters, check, extra, malformed_pages(batch_pages))

    writer = pages.writeStream.foreachBatch(add)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def retry_failed(spark: SparkSession, table: str, dead_letters: str, check: Check = no_errors, apart: int | None = None) -> DataFrame:
    """Second pass over the dead letters whose URL the table still lacks: (image_url, ..., error), error null where it is good now.

    Rows of the batch ``apart`` don't count as known. Malformed pages have no URL and aren't tried again: the feed has to send
    them anew.
    """
    failed = read_rows(spark, dead_letters, FAILED).where("image_url IS NOT NULL")
    latest = failed.groupBy("image_url").agg(F.max_by(F.struct("product_name", "product_name_cn", "product_id", "category"), "batch").alias("p"))
    latest = write_table(latest.select("image_url", "p.*"), "latest")
    known = known_urls(latest.select("image_url"), table, older_batches(spark, table, apart=apart))
    return check(ingest.new_products(latest, known))


def add_retried(spark: SparkSession, table: str, dead_letters: str, check: Check = no_errors, extra: Extra = Extra(), attempt: int = 0) -> DataFrame:
    """Run the second pass and add what is good now, as batch -2 - attempt; returns (image_url, status, error) of all retried products.

    To be run while no stream runs, each time with the next ``attempt``; an attempt that is run again gives the same result.
    """
    batch = RETRY - attempt
    retried = write_table(retry_failed(spark, table, dead_letters, check, batch), "retried")
    judged = _add(retried, batch, older_batches(spark, table, apart=batch), table, extra)
    return judged.select("image_url", F.when(F.col("error").isNull(), "ok").otherwise("failed").alias("status"), "error")
