"""Catalogue, vector and feed tables: schemas, readers, writers, defaults and additive migration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catsim.operators.ingest import OTHER, TEXTS, strip


def _schema(**types: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in types.items()])


_LONG, _INT, _TEXT, _FLOATS = T.LongType(), T.IntegerType(), T.StringType(), T.ArrayType(T.FloatType())
_NAME = _schema(nameEn=_TEXT)
# Types are objects and not DDL, so that the module can be imported before there is a session.
CATALOGUE = _schema(
    id=_LONG, faiss_id=_LONG, image_url=_TEXT, category=_TEXT, product_name=_TEXT, product_name_cn=_TEXT, product_id=_TEXT,
    keywords_cn=_TEXT, keywords_en=_TEXT, file_size=_LONG, width=_INT, height=_INT, create_time=T.TimestampType(),
)
VECTORS = _schema(faiss_id=_LONG, coarse=_FLOATS, fine=_FLOATS)
ITEM = _schema(id=_TEXT, img=_TEXT, name=_TEXT, nameEn=_TEXT, tags=T.ArrayType(_NAME), category=_NAME)
FEED = _schema(page=_LONG, items=T.ArrayType(ITEM))
#: Pages as they are read: one that is no page, cut off for instance, is kept as it is in ``_corrupt_record``.
RAW_FEED = _schema(page=_LONG, items=T.ArrayType(ITEM), _corrupt_record=_TEXT)
MANIFEST = ("files", "image_urls", "product_names", "product_names_cn", "product_ids", "keywords_cn_list", "keywords_en_list")
NUMBERS = ("file_size", "width", "height")


def explode_feed(pages: DataFrame) -> DataFrame:
    """Feed items (page, pos, img, id, name, nameEn, tag, category) from pages; pos is the place on the page."""
    items = pages.select("page", F.posexplode("items").alias("pos", "item"))
    tag = F.get("item.tags", F.lit(0))["nameEn"]
    return items.select("page", F.col("pos").cast("long").alias("pos"), "item.img", "item.id", "item.name", "item.nameEn", tag.alias("tag"), F.col("item.category.nameEn").alias("category"))


def good_pages(pages: DataFrame) -> DataFrame:
    """Pages (page, items) of a feed read by `RAW_FEED` that are pages."""
    return pages.where("_corrupt_record IS NULL").select("page", "items")


def malformed_pages(pages: DataFrame) -> DataFrame:
    """(page, bytes, error) of those that are not; page is the number that the text gives first, or null."""
    # The other columns are named too, because Spark reads no file for this column alone.
    broken = pages.select("page", "items", "_corrupt_record").where("_corrupt_record IS NOT NULL")
    error = F.concat(F.lit("malformed page: "), F.left("_corrupt_record", F.lit(200)))
    # What the parser makes of a broken page hangs on where it broke off, so the number is taken from the text.
    number = F.regexp_extract("_corrupt_record", r'"page"\s*:\s*(\d{1,18})\b', 1)
    return broken.select(F.nullif(number, F.lit("")).cast("long").alias("page"), F.octet_length("_corrupt_record").cast("long").alias("bytes"), error.alias("error"))


def read_feed_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages of a feed, for `good_pages` and `malformed_pages`."""
    return spark.read.schema(RAW_FEED).json(path)


def read_product_feed(spark: SparkSession, path: str) -> DataFrame:
    """Feed items from JSON pages; missing fields are null, and malformed pages have none."""
    return explode_feed(good_pages(read_feed_pages(spark, path)))


def read_catalogue(spark: SparkSession, path: str, category: str | None = None, ordered: bool = False) -> DataFrame:
    """Catalogue rows, of one category if it is given and not empty, and in the order of their ids if asked."""
    rows = spark.read.schema(CATALOGUE).parquet(path)
    rows = rows.where(F.col("category") == category) if category else rows
    return rows.orderBy("id") if ordered else rows


def append_catalogue(rows: DataFrame, path: str) -> None:
    """Add rows to a catalogue."""
    migrate_catalogue(rows).write.mode("append").parquet(path)


def write_vectors(vectors: DataFrame, path: str) -> None:
    """Write vectors in the order of their ids, so that row groups hold narrow id ranges."""
    vectors.select(*VECTORS.names).repartitionByRange("faiss_id").sortWithinPartitions("faiss_id").write.mode("overwrite").parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Vectors; a store that does not exist yet is empty."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
    return spark.read.schema(VECTORS).parquet(path) if there else spark.createDataFrame([], VECTORS)


def insert_defaults(rows: DataFrame) -> DataFrame:
    """Texts that are null become empty, a blank category the default one, and the product id a string."""
    filled: dict[str, Column] = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in TEXTS}
    filled["category"] = F.coalesce(F.nullif(strip("category"), F.lit("")), F.lit(OTHER))
    return rows.withColumns(filled)


def explode_manifest(manifests: DataFrame) -> DataFrame:
    """Rows to insert from manifests: JSON lists that belong together by position, and one category.

    A short list gives empty texts, a missing URL the file's name; places without a file name are left out and still count.
    Other columns of a manifest stay.
    """
    lists = manifests.withColumns({c: F.from_json(F.coalesce(c, F.lit("[]")), "array<string>") for c in MANIFEST})
    rows = lists.select("*", F.posexplode("files").alias("pos", "file_name")).where(F.coalesce("file_name", F.lit("")) != "")
    at = lambda c: F.get(c, F.col("pos"))
    named = dict(zip(TEXTS, MANIFEST[2:], strict=True))
    url = F.coalesce(at("image_urls"), F.col("file_name"))
    return insert_defaults(rows.withColumns({**{to: at(c) for to, c in named.items()}, "image_url": url})).drop(*MANIFEST)


def migrate_catalogue(rows: DataFrame) -> DataFrame:
    """Rows of an older catalogue with all columns of the present one; new texts are empty and new numbers 0."""
    whole = rows.sparkSession.createDataFrame([], CATALOGUE).unionByName(rows, allowMissingColumns=True)
    numbers = {c: F.coalesce(c, F.lit(0)).cast(CATALOGUE[c].dataType) for c in NUMBERS}
    return insert_defaults(whole).withColumns(numbers).select(*CATALOGUE.names)
