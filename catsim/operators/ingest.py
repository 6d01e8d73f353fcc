"""Product feeds: projection, de-duplication by URL, and the split into new and known products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catsim.functions import text

OTHER = "其他"
TEXTS = ("product_name", "product_name_cn", "product_id", "keywords_cn", "keywords_en")


def strip(text: str | Column) -> Column:
    """A text without white space at its ends, Unicode white space included."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def pick_category(tag: Column, category: Column) -> Column:
    """The first tag if it is not blank, else the category if it is not blank, else the default."""
    return F.left(F.coalesce(F.nullif(strip(tag), F.lit("")), F.nullif(strip(category), F.lit("")), F.lit(OTHER)), F.lit(50))


def project_products(items: DataFrame, en_len: int = 60) -> DataFrame:
    """Catalogue columns from feed items (page, pos, img, id, name, nameEn, tag, category); items without URL are dropped."""
    short = lambda c, n: F.left(strip(F.coalesce(c, F.lit(""))), F.lit(n))
    url = F.substring_index(F.coalesce("img", F.lit("")), "?", 1)
    made = items.select(
        "page",
        "pos",
        url.alias("image_url"),
        short("nameEn", en_len).alias("product_name"),
        short("name", 200).alias("product_name_cn"),
        F.coalesce(F.col("id").cast("string"), F.lit("")).alias("product_id"),
        pick_category(F.col("tag"), F.col("category")).alias("category"),
    )
    return made.where("image_url <> ''")


def one_per_url(products: DataFrame, last: bool = False) -> DataFrame:
    """The first product of each URL in feed order, or the last.

    An aggregate and no window: each task keeps one row of a URL before the shuffle, so a URL with very many copies is
    no burden. Rows of the same place are ordered by their other columns.
    """
    rest = [c for c in products.columns if c not in ("image_url", "page", "pos")]
    row = F.struct("page", "pos", *rest)
    best = products.groupBy("image_url").agg((F.max(row) if last else F.min(row)).alias("_row"))
    return best.select(*[F.col(c) if c == "image_url" else F.col("_row")[c].alias(c) for c in products.columns])


def new_products(products: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Products whose URL the catalogue does not have."""
    return products.join(catalogue.select("image_url"), "image_url", "left_anti")


def known_products(products: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Products whose URL the catalogue has."""
    return products.join(catalogue.select("image_url"), "image_url", "left_semi")


def needs_backfill() -> Column:
    """Whether a catalogue row lacks its English or its Chinese name."""
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    return blank("product_name") | blank("product_name_cn")


def backfill_names(catalogue: DataFrame, products: DataFrame) -> DataFrame:
    """The whole catalogue with ``status``: rows that lack a name take all five text columns of the product with their URL.

    status is updated, not_found (no product has the URL) or complete. ``products`` are feed products; of several with one
    URL the last counts.
    """
    new = one_per_url(products, last=True).select(
        "image_url",
        F.struct("product_name", "product_name_cn", "product_id", text.keywords_cn("product_name_cn").alias("keywords_cn"), text.keywords_en("product_name").alias("keywords_en")).alias("_new"),
    )
    needs = needs_backfill()
    taken = needs & F.col("_new").isNotNull()
    status = F.when(taken, "updated").when(needs, "not_found").otherwise("complete")
    joined = catalogue.join(new, "image_url", "left")
    return joined.withColumns({**{c: F.when(taken, F.col("_new")[c]).otherwise(F.col(c)) for c in TEXTS}, "status": status}).drop("_new")


def with_keywords(products: DataFrame) -> DataFrame:
    """Products with the keywords of both their names."""
    return products.withColumns({"keywords_cn": text.keywords_cn("product_name_cn"), "keywords_en": text.keywords_en("product_name")})


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    """Rows of each status."""
    return outcomes.groupBy("status").agg(F.count("*").alias("n"))


def both_passes(first: DataFrame, retried: DataFrame) -> DataFrame:
    """Outcomes of the first pass and of the second, told apart by ``attempt``; columns that one lacks are null."""
    return first.withColumn("attempt", F.lit(1)).unionByName(retried.withColumn("attempt", F.lit(2)), allowMissingColumns=True)
