"""Joins whose keys may be hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WAYS = 16


def spread_join(many: DataFrame, one: DataFrame, on: list[str], by: str, how: str = "inner", ways: int = WAYS) -> DataFrame:
    """Join on the columns ``on``, where one key may hold very many rows of ``many``: they are dealt ``ways`` ways by ``by``.

    The rows of ``one``, few for each key, are repeated for every way.
    """
    way = "way"
    while way in {c.lower() for c in (*many.columns, *one.columns)}:
        way = "_" + way
    left = many.withColumn(way, F.pmod(F.xxhash64(by), F.lit(ways)).cast("int"))
    return left.join(one.withColumn(way, F.explode(F.sequence(F.lit(0), F.lit(ways - 1)))), [*on, way], how).drop(way)
