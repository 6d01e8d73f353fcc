"""Filters that tell which of many batches may hold a key: Bloom filters in blocks, made and asked by DataFrame functions.

A key belongs to one block of 32768 bits and sets `PROBES` bits of it. The blocks of a batch are rows, so no task and no
row holds a whole filter, and a key is asked of one block of each batch. At `BITS` bits a key about one in a million keys
that a batch lacks passes; a key that it has always does.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS, PROBES, BLOCK_BITS = 32, 12, 1 << 15
SCHEMA = "blocks int, block int, bits binary"


def blocks_for(n: int) -> int:
    """Number of blocks for ``n`` keys: a power of two, so that filters of many batches have few sizes."""
    return 1 << max(0, -(-n * BITS // BLOCK_BITS) - 1).bit_length()


def _block(key: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(1)), blocks).cast("int")


def _probe(key: Column, i: int) -> Column:
    """The i-th bit of a key: fifteen bits of a hash, of which each gives four."""
    h = F.xxhash64(key, F.lit(2 + i // 4))
    return F.shiftrightunsigned(h, 15 * (i % 4)).bitwiseAND(F.lit(BLOCK_BITS - 1))


def build_filter(keys: DataFrame, n: int) -> DataFrame:
    """(blocks, block, bits) of the first column of ``keys``, about ``n`` keys; null keys are left out."""
    key, blocks = F.col(keys.columns[0]), F.lit(blocks_for(n))
    rows = keys.where(key.isNotNull()).select(_block(key, blocks).alias("block"), F.explode(F.array(*[_probe(key, i) for i in range(PROBES)])).alias("bit"))
    made = rows.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits"))
    return made.select(blocks.cast("int").alias("blocks"), "block", "bits")


def _has(bits: Column, at: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (at % 8).cast("int")) == 1


def may_hold(keys: DataFrame, filters: DataFrame, sizes: list[int]) -> DataFrame:
    """(key, batch): which batches of ``filters`` (batch, blocks, block, bits) may hold each of the different keys of the first
    column of ``keys``. ``sizes`` are the numbers of blocks that occur."""
    name = keys.columns[0]
    asked = keys.select(F.col(name).alias("asked"), F.explode(F.array(*[F.lit(s).cast("int") for s in sizes])).alias("size"))
    asked = asked.withColumn("in_block", _block(F.col("asked"), F.col("size")))
    all_bits = reduce(lambda a, b: a & b, [_has(F.col("bits"), _probe(F.col("asked"), i)) for i in range(PROBES)])
    met = asked.join(filters, (F.col("size") == F.col("blocks")) & (F.col("in_block") == F.col("block")) & all_bits)
    return met.select(F.col("asked").alias(name), "batch")
