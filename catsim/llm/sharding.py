"""Shards of a reproducible shuffle: a Feistel permutation of global row numbers.

Rows are numbered 0 to n - 1 in the order of doc_id and text, and the permutation sends a number to its place in the
shuffled order: shard = place mod shards, slot = place div shards. So shard counts differ by one row at most, slots have no
gaps, and both are computed from a row's number, the number of rows and the seed alone; `Shuffle.number` goes back from a
place to the row. Equal texts are spread like any other rows. DataFrame functions only.

The permutation works on pairs (left, right) with left < a and right < b, where a * b is the least such product of
a = ceil(sqrt(n)) that reaches n. Fewer than a numbers lie outside 0 to n - 1; a place among them is walked on along its
cycle until it falls inside.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catsim.llm.crc_sql import TABLE, crc32
from catsim.llm.storage import column, free_name
from catsim.operators.ids import allocate_ids

SHARDS = 24
ROUNDS = 8
_MASK = (1 << 31) - 1
#: Odd multipliers below 2**31, so that products stay below 2**62.
_MULTIPLIERS = (1597334677, 747796405)


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b))


@dataclass(frozen=True)
class Shuffle:
    """The permutation of 0 to n - 1 of a seed; ``steps`` walks are enough for every number (see `shuffle_of`)."""

    n: int
    seed: int
    steps: int = 1

    @property
    def sides(self) -> tuple[int, int]:
        a = max(1, math.isqrt(max(self.n - 1, 0)) + 1)
        return a, max(1, -(-self.n // a))

    def _rounds(self) -> list[tuple[int, int]]:
        """Key and modulus of each round; the moduli take turns because the halves do."""
        keys = [int(hashlib.sha256(f"{self.seed}:{i}".encode()).hexdigest()[:8], 16) & _MASK for i in range(ROUNDS)]
        return [(key, self.sides[i % 2]) for i, key in enumerate(keys)]

    @staticmethod
    def _noise(half: Column, key: Column) -> Column:
        x = half.bitwiseXOR(key)
        for multiplier, shift in zip(_MULTIPLIERS, (15, 13), strict=True):
            x = (x * F.lit(multiplier)).bitwiseAND(F.lit(_MASK))
            x = x.bitwiseXOR(F.shiftright(x, shift))
        return x

    def _once(self, number: Column, back: bool) -> Column:
        a, _ = self.sides
        rounds = F.array(*[F.struct(F.lit(k).cast("long").alias("key"), F.lit(m).cast("long").alias("of")) for k, m in self._rounds()[:: -1 if back else 1]])
        start = F.struct((number % a).alias("left"), _div(number, a).alias("right"))

        def forward(s: Column, r: Column) -> Column:
            return F.struct(s["right"].alias("left"), ((s["left"] + self._noise(s["right"], r["key"])) % r["of"]).alias("right"))

        def backward(s: Column, r: Column) -> Column:
            return F.struct(F.pmod(s["right"] - self._noise(s["left"], r["key"]), r["of"]).alias("left"), s["left"].alias("right"))

        return F.aggregate(rounds, start, backward if back else forward, lambda s: s["right"] * F.lit(a) + s["left"])

    def _walk(self, number: str | Column, back: bool) -> Column:
        number = (F.col(number) if isinstance(number, str) else number).cast("long")
        first = self._once(number, back)
        return first if self.steps < 2 else F.aggregate(F.sequence(F.lit(2), F.lit(self.steps)), first, lambda x, _: F.when(x >= self.n, self._once(x, back)).otherwise(x))

    def place(self, number: str | Column) -> Column:
        """Where row ``number`` comes in the shuffled order."""
        return self._walk(number, False)

    def number(self, place: str | Column) -> Column:
        """Which row comes at ``place`` of the shuffled order: slot * shards + shard."""
        return self._walk(place, True)


def shuffle_of(spark: SparkSession, n: int, seed: int = 0) -> Shuffle:
    """The permutation of 0 to n - 1, with as many walks as the longest one needs.

    A walk of more than one step goes through numbers from n on. There are fewer than sqrt(n) + 1 of them, so following all
    of them in a small Spark job tells how many steps are enough, forward and back.
    """
    made = Shuffle(n, seed)
    a, b = made.sides
    steps = 4
    while 0 < n < a * b:
        made = Shuffle(n, seed, steps)
        if spark.range(n, a * b).where((made.place("id") >= n) | (made.number("id") >= n)).isEmpty():
            return Shuffle(n, seed, steps + 1)
        steps *= 2
    return made


def _assign(docs: DataFrame, kept: list[Column], shard: str, slot: str, shards: int, seed: int) -> DataFrame:
    """The columns ``kept`` of ``docs`` with shard and slot."""
    # Rows that agree in id and text are dealt by their place in the input, so that no task gets all of them.
    rows = docs.select(F.struct(*kept).alias("doc"), F.col("doc_id").alias("id"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")).alias("digest"), F.monotonically_increasing_id().alias("copy"))
    numbered = allocate_ids(rows, ["id", "digest", "copy"], id_column="number")
    place = shuffle_of(docs.sparkSession, numbered.count(), seed).place("number")
    placed = numbered.select("doc", place.alias("place"))
    return placed.select("doc.*", (F.col("place") % shards).cast("int").alias(shard), _div(F.col("place"), shards).alias(slot))


def assign_shards(docs: DataFrame, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, more) with ``shard`` and ``slot``, which get underscores before them where docs has them.

    Null ids come first in the numbering and a null text counts as empty. Rows that share id and text get neighbouring
    numbers, in any order: if they differ in other columns, which of them has which number may change with the input's
    layout. Very long texts are rows like any other, and an empty table gives no rows.
    """
    return _assign(docs, [column(c) for c in docs.columns], free_name("shard", docs), free_name("slot", docs), shards, seed)


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = 0) -> None:
    """Write the rows of `assign_shards` as Parquet, a folder for each shard, in the order of their slots."""
    made = assign_shards(docs, shards, seed)
    shard, slot = made.columns[-2:]
    made.repartitionByRange(shard, slot).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)


def shard_digests(docs: DataFrame, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of each row, placed as `assign_shards` places it."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kept = [F.col("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")]
    placed = _assign(docs, kept, "shard", "slot", shards, seed)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _sql() -> str:
    noise = "xor(s[2], k[1])"
    for multiplier, shift in ((1597334677, 15), (747796405, 13)):
        noise = f"list_transform([({noise} * {multiplier}) & 2147483647], lambda x: xor(x, x >> {shift}))[1]"
    keys = ", ".join(f"[('0x' || sha256('0:{i}')[1:8])::BIGINT & 2147483647, {'ab'[i % 2]}]" for i in range(8))
    once = f"list_transform([list_reduce(list_prepend([p % a, p // a], [{keys}]), lambda s, k: [s[2], (s[1] + {noise}) % k[2]])], lambda s: s[2] * a + s[1])[1]"
    return f"""
WITH RECURSIVE {TABLE}, numbered AS (
    SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size, {crc32("coalesce(text, '')")} AS text_crc32,
        row_number() OVER (ORDER BY doc_id NULLS FIRST, md5(coalesce(text, ''))) - 1 AS p, count(*) OVER () AS n
    FROM documents, crc
), sides AS (
    SELECT *, ceil(sqrt(n))::BIGINT AS a, ceil(n / ceil(sqrt(n)))::BIGINT AS b FROM numbered
), walk AS (
    SELECT doc_id, size, text_crc32, n, a, b, {once} AS p FROM sides
    UNION ALL
    SELECT doc_id, size, text_crc32, n, a, b, {once} AS p FROM walk WHERE p >= n
)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, (p % 24)::INT AS shard, p // 24 AS slot, NULL::INT AS grown_shard FROM walk WHERE p < n
"""


ORACLE_SQL = _sql()
