"""What the operators share: written tables, Arrow batches of bounded size, bounded samples and free column names."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catsim.sources.shared import drop_table, shared_dir, table_scope, write_table

__all__ = ["bounded", "bounded_sample", "column", "doc_type", "drop_table", "free_name", "id_and_text", "shared_dir", "table_scope", "write_table"]

#: Rows and bytes of text that an operator handles at once; a single longer text comes alone.
SLICE_ROWS, SLICE_BYTES = 2000, 4 << 20


def bounded(batches: Iterator[pa.RecordBatch], text: int = 1, rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices of at most ``rows`` rows and about ``size`` bytes in column number ``text``.

    So the memory of a task doesn't hang on the session's Arrow settings.
    """
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        first = held = 0
        for i, n in enumerate(lengths):
            if i > first and (i - first >= rows or held + n > size):
                yield batch.slice(first, i - first)
                first, held = i, 0
            held += n
        if len(lengths) > first:
            yield batch.slice(first)


def column(name: str) -> Column:
    """A column by its whole name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(stem: str, *taken: DataFrame) -> str:
    """``stem``, with as many underscores before it as keep it apart from the columns of ``taken`` (case ignored)."""
    names = {c.lower() for df in taken for c in df.columns}
    while stem.lower() in names:
        stem = "_" + stem
    return stem


def doc_type(docs: DataFrame) -> str:
    """The type of doc_id, which results keep; ids of a type that can't be compared are not supported."""
    return docs.schema["doc_id"].dataType.simpleString()


def id_and_text(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with doc_id as it is and text as a string."""
    return docs.select("doc_id", F.col("text").cast("string").alias("text"))


def bounded_sample(rows: DataFrame, key: list[str], n: int, seed: int = 0) -> DataFrame:
    """At most ``n`` rows, those of the least hash of the columns ``key``; rows that agree in all of them count once.

    The result is a written table. It doesn't hang on the partitioning, and however many equal rows there are, they neither
    fill nor thin the sample: the number of different hashes is estimated first, and rows below a threshold that lets about
    twice as many as are wanted through are kept once each. Should the estimate have been too high, the threshold rises.
    """
    draw = free_name("draw", rows)
    number = F.shiftrightunsigned(F.xxhash64(*key, F.lit(seed)), 11) * F.lit(2.0**-53)
    share = min(1.0, (2 * n + 64) / max(rows.select(F.approx_count_distinct(number, 0.02)).first()[0], 1))
    while True:
        some = rows.withColumn(draw, number).where(F.col(draw) <= share).dropDuplicates([draw])
        kept = write_table(some.orderBy(draw).limit(n).drop(draw), "sample")
        if share >= 1 or kept.count() >= n:
            return kept
        drop_table(kept)
        share = min(1.0, 4 * share)
