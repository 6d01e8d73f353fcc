"""Sums of arrays by key, without a row for each element."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that a task holds sums of; beyond that it hands them on and begins again.
HELD_KEYS = 4096


class _Sums:
    """Running sums and counts of arrays by key."""

    def __init__(self, key_type: pa.DataType) -> None:
        self.key_type = key_type
        self.held: dict[object, list] = {}

    def add(self, keys: pa.Array, counts: np.ndarray, lists: pa.Array) -> None:
        if not len(keys):
            return
        coded = keys.dictionary_encode(null_encoding="encode")
        codes = coded.indices.to_numpy()
        sizes = np.unique(pc.list_value_length(lists).to_numpy())
        if len(sizes) > 1:
            raise ValueError("arrays to be summed differ in length")
        values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
        order = np.argsort(codes, kind="stable")
        first = np.flatnonzero(np.diff(codes[order], prepend=-1))
        sums = np.add.reduceat(values[order], first, axis=0)
        n = np.add.reduceat(counts[order], first)
        names = coded.dictionary.to_pylist()
        for code, total, count in zip(codes[order][first].tolist(), sums, n.tolist(), strict=True):
            known = self.held.setdefault(names[code], [0, 0.0])
            known[0] += count
            known[1] = known[1] + total

    def batch(self) -> pa.RecordBatch:
        keys = pa.array(list(self.held), self.key_type)
        n = pa.array([c for c, _ in self.held.values()], pa.int64())
        sums = pa.array([s.tolist() for _, s in self.held.values()], pa.list_(pa.float64()))
        self.held = {}
        return pa.RecordBatch.from_arrays([keys, n, sums], ["key", "n", "sum"])


def array_sums(rows: DataFrame, key: str, values: str) -> DataFrame:
    """(key, n, sum): for each value of the column ``key``, null among them, how many arrays there are and their sum by position.

    A task adds its arrays up and hands on one row for each key; these rows are dealt by the key and added up as they come,
    so what is shuffled are keys times tasks, and no task holds the rows of a key. Rows without an array are left out; all
    arrays have the same length.
    """
    some = rows.where(F.col(values).isNotNull()).select(F.col(key).alias("key"), F.lit(1).cast("long").alias("n"), F.col(values).cast("array<double>").alias("sum"))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for batch in batches:
            sums = _Sums(batch.schema.field(0).type) if sums is None else sums
            sums.add(batch.column(0), batch.column(1).to_numpy(), batch.column(2))
            if len(sums.held) > HELD_KEYS:
                yield sums.batch()
        if sums is not None and sums.held:
            yield sums.batch()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in the order of their keys, so a key is done when the next one begins."""
        sums = None
        for batch in batches:
            sums = _Sums(batch.schema.field(0).type) if sums is None else sums
            sums.add(batch.column(0), batch.column(1).to_numpy(), batch.column(2))
            last = batch.column(0)[-1].as_py() if len(batch) else None
            if len(batch) and len(sums.held) > 1:
                open_sum = sums.held.pop(last)
                yield sums.batch()
                sums.held[last] = open_sum
        if sums is not None and sums.held:
            yield sums.batch()

    schema = some.schema.simpleString().removeprefix("struct<").removesuffix(">")
    parts = some.mapInArrow(add_up, schema)
    return parts.repartition("key").sortWithinPartitions("key").mapInArrow(merge, schema).withColumnRenamed("key", key)
