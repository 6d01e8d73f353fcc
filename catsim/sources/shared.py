"""Tables that a job writes between its steps, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Folders of the open scopes, the innermost last. Each thread has its own, so jobs in several threads don't meet.
_SCOPES: ContextVar[tuple[str, ...]] = ContextVar("scopes", default=())


def shared_dir(spark: SparkSession) -> str:
    """A new folder for a job: inside the present `table_scope`, or else below ``spark.checkpoint.dir``.

    Where the setting is empty, a local master gets a temporary folder; any other master is an error, because a
    machine's own folder is not seen by the other machines.
    """
    scopes = _SCOPES.get()
    root = scopes[-1] if scopes else spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='catsim-')}"
    return f"{root.rstrip('/')}/catsim-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def table_scope(spark: SparkSession) -> Iterator[str]:
    """All tables that jobs write inside are deleted at the end: write or collect a job's result before that."""
    root = shared_dir(spark)
    outer = _SCOPES.set((*_SCOPES.get(), root))
    try:
        yield root
    finally:
        _SCOPES.reset(outer)
        _delete(spark, root)


def write_table(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` once and read it back: lineage ends here, and a lost executor costs no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_table(table: DataFrame) -> None:
    """Delete a table of `write_table` that nothing reads any more."""
    for folder in {file.rpartition("/")[0] for file in table.inputFiles()}:
        _delete(table.sparkSession, folder)
