"""A stream of full snapshots, each compared with the one before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spandrel.operators.table_diff import TableDiff, diff_tables
from spandrel.runtime import _hadoop


def _kept(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the whole snapshots in a folder."""
    where, fs = _hadoop(spark, path)
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    return sorted(int(n) for n in names if n.isdigit() and fs.exists(_hadoop(spark, f"{path}/{n}/_SUCCESS")[0]))


def snapshot_differ(key: list[str], handle: Callable[[int, TableDiff], None], path: str) -> Callable[[DataFrame, int], None]:
    """For ``writeStream.foreachBatch``: calls ``handle(batch, diff)`` from the second batch on.

    A snapshot is written to ``path``/batch, in a folder that outlives the
    application, as the stream's own checkpoint does. A batch is compared with
    the last one before it, so a batch that runs again, or the first one after a
    restart, gets the same comparison. The last two snapshots are kept.
    """

    def on_batch(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        here = f"{path.rstrip('/')}/{number}"
        batch.write.mode("overwrite").parquet(here)
        before = [n for n in _kept(spark, path) if n < number]
        read = lambda n: spark.read.parquet(f"{path.rstrip('/')}/{n}")
        if before:
            handle(number, diff_tables(read(before[-1]), read(number), key=key))
        for n in before[:-1]:
            old, fs = _hadoop(spark, f"{path.rstrip('/')}/{n}")
            fs.delete(old, True)

    return on_batch
