"""Session helpers that every part of the package shares."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="spandrel-")) / f"spandrel_{os.getpid()}.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    ``spark.checkpoint.dir`` names it. Only where that is unset and the master
    is local (tests, a laptop) is a local folder made, and set for checkpoint()
    as well; elsewhere executors would not see each other's files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = getattr(spark.sparkContext, "_spandrel_root", None)
        if not root:
            master = spark.sparkContext.master
            if master != "local" and not master.startswith("local["):
                raise RuntimeError(f"spark.checkpoint.dir must name a folder that the driver and all executors share; the master is {master}")
            root = f"file://{tempfile.mkdtemp(prefix='spandrel-shared-')}"
            spark.sparkContext.setCheckpointDir(root)
            spark.sparkContext._spandrel_root = root
    return root.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses; it goes when the application ends."""
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    where, fs = _hadoop(spark, path)
    fs.deleteOnExit(where)
    return path


def _hadoop(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it again.

    It cuts the lineage with files that outlive any executor.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._spandrel_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Remove the files of frames that materialise() gave and that nothing reads any more."""
    for df in frames:
        where, fs = _hadoop(df.sparkSession, df._spandrel_path)
        fs.delete(where, True)


#: Bytes of an Arrow batch to a Python worker: its texts, their copies and what is made of them stay small.
BATCH_BYTES = 1 << 20


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_BYTES, or one row, in this session.

    Spark reads the setting when a frame runs, not when it is made, so it can't
    be put back here. A smaller bound stays; the number of rows is left alone.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).lower().removesuffix("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


#: Rows that Spark's Parquet reader holds at once. It keeps their texts in one array of the heap, which doubles as it grows.
READER_ROWS = 128


def bound_reader(spark: SparkSession) -> None:
    """Parquet batches of at most READER_ROWS in this session, for tables of long texts; a smaller bound stays."""
    name = "spark.sql.parquet.columnarReaderBatchSize"
    if int(spark.conf.get(name)) > READER_ROWS:
        spark.conf.set(name, str(READER_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
