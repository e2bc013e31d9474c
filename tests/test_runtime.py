"""Shared files and session settings."""

import os

import pytest

from spandrel import runtime


def test_files_go(spark):
    df = runtime.materialise(spark.range(5).toDF("x"), "some")
    path = df._spandrel_path.removeprefix("file://")
    assert os.path.isdir(path) and df.count() == 5
    runtime.discard(df)
    assert not os.path.exists(path)


def test_no_local_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = {}, Context()

    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        runtime.shared_root(Session())


def test_batch_bytes(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    runtime.bound_batches(spark)
    assert spark.conf.get(name) == str(runtime.BATCH_BYTES)
    spark.conf.set(name, "1000")
    runtime.bound_batches(spark)
    assert spark.conf.get(name) == "1000"
    spark.conf.set(name, before)


def test_reader_rows(spark):
    name = "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(name)
    runtime.bound_reader(spark)
    assert spark.conf.get(name) == str(runtime.READER_ROWS)
    spark.conf.set(name, "100")
    runtime.bound_reader(spark)
    assert spark.conf.get(name) == "100"
    spark.conf.set(name, before)
