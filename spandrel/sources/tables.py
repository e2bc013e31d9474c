"""Tables from anything that holds one."""

from __future__ import annotations

import os
from typing import Any

from pyspark.sql import DataFrame, SparkSession

_READERS = {".parquet": "parquet", ".orc": "orc", ".json": "json", ".jsonl": "json", ".ndjson": "json", ".csv": "csv"}


def as_dataframe(source: Any, spark: SparkSession | None = None) -> DataFrame:
    """A frame as it is; a path by its ending; another str as a catalog table; Arrow (by its protocol) and pandas objects as local tables."""
    if isinstance(source, DataFrame):
        return source
    spark = spark or SparkSession.active()
    if isinstance(source, str | os.PathLike):
        name = os.fspath(source)
        ending = os.path.splitext(name.rstrip("/"))[1].lower()
        if ending in _READERS:
            reader = spark.read
            if ending == ".csv":
                reader = reader.option("header", True).option("inferSchema", True)
            return reader.format(_READERS[ending]).load(name)
        return spark.read.parquet(name) if "/" in name else spark.table(name)
    if hasattr(source, "__arrow_c_stream__") or hasattr(source, "__arrow_c_array__"):
        return spark.createDataFrame(signed(arrow_table(source)))
    if type(source).__module__.startswith("pandas"):
        return spark.createDataFrame(source)
    raise TypeError(f"{type(source).__name__} has neither __arrow_c_stream__ nor __arrow_c_array__")


def arrow_table(source: Any):
    import pyarrow as pa

    if hasattr(source, "__arrow_c_stream__"):
        return pa.table(source)
    return pa.Table.from_batches([pa.record_batch(source)])


def signed(table):
    """Unsigned columns as the next wider signed ones, dictionaries and views decoded: Spark has neither."""
    import pyarrow as pa

    wider = {pa.uint8(): pa.int16(), pa.uint16(): pa.int32(), pa.uint32(): pa.int64(), pa.uint64(): pa.decimal128(20, 0), pa.float16(): pa.float32(), pa.string_view(): pa.string(), pa.binary_view(): pa.binary()}
    fields = []
    for f in table.schema:
        t = f.type.value_type if pa.types.is_dictionary(f.type) else f.type
        fields.append(f.with_type(wider.get(t, t)))
    return table.cast(pa.schema(fields))


def from_rows(spark: SparkSession, rows: list, schema) -> DataFrame:
    return spark.createDataFrame(rows, schema)
