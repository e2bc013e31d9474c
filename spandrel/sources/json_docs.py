"""JSON documents from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_document(path: str) -> str:
    """One file as one JSON text."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def document_pairs(spark: SparkSession, left: str, right: str) -> DataFrame:
    """(name, a_json, b_json): files of two folders with the same names; null where one side has none."""

    def side(path: str, column: str) -> DataFrame:
        files = spark.read.text(path, wholetext=True)
        return files.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), F.col("value").alias(column))

    return side(left, "a_json").join(side(right, "b_json"), "name", "full_outer")
