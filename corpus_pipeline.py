"""A corpus pipeline of four stages; each is written and read again by the next.

toxicity drops the documents that the classifier rejects; near_duplicates
keeps one document of each group; decontamination drops documents that hold a
benchmark item; packing returns the packed pieces of all that are left.

Rows are told apart by doc_id and text, so rows without a doc_id and rows that
share one are judged each. Of a group of near duplicates the smallest doc_id
stays, and one without a doc_id only if the whole group has none; of rows equal
in doc_id and text any one stays. Rows without words are no near duplicates.
Null and empty texts pass every stage. An empty table passes through all
stages. Columns besides those of documents are left out by the first stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.llm import decontamination as leaks
from spandrel.llm import jaccard_join, packing
from spandrel.llm import toxicity as toxic
from spandrel.llm.queries import END_BYTE_BPE, toxicity_model
from spandrel.runtime import bound_batches, materialise, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score below 0.5."""
    bound_batches(spark)
    scored = toxic.score(docs, toxicity_model(spark, docs, sf_dir), keep=COLUMNS)
    return scored.where("score < 0.5").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group."""
    bound_batches(spark)
    return jaccard_join.one_of_each(docs).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    bound_batches(spark)
    named = docs.withColumn("__row", jaccard_join.row_name("doc_id", "text"))
    found = leaks.contaminated(named, table(spark, sf_dir, "benchmark"), key=("doc_id", "__row"))
    held = found.select(F.col("doc_id").alias("__id"), F.col("__row").alias("__name")).distinct()
    return named.join(held, (F.col("__row") == F.col("__name")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left_anti").select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents, with a checksum of each piece's ids."""
    bound_batches(spark)
    packed = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), END_BYTE_BPE)
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("best_fit_packing", best_fit_packing)]

#: No stage can be said in SQL; tests compare them with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, f"pipeline-{name}")
    return docs
