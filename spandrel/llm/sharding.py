"""Sharding by a two-pass external shuffle, in DataFrame operations only.

Pass one scatters the records uniformly over buckets by a seeded hash of key
and text; the number of buckets follows from the bytes of all texts, so that
one bucket fits in a task's memory, and each bucket has a partition of its
own. Pass two takes a bucket at a time, puts its records into an order of
their own, shuffles that list by Fisher-Yates (Spark's ``shuffle`` with a
seed), deals positions and writes them: a record's place in the whole is the
records of earlier buckets plus its place in its bucket. Shard s of S holds
places floor(s*n/S) to floor((s+1)*n/S), so counts differ by one at most (law
``rows``) and a bucket is written to one or two shards without another
exchange.

Equal seeds, rows and bucket sizes give equal shards, whatever the partitions
of the input, so a task that runs again repeats its rows. Copies of a text
differ in their keys and scatter. Rows equal in both key and text share a
bucket; a bucket that they fill beyond OVERFULL times its size is scattered
again, once, by the rows' places in the input, and written with them.

A null text has no bytes; a null key is hashed as such. An empty table gives an
empty result. A column of the input named like an added one is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spandrel.runtime import materialise

#: Bytes that a record counts besides its text.
RECORD_BYTES = 16
#: Times its size that a bucket may have.
OVERFULL = 4
#: Buckets that are summed up at a time.
_BLOCK = 4096


def record_size(text_col: str):
    return F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long") + RECORD_BYTES


def _bases(counts: DataFrame) -> DataFrame:
    """(__b, __base): the records of the buckets before each; block by block, so that no task has all buckets."""
    counts = counts.withColumn("block", F.expr(f"__b div {_BLOCK}"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    blocks = counts.groupBy("block").agg(F.sum("n").alias("n"))  # one row for _BLOCK buckets
    blocks = blocks.select("block", F.coalesce(F.sum("n").over(before(Window.orderBy("block"))), F.lit(0)).alias("base"))
    inside = counts.withColumn("inside", F.coalesce(F.sum("n").over(before(Window.partitionBy("block").orderBy("__b"))), F.lit(0)))
    return inside.join(blocks, "block").select("__b", (F.col("base") + F.col("inside")).alias("__base"))


def shard(docs: DataFrame, n_shards: int, seed: int = 20240607, key: str = "doc_id", text_col: str = "text", bucket_bytes: int = 24 << 20) -> DataFrame:
    """``docs`` with law, shard and slot; slot is gapless from 0 within a shard."""
    docs = docs.drop("law", "shard", "slot")
    columns = docs.columns
    whole = docs.agg(F.coalesce(F.sum(record_size(text_col)), F.lit(0)).alias("bytes"), F.count("*").alias("n")).first()
    n_buckets, n = int(max(1, -(-whole["bytes"] // bucket_bytes))), whole["n"]
    place = F.pmod(F.xxhash64(F.lit(seed), F.col(key), F.col(text_col)), F.lit(n_buckets)).cast("int")
    bucketed = docs.withColumn("__bucket", place)
    sums = lambda df: df.groupBy(F.col("__bucket").alias("__b")).agg(F.count("*").alias("n"), F.sum(record_size(text_col)).alias("bytes"))
    counts = materialise(sums(bucketed), "buckets")
    # A row or two more than fit are no reason; at most n_buckets / OVERFULL numbers.
    full = counts.where((F.col("bytes") > OVERFULL * bucket_bytes) & (F.col("n") > 1)).select(F.col("__b").alias("__full"))
    if n_buckets > 1 and not full.isEmpty():
        again = F.pmod(F.xxhash64(F.lit(seed), F.monotonically_increasing_id()), F.lit(n_buckets)).cast("int")
        is_full = F.col("__bucket") == F.col("__full")
        # Written, so that every later reading has the same places.
        moved = materialise(bucketed.join(full, is_full, "left_semi").withColumn("__bucket", again), "moved")
        bucketed = bucketed.join(full, is_full, "left_anti").unionByName(moved)
        counts = materialise(sums(bucketed), "buckets")
    order = [F.col(key).asc_nulls_first(), F.xxhash64(F.col(text_col)).asc()]
    record = F.struct(*[F.col(f"`{c}`") for c in columns])
    lists = bucketed.repartitionById(n_buckets, "__bucket").sortWithinPartitions("__bucket", *order).groupBy("__bucket").agg(F.collect_list(record).alias("__list"))
    dealt = lists.select("__bucket", F.posexplode(F.shuffle("__list", seed)).alias("__at", "__row"))
    # The shard whose range holds the place, and the range's start.
    number = F.expr(f"({n_shards}L * __place + {n_shards - 1}L) div {max(n, 1)}L")
    start = F.expr(f"(__shard * {n}L) div {n_shards}L")
    return (
        # n_buckets rows of two numbers; Spark picks the join by their size.
        dealt.join(_bases(counts), F.col("__bucket") == F.col("__b"))
        .withColumn("__place", F.col("__base") + F.col("__at"))
        .withColumn("__shard", number)
        .select("__row.*", F.lit("rows").alias("law"), F.col("__shard").cast("int").alias("shard"), (F.col("__place") - start).alias("slot"))
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder a shard; rows carry their slots."""
    sharded.write.partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The rows of all shards, with the columns of ``like``, which was written."""
    return spark.read.schema(like.schema).parquet(path).select(*[f"`{c}`" for c in like.columns])
