"""Token ids in word-aligned files (Simple-8b), written and read by Spark.

A 64-bit word holds a selector in its top 4 bits and, for selector s, COUNTS[s]
ids of BITS[s] bits each, the first lowest. Selector 0 is the escape: the next
word is one id of up to 64 bits, which nothing in its own word could hold.
The greedy choice takes the most ids that fit.

A file is Parquet, so writing commits whole files through any store Spark
knows, and a lost executor costs one task again. A row is a group of whole
documents in order: their keys and lengths, the packed words, and the offset
of every block of BLOCK_IDS ids in words, so that blocks decode on their own
and all at once. Rows carry their task's number and their first id's place in
the task; places in the whole are the sums over earlier tasks, one number a
task.

Documents go by ascending key through one range exchange. Rows with a null key
come first, ties go by text; rows of one key are one range, so one task writes
them. A null text is the end id alone. An empty table
gives no files' rows and an empty result. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spandrel.runtime import ship

from . import token_ids

#: The layout of the words by selector, from 1 on. Fixed values of the format.
COUNTS = (1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = (0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
BLOCK_IDS = 8192
GROUP_IDS = 1 << 18
#: A row is up to a page; Parquet else looks at a page's size after 100 rows, and holds tens of MB for each.
PAGES = {"parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1", "parquet.enable.dictionary": "false"}


#: The class of each small value: the selector of the narrowest field that holds it.
_CLASS = np.searchsorted(np.array([2**b for b in BITS[1:]], np.uint64), np.arange(1 << 16, dtype=np.uint64), side="right").astype(np.uint8) + 1


def _classes(values: np.ndarray) -> np.ndarray:
    """The narrowest selector for each value; 15 where none holds it."""
    if not len(values) or values.max() < 1 << 16:
        return _CLASS[values]
    return (np.searchsorted(np.array([2**b for b in BITS[1:]], np.uint64), values, side="right") + 1).astype(np.uint8)


def _block(values: np.ndarray) -> np.ndarray:
    """The words of one block."""
    n = len(values)
    high = np.concatenate([_classes(values), np.ones(COUNTS[1], np.uint8)])
    best, span = np.zeros(n, np.uint8), 1
    # high[i] is the class of the widest of ``span`` values from i on; counts ascend.
    for s in range(14, 0, -1):
        while span < COUNTS[s]:
            step = min(span, COUNTS[s] - span)
            high = np.maximum(high[:-step], high[step:])
            span += step
        fits = high[:n] <= s
        if not fits.any():
            break  # nor does any longer run of narrower ones
        best[fits] = s
    counts = np.array(COUNTS, np.int64)[best].tolist()
    at, i = [], 0
    while i < n:
        at.append(i)
        i += counts[i]
    at = np.array(at, np.int64)
    chosen = best[at]
    place = np.arange(len(at)) + np.concatenate([[0], np.cumsum(chosen == 0)[:-1]])
    words = np.zeros(len(at) + int((chosen == 0).sum()), np.uint64)
    padded = np.concatenate([values, np.zeros(64, np.uint64)])
    for s in np.unique(chosen).tolist():
        here = chosen == s
        first, to = at[here], place[here]
        if s == 0:
            words[to + 1] = padded[first]
            continue
        word = np.full(len(first), np.uint64(s) << np.uint64(60), np.uint64)
        for k in range(COUNTS[s]):
            word |= padded[first + k] << np.uint64(k * BITS[s])
        words[to] = word
    return words


def encode(values: np.ndarray, block_ids: int = BLOCK_IDS) -> tuple[bytes, bytes]:
    """(words, offset of each block in words) of unsigned values."""
    values = np.ascontiguousarray(values, dtype=np.uint64)
    parts = [_block(values[i : i + block_ids]) for i in range(0, len(values), block_ids)]
    starts = np.cumsum([0, *map(len, parts)])[:-1] if parts else np.zeros(0)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)).astype("<u8").tobytes(), starts.astype("<u4").tobytes()


def _decode_block(words: np.ndarray, n: int) -> np.ndarray:
    selector = (words >> np.uint64(60)).astype(np.int64)
    escapes = np.flatnonzero(selector == 0)
    if len(escapes):  # the word after an escape is data; a data word may look like anything
        raw, i = np.zeros(len(words), bool), -1
        for e in escapes.tolist():
            if e > i:
                i = e + 1
                raw[i] = True
        heads = np.flatnonzero(~raw)
    else:
        heads = np.arange(len(words))
    kind = selector[heads]
    counts = np.array(COUNTS, np.int64)[kind]
    start = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for s in np.unique(kind).tolist():
        here = kind == s
        to, word = start[here], words[heads[here]]
        if s == 0:
            out[to] = words[heads[here] + 1]
            continue
        mask = np.uint64((1 << BITS[s]) - 1)
        for k in range(COUNTS[s]):
            out[to + k] = (word >> np.uint64(k * BITS[s])) & mask
    return out[:n]


def decode(words: bytes, offsets: bytes, n: int, block_ids: int = BLOCK_IDS) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    w, o = np.frombuffer(words, "<u8"), np.frombuffer(offsets, "<u4").astype(np.int64)
    ends = [*o[1:].tolist(), len(w)]
    parts = [_decode_block(w[a:b], min(block_ids, n - i * block_ids)) for i, (a, b) in enumerate(zip(o.tolist(), ends, strict=True))]
    return np.concatenate(parts)


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, key: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of ``docs``, each document followed by ``end_id``, by ascending key."""
    ship(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()
    key_type = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part = token_ids.worker(tokenizer_path), TaskContext.get().partitionId()
        keys, chunks, lengths, size, start, group = [], [], [], 0, 0, 0

        def row() -> pa.RecordBatch:
            words, offsets = encode(np.frombuffer(b"".join(chunks), "<u4"))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()), pa.array([group], pa.int32()), pa.array([start], pa.int64()), pa.array([size], pa.int64()),
                    pa.array([keys], pa.list_(kind)), pa.array([lengths], pa.list_(pa.int64())), pa.array([offsets], pa.binary()), pa.array([words], pa.binary()),
                ],
                names=["part", "group", "start", "n_ids", "keys", "lengths", "offsets", "words"],
            )

        kind = None
        for whole in batches:
            kind = whole.schema.field(0).type
            for at in range(0, whole.num_rows, 128):
                b = whole.slice(at, 128)
                for k, ids in zip(b.column(0).to_pylist(), encoder.ids(b.column(1).to_pylist()), strict=True):
                    ids += end
                    keys.append(k)
                    chunks.append(ids)
                    lengths.append(len(ids) // 4)
                    size += len(ids) // 4
                    if size >= GROUP_IDS:
                        yield row()
                        start, group = start + size, group + 1
                        keys, chunks, lengths, size = [], [], [], 0
        if keys:
            yield row()

    out = T.StructType(
        [
            T.StructField("part", T.IntegerType()), T.StructField("group", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("n_ids", T.LongType()),
            T.StructField("keys", T.ArrayType(key_type)), T.StructField("lengths", T.ArrayType(T.LongType())), T.StructField("offsets", T.BinaryType()), T.StructField("words", T.BinaryType()),
        ]
    )
    rows = docs.select(key, docs[text_col].alias("__text")).repartitionByRange(key).sortWithinPartitions(F.col(key).asc_nulls_first(), F.col("__text").asc_nulls_first())
    rows.mapInArrow(run, out).write.options(**PAGES).parquet(path)


def read(spark: SparkSession, path: str, key: str = "doc_id", key_type: str = "bigint", with_ids: bool = True) -> DataFrame:
    """key, start, n_tokens, ids_crc32 and, if asked for, ids of each document, decoded from the files."""
    ship(spark)
    files = spark.read.parquet(path)
    # One row for each writing task comes to the driver: its number of ids.
    totals = sorted((r["part"], r["n"]) for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    before, total = [], 0
    for part, n in totals:
        before.append((part, total))
        total += n
    bases = dict(before)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids = decode(r["words"], r["offsets"], r["n_ids"]).astype("<u4")
                lengths = np.array(r["lengths"], np.int64)
                ends = np.cumsum(lengths)
                starts = ends - lengths
                cut = [ids[s:e].tobytes() for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                columns = [pa.array(r["keys"], b.schema.field("keys").type.value_type), pa.array(starts + (r["start"] + bases[r["part"]])), pa.array(lengths), pa.array([zlib.crc32(x) for x in cut], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(cut, pa.binary())] * with_ids, names=[key, "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    return files.drop("group").mapInArrow(run, f"`{key}` {key_type}, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids)
