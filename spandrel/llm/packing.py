"""Best-fit packing of documents into sequences of a fixed length.

Bounded-space online best-fit on the map side, without a shuffle: a task keeps
at most ``open_bins`` open sequences. A bit set has bit f set while a sequence
with f free places is open, so the tightest one that still fits is the lowest
bit at or above the need. When nothing fits and all bins are in use, the
fullest closes first. Memory in a task is the open bins and one Arrow batch.

A document is its ids and the end id. Only one longer than a sequence is cut:
its full pieces are sequences of their own, and what is left over, which is
the first piece, is packed. A null text is empty, so it is one end id.
Repeated rows are packed each; an empty table gives an empty result; extra
columns are ignored. Sequence ids are unique numbers without further meaning:
the task's number and a count. A task that runs again gives the same rows, as
it reads the same partition in the same order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from spandrel.runtime import ship

from . import token_ids


class BestFit:
    """place(need) -> (sequence, offset)."""

    def __init__(self, capacity: int, open_bins: int, first: int):
        self.capacity, self.most, self.next = capacity, open_bins, first
        self.bits, self.open = 0, 0
        self.free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def new(self) -> int:
        self.next += 1
        return self.next - 1

    def _take(self, free: int) -> int:
        here = self.free[free]
        sequence = here.pop()
        if not here:
            self.bits ^= 1 << free
        self.open -= 1
        return sequence

    def place(self, need: int) -> tuple[int, int]:
        fits = self.bits >> need
        if fits:
            free = need + (fits & -fits).bit_length() - 1
            sequence = self._take(free)
        else:
            if self.open >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, sequence = self.capacity, self.new()
        left = free - need
        if left:
            self.free[left].append(sequence)
            self.bits |= 1 << left
            self.open += 1
        return sequence, self.capacity - free


def pieces(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids; the first may be shorter."""
    head = n % capacity
    out = [(0, head)] if head else []
    return out + [(s, capacity) for s in range(head, n, capacity)]


PACKED = T.StructType(
    [
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
    ]
)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = 1024, open_bins: int = 2048, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: key, piece, start, length, ids (little-endian 32 bit), sequence_id, offset."""
    ship(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = token_ids.worker(tokenizer_path)
        bins = BestFit(capacity, open_bins, (TaskContext.get().partitionId() << 36))
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                rows, out = [], [[] for _ in range(6)]
                for i, ids in enumerate(encoder.ids(b.column(1).to_pylist())):
                    ids += end
                    for k, (start, length) in enumerate(pieces(len(ids) // 4, capacity)):
                        sequence, offset = bins.place(length) if length < capacity else (bins.new(), 0)
                        rows.append(i)
                        for column, x in zip(out, (k, start, length, ids[4 * start : 4 * (start + length)], sequence, offset), strict=True):
                            column.append(x)
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], names=[key, *PACKED.names])

    return docs.select(key, docs[text_col].alias("__text")).mapInArrow(run, T.StructType([docs.schema[key], *PACKED.fields]))
