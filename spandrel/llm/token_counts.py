"""Token counts by a two-tier lookup on the map side.

A text is cut in front of every run of spaces. No piece of the vocabulary has
a space behind another character (checked when the model loads), so no merge
crosses such a cut and the count of a text is the sum over its pre-tokens.

Tier one is a broadcast table of the most frequent pre-tokens and their
lengths, at most ``frequent`` entries whatever the corpus. Tier two is a cache
in each Python worker, which lasts from task to task and is emptied when it is
full. Texts' pre-tokens never enter a shuffle: the frequent ones come from
bounded summaries, one per partition, which a tree of tasks merges.

Nulls count as the empty text (0 bytes, 0 tokens). Repeated rows are counted
each. An empty table gives an empty result. Other columns are ignored unless
named in ``keep``; there a column named like an added one is refused.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from spandrel.runtime import ship

#: Longer pre-tokens are counted but not kept in a cache or summary.
KEPT_CHARS = 48
CACHE_ENTRIES = 400_000
#: Entries that a summary of one partition, or of a group of summaries, may have.
SUMMARY_ENTRIES = 20_000
#: Summaries that one task merges.
SUMMARY_FAN = 32

_RUNS = re.compile(" +[^ ]*")
_workers: dict = {}


class PieceCounter(dict):
    """Pre-token -> number of tokens, filled on demand."""

    def __init__(self, path: str):
        import sentencepiece

        super().__init__()
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.vocab_size()
        # A piece such as "a▁" would let a merge cross a cut.
        self.separable = not any("▁" in self.model.id_to_piece(i).lstrip("▁") for i in range(size))
        self.fixed: dict[str, int] = {}
        self.table: bytes | None = None

    def start(self, table: bytes) -> None:
        """Take the broadcast table; what was learnt with the same one stays."""
        if self.table != table:
            t = pa.ipc.open_stream(table).read_all()
            self.table, self.fixed = table, dict(zip(t.column("key").to_pylist(), t.column("n").to_pylist(), strict=True))
            self.reset()

    def reset(self) -> None:
        self.clear()
        self.update(self.fixed)

    def __missing__(self, key: str) -> int:
        # The model puts one space before a text, which is the one that was cut off.
        n = len(self.model.encode(key)) if key else len(self.model.encode("a ")) - len(self.model.encode("a"))
        if len(key) <= KEPT_CHARS:
            self[key] = n
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.separable:
            return len(self.model.encode(text))
        return sum(map(self.__getitem__, pretokens(text)))


def pretokens(text: str) -> list[str]:
    """The pre-tokens of a text, each without the first of its spaces."""
    if "▁" in text:  # the model writes a space so
        text = text.replace("▁", " ")
    if "  " in text or text[0] == " ":
        return [x[1:] for x in _RUNS.findall(" " + text)]
    return text.split(" ")


def _counter(path: str) -> PieceCounter:
    if path not in _workers:
        _workers[path] = PieceCounter(path)
    return _workers[path]


def _cut(counts: dict[str, int], most: int) -> dict[str, int]:
    if len(counts) <= most:
        return counts
    return dict(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:most])


def _summaries(text_col: str):
    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        counts: Counter = Counter()
        for b in batches:
            for text in b.column(text_col).to_pylist():
                if text:
                    counts.update(pretokens(text))
            if len(counts) > 8 * SUMMARY_ENTRIES:
                counts = Counter(_cut(counts, SUMMARY_ENTRIES))
        yield _row(_cut({k: v for k, v in counts.items() if len(k) <= KEPT_CHARS}, SUMMARY_ENTRIES))

    return one


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from collections import Counter

    counts: Counter = Counter()
    for b in batches:
        for keys, ns in zip(b.column("keys").to_pylist(), b.column("counts").to_pylist(), strict=True):
            counts.update(dict(zip(keys, ns, strict=True)))
            if len(counts) > 4 * SUMMARY_ENTRIES:
                counts = Counter(_cut(counts, SUMMARY_ENTRIES))
    yield _row(_cut(counts, SUMMARY_ENTRIES))


_SUMMARY = pa.schema([("keys", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])


def _row(counts: dict[str, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"keys": [list(counts)], "counts": [list(counts.values())]}, schema=_SUMMARY)


def frequent_pretokens(docs: DataFrame, text_col: str = "text", most: int = 65_536) -> list[str]:
    """The ``most`` frequent pre-tokens of all documents, by bounded summaries.

    Each partition sends one summary; a task merges SUMMARY_FAN of them, and so
    on, until few enough are left for the driver, of SUMMARY_ENTRIES keys each.
    """
    ship(docs.sparkSession)
    kind = "keys array<string>, counts array<bigint>"
    texts = docs.select(text_col)
    groups, rows = texts.rdd.getNumPartitions(), texts.mapInArrow(_summaries(text_col), kind)
    while groups > 2:
        groups = -(-groups // SUMMARY_FAN)
        rows = rows.repartition(groups).mapInArrow(_merged, kind)
    counts: dict[str, int] = {}
    for r in rows.collect():  # two at most
        for k, n in zip(r["keys"], r["counts"], strict=True):
            counts[k] = counts.get(k, 0) + n
    return list(_cut(counts, most))


def compact_table(model_path: str, keys: list[str]) -> bytes:
    """The broadcast form: an Arrow table of pre-tokens and 32-bit lengths."""
    counter = PieceCounter(model_path)
    lengths = [counter[k] for k in keys]
    t = pa.table({"key": pa.array(keys, pa.string()), "n": pa.array(lengths, pa.int32())})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema) as w:
        w.write_table(t)
    return sink.getvalue().to_pybytes()


def count_tokens(docs: DataFrame, model_path: str, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", frequent: int = 65_536) -> DataFrame:
    """``keep`` columns, n_bytes (UTF-8) and n_tokens of every whole text."""
    spark = docs.sparkSession
    ship(spark)
    if clash := {"n_bytes", "n_tokens"} & set(keep):
        raise ValueError(f"columns {sorted(clash)} are added and can't be kept")
    shared = spark.sparkContext.broadcast(compact_table(model_path, frequent_pretokens(docs, text_col, frequent)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(model_path)
        counter.start(shared.value)
        for b in batches:
            texts = b.column("__text")
            counts = []
            for text in texts.to_pylist():
                counts.append(counter.count(text) if text else 0)
                if len(counter) > CACHE_ENTRIES:
                    counter.reset()
            yield pa.RecordBatch.from_arrays(
                [b.column(i) for i in range(b.num_columns - 1)] + [pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64()), pa.array(counts, pa.int64())],
                names=[*b.schema.names[:-1], "n_bytes", "n_tokens"],
            )

    out = T.StructType([*[docs.schema[k] for k in keep], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return docs.select(*keep, docs[text_col].alias("__text")).mapInArrow(run, out)
