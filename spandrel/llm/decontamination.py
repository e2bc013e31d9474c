"""Benchmark decontamination by latent semantic retrieval.

1. Words of the benchmark get document frequencies over all documents.
2. Items go to spaces of at most RANK items. A randomised SVD of a space's
   TF-IDF passages, distributed over its rows, gives the latent space: partial
   products come from the partitions and only a (words of the space) x (rank)
   matrix reaches the driver. As the rank is not below the number of items, no
   item loses a part of its direction, however large the benchmark is.
3. Every document is cut into overlapping windows, as long as the items of a
   size class ask for. A window is left out only if step 4 would refuse every
   item there: by counts of the item's words and answer words, which no other
   word and no number of documents changes. The rest are projected and meet
   the items by cosine.
4. A candidate counts if the longest common subsequence of words covers
   ``least_common`` of the item in a stretch of the document 1.3 times as long
   as the item, and the answer is there: the words of column ``answer`` where
   the benchmark has one, else the item's rarest quarter of words (of those
   that the documents have at all), of which ``least_answer`` must be in that
   stretch. All stretches about the window are tried, the best one counts.
   Paraphrases keep both.

The benchmark is a stated query set: it goes over all rows in blocks of at most
BLOCK_ITEMS items and BLOCK_BYTES bytes, which bounds every broadcast; a block
takes two passes over the documents.

Items with fewer than LEAST_WORDS words are too short for a part of them to
tell: they match where all their words stand next to each other in order (then
cosine and common are 1). Null or empty texts and items match nothing, nor do
items without a letter or digit. Repeated rows are reported each, as are
repeated items. Empty tables give an empty result. Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spandrel.runtime import ship

BLOCK_ITEMS, BLOCK_BYTES = 2_048, 4 << 20
LEAST_WORDS = 5
RANK, POWER_ROUNDS = 256, 2
LEAST_COSINE, LEAST_COMMON, LEAST_ANSWER = 0.5, 0.6, 0.3
CACHE_ENTRIES = 300_000
_SEED = 11


def normal(word: str) -> str:
    low = word.lower()
    return low if low.isalnum() else "".join(filter(str.isalnum, low))


def normal_words(text: str | None) -> list[str]:
    return [w for w in map(normal, (text or "").split()) if w]


class _Ids(dict):
    """Chunk of text -> number of its word; -1 for other words and -2 for none."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, chunk: str) -> int:
        w = normal(chunk)
        i = self.vocabulary.get(w, -1) if w else -2
        if len(chunk) <= 48:
            self[chunk] = i
        return i

    def of(self, text: str) -> np.ndarray:
        if len(self) > CACHE_ENTRIES:
            self.clear()
        chunks = text.split()
        ids = np.fromiter(map(self.__getitem__, chunks), np.int32, len(chunks))
        return ids[ids > -2] if len(ids) and ids.min() == -2 else ids


def _frequencies(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary.value
        ids, n = _Ids(words), 0
        total = np.zeros(len(words), np.int64)
        for b in batches:
            for text in b.column(0).to_pylist():
                n += 1
                if text:
                    i = ids.of(text)
                    total[np.unique(i[i >= 0])] += 1
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"word": pa.array([-1, *seen.tolist()], pa.int32()), "n": pa.array([n, *total[seen].tolist()], pa.int64())})

    return run


def _tfidf(ids: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, weights) of a passage, of length 1."""
    words, counts = np.unique(ids, return_counts=True)
    weights = counts * idf[words]
    norm = np.sqrt((weights**2).sum())
    return words, weights / norm if norm > 0 else weights


def latent_space(passages: DataFrame, n_words: int, idf: np.ndarray, rank: int | None = None) -> np.ndarray:
    """An orthonormal basis (words x rank) of the main directions of the passages.

    ``passages`` has one column, the list of word numbers. Subspace iteration
    of A'A, where each partition adds up its rows' part.
    """
    spark = passages.sparkSession
    q = np.linalg.qr(np.random.default_rng(_SEED).standard_normal((n_words, min(rank or RANK, n_words))))[0]
    for _ in range(POWER_ROUNDS):
        shared = spark.sparkContext.broadcast((q.astype(np.float32), idf))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            basis, weights = shared.value
            out: dict[int, np.ndarray] = {}
            for b in batches:
                for ids in b.column(0).to_pylist():
                    words, w = _tfidf(np.array(ids, np.int64), weights)
                    y = w @ basis[words]
                    for i, x in zip(words.tolist(), w.tolist(), strict=True):
                        out[i] = out[i] + x * y if i in out else x * y
            yield pa.RecordBatch.from_pydict({"word": pa.array(list(out), pa.int32()), "row": pa.array([x.astype("<f4").tobytes() for x in out.values()], pa.binary())})

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out: dict[int, np.ndarray] = {}
            for b in batches:
                for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    x = np.frombuffer(x, "<f4")
                    out[i] = out[i] + x if i in out else x
            yield pa.RecordBatch.from_pydict({"word": pa.array(list(out), pa.int32()), "row": pa.array([x.tobytes() for x in out.values()], pa.binary())})

        product = np.zeros(q.shape)
        for r in passages.mapInArrow(run, "word int, row binary").repartition(8, "word").mapInArrow(add, "word int, row binary").toLocalIterator():
            product[r["word"]] = np.frombuffer(r["row"], "<f4")
        q = np.linalg.qr(product)[0]
    return q.astype(np.float32)


def _least_count(share: float, n: int) -> int:
    """The smallest count that is at least ``share`` of ``n``."""
    return next(k for k in range(max(0, math.ceil(share * n) - 1), n + 2) if k / n >= share or k > n)


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, a bit a word of ``a``."""
    at: dict[int, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for x in b:
        u = s & at.get(x, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


class Space:
    """A latent space, the items in it, and which words of the block it has."""

    def __init__(self, items: list[int], words: np.ndarray, idf: np.ndarray, basis: np.ndarray, of_item: list[np.ndarray]):
        self.items, self.words, self.idf, self.basis = np.array(items), words, idf[words].astype(np.float32), basis
        latent = np.stack([self.project(of_item[i]) for i in items])
        norm = np.linalg.norm(latent, axis=1, keepdims=True)
        self.latent = latent / np.where(norm > 0, norm, 1)

    def project(self, ids: np.ndarray) -> np.ndarray:
        """The TF-IDF vector of a passage in this space; words that it doesn't have are no part of it."""
        at = np.searchsorted(self.words, ids)
        at[at == len(self.words)] = 0
        own = at[self.words[at] == ids]
        w, x = _tfidf(own, self.idf) if len(own) else (own, self.idf[:0])
        return (x @ self.basis[w]).astype(np.float32)


class Matcher:
    """Items of a block, ready to be met by documents."""

    def __init__(self, items: list[tuple], vocabulary: dict[str, int], idf: np.ndarray, bases: list[tuple[list[int], np.ndarray, np.ndarray]], least: tuple[float, float, float], seen: np.ndarray):
        self.vocabulary, self.least = vocabulary, least
        self.keys = [k for k, _, _ in items]
        self.words = [np.array([vocabulary[w] for w in ws], np.int64) for _, ws, _ in items]
        self.spaces = [Space(own, words, idf, basis, self.words) for own, words, basis in bases]
        self.short = [i for i, w in enumerate(self.words) if len(w) < LEAST_WORDS]
        self.answers = []
        for w, (_, _, answer) in zip(self.words, items, strict=True):
            kept = [vocabulary[a] for a in answer]
            if not kept:
                there = w[seen[w]] if seen[w].any() else w
                rare = there[np.argsort(-idf[there], kind="stable")]
                kept = rare[: max(1, math.ceil(len(w) / 4))].tolist()
            self.answers.append(set(kept))
        # Answer word -> items, as one list with bounds; how many of them, and of its words in a stretch, an item needs.
        by_word: list[list[int]] = [[] for _ in vocabulary]
        for i, answer in enumerate(self.answers):
            for w in answer if len(self.words[i]) >= LEAST_WORDS else set(self.words[i][:1].tolist()):
                by_word[w].append(i)
        self.posted = np.array([i for ix in by_word for i in ix], np.int64)
        self.bounds = np.cumsum([0, *map(len, by_word)])
        # Other words have number -1, which is the last place and false.
        self.telling = np.array([*map(bool, by_word), False])
        self.least_answers = np.array([_least_count(least[2], len(a)) if len(w) >= LEAST_WORDS else 1 for a, w in zip(self.answers, self.words, strict=True)])
        self.least_words = [_least_count(least[1], len(w)) for w in self.words]
        # Windows by size class: each item meets windows of about 1.5 times its length.
        groups: dict[tuple[int, int], list[int]] = {}
        for s, space in enumerate(self.spaces):
            for j, i in enumerate(space.items.tolist()):
                groups.setdefault((s, 1 << max(3, (len(self.words[i]) - 1).bit_length())), []).append(j)
        self.groups = [(self.spaces[s], int(c * 1.25), np.array(js)) for (s, c), js in groups.items()]

    def matches(self, ids: np.ndarray) -> list[tuple[int, float, float, int]]:
        """(item, cosine, share of the item in order, first word) of each item that is in a document."""
        told = np.flatnonzero(np.bincount(ids[self.telling[ids]], minlength=1))
        counts = np.zeros(len(self.keys), np.int64)
        for w in told.tolist():
            counts[self.posted[self.bounds[w] : self.bounds[w + 1]]] += 1
        there = np.flatnonzero(counts >= self.least_answers).tolist()
        best: dict[int, tuple[float, float, int]] = {}
        for i in there:
            if len(self.words[i]) < LEAST_WORDS and (at := self._whole(i, ids)) is not None:
                best[i] = 1.0, 1.0, at
        places = {i: p for i in there if len(self.words[i]) >= LEAST_WORDS and (p := self._places(i, ids)) is not None}
        for space, width, members in self.groups if places else ():
            members = [j for j in members.tolist() if int(space.items[j]) in places]
            if not members:
                continue
            starts = np.arange(0, max(1, len(ids) - width + max(1, width // 4)), max(1, width // 4))
            ends = np.minimum(starts + width, len(ids))
            # Which windows have a place of an item in the part of the document that _verify looks at.
            near = np.zeros((len(members), len(starts)), bool)
            for row, j in zip(near, members, strict=True):
                i = int(space.items[j])
                n = len(self.words[i])
                row[:] = np.searchsorted(places[i], ends + n) > np.searchsorted(places[i], starts - n)
            cosines = np.zeros(near.shape, np.float32)
            for at in np.flatnonzero(near.any(axis=0)).tolist():
                window = ids[starts[at] : ends[at]]
                v = space.project(window[window >= 0].astype(np.int64))
                norm = np.linalg.norm(v)
                if norm > 0:
                    cosines[:, at] = space.latent[members] @ (v / norm)
            for row, j, cosine in zip(near, members, cosines, strict=True):
                i = int(space.items[j])
                n, tried = len(self.words[i]), -1
                for at in np.flatnonzero(row & (cosine >= self.least[0])).tolist():
                    first, last = np.searchsorted(places[i], [max(tried + 1, starts[at] - n), ends[at] + n])
                    self._verify(i, float(cosine[at]), ids, places[i][first:last], best)
                    tried = int(ends[at] + n - 1)
        return [(i, *x) for i, x in sorted(best.items())]

    def _whole(self, item: int, ids: np.ndarray) -> int | None:
        """Where a short item's words first stand in a row."""
        words = self.words[item]
        n = len(words)
        if not n or len(ids) < n:
            return None
        found = np.flatnonzero(np.logical_and.reduce([ids[k : len(ids) - n + 1 + k] == w for k, w in enumerate(words)]))
        return int(found[0]) if len(found) else None

    def _places(self, item: int, ids: np.ndarray) -> np.ndarray | None:
        """Where stretches with enough of an item's words begin; a common subsequence is no longer than their count."""
        words = self.words[item]
        counts = np.concatenate([[0], np.cumsum(np.isin(ids, words))])
        if counts[-1] < self.least_words[item]:
            return None
        ends = np.minimum(np.arange(len(ids)) + math.ceil(1.3 * len(words)), len(ids))
        places = np.flatnonzero(counts[ends] - counts[:-1] >= self.least_words[item])
        return places if len(places) else None

    def _verify(self, item: int, cosine: float, ids: np.ndarray, places: np.ndarray, best: dict) -> None:
        """The best stretch that begins at one of ``places``.

        From a stretch to the next one word goes and one comes, so the common
        subsequence grows by one at most, as does the count of answer words;
        so many places as are missing are passed over.
        """
        words, answers = self.words[item].tolist(), self.answers[item]
        n, span, k = len(words), math.ceil(1.3 * len(words)), 0
        while k < len(places):
            at = int(places[k])
            stretch = ids[at : at + span].tolist()
            wanted = max(self.least_words[item], round(best[item][1] * n) + 1 if item in best else 0)
            if wanted > n:
                return
            missing = wanted - common_subsequence(words, stretch)
            if missing <= 0:
                have = len(answers.intersection(stretch))
                missing = int(self.least_answers[item]) - have
                if missing <= 0:
                    best[item] = (cosine, common_subsequence(words, stretch) / n, at)
                    continue
            k = max(k + 1, int(np.searchsorted(places, at + missing)))


def _blocks(benchmark: DataFrame, key: str, text_col: str) -> Iterator[list]:
    """The items by key, in blocks of bounded size."""
    block, size = [], 0
    columns = [key, text_col, *(["answer"] if "answer" in benchmark.columns else [])]
    for r in benchmark.where(F.col(text_col).isNotNull()).select(*columns).orderBy(key).toLocalIterator():
        block.append(r)
        size += len(r[text_col])
        if len(block) >= BLOCK_ITEMS or size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str | tuple[str, ...] = "doc_id", text_col: str = "text", item_key: str = "item_id", least_cosine: float = LEAST_COSINE, least_common: float = LEAST_COMMON, least_answer: float = LEAST_ANSWER) -> DataFrame:
    """(key, item_key, cosine, common, first_word): an item in a document, with how much of it is there in order, and where.

    ``key``: a column, or several, that come with each row.
    """
    spark = docs.sparkSession
    ship(spark)
    keys = [key] if isinstance(key, str) else list(key)
    columns = [(k, docs.schema[k].dataType.simpleString()) for k in keys] + [(item_key, benchmark.schema[item_key].dataType.simpleString())]
    out = ", ".join(f"`{k}` {kind}" for k, kind in columns) + ", cosine double, common double, first_word bigint"
    found = None
    texts = docs.select(docs[text_col].alias("__text"))
    for block in _blocks(benchmark, item_key, "text"):
        items = [(r[item_key], normal_words(r["text"]), normal_words(r["answer"]) if "answer" in r else []) for r in block]
        items = [x for x in items if x[1]]
        if not items:
            continue
        vocabulary: dict[str, int] = {}
        for _, ws, answer in items:
            for w in (*ws, *answer):
                vocabulary.setdefault(w, len(vocabulary))
        shared = spark.sparkContext.broadcast(vocabulary)
        counts = Counter()
        for r in texts.mapInArrow(_frequencies(shared), "word int, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect():  # a row for each word of the block
            counts[r["word"]] = r["n"]
        n = max(1, counts.pop(-1, 1))
        idf = np.array([math.log((n + 1) / (counts[i] + 0.5)) for i in range(len(vocabulary))])
        idf = np.maximum(idf, 1e-3)
        long = [i for i, x in enumerate(items) if len(x[1]) >= LEAST_WORDS]
        bases = []
        for own in (long[k : k + RANK] for k in range(0, len(long), RANK)):
            ids = [np.array([vocabulary[w] for w in items[i][1]]) for i in own]
            words = np.unique(np.concatenate(ids))
            passages = spark.createDataFrame([(np.searchsorted(words, x).tolist(),) for x in ids], "ids array<int>").repartition(8)
            bases.append((own, words, latent_space(passages, len(words), idf[words])))
        matcher = spark.sparkContext.broadcast(Matcher(items, vocabulary, idf, bases, (least_cosine, least_common, least_answer), np.array([counts[i] > 0 for i in range(len(vocabulary))])))

        def run(batches: Iterator[pa.RecordBatch], matcher=matcher) -> Iterator[pa.RecordBatch]:
            m = matcher.value
            ids = _Ids(m.vocabulary)
            for b in batches:
                rows = [[] for _ in range(5)]
                for i, text in enumerate(b.column(len(keys)).to_pylist()):
                    for item, cosine, common, first in m.matches(ids.of(text)) if text else ():
                        for column, x in zip(rows, (i, m.keys[item], cosine, common, first), strict=True):
                            column.append(x)
                if rows[0]:
                    places = pa.array(rows[0])
                    yield pa.RecordBatch.from_arrays([*(b.column(c).take(places) for c in range(len(keys))), pa.array(rows[1]), *(pa.array(x, k) for x, k in zip(rows[2:], (pa.float64(), pa.float64(), pa.int64()), strict=True))], names=[*keys, item_key, "cosine", "common", "first_word"])

        part = docs.select(*keys, docs[text_col].alias("__text")).mapInArrow(run, out)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], out)
