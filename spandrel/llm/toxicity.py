"""Toxicity by a support vector machine with a subsequence string kernel.

The kernel of two words sums, over all common subsequences of three letters,
decay ** (letters spanned) of every occurrence in both (spans of at most SPAN
letters; longer ones weigh next to nothing), normalised. So a word with gaps
or inserted characters stays close to the word it hides. The start and the end of a
word count as letters. Signs and digits are dropped first and runs of single letters join, so "i.d.i.o.t" and "i d i o t"
are words as well.

Nyström: ``landmarks`` words from the training sentences stand for the kernel's
feature space. A linear machine on those features collapses into one weight a
subsequence, so scoring a word is a sum of look-ups and costs nothing more for
more landmarks.

Training is on labelled sentences, and the unit is the word: a sentence of a
clean document has only clean words; a sentence of a toxic one is known to be
toxic only through its document, so the machine and the choice of the toxic
words (the witnesses) alternate a few rounds. A word broken by a space into
parts of two or more letters, and an insult made of ordinary words, has no
word that tells and is not found. A document's score is a logistic function of
its highest word score, fitted on training documents.

Fitting uses at most MOST_TOXIC and MOST_CLEAN labelled documents, those of
the smallest hashes of the key: a documented bound, the same at any size. Of
their clean words at most MOST_NEGATIVES train the machine, two fifths of them
the most frequent ones and the rest at equal steps, and in each round
HARD_NEGATIVES more that it took for toxic ones. A toxic document has at most
WITNESSES witnesses. Words are cut in the tasks that read the texts,
and one task fits the machine on them; the driver gets the weights.

All documents are scored, whole. A null or empty text, and one without a word
of three letters, scores as a document of clean words does. Without labels of
both kinds every score is 0 (next to it, by the logistic function). Of labelled
rows with one key the one with the smallest hash of the text is learnt from; a
key with labels of both kinds is toxic. Repeated rows are scored each, and
equal texts equally. An empty table gives an empty result. Columns named
``score`` or like inner ones in the input do no harm.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spandrel.runtime import ship

MOST_TOXIC, MOST_CLEAN = 1500, 3000
LANDMARKS = 400
DECAY, SPAN = 0.6, 6
ROUNDS = 4
#: Bounds of the fit: clean words of the machine, and witnesses of a toxic document.
MOST_NEGATIVES, WITNESSES, HARD_NEGATIVES = 20_000, 8, 1_000
#: A witness is in so many times the share of toxic documents as of clean ones.
TELLING = 4
CACHE_ENTRIES = 400_000
#: Longer words are taken apart into windows of this many letters, half of each in the next.
WINDOW = 24

#: Letters outside a-z that have a class of their own; all others share one.
_EXTRA = {c: 27 + i for i, c in enumerate("äöüßéèêçíóñáúâîà")}
_OTHER, _START, _END = 43, 44, 45
_BASE = 48
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def _letters(word: str) -> bytes:
    """The classes of a word's letters."""
    out = bytearray()
    for c in word.lower():
        if "a" <= c <= "z":
            out.append(ord(c) - 96)
        elif c in _EXTRA:
            out.append(_EXTRA[c])
        elif c.isalpha():
            out.append(_OTHER)
    return bytes(out)


def words_of(text: str) -> list[str]:
    """Words of a text; three or more single letters in a row are one word."""
    parts = text.split()
    if not any(len(p) < 3 for p in parts):
        return parts
    out, run = [], []
    for p in parts:
        if len(p) <= 2 and len(p.strip(".,-_*!?;:")) == 1:
            run.append(p)
            continue
        if run:
            out += ["".join(run)] if len(run) > 2 else run
            run = []
        out.append(p)
    if run:
        out += ["".join(run)] if len(run) > 2 else run
    return out


def _offsets() -> list[tuple[int, int]]:
    return [(j, k) for j in range(1, SPAN - 1) for k in range(j + 1, SPAN)]


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, weights) of the subsequences of each word of at most WINDOW letters, normalised; weight 0 is padding."""
    n = max(3, max(map(len, words), default=3))
    letters = np.zeros((len(words), n + SPAN), np.int32)
    for i, w in enumerate(words):
        letters[i, : len(w)] = np.frombuffer(w, np.uint8)
    codes, weights = [], []
    for j, k in _offsets():
        a, b, c = letters[:, :n], letters[:, j : j + n], letters[:, k : k + n]
        codes.append((a * _BASE + b) * _BASE + c)
        weights.append(np.where((a > 0) & (b > 0) & (c > 0), np.float32(DECAY ** (k + 1)), np.float32(0)))
    codes, weights = np.concatenate(codes, 1), np.concatenate(weights, 1)
    # The norm counts a subsequence that occurs twice as one feature.
    order = np.argsort(codes, axis=1, kind="stable")
    c, w = np.take_along_axis(codes, order, 1), np.take_along_axis(weights, order, 1)
    total = np.cumsum(w.astype(np.float64), 1)
    last = np.ones(c.shape, bool)
    last[:, :-1] = c[:, 1:] != c[:, :-1]
    ends = np.where(last, total, 0.0)
    before = np.maximum.accumulate(np.concatenate([np.zeros((len(c), 1)), ends], 1)[:, :-1], 1)
    sums = np.where(last, total - before, 0.0)
    norm = np.sqrt((sums**2).sum(1, keepdims=True))
    return c, (w / np.where(norm > 0, norm, 1)).astype(np.float32)


def _windows(letters: bytes) -> list[bytes]:
    """The word between a mark of its start and one of its end, in parts if it is long."""
    letters = bytes([_START]) + letters + bytes([_END]) if letters else b""
    if len(letters) <= WINDOW:
        return [letters]
    return [letters[i : i + WINDOW] for i in range(0, len(letters) - WINDOW // 2, WINDOW // 2)]


class Model:
    """Weights of subsequences and the logistic function of a document's highest score."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float, shift: float):
        self.weights, self.bias, self.slope, self.shift = weights.astype(np.float32), float(bias), float(slope), float(shift)

    def letters_scores(self, words: list[bytes]) -> np.ndarray:
        out = np.empty(len(words))
        order = np.argsort([len(w) for w in words], kind="stable")  # words of a length pad nothing
        for at in range(0, len(words), 2048):
            here = order[at : at + 2048]
            c, w = features([words[i] for i in here])
            out[here] = (self.weights[c] * w).sum(1)
        return out + self.bias

    def word_scores(self, words: list[str]) -> list[float]:
        cut = [_windows(_letters(w)) for w in words]
        flat = [x for c in cut for x in c]
        scores = self.letters_scores(flat).tolist()
        out, i = [], 0
        for c in cut:
            out.append(max(scores[i : i + len(c)]))
            i += len(c)
        return out

    def probability(self, highest: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * highest + self.shift, -40, 40)))


class Scorer:
    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def highest(self, texts: list[str | None]) -> np.ndarray:
        known = self.known
        if len(known) > CACHE_ENTRIES:
            known.clear()
        cut = [words_of(t) if t else [] for t in texts]
        missing = list({w for ws in cut for w in ws if w not in known})
        got = dict(zip(missing, self.model.word_scores(missing), strict=True)) if missing else {}
        known.update(got)
        out = np.array([max(map(known.__getitem__, ws)) if ws else self.model.bias for ws in cut], np.float64)
        for w in missing:
            if len(w) > 48:
                del known[w]
        return out


def _machine(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss by Newton steps; sums of products go by blocks of rows."""
    size = x.shape[1] + 1
    ridge = np.eye(size)
    ridge[-1, -1] = 1e-3
    w = np.zeros(size)
    for _ in range(30):
        active = np.flatnonzero(y * (x @ w[:-1] + w[-1]) < 1)
        gram, right = ridge.copy(), np.zeros(size)
        for at in range(0, len(active), 2048):
            rows = active[at : at + 2048]
            z = np.concatenate([x[rows], np.ones((len(rows), 1), x.dtype)], 1).astype(np.float64)
            gram += z.T @ (z * cost[rows, None])
            right += z.T @ (cost[rows] * y[rows])
        new = np.linalg.solve(gram, right)
        if np.abs(new - w).max() < 1e-7:
            break
        w = new
    return w[:-1], w[-1]


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton steps with a small ridge; targets are pulled in as Platt does."""
    n1, n0 = y.sum(), (1 - y).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    z, w = np.stack([x, np.ones(len(x))], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (t - p) - 1e-3 * w
        h = (z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w[0], w[1]


def _top(words: np.ndarray, scores: np.ndarray, within: float) -> np.ndarray:
    """The words of the highest scores, WITNESSES at most; ``words`` are numbers in the order of their letters."""
    order = np.lexsort((words, -scores))[:WITNESSES]
    return words[order[scores[order] >= scores[order[0]] - within]]


def _grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, int]:
    """The numbers of the runs of four and five letters of each word, one word after the other, where each begins, and how many runs there are."""

    def codes(some: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        letters = np.zeros((len(some), WINDOW), np.int32)
        for i, w in enumerate(some):
            letters[i, : len(w)] = np.frombuffer(w, np.uint8)
        out = np.full((len(some), 2 * WINDOW - 7), -1, np.int32)
        for column, (n, i) in enumerate((n, i) for n in (4, 5) for i in range(WINDOW - n + 1)):
            code = np.full(len(some), n, np.int32)
            for k in range(n):
                code = code * _BASE + letters[:, i + k]
            out[:, column] = np.where(letters[:, i + n - 1] > 0, code, -1)
        return out[out >= 0], (out >= 0).sum(1)

    blocks = [words[i : i + 8192] for i in range(0, len(words), 8192)]
    known = np.zeros(0, np.int32)
    for block in blocks:
        known = np.union1d(known, codes(block)[0])
    found = [(np.searchsorted(known, c).astype(np.int32), n) for c, n in map(codes, blocks)]
    return np.concatenate([c for c, _ in found]), np.concatenate([[0], *(n for _, n in found)]).cumsum(), len(known)


def train(documents: pa.Table, landmarks: int = LANDMARKS) -> Model:
    """From columns label and parts, the distinct parts of words of each labelled document; their order is nothing to it."""
    labels = documents.column("label").to_numpy().astype(np.int64)
    size = _BASE**3
    if not 0 < labels.sum() < len(labels):
        return Model(np.zeros(size), -1.0, 1.0, -40.0)
    parts = documents.column("parts").combine_chunks()
    parts = parts.chunk(0) if isinstance(parts, pa.ChunkedArray) else parts
    coded, bounds = parts.flatten().dictionary_encode(), parts.offsets.to_numpy() - parts.offsets[0].as_py()
    vocabulary = coded.dictionary.to_pylist()
    order = sorted(range(len(vocabulary)), key=vocabulary.__getitem__)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    vocabulary, numbers = [vocabulary[i] for i in order], rank[coded.indices.to_numpy()]
    docs = [np.unique(numbers[i:j]) for i, j in zip(bounds, bounds[1:], strict=False)]
    del documents, parts, coded, order, rank, numbers

    # First witnesses: the words whose four or five letters in a row are the most telling in their document.
    of_word, starts, n_grams = _grams(vocabulary)
    held, count = np.zeros((2, n_grams)), np.zeros((2, len(vocabulary)), np.int64)
    for y, ws in zip(labels, docs, strict=True):
        if len(ws):
            held[y, np.unique(np.concatenate([of_word[starts[w] : starts[w + 1]] for w in ws]))] += 1
            count[y, ws] += 1
    n1, n0 = labels.sum(), (1 - labels).sum()
    # A word of clean documents is no witness, but for what labels may have wrong.
    may = (count[1] + 0.5) / n1 >= TELLING * (count[0] + 0.5) / n0
    suspects = {i: docs[i][may[docs[i]]] for i in np.flatnonzero(labels)}
    suspects = {i: ws for i, ws in suspects.items() if len(ws)}
    tells = np.log((held[1] + 0.1) / n1) - np.log((held[0] + 0.1) / n0)
    tells = np.maximum.reduceat(tells[of_word], starts[:-1]) if len(vocabulary) else tells
    witnesses = {i: _top(ws, tells[ws], 0.7) for i, ws in suspects.items()}
    common = np.lexsort((np.arange(len(vocabulary)), -count[0]))[: int((count[0] > 0).sum())]
    half = 2 * MOST_NEGATIVES // 5
    negatives = np.concatenate([common[:half], common[half :: max(1, -(-(len(common) - half) // (MOST_NEGATIVES - half)))]])
    positive = Counter(w for ws in witnesses.values() for w in ws.tolist())
    chosen = sorted(positive, key=lambda w: (-positive[w], w))[: landmarks // 2]
    chosen += [w for w in negatives.tolist() if len(vocabulary[w]) > 3][: landmarks - len(chosen)]
    codes, weights = features([vocabulary[w] for w in chosen])
    used = np.unique(codes[weights > 0])
    place = np.full(size, len(used))
    place[used] = np.arange(len(used))
    space = np.zeros((len(used) + 1, len(chosen)), np.float32)  # feature space x landmarks; the last row is for all else
    for i in range(len(chosen)):
        real = weights[i] > 0
        np.add.at(space[:, i], place[codes[i][real]], weights[i][real])
    kernel = np.zeros((len(chosen), len(chosen)))
    for at in range(0, len(space), 2048):
        part = space[at : at + 2048].astype(np.float64)
        kernel += part.T @ part
    values, vectors = np.linalg.eigh(kernel)
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])

    def mapped(words: np.ndarray) -> np.ndarray:
        out = np.empty((len(words), root.shape[1]), np.float32)
        order = np.argsort([len(vocabulary[w]) for w in words], kind="stable")
        for at in range(0, len(words), 512):
            here = order[at : at + 512]
            c, w = features([vocabulary[words[i]] for i in here])
            dense = np.zeros((len(here), len(space)), np.float32)
            np.add.at(dense, (np.arange(len(here))[:, None], place[c]), w)
            dense[:, -1] = 0
            out[here] = (dense @ space) @ root
        return out

    negative = mapped(negatives)
    for _ in range(ROUNDS):
        positive = Counter(w for ws in witnesses.values() for w in ws.tolist())
        words = np.array(sorted(positive), np.int64)
        x = np.concatenate([mapped(words), negative])
        y = np.concatenate([np.ones(len(words)), -np.ones(len(negative))])
        # A word of one document may be there by chance.
        cost = np.concatenate([[4.0 * positive[w] - 3.5 for w in words.tolist()], np.full(len(negative), 10.0)])
        w, bias = _machine(x, y, cost)
        flat = np.zeros(size)
        flat[used] = space[:-1] @ (root @ w)
        scores = Model(flat, bias, 1.0, 0.0).letters_scores(vocabulary)
        highest = np.array([scores[ws].max() if len(ws) else bias for ws in docs])
        witnesses = {i: _top(ws, scores[ws], 0.4) for i, ws in suspects.items()}
        # Clean words that the machine takes for toxic ones, and has not been told of.
        hard = np.setdiff1d(common, negatives)
        hard = hard[np.argsort(-scores[hard], kind="stable")[:HARD_NEGATIVES]]
        negatives, negative = np.concatenate([negatives, hard]), np.concatenate([negative, mapped(hard)])
    slope, shift = _logistic(highest, labels.astype(float))
    return Model(flat, bias, max(slope, 1e-3), shift)


def parts_of(text: str) -> list[bytes]:
    """The distinct parts of the words in a text's sentences, those of three letters or more."""
    words = {w for sentence in _SENTENCE.split(text) for w in words_of(sentence)}
    return sorted({x for w in words for x in _windows(_letters(w)) if len(x) > 4})


def _first_of_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each key of a partition, that of the smallest hash; there are as many keys as the sample has at most."""
    best: dict = {}
    names, kind = ["key", "label", "hash", "parts"], None
    for b in batches:
        kind = b.schema.field(0).type
        for i, (key, label, h) in enumerate(zip(*(b.column(c).to_pylist() for c in range(3)), strict=True)):
            if key not in best or h < best[key][1]:
                best[key] = label, h, parts_of(b.column(3)[i].as_py())
    for key, (label, h, parts) in best.items():
        yield pa.RecordBatch.from_arrays([pa.array([key], kind), pa.array([label], pa.int32()), pa.array([h], pa.int64()), pa.array([parts], pa.list_(pa.binary()))], names=names)


_PARTS = pa.schema([("label", pa.int32()), ("parts", pa.list_(pa.binary()))])


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [pa.RecordBatch.from_arrays(b.columns, names=_PARTS.names) for b in batches]
    m = train(pa.Table.from_batches(rows) if rows else _PARTS.empty_table())
    yield pa.RecordBatch.from_pydict({"weights": pa.array([m.weights.tobytes()], pa.binary()), "bias": [m.bias], "slope": [float(m.slope)], "shift": [float(m.shift)]})


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """From the texts of at most MOST_TOXIC and MOST_CLEAN rows of ``labels``, in one pass over ``docs``."""
    ship(docs.sparkSession)
    order = F.xxhash64(F.lit(7), F.col("key"))
    known = labels.select(F.col(key).alias("key"), F.col(label_col).cast("int").alias("label")).where("key is not null and label is not null").groupBy("key").agg(F.max("label").alias("label"))
    parts = [known.where(F.col("label") == y).orderBy(order, "key").limit(most) for y, most in ((1, MOST_TOXIC), (0, MOST_CLEAN))]
    chosen = parts[0].unionByName(parts[1])  # bounded, so it is safe to broadcast
    texts = docs.select(F.col(key).alias("key"), F.col(text_col).alias("text")).where("text is not null")
    rows = texts.join(F.broadcast(chosen), "key").select("key", "label", F.xxhash64("text").alias("hash"), "text")
    kind = rows.schema["key"].dataType.simpleString()
    cut = rows.mapInArrow(_first_of_key, f"key {kind}, label int, hash bigint, parts array<binary>")
    one = cut.groupBy("key").agg(F.min(F.struct("hash", "label", "parts")).alias("x")).select("x.label", "x.parts")
    got = one.repartition(1).mapInArrow(_trained, "weights binary, bias double, slope double, shift double").first()
    return train(_PARTS.empty_table()) if got is None else Model(np.frombuffer(got["weights"], np.float32), got["bias"], got["slope"], got["shift"])


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """``keep`` columns and score of every row."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # _BASE ** 3 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            p = shared.value.probability(scorer.highest(b.column("__text").to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(b.num_columns - 1)] + [pa.array(p, pa.float64())], names=[*b.schema.names[:-1], "score"])

    return docs.select(*keep, docs[text_col].alias("__text")).mapInArrow(run, T.StructType([*[docs.schema[k] for k in keep], T.StructField("score", T.DoubleType())]))
