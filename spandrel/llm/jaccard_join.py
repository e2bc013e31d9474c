"""Near duplicates by an exact Jaccard join on word shingles, size-aware.

A document's set is its distinct shingles of five words (64-bit hashes).
Documents with equal sets are one node. Two nodes link when
100 * intersection >= 75 * union; then the overlap is at least
c(s) = ceil(0.75 * s) for the size s of either, and both hold k common
shingles within their first s - c(s) + k under any common order.

* Order: by how common a shingle is, rare first, ties by hash. A count sketch
  over all documents gives the frequencies; any fixed function of a shingle is
  a valid order, so collisions in the sketch cost time and never a link.
* Light sets (s <= boundary) enumerate all subsets of two shingles of that
  prefix (k = 2) and meet other light sets there.
* Heavy sets scan inverted lists of single shingles of the prefix (k = 1).
  Light sets large enough to reach a heavy one are in the lists, too.
* The boundary is chosen by cost: subsets to enumerate against the lengths of
  the lists to scan, summed by size over all documents.

A list is never expanded into all its pairs.

1. Every node is tried against the hub of each of its lists, the node that has
   the key earliest: it has the fewest shingles of its own, as the original of
   a group of near copies has. What links is one component, so such a group is
   done with one try a member.
2. A node stays in a list only if the list has a node small enough that the
   place of the key leaves room for a link (_most_size). In lists that then
   meet several components, the nodes outside of the largest one meet all
   others: within a component nothing can be added to it. Size and place
   are part of the join, so only pairs pass that may link by both. Long lists
   are dealt over several tasks by a salt.

A pair is verified on whole sets, after a bound from what the two prefixes
have in common.

Sets are made by the text again where they are needed (numpy, vectorised), so
no set of an isolated document is ever stored or moved. Broadcasts are of
fixed size: the sketch (at most 2**24 bytes) and a bitmap of candidates
(2**20 bytes) that only saves work.

Nodes are named by a 64-bit digest of the set, and keys of documents come in
at the end only. A null or empty text, and one without words, has an empty set
and links with nothing. Repeated rows, of one key or several, are copies of
each other if their sets are equal; rows of one key with unlike texts are
nodes of their own. A component takes its smallest non-null key, null if it has
none. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spandrel.runtime import discard, materialise, ship

from .components import components

WORDS = 5
PERCENT = 75
#: Sets up to this size may be light.
LIGHT_MOST = 48
CACHE_ENTRIES = 300_000
BITMAP_BITS = 1 << 23
_CHUNK = 1 << 16
#: Nodes of a list that one task compares with others at most.
SALT_ROWS = 4096
#: Odd multipliers of the word hashes in a shingle, one a position.
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 48:
            self[word] = h
        return h


_hashes = _WordHashes()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes.

    A-Z are lower-cased; words are cut at space and U+0009 to U+000D, which is
    what the split of bytes does.
    """
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    if len(_hashes) > CACHE_ENTRIES:
        _hashes.clear()
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = len(h)
    if n < WORDS:
        s = (h * _FACTORS[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n)
    else:
        s = h[: n - 4] * _FACTORS[0]
        for k in range(1, WORDS):
            s += h[k : n - 4 + k] * _FACTORS[k]
    return np.unique(_mix(s))


def _digest(s: np.ndarray) -> int:
    """A 64-bit name of a set."""
    import xxhash

    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _sketch_parts(cells: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.uint32)
        waiting, held = [], 0
        for b in batches:
            for text in b.column(0).to_pylist():
                s = shingles(text)
                waiting.append((s & np.uint64(cells - 1)).astype(np.int64))
                held += len(s)
                if held > 1 << 20:
                    total += np.bincount(np.concatenate(waiting), minlength=cells).astype(np.uint32)
                    waiting, held = [], 0
        if held:
            total += np.bincount(np.concatenate(waiting), minlength=cells).astype(np.uint32)
        for k in range(0, cells, _CHUNK):
            part = total[k : k + _CHUNK]
            if part.any():
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([k // _CHUNK], pa.int32()), "counts": pa.array([part.tobytes()], pa.binary())})

    return run


def _sketch_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            part = np.frombuffer(c, "<u4").astype(np.float64)
            sums[k] = sums[k] + part if k in sums else part
    for k, part in sums.items():
        level = np.minimum(255, np.round(6 * np.log2(1 + part))).astype(np.uint8)
        yield pa.RecordBatch.from_pydict({"chunk": pa.array([k], pa.int32()), "levels": pa.array([level.tobytes()], pa.binary())})


def frequency_levels(docs: DataFrame, text_col: str) -> np.ndarray:
    """How common the shingles of each cell are over all documents, on a log scale in a byte."""
    rows = docs.count()
    cells = 1 << max(18, min(24, (4 * rows).bit_length()))
    parts = docs.select(text_col).mapInArrow(_sketch_parts(cells), "chunk int, counts binary")
    summed = parts.repartition(max(1, cells // _CHUNK), "chunk").mapInArrow(_sketch_sums, "chunk int, levels binary")
    levels = np.zeros(cells, np.uint8)
    for r in summed.collect():  # ``cells`` bytes in all
        levels[r["chunk"] * _CHUNK : r["chunk"] * _CHUNK + len(r["levels"])] = np.frombuffer(r["levels"], np.uint8)
    return levels


def _least_overlap(s: int) -> int:
    return -(-PERCENT * s // 100)


def prefix_keys(s: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(keys of lists, keys of subsets, estimated length of the lists) of a set.

    A set of one or two shingles links with no other set.
    """
    n = len(s)
    if n < 3:
        return s[:0], s[:0], 0.0
    level = levels[(s & np.uint64(len(levels) - 1)).astype(np.int64)]
    p = n - _least_overlap(n) + 1
    first = np.lexsort((s, level))[: p + 1]
    front = s[first]
    cost = float(np.exp2(level[first[:p]].astype(np.float64) / 6).sum())
    pairs = s[:0]
    if n <= LIGHT_MOST:
        i, j = np.triu_indices(len(front), 1)
        low, high = np.minimum(front[i], front[j]), np.maximum(front[i], front[j])
        pairs = _mix(low * _FACTORS[0] + high * _FACTORS[1])
    return front[:p], pairs, cost


def _keyed(shared_levels):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = np.frombuffer(shared_levels.value, np.uint8)
        seen: set[int] = set()
        for b in batches:
            out = [[] for _ in range(5)]
            for text in b.column(2).to_pylist():
                s = shingles(text)
                node = _digest(s)
                lists, pairs, cost = prefix_keys(s, levels) if node not in seen else (s[:0], s[:0], 0.0)
                if len(seen) < 1_000_000:  # copies in the same task add no keys
                    seen.add(node)
                for column, x in zip(out, (len(s), node, _signed(lists), _signed(pairs), cost), strict=True):
                    column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], names=["id", "row", "n", "node", "lists", "pairs", "cost"])

    return run


def choose_boundary(keyed: DataFrame) -> int:
    """The size up to which sets are light: the least sum of subsets made below it and lists scanned above."""
    rows = {r["n"]: (r["pairs"], r["cost"]) for r in keyed.where(f"n between 3 and {LIGHT_MOST} and size(lists) > 0").groupBy("n").agg(F.sum(F.size("pairs")).alias("pairs"), F.sum("cost").alias("cost")).collect()}
    best, boundary, light, heavy = None, 0, 0.0, sum(c for _, c in rows.values())
    for x in range(0, LIGHT_MOST + 1):
        made, scanned = rows.get(x, (0, 0.0))
        light, heavy = light + made, heavy - scanned
        # Light sets that reach a heavy one are scanned as well.
        reach = sum(rows[s][1] for s in rows if s <= x and 4 * s >= 3 * (x + 1))
        cost = light + heavy + reach
        if best is None or cost < best:
            best, boundary = cost, x
    return boundary


def row_name(key: str, text_col: str) -> Column:
    """Rows with equal key and text have the same, and as good as no others."""
    return F.xxhash64(F.col(key), F.lit(0), F.col(text_col))


def _set_rows(bitmap):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap.value, np.uint8)
        seen: set[int] = set()
        for b in batches:
            at = b.column(1).to_numpy(zero_copy_only=False)
            texts = b.column(0)
            nodes, sets = [], []
            for i in np.flatnonzero((bits[at >> 3] >> (at & 7)) & 1).tolist():
                s = shingles(texts[i].as_py())
                node = _digest(s)
                if node not in seen:
                    if len(seen) < 1_000_000:
                        seen.add(node)
                    nodes.append(node)
                    sets.append(_signed(s))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "set"])

    return run


def _bitmap(bits: DataFrame) -> DataFrame:
    """(word, bits): the bits that are set, BITMAP_BITS / 64 rows at most."""
    return bits.groupBy(F.floor(F.col("bit") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits"))


def _candidate_sets(docs: DataFrame, key: str, text_col: str, wanted: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, set) for the nodes of ``wanted``, from the texts, without moving texts."""
    spark = docs.sparkSession
    bit = F.pmod(F.col("row"), F.lit(BITMAP_BITS))
    bitmap = np.zeros(BITMAP_BITS // 64, np.int64)  # at most that many rows come here
    for r in _bitmap(wanted.join(classes, "node").select(bit.alias("bit"))).collect():
        bitmap[r["word"]] = r["bits"]
    shared = spark.sparkContext.broadcast(bitmap.astype("<i8").tobytes())
    rows = docs.select(docs[text_col].alias("text"), row_name(key, text_col).alias("row")).withColumn("bit", bit).select("text", "bit")
    sets = rows.mapInArrow(_set_rows(shared), "node bigint, set array<bigint>")
    return materialise(sets.join(wanted, "node", "left_semi").dropDuplicates(["node"]), "sets")


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that link, by their whole sets."""
    both = pairs.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    union = F.size("x") + F.size("y") - common
    return both.where(100 * common >= PERCENT * union).select("a", "b")


def _may_link(na, pos_a, nb, pos_b):
    """Whether sets of these sizes may link, and if so, whether the key is early enough in both.

    Both hold a common shingle within their first n - overlap + 1.
    """
    need = F.ceil(F.lit(PERCENT) * (na + nb) / (100 + PERCENT))
    sizes = 100 * F.least(na, nb) >= PERCENT * F.greatest(na, nb)
    return sizes & (F.col("light") | (pos_a <= na - need) & (pos_b <= nb - need))


def _most_size(n, pos):
    """The size of the largest set that may link with one of size ``n`` by a key at ``pos``: pos <= n - overlap, solved for the other's size."""
    by_size = F.floor(100 * n / PERCENT)
    by_place = F.floor((100 + PERCENT) * (n - pos) / PERCENT) - n
    return F.when(F.col("light"), by_size).otherwise(F.least(by_size, by_place))


def _promising(pairs: DataFrame, prefixes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose prefixes have enough in common: what follows a prefix cannot make up for more.

    ``light`` pairs are taken as they are.
    """
    side = lambda x: prefixes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("keys").alias(f"l{x}"))
    both = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")  # light sets may have no prefix here
    need = F.ceil(F.lit(PERCENT) * (F.col("na") + F.col("nb")) / (100 + PERCENT))
    # A prefix has n - ceil(0.75 n) + 1 shingles.
    after = F.ceil(F.lit(PERCENT) * F.greatest("na", "nb") / 100) - 1
    return both.where(F.col("light") | (F.size(F.array_intersect("la", "lb")) + after >= need)).select("a", "b")


def _listed(rows: DataFrame) -> DataFrame:
    """The rows (k, node, m) of lists with several nodes: k, light, node, n, pos, the list's hub, and whether the row is open.

    A row is open if its list has another one that leaves room for a link by
    size and place. One exchange by key serves all of it.
    """
    met = rows.withColumn("c", F.count("*").over(Window.partitionBy("k"))).where("c > 1")
    # Copies in several tasks make keys look shared that one node holds; they go here.
    met = met.groupBy("k", "node").agg(F.min("m").alias("m"))
    met = met.select("k", F.expr("m % 2 = 1").alias("light"), "node", F.expr("shiftright(m, 32)").alias("n"), F.expr("shiftright(m % 4294967296, 1)").alias("pos"))
    of_list = Window.partitionBy("k", "light")
    met = met.withColumns({"c": F.count("*").over(of_list), "hub": F.min(F.struct("pos", "node", "n")).over(of_list), "least": F.min("n").over(of_list)}).where("c > 1")
    met = met.withColumn("room", _most_size(F.col("n"), F.col("pos")) >= F.col("least"))
    met = met.withColumn("open", F.col("room") & (F.count_if("room").over(of_list) > 1))
    return met.select("k", "light", "node", "n", "pos", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n"), F.col("hub.pos").alias("hub_pos"), "open")


def _crossing(kept: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs (a, b, light), a > b, of nodes that a list holds, of two components, and that may link by size and place."""
    labelled = kept.where("open").select("k", "light", "node", "n", "pos").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    of_list, of_part = Window.partitionBy("k", "light"), Window.partitionBy("k", "light", "component")
    # One exchange by the list; the rows of a part stand together in it.
    labelled = labelled.repartition("k", "light").withColumn("c", F.count("*").over(of_part))
    whole = labelled.withColumns({"lo": F.min("component").over(of_list), "hi": F.max("component").over(of_list), "largest": F.max(F.struct("c", "component")).over(of_list), "all": F.count("*").over(of_list)})
    rows = whole.where("lo <> hi").select("k", "light", "node", "n", "pos", "component", F.col("largest.component").alias("largest"), F.expr(f"cast((all + {SALT_ROWS - 1}) div {SALT_ROWS} as int)").alias("salts"))
    rows = materialise(rows, "labelled")
    # The salt deals one side over tasks; the other goes to each of them.
    outside = rows.where("component <> largest").withColumn("salt", F.expr("cast(pmod(node, salts) as int)"))
    every = rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    side = lambda df, x: df.select("k", "light", "salt", *(["largest"] if x == "b" else []), F.col("component").alias(f"c{x}"), F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("pos").alias(f"p{x}"))
    # Of two nodes outside of the largest component each meets the other; one of these meetings is enough.
    once = (F.col("cb") == F.col("largest")) | (F.col("a") > F.col("b"))
    met = side(outside, "a").join(side(every, "b"), ["k", "light", "salt"]).where((F.col("ca") != F.col("cb")) & once & _may_link(F.col("na"), F.col("pa"), F.col("nb"), F.col("pb")))
    out = materialise(_distinct(met.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), "light")), "crossing")
    discard(rows)
    return out


def _distinct(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a", "b").agg(F.max("light").alias("light"))


def _nodes(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()


def jaccard_rows(docs: DataFrame, key: str = "doc_id", text_col: str = "text", boundary: int | None = None) -> DataFrame:
    """(id, row, n, node, component, component_id) of every document.

    ``row`` names a row by key and text, ``node`` its set of size ``n``, and
    ``component`` the component by its smallest node; component_id is the
    smallest key there. ``boundary``: the largest light set, at most
    LIGHT_MOST; chosen by cost if not given.
    """
    spark = docs.sparkSession
    ship(spark)
    key_type = docs.schema[key].dataType.simpleString()
    levels = spark.sparkContext.broadcast(frequency_levels(docs, text_col).tobytes())
    named = docs.select(F.col(key).alias("id"), row_name(key, text_col).alias("row"), docs[text_col].alias("text"))
    keyed = materialise(named.mapInArrow(_keyed(levels), f"id {key_type}, row bigint, n bigint, node bigint, lists array<bigint>, pairs array<bigint>, cost double"), "keyed")
    classes = materialise(keyed.where("n > 0").groupBy("node").agg(F.min("id").alias("rep"), F.min("row").alias("row")), "classes")
    boundary = choose_boundary(keyed) if boundary is None else boundary

    # Size, place in the prefix and kind of key in one number: rows are many and hashes don't compress.
    packed = "shiftleft(n, 32) + pos * 2L"
    light = keyed.where(f"n <= {boundary}").select("node", "n", F.posexplode("pairs").alias("pos", "k")).select("k", "node", F.expr(f"{packed} + 1").alias("m"))
    heavy = keyed.where(f"4 * n >= {3 * (boundary + 1)}").select("node", "n", F.posexplode("lists").alias("pos", "k")).select("k", "node", F.expr(packed).alias("m"))
    rows = heavy.unionByName(light) if boundary else heavy
    kept = materialise(_listed(rows), "kept")
    # Only keys that are shared can be common: a prefix is what is left of it.
    prefixes = materialise(kept.where("not light").groupBy("node").agg(F.max("n").alias("n"), F.collect_list("k").alias("keys")), "prefixes")

    starred = kept.where(F.col("node") != F.col("hub")).where(_may_link(F.col("n"), F.col("pos"), F.col("hub_n"), F.col("hub_pos")))
    stars = _distinct(starred.select(F.greatest("node", "hub").alias("a"), F.least("node", "hub").alias("b"), "light"))
    tried = materialise(_promising(stars, prefixes), "tried")
    sets = _candidate_sets(docs, key, text_col, _nodes(tried), classes)
    links = materialise(_links(tried, sets), "links")
    discard(sets)
    found = components(links)

    crossed = _crossing(kept, found)
    rest = materialise(_promising(crossed.join(tried, ["a", "b"], "left_anti"), prefixes), "rest")
    discard(crossed, kept, prefixes, tried)
    if not rest.isEmpty():
        sets = _candidate_sets(docs, key, text_col, _nodes(rest), classes)
        links = materialise(links.unionByName(_links(rest, sets)), "links")
        discard(sets)
        found = components(links)
    discard(rest, links)

    least = classes.join(found, "node").groupBy("component").agg(F.min("rep").alias("component_id"))
    of_node = found.join(least, "component").select("node", "component", "component_id")
    whole = classes.join(of_node, "node", "left").select("node", F.coalesce("component", "node").alias("component"), F.when(F.col("component").isNull(), F.col("rep")).otherwise(F.col("component_id")).alias("component_id"))
    rows = keyed.select("id", "row", "n", F.when(F.col("n") > 0, F.col("node")).alias("node"))
    # Rows without a set must not meet in one task.
    full = rows.where("n > 0").join(whole, "node", "left").select("id", "row", "n", "node", "component", "component_id")
    none = rows.where("n = 0").select("id", "row", "n", "node", F.lit(None).cast("bigint").alias("component"), F.col("id").alias("component_id"))
    return full.unionByName(none)


def jaccard_components(docs: DataFrame, key: str = "doc_id", text_col: str = "text", boundary: int | None = None) -> DataFrame:
    """key, n_shingles, component_id of every document."""
    rows = jaccard_rows(docs, key, text_col, boundary)
    return rows.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group: the smallest key's, null keys last, then by the row's hash.

    Of rows equal in key and text, any one stays. Rows without words are no
    group's and all stay.
    """
    columns = docs.columns
    rows = materialise(jaccard_rows(docs, key, text_col).where("n > 0").select("id", "row", "component"), "grouped")
    each = rows.groupBy("component", "id", "row").agg(F.count("*").alias("c"))
    first = each.groupBy("component").agg(F.min(F.struct(F.col("id").isNull(), "id", "row", "c")).alias("first"))
    dropped = each.join(first, "component").where(~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("row") == F.col("first.row"))))
    dropped = materialise(dropped.select(F.col("id").alias("__id"), F.col("row").alias("__name")), "dropped")
    again = materialise(first.where("first.c > 1").select(F.col("first.id").alias("__id"), F.col("first.row").alias("__name")), "again")
    discard(rows)
    # Rows that are not in the bitmap of those that go stay where they are; the others are looked up.
    named = docs.withColumn("__row", row_name(key, text_col)).withColumn("__bit", F.pmod(F.col("__row"), F.lit(BITMAP_BITS)))
    words = _bitmap(dropped.unionByName(again).select(F.pmod(F.col("__name"), F.lit(BITMAP_BITS)).alias("bit"))).toDF("__word", "__bits")
    marked = named.withColumn("__word", F.floor(F.col("__bit") / 64).cast("int")).join(F.broadcast(words), "__word", "left")
    marked = marked.withColumn("__maybe", F.expr("coalesce(getbit(__bits, cast(__bit % 64 as int)) = 1, false)"))
    same = (F.col("__row") == F.col("__name")) & F.col(key).eqNullSafe(F.col("__id"))
    kept = marked.where("__maybe").join(dropped, same, "left_anti")
    if not again.isEmpty():
        repeated = kept.join(again, same, "left_semi").dropDuplicates([key, "__row"])
        kept = kept.join(again, same, "left_anti").unionByName(repeated)
    return marked.where("not __maybe").unionByName(kept).select(*columns)
