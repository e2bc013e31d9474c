"""Document fingerprints: invertible Bloom lookup sketches, in DataFrame operations only.

A text's paragraphs are its lines, long ones cut every PARAGRAPH characters
from their start; their 64-bit digests form a set. The fingerprint has CELLS
cells in three tables; a digest is added to one cell of each: a count, the
digests' xor and the xor of a second hash of them. Two fingerprints subtract
cell by cell, so what both have cancels, and peeling recovers the digests that
only one side has: a cell of count one whose hashes agree gives a digest, which
leaves its other cells, and so on.

If cells are left over, the difference was too large and a larger sketch is
tried: SPLIT times the cells, as SPLIT sketches of the digests of one hash
class each; only classes that fail again are split further. Each level places
digests anew, so that digests with the same cells part. What LEVELS splits
leave over is compared digest by digest. So the work stays in proportion to
the paragraphs, a document stays one row, and every difference is counted.

The likeness of two texts is the share of common paragraphs: with d recovered
digests, (a + b - d) / (a + b + d) for sets of a and b. Equal texts have equal
fingerprints. A null text is empty and has one empty paragraph, as a text of
line ends has. Repeated rows each have a fingerprint. An empty table gives an
empty result. Other columns stay as they are; one named ``fingerprint`` is
replaced.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELLS, TABLES, PARAGRAPH, SPLIT = 30, 3, 256, 8
#: Peeling ends by itself; a sketch that still has single cells after so many rounds counts as failed.
ROUNDS = 10
#: Splits tried: SPLIT ** LEVELS sketches at most for one pair of texts.
LEVELS = 6
BUCKET_BYTES, MOST_BUCKETS = 16 << 20, 20_000
_FIRST = -(1 << 63)


def _placed(x: Column, level: Column | None, **more: Column) -> Column:
    """A digest, its second hash, and its cell in each table; each takes other bits of the digest, or of its hash at ``level``."""
    per = CELLS // TABLES
    # _split takes the lowest three bits of the same hash.
    bits = x if level is None else F.xxhash64(x, level)
    cells = [F.pmod(F.call_function("shiftrightunsigned", bits, F.lit(20 * t + 3)), F.lit(per)).cast("int").alias(f"c{t}") for t in range(TABLES)]
    return F.struct(x.alias("x"), F.xxhash64(x).alias("h"), *cells, *[c.alias(k) for k, c in more.items()])


def _empty() -> Column:
    return F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("c"))


def _by_table(cell) -> Column:
    """The cells of all tables, one after the other, by ``cell(table, number in it)``."""
    per = CELLS // TABLES

    def table(t: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(per - 1)), lambda j: cell(t, j))

    return F.concat(*map(table, range(TABLES)))


def paragraphs(text: Column) -> Column:
    """The set of digests of a text's paragraphs."""
    cut = F.regexp_extract_all(text, F.lit(f"[^\\n]{{1,{PARAGRAPH}}}|\\n"), F.lit(0))
    kept = F.filter(cut, lambda p: p != "\n")
    digests = F.array_distinct(F.transform(kept, lambda p: F.xxhash64(p)))
    return F.when(F.size(digests) == 0, F.array(F.xxhash64(F.lit("")))).otherwise(digests)


def sketch(digests: Column, level: Column | None = None) -> Column:
    """The cells of a set of digests; each level places them in its own way."""
    return F.get(F.transform(F.array(F.transform(digests, lambda x: _placed(x, level))), _cells), F.lit(0))


def _cells(entries: Column) -> Column:
    def add(s: Column, e: Column) -> Column:
        return F.struct((s["n"] + 1).alias("n"), s["x"].bitwiseXOR(e["x"]).alias("x"), s["c"].bitwiseXOR(e["h"]).alias("c"))

    return _by_table(lambda t, j: F.aggregate(F.filter(entries, lambda e: e[f"c{t}"] == j), _empty(), add))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda p, q: F.struct((p["n"] - q["n"]).alias("n"), p["x"].bitwiseXOR(q["x"]).alias("x"), p["c"].bitwiseXOR(q["c"]).alias("c")))


def _single(cells: Column, level: Column | None) -> Column:
    """The digests of cells that hold one, with its sign."""
    found = F.filter(cells, lambda c: ((c["n"] == 1) | (c["n"] == -1)) & (F.xxhash64(c["x"]) == c["c"]))
    return F.array_distinct(F.transform(found, lambda c: _placed(c["x"], level, n=c["n"])))


def _without(cells: Column, keys: Column) -> Column:
    per = CELLS // TABLES

    def take(s: Column, k: Column) -> Column:
        return F.struct((s["n"] - k["n"]).alias("n"), s["x"].bitwiseXOR(k["x"]).alias("x"), s["c"].bitwiseXOR(k["h"]).alias("c"))

    return _by_table(lambda t, j: F.aggregate(F.filter(keys, lambda k: k[f"c{t}"] == j), F.get(cells, j + t * per), take))


def peel(cells: Column, level: Column | None = None) -> Column:
    """(d, done): how many digests came out, and whether nothing is left."""
    start = F.struct(cells.alias("cells"), F.lit(0).alias("d"), _single(cells, level).alias("keys"))

    def step(s: Column, _: Column) -> Column:
        left = _without(s["cells"], s["keys"])
        return F.when(F.size(s["keys"]) == 0, s).otherwise(F.struct(left.alias("cells"), (s["d"] + F.size(s["keys"])).alias("d"), _single(left, level).alias("keys")))

    end = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)
    return F.struct(end["d"].alias("d"), (~F.exists(end["cells"], lambda c: (c["n"] != 0) | (c["x"] != 0) | (c["c"] != 0))).alias("done"))


def encoded(cells: Column) -> Column:
    """A sketch as text: 20 bytes a cell."""
    hexes = F.transform(cells, lambda c: F.concat(F.lpad(F.hex(c["n"]), 8, "0"), F.lpad(F.hex(c["x"]), 16, "0"), F.lpad(F.hex(c["c"]), 16, "0")))
    return F.translate(F.base64(F.unhex(F.array_join(hexes, ""))), "\r\n", "")


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _split(parts: Column, level: Column) -> Column:
    """Each pair of sets as SPLIT pairs, one a hash class."""

    def split(p: Column) -> Column:
        def one(i: Column) -> Column:
            inside = lambda x: F.pmod(F.xxhash64(x, level), F.lit(SPLIT)) == i
            return F.struct(p["kind"].alias("kind"), F.filter(p["a"], inside).alias("a"), F.filter(p["b"], inside).alias("b"))

        return F.transform(F.sequence(F.lit(0), F.lit(SPLIT - 1)), one)

    return F.flatten(F.transform(parts, split))


def _tried(p: Column, cells: Column, level: Column | None = None) -> Column:
    return F.struct(p["kind"].alias("kind"), p["a"].alias("a"), p["b"].alias("b"), peel(cells, level).alias("r"))


def _recovered(tried: Column) -> Column:
    return F.transform(F.filter(tried, lambda t: t["r"]["done"]), lambda t: F.struct(t["kind"].alias("kind"), t["r"]["d"].alias("d")))


def _rest(tried: Column) -> Column:
    return F.transform(F.filter(tried, lambda t: ~t["r"]["done"]), lambda t: F.struct(t["kind"].alias("kind"), t["a"].alias("a"), t["b"].alias("b")))


def with_differences(df: DataFrame, pairs: dict[str, tuple[str, str, str, str]]) -> DataFrame:
    """``df`` with a column for each of ``pairs`` (set, set, their sketches): how many digests one only of the sets has."""
    names = list(pairs)
    first = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(a).alias("a"), F.col(b).alias("b"), subtract(F.col(ca), F.col(cb)).alias("cells")) for k, (a, b, ca, cb) in enumerate(pairs.values())])
    df = df.withColumn("__first", F.transform(first, lambda p: _tried(p, p["cells"])))
    start = F.struct(_rest(F.col("__first")).alias("parts"), _recovered(F.col("__first")).alias("out"))

    def step(s: Column, level: Column) -> Column:
        def more() -> Column:
            tried = F.transform(_split(s["parts"], level), lambda p: _tried(p, subtract(sketch(p["a"], level), sketch(p["b"], level)), level))
            return _let(tried, lambda t: F.struct(_rest(t).alias("parts"), F.concat(s["out"], _recovered(t)).alias("out")))

        return F.when(F.size(s["parts"]) == 0, s).otherwise(more())

    df = df.withColumn("__end", F.aggregate(F.sequence(F.lit(1), F.lit(LEVELS)), start, step))
    apart = lambda p: F.size(F.array_except(p["a"], p["b"])) + F.size(F.array_except(p["b"], p["a"]))
    rest = lambda k: F.aggregate(F.filter("__end.parts", lambda p: p["kind"] == k), F.lit(0), lambda s, p: s + apart(p))
    count = lambda k: F.aggregate(F.filter("__end.out", lambda o: o["kind"] == k), F.lit(0), lambda s, o: s + o["d"])
    return df.withColumns({n: count(k) + rest(k) for k, n in enumerate(names)}).drop("__first", "__end")


def likeness(a: str, b: str, d: str) -> Column:
    both = F.size(a) + F.size(b)
    return (both - F.col(d)) / (both + F.col(d)).cast("double")


def with_next(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, text, next_text): each text and that of the next key, after the last the first.

    Ranges of the key go to buckets of about BUCKET_BYTES; the first document of
    each bucket also goes to the end of the bucket before, so that one exchange
    brings neighbours together. Keys are whole numbers; null keys, and others
    that are none, come first; ties go by text. Other columns are left out.
    """
    rows = docs.select(F.col(key), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(key).cast("long"), F.lit(_FIRST)).alias("__at"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = int(max(1, min(MOST_BUCKETS, -(-size // BUCKET_BYTES))))
    bounds = []
    if n > 1:
        got = rows.agg(F.percentile_approx("__at", [i / n for i in range(1, n)], max(10_000, 10 * n)).alias("q")).first()["q"]
        bounds = sorted({float(x) for x in got})
    if bounds:
        ranges = Bucketizer(splits=[-float("inf"), *bounds, float("inf")], inputCol="__place", outputCol="__bucket")
        rows = ranges.transform(rows.withColumn("__place", F.col("__at").cast("double"))).drop("__place")
    else:
        rows = rows.withColumn("__bucket", F.lit(0.0))
    heads = rows.groupBy("__bucket").agg(F.min("__at").alias("__head"))
    # One row a bucket.
    order = Window.orderBy("__b")
    last = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.withColumnRenamed("__bucket", "__b").withColumn("__before", F.coalesce(F.lag("__b").over(order), F.max("__b").over(last)))
    placed = rows.join(heads, (F.col("__bucket") == F.col("__b")) & (F.col("__at") == F.col("__head")), "left")
    here = F.struct(F.col("__bucket").alias("bucket"), F.lit(False).alias("ghost"))
    before = F.struct(F.col("__before").alias("bucket"), F.lit(True).alias("ghost"))
    spread = placed.select(key, "text", "__at", F.explode(F.when(F.col("__before").isNull(), F.array(here)).otherwise(F.array(here, before))).alias("p"))
    in_bucket = Window.partitionBy("p.bucket").orderBy("p.ghost", "__at", "text")
    return spread.withColumn("next_text", F.lead("text").over(in_bucket)).where(~F.col("p.ghost")).select(key, "text", "next_text")


def fingerprint(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with column fingerprint."""
    return docs.withColumn("fingerprint", encoded(sketch(paragraphs(F.coalesce(F.col(text_col), F.lit(""))))))
