"""The grouped relation of two tables by key: one exchange for all outputs.

Both sides go into one union, tagged, and are grouped by key. A group has the
rows of each side and, of a pair, what tells its cells apart: a cell of fixed
width as it is, a text or binary as 128 bits of digest, and of two domains that
never compare only whether the cell is null. All of it has fixed width, so
Spark groups by hash and never sorts whole rows; texts stay where they are.
Texts that differ have the same digest once in 2**128 pairs, if nobody makes
them so. The grouping combines on the map side, so a key that repeats without
bound is a pair of counts there.

Columns go by position under names of their own, which keeps names apart that
differ in case only, and names with dots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spandrel.functions.semantics import change, domain

LEFT, RIGHT = "l", "r"


def placed(df: DataFrame, side: str) -> DataFrame:
    """The columns by position: l0, l1, ... or r0, r1, ..."""
    return df.toDF(*[f"{side}{i}" for i in range(len(df.columns))])


def form(lt: T.DataType, rt: T.DataType) -> str:
    """How a cell of these types goes into a group: there, digest or value."""
    if domain(lt) != domain(rt) or domain(lt) == "null":
        return "there"
    return "digest" if domain(lt) in ("string", "binary") else "value"


def _carried(c: Column, name: str, how: str) -> list[Column]:
    if how == "there":
        return [c.isNotNull().alias(name)]
    if how == "digest":
        return [F.when(c.isNotNull(), h).alias(f"{name}{x}") for x, h in (("a", F.xxhash64(c)), ("b", F.xxhash64(F.lit(1), c)))]
    return [c.alias(name)]


def label(i: int, lt: T.DataType, rt: T.DataType) -> Column:
    """The label of the change of value column ``i`` of a group, or null."""
    how = form(lt, rt)
    if how == "there":
        return change(*(F.when(F.col(f"{side}{i}"), 1) for side in (LEFT, RIGHT)), lt, rt)
    if how == "value":
        return change(F.col(f"{LEFT}{i}"), F.col(f"{RIGHT}{i}"), lt, rt)
    a, b = (change(F.col(f"{LEFT}{i}{x}"), F.col(f"{RIGHT}{i}{x}"), T.LongType(), T.LongType()) for x in "ab")
    return F.coalesce(a, b)


def grouped(left: DataFrame, right: DataFrame, key: list[tuple[int, int]], values: list[tuple[int, int]]) -> DataFrame:
    """k0.., lc, rc (rows of each side), and what a pair's value columns carry (l0.., r0.., see ``form``).

    ``key`` and ``values`` pair positions on the left and on the right.
    """
    lt, rt = ([f.dataType for f in df.schema.fields] for df in (left, right))

    def side(df: DataFrame, name: str, which: int) -> DataFrame:
        own = placed(df, name)
        keys = [F.col(f"{name}{p[which]}").alias(f"k{i}") for i, p in enumerate(key)]
        mine = [c for i, p in enumerate(values) for c in _carried(F.col(f"{name}{p[which]}"), f"{name}_{i}", form(lt[p[0]], rt[p[1]]))]
        return own.select(*keys, F.lit(1 - which).cast("bigint").alias("lc"), F.lit(which).cast("bigint").alias("rc"), *mine)

    both = side(left, LEFT, 0).unionByName(side(right, RIGHT, 1), allowMissingColumns=True)
    carried = [c for c in both.columns if c[:2] in (f"{LEFT}_", f"{RIGHT}_")]
    # Of one row that is there, the greatest value is its value.
    return both.groupBy(*[f"k{i}" for i in range(len(key))]).agg(F.sum("lc").alias("lc"), F.sum("rc").alias("rc"), *[F.max(c).alias(c.replace("_", "")) for c in carried])
