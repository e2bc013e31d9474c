"""Keyed comparison of two tables."""

from __future__ import annotations

import json
from functools import cached_property, reduce
from operator import and_
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spandrel.functions.render import rendered
from spandrel.functions.semantics import change, domain, nested
from spandrel.plans.keyed import form, grouped, label, placed
from spandrel.sources.tables import as_dataframe

from .schema_diff import SCHEMA_DIFF, check_schema, schema_diff, types_equal

MAX_THREADS = 1024
#: Rows that to_json() writes at most, all members together.
MAX_JSON_ROWS = 10_000
CELLS = "array<struct<rank:int,column:string,old_value:string,new_value:string,change:string>>"


def check_threads(threads: int | None) -> int | None:
    if threads is None:
        return None
    if isinstance(threads, bool) or not isinstance(threads, int):
        raise TypeError("threads must be an int")
    if not 1 <= threads <= MAX_THREADS:
        raise ValueError(f"threads must be from 1 to {MAX_THREADS}")
    return threads


def check_key(key: Any, left: T.StructType, right: T.StructType) -> list[str]:
    if isinstance(key, str):
        raise TypeError("key must be a list of column names, not a str")
    key = list(key)
    if not key:
        raise ValueError("key must name at least one column")
    if len(set(key)) != len(key):
        raise ValueError("key names a column twice")
    for side, schema in (("left", left), ("right", right)):
        for k in key:
            if k not in schema.names:
                raise ValueError(f"key column {k!r} is not in the {side} table")
    for k in key:
        a, b = _type(left, k), _type(right, k)
        if not types_equal(a, b):
            raise ValueError(f"key column {k!r} is {a.simpleString()} on the left and {b.simpleString()} on the right")
    for side, schema in (("left", left), ("right", right)):
        for f in schema.fields:
            if domain(f.dataType) is None and (f.name in key or not nested(f.dataType)):
                raise ValueError(f"{side} column {f.name!r}: {f.dataType.simpleString()} cannot be compared")
    return key


def _type(schema: T.StructType, name: str) -> T.DataType:
    return next(f.dataType for f in schema.fields if f.name == name)


class TableDiff:
    """What differs between two tables; every member is a lazy DataFrame."""

    def __init__(self, left: DataFrame, right: DataFrame, key: list[str]):
        self.left, self.right, self.key = left, right, key
        self.schema = schema_diff(left.schema, right.schema)
        theirs = {f.name for f in right.schema.fields if not nested(f.dataType)}
        #: Columns that are compared: on both sides, nested on neither.
        self.values = [f.name for f in left.schema.fields if f.name not in key and f.name in theirs and not nested(f.dataType)]
        at = lambda names: [(left.columns.index(c), right.columns.index(c)) for c in names]
        self.groups = grouped(left, right, at(key), at(self.values))

    # The grouped relation

    def persist(self, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> TableDiff:
        """Keep the grouped relation for several members."""
        self.groups = self.groups.persist(level)
        return self

    def unpersist(self) -> None:
        self.groups.unpersist()

    def _keys(self, groups: DataFrame) -> list[Column]:
        return [F.col(f"k{i}") for i in range(len(self.key))]

    @cached_property
    def _paired(self) -> str:
        return "lc = 1 AND rc = 1"

    def _types(self, name: str) -> tuple[T.DataType, T.DataType]:
        return _type(self.left.schema, name), _type(self.right.schema, name)

    def _cells(self, old, new) -> Column:
        """The changed cells of a pair of rows: structs of rank, column, old_value, new_value, change; ``old`` and ``new`` give a column by its rank."""
        cells = []
        for rank, name in enumerate(self.values):
            lt, rt = self._types(name)
            kind = change(old(rank), new(rank), lt, rt)
            shown = F.struct(F.lit(rank).alias("rank"), F.lit(name).alias("column"), rendered(old(rank), lt, rt).alias("old_value"), rendered(new(rank), rt, lt).alias("new_value"), kind.alias("change"))
            cells.append(F.when(kind.isNotNull(), shown))
        return F.filter(F.array(*cells), lambda c: c.isNotNull())

    def _changes(self) -> Column:
        """How many cells of a pair of rows have changed."""
        total = F.lit(0)
        for i, name in enumerate(self.values):
            total = total + F.when(label(i, *self._types(name)).isNotNull(), 1).otherwise(0)
        return total

    def _changed(self) -> DataFrame:
        """The pairs of rows with changed cells: k0.., and c, their cells."""
        changed = self.groups.where(self._paired).where(self._changes() > 0)
        keys = self._keys(changed)
        fetched = [i for i, name in enumerate(self.values) if form(*self._types(name)) != "value"]
        # What groups don't carry comes from the tables, for changed rows only; it is compared whole.
        rows = changed.drop("lc", "rc")
        for df, side in ((self.left, "l"), (self.right, "r")) if fetched else ():
            own = placed(df, side)
            at = lambda name: F.col(f"{side}{df.columns.index(name)}")  # noqa: B023, E731
            own = own.select(*[at(k).alias(f"{side}k{i}") for i, k in enumerate(self.key)], *[at(self.values[i]).alias(f"{side}v{i}") for i in fetched])
            same = reduce(and_, [F.col(f"k{i}").eqNullSafe(F.col(f"{side}k{i}")) for i in range(len(self.key))])
            rows = rows.join(own, same).drop(*[f"{side}k{i}" for i in range(len(self.key))])
        cell = lambda side: lambda i: F.col(f"{side}v{i}" if i in fetched else f"{side}{i}")
        return rows.select(*keys, self._cells(cell("l"), cell("r")).alias("c"))

    # Members

    def _rows_of(self, df: DataFrame, where: str) -> DataFrame:
        """Whole rows of one side whose key's group is such; its other columns never met the exchange above."""
        found = self.groups.where(where).select(*self._keys(self.groups))
        names = [f"c{i}" for i in range(len(df.columns))]
        side = df.toDF(*names)
        same = None
        for i, k in enumerate(self.key):
            one = F.col(names[df.columns.index(k)]).eqNullSafe(F.col(f"k{i}"))
            same = one if same is None else same & one
        return side.join(found, same, "left_semi").toDF(*df.columns)

    def rows_added(self) -> DataFrame:
        return self._rows_of(self.right, "lc = 0 AND rc = 1")

    def rows_removed(self) -> DataFrame:
        return self._rows_of(self.left, "lc = 1 AND rc = 0")

    def cells_changed(self, ordered: bool = True) -> DataFrame:
        """Key columns, column, old_value, new_value, change; by the keys as text (nulls first), then by the left table's column order."""
        found = self._changed() if self.values else self.groups.where("false").select(*self._keys(self.groups), F.array().cast(CELLS).alias("c"))
        cells = found.select(*self._keys(found), F.explode("c").alias("c"))
        if ordered:
            # A sort samples what is below it first: this exchange of the changes keeps the sample from comparing all again.
            cells = cells.repartition(*self._keys(cells))
            shown = [rendered(F.col(f"k{i}"), _type(self.left.schema, k), suffix=False).asc_nulls_first() for i, k in enumerate(self.key)]
            cells = cells.orderBy(*shown, F.col("c.rank"))
        names = [*self.key, "column", "old_value", "new_value", "change"]
        return cells.select(*self._keys(cells), "c.column", "c.old_value", "c.new_value", "c.change").toDF(*names)

    def duplicate_keys(self) -> DataFrame:
        found = self.groups.where("lc > 1 OR rc > 1").select(*self._keys(self.groups), "lc", "rc")
        return found.toDF(*self.key, "left_count", "right_count")

    def summary_frame(self) -> DataFrame:
        """One row of nine counters, in one pass over the groups."""
        null_key = F.lit(False)
        for i in range(len(self.key)):
            null_key = null_key | F.col(f"k{i}").isNull()
        cells = F.when(F.expr(self._paired), self._changes()).otherwise(0)
        counted = self.groups.select("lc", "rc", null_key.alias("null_key"), cells.alias("cells"))
        schema = {c: sum(x["change"] == c for x in self.schema) for c in ("added", "removed", "type_changed")}
        count = lambda cond: F.coalesce(F.count_if(cond), F.lit(0))
        return counted.agg(
            *[F.lit(n).cast("bigint").alias(f"columns_{c}") for c, n in schema.items()],
            count(F.expr("lc = 0 AND rc = 1")).alias("rows_added"),
            count(F.expr("lc = 1 AND rc = 0")).alias("rows_removed"),
            count(F.col("cells") > 0).alias("rows_changed"),
            count(F.expr("lc > 1 OR rc > 1")).alias("duplicate_keys"),
            count(F.col("null_key")).alias("null_keys"),
            F.coalesce(F.sum("cells"), F.lit(0)).cast("bigint").alias("cells_changed"),
        )

    def summary(self) -> dict[str, int]:
        return self.summary_frame().first().asDict()

    def schema_frame(self) -> DataFrame:
        return self.left.sparkSession.createDataFrame([tuple(x.values()) for x in self.schema], SCHEMA_DIFF)

    # Exports

    def schema_arrow(self):
        return self.schema_frame().toArrow()

    def to_json(self) -> str:
        """Everything as one JSON text; refused beyond MAX_JSON_ROWS rows."""
        self.persist()  # five members read the groups
        try:
            counts = self.summary()
            rows = sum(counts[c] for c in ("rows_added", "rows_removed", "cells_changed", "duplicate_keys"))
            if rows > MAX_JSON_ROWS:
                raise ValueError(f"{rows} rows are more than the {MAX_JSON_ROWS} that to_json() writes")
            out: dict[str, Any] = {"schema": self.schema, "summary": counts}
            for name in ("rows_added", "rows_removed", "cells_changed", "duplicate_keys"):
                out[name] = rows_json(getattr(self, name)())
        finally:
            self.unpersist()
        return json.dumps(out, ensure_ascii=False, separators=(",", ":"))

    def __repr__(self) -> str:
        return f"TableDiff(key={self.key!r}, schema_changes={len(self.schema)}, compared={self.values!r})"


def rows_json(df: DataFrame) -> list[dict[str, str | None]]:
    """Rows as objects of rendered cells; the caller bounds their number."""
    names = df.columns
    placed = df.toDF(*[f"c{i}" for i in range(len(names))])
    cells = [F.to_json(F.col(f.name)) if nested(f.dataType) else rendered(F.col(f.name), f.dataType, suffix=False) for f in placed.schema.fields]
    return [dict(zip(names, r, strict=True)) for r in placed.select(*[c.alias(f"c{i}") for i, c in enumerate(cells)]).toLocalIterator()]


def diff_tables(left: Any, right: Any, *, key: list[str], threads: int | None = None, spark: SparkSession | None = None) -> TableDiff:
    """Compare two tables (frames, files, catalog tables, Arrow or pandas objects) by key.

    ``threads`` is checked and otherwise left to Spark.
    """
    if isinstance(key, str):
        raise TypeError("key must be a list of column names, not a str")
    check_threads(threads)
    if not list(key):
        raise ValueError("key must name at least one column")
    left, right = as_dataframe(left, spark), as_dataframe(right, spark)
    check_schema(left.schema, "left")
    check_schema(right.schema, "right")
    return TableDiff(left, right, check_key(key, left.schema, right.schema))
