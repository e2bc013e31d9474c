"""Differences of two schemas, from metadata alone."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import types as T

from spandrel.errors import MaxDepthError

MAX_NESTING = 128

SCHEMA_DIFF = T.StructType(
    [
        T.StructField("column", T.StringType(), False),
        T.StructField("change", T.StringType(), False),
        T.StructField("left_type", T.StringType()),
        T.StructField("right_type", T.StringType()),
        T.StructField("left_nullable", T.BooleanType()),
        T.StructField("right_nullable", T.BooleanType()),
    ]
)


def nests_deeper(t: T.DataType, limit: int = MAX_NESTING) -> bool:
    level, depth = [t], 0
    while level:
        if depth > limit:
            return True
        level = [c for x in level for c in _inner(x)]
        depth += 1
    return False


def _inner(t: T.DataType) -> list[T.DataType]:
    if isinstance(t, T.StructType):
        return [f.dataType for f in t.fields]
    if isinstance(t, T.ArrayType):
        return [t.elementType]
    return [t.keyType, t.valueType] if isinstance(t, T.MapType) else []


def normalised(t: T.DataType) -> T.DataType:
    """A type without nullability; a list of key and value is a map; all texts are one."""
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, normalised(f.dataType)) for f in t.fields])
    if isinstance(t, T.ArrayType):
        e = t.elementType
        if isinstance(e, T.StructType) and [f.name for f in e.fields] == ["key", "value"]:
            return T.MapType(normalised(e.fields[0].dataType), normalised(e.fields[1].dataType))
        return T.ArrayType(normalised(e))
    if isinstance(t, T.MapType):
        return T.MapType(normalised(t.keyType), normalised(t.valueType))
    return T.StringType() if isinstance(t, T.CharType | T.VarcharType | T.StringType) else t


def types_equal(a: T.DataType, b: T.DataType) -> bool:
    return normalised(a) == normalised(b)


def check_schema(schema: T.StructType, side: str) -> None:
    repeated = [c for c, n in Counter(schema.names).items() if n > 1]
    if repeated:
        raise ValueError(f"{side} table: duplicate column {repeated[0]!r}")
    for f in schema.fields:
        if nests_deeper(f.dataType):
            raise MaxDepthError(f"{side} column {f.name!r}", MAX_NESTING)


def schema_diff(left: T.StructType, right: T.StructType) -> list[dict]:
    """Left columns in their order (removed, type_changed), then those only on the right (added)."""
    check_schema(left, "left")
    check_schema(right, "right")
    mine, theirs = ({f.name: f for f in s.fields} for s in (left, right))
    out = []
    for f in left.fields:
        other = theirs.get(f.name)
        if other is None:
            out.append(_change(f.name, "removed", f, None))
        elif not types_equal(f.dataType, other.dataType):
            out.append(_change(f.name, "type_changed", f, other))
    return out + [_change(f.name, "added", None, f) for f in right.fields if f.name not in mine]


def _change(name: str, change: str, left: T.StructField | None, right: T.StructField | None) -> dict:
    return {
        "column": name,
        "change": change,
        "left_type": left and left.dataType.simpleString(),
        "right_type": right and right.dataType.simpleString(),
        "left_nullable": left and left.nullable,
        "right_nullable": right and right.nullable,
    }
