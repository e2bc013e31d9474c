"""When two cells differ, and what kind of change that is.

Decided from the types when the plan is built, so Spark's own coercions (text
with number, date with timestamp) never decide. Nulls equal only nulls. NaN
equals NaN and both zeros are one. Whole numbers, floats and booleans compare
by value, decimals by value whatever their scale.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATS = (T.FloatType, T.DoubleType)
NESTED = (T.ArrayType, T.MapType, T.StructType)
#: Beyond it a double no longer tells whole numbers apart.
EXACT = 1 << 53


def domain(t: T.DataType) -> str | None:
    """The value domain of a type; None if cells of it cannot be compared."""
    if isinstance(t, T.NullType):
        return "null"
    if isinstance(t, (T.BooleanType, *WHOLE, *FLOATS)):
        return "number"
    if isinstance(t, T.DecimalType):
        return "decimal"
    if isinstance(t, T.StringType | T.CharType | T.VarcharType):
        return "string"
    if isinstance(t, T.BinaryType):
        return "binary"
    if isinstance(t, T.TimestampType):
        return "timestamp with zone"
    if isinstance(t, T.TimestampNTZType):
        return "timestamp"
    if isinstance(t, T.DateType):
        return "date"
    if type(t).__name__ == "TimeType":
        return "time"
    if isinstance(t, T.DayTimeIntervalType):
        return "duration"
    if isinstance(t, T.YearMonthIntervalType):
        return "months"
    return None


def nested(t: T.DataType) -> bool:
    return isinstance(t, NESTED) or type(t).__name__ == "VariantType"


def _whole(c: Column, t: T.DataType) -> Column:
    return c.cast("bigint") if isinstance(t, T.BooleanType) else c


def equal_values(left: Column, right: Column, lt: T.DataType, rt: T.DataType) -> Column:
    """Whether two cells of one domain that are not null are equal."""
    left, right = _whole(left, lt), _whole(right, rt)
    if isinstance(lt, FLOATS) and isinstance(rt, FLOATS):
        return left.cast("double").eqNullSafe(right.cast("double"))
    if isinstance(lt, FLOATS) or isinstance(rt, FLOATS):
        number, whole = (left, right) if isinstance(lt, FLOATS) else (right, left)
        number = number.cast("double")
        inside = F.abs(number) <= F.lit(float(EXACT))
        as_whole = F.when(inside, F.floor(number)).cast("bigint")
        return F.coalesce(inside & (number == F.floor(number)) & (as_whole == whole.cast("bigint")), F.lit(False))
    return left.eqNullSafe(right)


def change(left: Column, right: Column, lt: T.DataType, rt: T.DataType) -> Column:
    """The label of a cell's change, or null."""
    label = F.when(left.isNull() & right.isNull(), F.lit(None).cast("string")).when(right.isNull(), "became_null").when(left.isNull(), "became_non_null")
    if "null" in (domain(lt), domain(rt)):
        return label
    if domain(lt) != domain(rt):
        return label.otherwise("type_changed")
    return label.when(~equal_values(left, right, lt, rt), "value_changed")
