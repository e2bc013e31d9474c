"""Keyed table comparison: small fixtures, types, validation, random tables against a plain model."""

import datetime as dt
import json
import random
from collections import Counter
from decimal import Decimal

import pytest

from spandrel.api import ArrowTable, diff_tables


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def cells(diff):
    return [tuple(r) for r in diff.cells_changed().collect()]


def one(spark, left, right, lt, rt=None):
    """The changed cells of a column v over rows with the same keys."""
    a = spark.createDataFrame(list(enumerate(left)), f"id bigint, v {lt}")
    b = spark.createDataFrame(list(enumerate(right)), f"id bigint, v {rt or lt}")
    return [c[1:] for c in cells(diff_tables(a, b, key=["id"]))]


def test_summary_of_a_small_pair(spark):
    left = spark.createDataFrame([(1, 10), (2, 20), (3, 30), (9, 90), (9, 91)], "id bigint, amount int")
    right = spark.createDataFrame([(2, 20, None), (3, 31, None), (4, 40, "x")], "id bigint, amount bigint, note string")
    d = diff_tables(left, right, key=["id"])
    assert d.summary() == dict(columns_added=1, columns_removed=0, columns_type_changed=1, rows_added=1, rows_removed=1, rows_changed=1, duplicate_keys=1, null_keys=0, cells_changed=1)
    assert cells(d) == [(3, "amount", "30", "31", "value_changed")]
    assert rows(d.rows_added()) == [(4, 40, "x")] and rows(d.rows_removed()) == [(1, 10)]
    assert rows(d.duplicate_keys()) == [(9, 2, 0)]
    out = json.loads(d.to_json())
    assert out["cells_changed"] == [{"id": "3", "column": "amount", "old_value": "30", "new_value": "31", "change": "value_changed"}]
    assert [x["change"] for x in out["schema"]] == ["type_changed", "added"]
    assert len(ArrowTable(d.rows_added())) == 1


def test_duplicates_and_null_keys(spark):
    left = spark.createDataFrame([(1, 10), (1, 11), (2, 20), (3, 30), (None, 50)], "id bigint, v int")
    right = spark.createDataFrame([(2, 20), (3, 31), (4, 40), (4, 41), (None, 50)], "id bigint, v int")
    d = diff_tables(left, right, key=["id"])
    s = d.summary()
    assert (s["rows_added"], s["rows_removed"], s["rows_changed"], s["null_keys"]) == (0, 0, 1, 1)
    assert rows(d.duplicate_keys()) == [(1, 2, 0), (4, 0, 2)]


@pytest.mark.parametrize(
    ("left", "right", "lt", "rt", "want"),
    [
        ([10, None], [None, 20], "int", "int", [("10", None, "became_null"), (None, "20", "became_non_null")]),
        (["5"], [5], "string", "bigint", [("5", "5", "type_changed")]),
        ([7], [7], "int", "bigint", []),
        ([True], [1], "boolean", "int", []),
        ([1], [1.0], "bigint", "double", []),
        ([9007199254740993], [9007199254740992.0], "bigint", "double", [("9007199254740993", "9.007199254740992e15", "value_changed")]),
        ([1], [float("nan")], "bigint", "double", [("1", "NaN", "value_changed")]),
        ([float("nan"), -0.0], [float("nan"), 0.0], "double", "double", []),
        ([0.1], [0.1], "float", "double", [("0.10000000149011612", "0.1", "value_changed")]),
        ([3.5], [4.5], "float", "float", [("3.5", "4.5", "value_changed")]),
        ([Decimal("20.0000")], [Decimal("20.5000")], "decimal(18,4)", "decimal(18,4)", [("20.0000", "20.5000", "value_changed")]),
        ([Decimal("1.50")], [Decimal("1.5000")], "decimal(10,2)", "decimal(12,4)", []),
        ([1], [Decimal("1.00")], "int", "decimal(10,2)", [("1", "1.00", "type_changed")]),
        ([b"\x01\xab"], [b"\x02"], "binary", "binary", [("01ab", "02", "value_changed")]),
        ([dt.datetime(2024, 1, 1)], [dt.datetime(2024, 1, 1, 0, 0, 0, 500000)], "timestamp_ntz", "timestamp_ntz", [("2024-01-01T00:00:00", "2024-01-01T00:00:00.500", "value_changed")]),
        ([dt.datetime(2024, 1, 1)], [dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)], "timestamp_ntz", "timestamp", [("2024-01-01T00:00:00", "2024-01-01T00:00:00[UTC]", "type_changed")]),
        ([dt.date(2024, 1, 1)], [dt.date(2024, 1, 2)], "date", "date", [("2024-01-01", "2024-01-02", "value_changed")]),
        ([dt.timedelta(seconds=-1, microseconds=-500000)], [dt.timedelta(days=1)], "interval day to second", "interval day to second", [("-PT1.5S", "PT86400S", "value_changed")]),
    ],
)
def test_cells_by_type(spark, left, right, lt, rt, want):
    assert one(spark, left, right, lt, rt) == [("v", *w) for w in want]


def test_order_names_and_nested_columns(spark):
    left = spark.createDataFrame([(2, 1, "x", [1]), (10, 1, "x", [1])], "id int, b int, `A.a` string, n array<int>")
    right = spark.createDataFrame([(2, 2, "y", [2]), (10, 2, "y", [3])], "id int, b int, `A.a` string, n array<int>")
    found = cells(diff_tables(left, right, key=["id"]))
    assert [(c[0], c[1]) for c in found] == [(10, "b"), (10, "A.a"), (2, "b"), (2, "A.a")]
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        two = spark.createDataFrame([(1, 2, 3)], "id int, x int, X int")
        assert [c[1] for c in cells(diff_tables(two, spark.createDataFrame([(1, 2, 4)], "id int, x int, X int"), key=["id"]))] == ["X"]
    finally:
        spark.conf.unset("spark.sql.caseSensitive")


def test_refusals(spark):
    df = spark.createDataFrame([(1, 2, [3])], "id bigint, v int, n array<int>")
    for key, error in (([], ValueError), (["nope"], ValueError), ("id", TypeError), (["n"], ValueError)):
        with pytest.raises(error):
            diff_tables(df, df, key=key)
    with pytest.raises(ValueError, match="id"):
        diff_tables(df, df.selectExpr("cast(id as int) id", "v"), key=["id"])
    with pytest.raises(ValueError, match="duplicate"):
        diff_tables(df.toDF("id", "v", "v"), df, key=["id"])
    for threads, error in ((0, ValueError), (1025, ValueError), ("2", TypeError)):
        with pytest.raises(error):
            diff_tables(df, df, key=["id"], threads=threads)
    with pytest.raises(TypeError, match="__arrow_c_stream__"):
        diff_tables(df, object(), key=["id"], spark=spark)
    many = spark.range(10_001)
    with pytest.raises(ValueError, match="10001"):
        diff_tables(many.where("id < 0"), many, key=["id"]).to_json()


def test_sources(spark, tmp_path):
    import pyarrow as pa

    t = pa.table({"id": pa.array([1, 2], pa.uint8()), "v": pa.array(["a", "b"]).dictionary_encode()})
    spark.createDataFrame([(1, "a"), (2, "c")], "id smallint, v string").write.parquet(str(tmp_path / "t.parquet"))
    d = diff_tables(t, str(tmp_path / "t.parquet"), key=["id"], spark=spark)
    assert cells(d) == [(2, "v", "b", "c", "value_changed")]
    assert rows(diff_tables(t.to_batches()[0], t, key=["id"], spark=spark).rows_added()) == []


def test_random_tables_against_a_plain_model(spark):
    rng = random.Random(5)
    for _ in range(6):
        side = [[(None if rng.random() < 0.15 else rng.randrange(6), rng.choice([None, 0, 1, 2])) for _ in range(rng.randrange(13))] for _ in range(2)]
        frames = [spark.createDataFrame(s, "id bigint, v int") for s in side]
        d = diff_tables(*frames, key=["id"])
        counts = [Counter(k for k, _ in s) for s in side]
        values = [dict(s) for s in side]
        keys = set(counts[0]) | set(counts[1])
        single = [k for k in keys if counts[0][k] <= 1 and counts[1][k] <= 1]
        changed = [k for k in single if counts[0][k] == counts[1][k] == 1 and values[0][k] != values[1][k]]
        s = d.summary()
        assert s["rows_added"] == sum(counts[0][k] == 0 for k in single) and s["rows_removed"] == sum(counts[1][k] == 0 for k in single)
        assert s["rows_changed"] == s["cells_changed"] == len(changed) and s["duplicate_keys"] == len(keys) - len(single) and s["null_keys"] == (None in keys)
        assert sorted(c[0] if c[0] is not None else -1 for c in cells(d)) == sorted(k if k is not None else -1 for k in changed)


def test_one_exchange_for_the_groups(spark):
    left, right = spark.range(100).selectExpr("id", "id % 3 v"), spark.range(50, 150).selectExpr("id", "id % 4 v")
    plan = diff_tables(left, right, key=["id"]).groups._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
