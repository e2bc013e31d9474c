"""Registered queries of the comparison operators, and the same in SQL.

The test data is one snapshot, so both sides of a comparison are derived from
a table by SQL that Spark and DuckDB read alike.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.documents import diff_json_column, findings, unified_diff_column
from .operators.table_diff import TableDiff, diff_tables
from .runtime import table


@dataclass(frozen=True)
class Pair:
    """Two sides by SQL, with ``{table}`` for a table."""

    name: str
    left: str
    right: str
    key: tuple[str, ...]
    #: Compared columns in the left side's order, with (as text left, as text right, whether the domains differ).
    values: tuple[str, ...]
    retyped: frozenset[str] = field(default_factory=frozenset)

    def frames(self, spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
        source = {self.name: table(spark, sf_dir, self.name)}
        return spark.sql(self.left, **source), spark.sql(self.right, **source)

    def diff(self, spark: SparkSession, sf_dir: str) -> TableDiff:
        left, right = self.frames(spark, sf_dir)
        return diff_tables(left, right, key=list(self.key))

    # SQL

    def _with(self) -> str:
        keys = ", ".join(self.key)
        on = lambda a, b: " AND ".join(f"{a}.{k} IS NOT DISTINCT FROM {b}.{k}" for k in self.key)
        return (
            f"WITH l AS ({self.left.format(**{self.name: self.name})}), r AS ({self.right.format(**{self.name: self.name})}), "
            f"g AS (SELECT {keys}, sum(s) AS lc, sum(1 - s) AS rc FROM (SELECT {keys}, 1 AS s FROM l UNION ALL SELECT {keys}, 0 AS s FROM r) GROUP BY {keys}), "
            f"p AS (SELECT {', '.join([f'l.{k}' for k in self.key] + [f'l.{v} AS l_{v}, r.{v} AS r_{v}' for v in self.values])} FROM g JOIN l ON {on('g', 'l')} JOIN r ON {on('g', 'r')} WHERE g.lc = 1 AND g.rc = 1) "
        )

    def _differs(self, v: str) -> str:
        return f"(l_{v} IS NOT NULL OR r_{v} IS NOT NULL)" if v in self.retyped else f"l_{v} IS DISTINCT FROM r_{v}"

    def cells_sql(self) -> str:
        keys = ", ".join(self.key)
        parts = []
        for v in self.values:
            label = f"CASE WHEN r_{v} IS NULL THEN 'became_null' WHEN l_{v} IS NULL THEN 'became_non_null' ELSE '{'type' if v in self.retyped else 'value'}_changed' END"
            parts.append(f"SELECT {keys}, '{v}' AS \"column\", CAST(l_{v} AS VARCHAR) AS old_value, CAST(r_{v} AS VARCHAR) AS new_value, {label} AS change FROM p WHERE {self._differs(v)}")
        return self._with() + " UNION ALL ".join(parts)

    def rows_sql(self, side: str) -> str:
        where = "g.lc = 0 AND g.rc = 1" if side == "r" else "g.lc = 1 AND g.rc = 0"
        on = " AND ".join(f"g.{k} IS NOT DISTINCT FROM {side}.{k}" for k in self.key)
        return self._with() + f"SELECT {side}.* FROM {side} JOIN g ON {on} WHERE {where}"

    def duplicates_sql(self) -> str:
        return self._with() + f"SELECT {', '.join(self.key)}, CAST(lc AS BIGINT) AS left_count, CAST(rc AS BIGINT) AS right_count FROM g WHERE lc > 1 OR rc > 1"

    def summary_sql(self, added: int = 0, removed: int = 0, changed: int = 0) -> str:
        cells = " + ".join(f"CASE WHEN {self._differs(v)} THEN 1 ELSE 0 END" for v in self.values) or "0"
        null_key = " OR ".join(f"{k} IS NULL" for k in self.key)
        return self._with() + (
            f"SELECT CAST({added} AS BIGINT) AS columns_added, CAST({removed} AS BIGINT) AS columns_removed, CAST({changed} AS BIGINT) AS columns_type_changed, "
            "(SELECT count(*) FROM g WHERE lc = 0 AND rc = 1) AS rows_added, (SELECT count(*) FROM g WHERE lc = 1 AND rc = 0) AS rows_removed, "
            f"(SELECT count(*) FROM p WHERE {cells} > 0) AS rows_changed, (SELECT count(*) FROM g WHERE lc > 1 OR rc > 1) AS duplicate_keys, "
            f"(SELECT count(*) FROM g WHERE {null_key}) AS null_keys, (SELECT CAST(coalesce(sum({cells}), 0) AS BIGINT) FROM p) AS cells_changed"
        )


ORDERS = Pair(
    "orders",
    "SELECT o_orderkey, o_custkey, o_orderstatus, CAST(floor(o_totalprice) AS BIGINT) AS price, CASE WHEN o_orderkey % 23 <> 0 THEN o_orderpriority END AS o_orderpriority FROM {orders} WHERE o_orderkey % 11 <> 0",
    "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 17 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CAST(floor(o_totalprice) AS BIGINT) + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS price, "
    "CASE WHEN o_orderkey % 19 <> 0 THEN o_orderpriority END AS o_orderpriority FROM {orders} WHERE o_orderkey % 13 <> 0",
    ("o_orderkey",),
    ("o_custkey", "o_orderstatus", "price", "o_orderpriority"),
)
LINEITEM = Pair(
    "lineitem",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS quantity, l_returnflag FROM {lineitem} WHERE l_partkey % 11 <> 0",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey + CASE WHEN l_orderkey % 5 = 0 THEN 1 ELSE 0 END AS l_suppkey, CAST(l_quantity AS BIGINT) AS quantity, CASE WHEN l_partkey % 3 = 0 THEN l_returnflag ELSE 'Z' END AS l_returnflag FROM {lineitem} WHERE l_suppkey % 7 <> 0",
    ("l_orderkey", "l_linenumber"),
    ("l_partkey", "l_suppkey", "quantity", "l_returnflag"),
)
CONVERSATIONS = Pair(
    "conversations",
    "SELECT conv_id, turn, role, text FROM {conversations} WHERE conv_id % 9 <> 0",
    "SELECT conv_id, turn, CASE WHEN turn % 5 = 1 THEN upper(role) ELSE role END AS role, CASE WHEN conv_id % 4 = 0 THEN replace(text, 'e', 'E') ELSE text END AS text FROM {conversations} WHERE turn < 6",
    ("conv_id", "turn"),
    ("role", "text"),
)
EVENTS = Pair(
    "events",
    "SELECT event_id, user_id, event_type, CASE WHEN event_id % 3 <> 0 THEN props END AS props FROM {events}",
    "SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN user_id END AS user_id, event_type, CASE WHEN event_id % 4 <> 0 THEN props END AS props FROM {events}",
    ("event_id",),
    ("user_id", "event_type", "props"),
)
EVENT_USERS = Pair(
    "events",
    "SELECT nullif(user_id, 7) AS user_id, event_type, count(*) AS n FROM {events} WHERE event_id % 2 = 0 GROUP BY nullif(user_id, 7), event_type",
    "SELECT nullif(user_id, 7) AS user_id, event_type, count(*) AS n FROM {events} WHERE event_id % 3 = 0 GROUP BY nullif(user_id, 7), event_type",
    ("user_id", "event_type"),
    ("n",),
)
PART = Pair(
    "part",
    "SELECT p_partkey, p_size, CAST(p_size AS BIGINT) AS size_wide, CAST(p_partkey AS INT) AS label FROM {part}",
    "SELECT p_partkey, CAST(p_size AS VARCHAR(20)) AS p_size, CAST(p_size AS DOUBLE) AS size_wide, CAST(CASE WHEN p_partkey % 6 = 0 THEN -p_partkey ELSE p_partkey END AS BIGINT) AS label FROM {part}",
    ("p_partkey",),
    ("p_size", "size_wide", "label"),
    frozenset({"p_size"}),
)
SUPPLIER = Pair(
    "supplier",
    "SELECT s_suppkey, CAST(s_nationkey AS DECIMAL(10,2)) AS amount, s_name FROM {supplier}",
    "SELECT s_suppkey, CAST(CASE WHEN s_suppkey % 3 = 0 THEN s_nationkey + 1 ELSE s_nationkey END AS DECIMAL(12,4)) AS amount, lower(s_name) AS s_name, 1 AS extra FROM {supplier}",
    ("s_suppkey",),
    ("amount", "s_name"),
)
EMBEDDINGS = Pair(
    "embeddings",
    "SELECT vec_id, embedding, label FROM {embeddings}",
    "SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN embedding END AS embedding, label + CASE WHEN vec_id % 5 = 0 THEN 1 ELSE 0 END AS label FROM {embeddings}",
    ("vec_id",),
    ("label",),
)


def _customer_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = {"customer": table(spark, sf_dir, "customer")}
    left = spark.sql("SELECT c_custkey, c_name, c_nationkey, 1 AS gone FROM {customer}", **source)
    right = spark.sql("SELECT c_custkey, c_name, CAST(c_nationkey AS STRING) AS c_nationkey, 2.5D AS fresh FROM {customer}", **source)
    return diff_tables(left, right, key=["c_custkey"]).schema_frame().select("column", "change", "left_type", "right_type")


def _documents_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.replace("text", F.lit("the"), F.lit("THE")).alias("edited"))
    return unified_diff_column(docs, "text", "edited").where("diff IS NOT NULL").select("doc_id", "diff")


def _props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("props").alias("a"), F.when(F.col("event_id") % 3 == 0, F.regexp_replace("props", r"(\d+)\}", "1$1, \"new\": true}")).otherwise(F.col("props")).alias("b"))


def _props_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff_json_column(_props(spark, sf_dir), "a", "b").select("event_id", "report")


def _props_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(_props(spark, sf_dir), "a", "b", ["event_id"])


def _props_unordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_set(F.col("event_id") % 50)).alias("n"))
    pairs = numbers.select("user_id", F.to_json("n").alias("a"), F.to_json(F.reverse(F.transform("n", lambda x: F.when(x % 10 == 0, x + 1).otherwise(x)))).alias("b"))
    return findings(pairs, "a", "b", ["user_id"], ignore_order=True)


#: A nested document for each order, before and after edits at every depth.
ORDER_DOCUMENTS = (
    "SELECT o_orderkey, to_json(named_struct('order', named_struct('key', o_orderkey, 'status', o_orderstatus), 'note', o_orderpriority, "
    "'parts', transform(sequence(0, 1 + CAST(o_orderkey % 4 AS INT)), i -> named_struct('n', i, 'sum', o_custkey + i)))) AS a, "
    "regexp_replace(to_json(named_struct('order', named_struct('key', o_orderkey, 'status', CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END), "
    "'note', CASE WHEN o_orderkey % 11 <> 0 THEN o_orderpriority END, 'flag', CASE WHEN o_orderkey % 11 = 0 THEN true END, "
    "'parts', transform(sequence(0, 1 + CAST(o_orderkey % 4 AS INT) + CASE o_orderkey % 7 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END), "
    "i -> named_struct('n', i, 'sum', o_custkey + i + CASE WHEN o_orderkey % 3 = 0 AND i % 2 = 1 THEN 10 ELSE 0 END)))), "
    "CASE WHEN o_orderkey % 13 = 0 THEN '\"key\":(\\\\d+)' ELSE '$^' END, '\"key\":\"$1\"') AS b FROM {orders}"
)
#: Objects in reverse order, some left out, and one more where none is.
ORDER_SETS = (
    "SELECT o_orderkey, to_json(v) AS a, to_json(concat(reverse(filter(v, x -> x.v % 10 <> 0)), "
    "CASE WHEN o_orderkey % 10 = 1 THEN array(named_struct('v', o_orderkey + 100)) ELSE filter(v, x -> false) END)) AS b "
    "FROM (SELECT o_orderkey, transform(sequence(0, 5), i -> named_struct('v', o_orderkey + i)) AS v FROM {orders})"
)


def _order_findings(sql: str, ignore_order: bool) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: findings(s.sql(sql, orders=table(s, d, "orders")), "a", "b", ["o_orderkey"], ignore_order)


def _findings_sql(key: str, parts: list[tuple[str, ...]], source: str) -> str:
    """Rows of findings from (category, path, old type, new type, old value, new value, condition)."""
    rows = (
        f"SELECT {key}, '{category}' AS category, {path} AS path, CAST({old_type} AS VARCHAR) AS old_type, CAST({new_type} AS VARCHAR) AS new_type, "
        f"CAST({old} AS VARCHAR) AS old_value, CAST({new} AS VARCHAR) AS new_value, CAST(NULL AS VARCHAR) AS new_path, CAST(NULL AS VARCHAR) AS diff FROM {source} WHERE {where}"
        for category, path, old_type, new_type, old, new, where in parts
    )
    return " UNION ALL ".join(rows)


def _text_path(path: str) -> str:
    return "'" + path.replace("'", "''") + "'"


def _document_findings_sql() -> str:
    item = lambda i, more: f"'{{\"n\":' || {i} || ',\"sum\":' || (o_custkey + {i} + {more}) || '}}'"
    size = "(2 + o_orderkey % 4)"
    plain = [
        ("type_changes", _text_path("root['order']['key']"), "'int'", "'str'", "o_orderkey", "'\"' || o_orderkey || '\"'", "o_orderkey % 13 = 0"),
        ("dictionary_item_removed", _text_path("root['order']['status']"), "NULL", "NULL", "'\"' || o_orderstatus || '\"'", "NULL", "o_orderkey % 5 = 0"),
        ("dictionary_item_removed", _text_path("root['note']"), "NULL", "NULL", "'\"' || o_orderpriority || '\"'", "NULL", "o_orderkey % 11 = 0"),
        ("dictionary_item_added", _text_path("root['flag']"), "NULL", "NULL", "NULL", "'true'", "o_orderkey % 11 = 0"),
        ("iterable_item_added", f"'root[''parts''][' || {size} || ']'", "NULL", "NULL", "NULL", item(size, f"CASE WHEN o_orderkey % 3 = 0 AND {size} % 2 = 1 THEN 10 ELSE 0 END"), "o_orderkey % 7 = 0"),
        ("iterable_item_removed", f"'root[''parts''][' || ({size} - 1) || ']'", "NULL", "NULL", item(f"({size} - 1)", "0"), "NULL", "o_orderkey % 7 = 1"),
    ]
    each = "(SELECT *, unnest(range(0, 2 + o_orderkey % 4 - CASE WHEN o_orderkey % 7 = 1 THEN 1 ELSE 0 END)) AS i FROM orders)"
    changed = [("values_changed", "'root[''parts''][' || i || '][''sum'']'", "NULL", "NULL", "o_custkey + i", "o_custkey + i + 10", "o_orderkey % 3 = 0 AND i % 2 = 1")]
    return _findings_sql("o_orderkey", plain, "orders") + " UNION ALL " + _findings_sql("o_orderkey", changed, each)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "orders_summary": lambda s, d: ORDERS.diff(s, d).summary_frame(),
    "orders_rows_added": lambda s, d: ORDERS.diff(s, d).rows_added(),
    "orders_rows_removed": lambda s, d: ORDERS.diff(s, d).rows_removed(),
    "orders_cells_changed": lambda s, d: ORDERS.diff(s, d).cells_changed(),
    "lineitem_summary": lambda s, d: LINEITEM.diff(s, d).summary_frame(),
    "lineitem_duplicate_keys": lambda s, d: LINEITEM.diff(s, d).duplicate_keys(),
    "lineitem_rows_added": lambda s, d: LINEITEM.diff(s, d).rows_added(),
    "lineitem_cells_changed": lambda s, d: LINEITEM.diff(s, d).cells_changed(),
    "conversations_cells_changed": lambda s, d: CONVERSATIONS.diff(s, d).cells_changed(),
    "events_became_null": lambda s, d: EVENTS.diff(s, d).cells_changed(),
    "events_null_keys": lambda s, d: EVENT_USERS.diff(s, d).summary_frame(),
    "events_null_key_cells": lambda s, d: EVENT_USERS.diff(s, d).cells_changed(),
    "part_type_changed": lambda s, d: PART.diff(s, d).summary_frame(),
    "part_type_changed_cells": lambda s, d: PART.diff(s, d).cells_changed(),
    "supplier_decimal_scale": lambda s, d: SUPPLIER.diff(s, d).cells_changed(),
    "supplier_summary": lambda s, d: SUPPLIER.diff(s, d).summary_frame(),
    "embeddings_nested_skipped": lambda s, d: EMBEDDINGS.diff(s, d).summary_frame(),
    "customer_schema_diff": _customer_schema,
    "documents_unified_diff": _documents_unified,
    "events_props_diff_json": _props_json,
    "events_props_findings": _props_findings,
    "events_ignore_order_findings": _props_unordered,
    "orders_document_findings": _order_findings(ORDER_DOCUMENTS, False),
    "orders_unordered_findings": _order_findings(ORDER_SETS, True),
}

ORACLE_SQL: dict[str, str] = {
    "orders_summary": ORDERS.summary_sql(),
    "orders_rows_added": ORDERS.rows_sql("r"),
    "orders_rows_removed": ORDERS.rows_sql("l"),
    "orders_cells_changed": ORDERS.cells_sql(),
    "lineitem_summary": LINEITEM.summary_sql(),
    "lineitem_duplicate_keys": LINEITEM.duplicates_sql(),
    "lineitem_rows_added": LINEITEM.rows_sql("r"),
    "lineitem_cells_changed": LINEITEM.cells_sql(),
    "conversations_cells_changed": CONVERSATIONS.cells_sql(),
    "events_became_null": EVENTS.cells_sql(),
    "events_null_keys": EVENT_USERS.summary_sql(),
    "events_null_key_cells": EVENT_USERS.cells_sql(),
    "part_type_changed": PART.summary_sql(changed=3),
    "part_type_changed_cells": PART.cells_sql(),
    "supplier_decimal_scale": SUPPLIER.cells_sql(),
    "supplier_summary": SUPPLIER.summary_sql(added=1, changed=1),
    "embeddings_nested_skipped": EMBEDDINGS.summary_sql(),
    "customer_schema_diff": (
        "WITH l AS (SELECT column_name AS c, column_type AS t FROM (DESCRIBE SELECT c_custkey, c_name, c_nationkey, 1 AS gone FROM customer)), "
        "r AS (SELECT column_name AS c, column_type AS t FROM (DESCRIBE SELECT c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, CAST(2.5 AS DOUBLE) AS fresh FROM customer)), "
        "n AS (SELECT * FROM (VALUES ('INTEGER', 'int'), ('BIGINT', 'bigint'), ('VARCHAR', 'string'), ('DOUBLE', 'double')) AS v(t, label)) "
        "SELECT coalesce(l.c, r.c) AS \"column\", CASE WHEN r.c IS NULL THEN 'removed' WHEN l.c IS NULL THEN 'added' ELSE 'type_changed' END AS change, "
        "a.label AS left_type, b.label AS right_type FROM l FULL JOIN r ON l.c = r.c LEFT JOIN n AS a ON a.t = l.t LEFT JOIN n AS b ON b.t = r.t WHERE l.t IS DISTINCT FROM r.t"
    ),
    "events_props_diff_json": (
        "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN '{}' ELSE "
        "'{\"values_changed\":{\"root[''k'']\":{\"old_value\":' || regexp_extract(props, '(\\d+)\\}', 1) || ',\"new_value\":1' || regexp_extract(props, '(\\d+)\\}', 1) || '}},\"dictionary_item_added\":{\"root[''new'']\":true}}' END AS report FROM events"
    ),
    "events_props_findings": _findings_sql(
        "event_id",
        [
            ("values_changed", _text_path("root['k']"), "NULL", "NULL", "regexp_extract(props, '(\\d+)\\}', 1)", "'1' || regexp_extract(props, '(\\d+)\\}', 1)", "event_id % 3 = 0"),
            ("dictionary_item_added", _text_path("root['new']"), "NULL", "NULL", "NULL", "'true'", "event_id % 3 = 0"),
        ],
        "events",
    ),
    "orders_document_findings": _document_findings_sql(),
    "orders_unordered_findings": _findings_sql(
        "o_orderkey",
        [
            ("iterable_item_removed", "'root[' || i || ']'", "NULL", "NULL", "'{\"v\":' || (o_orderkey + i) || '}'", "NULL", "(o_orderkey + i) % 10 = 0"),
            ("iterable_item_added", "'root[6]'", "NULL", "NULL", "NULL", "'{\"v\":' || (o_orderkey + 100) || '}'", "o_orderkey % 10 = 1 AND i = 0"),
        ],
        "(SELECT o_orderkey, unnest(range(0, 6)) AS i FROM orders)",
    ),
}
