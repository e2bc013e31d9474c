"""Document comparison over columns of JSON texts, in Arrow batches.

Texts that are equal are never sent to Python: equal texts are equal documents.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spandrel.runtime import ship

FINDING = "category string, path string, old_type string, new_type string, old_value string, new_value string, new_path string, diff string"


def _differing(a: Column, b: Column, found: Column, same: Column) -> Column:
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(a == b, same).otherwise(found)


def diff_json_column(df: DataFrame, a: str, b: str, out: str = "report", ignore_order: bool = False, max_depth: int | None = None, error: str | None = None) -> DataFrame:
    """``df`` with the report of each pair as JSON text; null if either is null.

    A pair that can't be compared (no JSON, too deep) ends the query, or, with
    ``error``, has no report and says why in a column of that name.
    """
    ship(df.sparkSession)

    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        from spandrel.operators.deep_diff import diff_json

        rows = [(None, None) if p is None or q is None or p == q else _tried(lambda p=p, q=q: diff_json(p, q, ignore_order, max_depth), error is not None) for p, q in zip(x, y, strict=True)]
        return pd.DataFrame(rows, columns=["report", "error"], dtype=object)

    udf = F.pandas_udf(run, "report string, error string")
    left, right = (F.when(F.col(a) != F.col(b), F.col(c)) for c in (a, b))
    found = df.withColumn("__found", udf(left, right))
    found = found.withColumn(out, _differing(F.col(a), F.col(b), F.col("__found.report"), F.lit("{}")))
    return (found.withColumn(error, F.col("__found.error")) if error else found).drop("__found")


def _tried(compare, keep: bool) -> tuple:
    """What ``compare`` gives, and nothing; or, if errors are kept, nothing and what is wrong."""
    from spandrel.errors import MaxDepthError

    try:
        return compare(), None
    except (ValueError, MaxDepthError) as e:
        if not keep:
            raise
        return None, str(e)


def findings(df: DataFrame, a: str, b: str, keep: list[str], ignore_order: bool = False, max_depth: int | None = None, errors: bool = False) -> DataFrame:
    """``keep`` columns and a row for each finding of each pair.

    A pair that can't be compared ends the query, or, with ``errors``, has one
    row of category ``error`` that says why in column diff.
    """
    ship(df.sparkSession)
    names = [f.split(" ")[0] for f in FINDING.split(", ")]

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        from spandrel.operators.deep_diff import finding_rows

        out = []
        for p, q in zip(x, y, strict=True):
            rows, wrong = _tried(lambda p=p, q=q: finding_rows(p, q, ignore_order, max_depth), errors)
            out.append([dict(zip(names, r, strict=True)) for r in rows] if wrong is None else [{"category": "error", "diff": wrong}])
        return pd.Series(out, dtype=object)

    kind = "array<struct<" + ",".join(f.replace(" ", ":") for f in FINDING.split(", ")) + ">>"
    udf = F.pandas_udf(run, kind)
    differing = df.where(F.col(a) != F.col(b))
    return differing.select(*keep, F.explode(udf(a, b)).alias("f")).select(*keep, "f.*")


def unified_diff_column(df: DataFrame, a: str, b: str, out: str = "diff") -> DataFrame:
    """``df`` with the unified line diff of two texts; null if they are equal or both of one line."""
    ship(df.sparkSession)

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        from spandrel.operators.deep_diff import line_diff

        return pd.Series([line_diff(p, q) for p, q in zip(x, y, strict=True)], dtype=object)

    left, right = (F.when(F.col(a) != F.col(b), F.col(c)) for c in (a, b))
    return df.withColumn(out, F.when(F.col(a) != F.col(b), F.pandas_udf(run, "string")(left, right)))
