"""The public names."""

from __future__ import annotations

from pyspark.sql import DataFrame

from . import __version__
from .errors import MaxDepthError, OutOfRangeError
from .operators.deep_diff import MAX_DEPTH_CEILING, DeepDiff, diff_json
from .operators.table_diff import TableDiff, diff_tables

__all__ = ["MAX_DEPTH_CEILING", "ArrowTable", "DeepDiff", "MaxDepthError", "OutOfRangeError", "TableDiff", "__version__", "diff_json", "diff_tables"]


class ArrowTable:
    """A member of a TableDiff as an Arrow table, for consumers of the Arrow protocol.

    It comes to the driver whole when it is first used.
    """

    def __init__(self, df: DataFrame):
        self._df, self._table = df, None

    def to_pyarrow(self):
        if self._table is None:
            self._table = self._df.toArrow()
        return self._table

    def __arrow_c_stream__(self, requested_schema=None):
        return self.to_pyarrow().__arrow_c_stream__(requested_schema)

    def __arrow_c_schema__(self):
        return self.to_pyarrow().schema.__arrow_c_schema__()

    def __len__(self) -> int:
        return self.to_pyarrow().num_rows

    def __repr__(self) -> str:
        return f"ArrowTable({self._df.schema.simpleString()})"
