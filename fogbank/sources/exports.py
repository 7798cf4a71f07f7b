"""CSV sinks of the prediction tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

BYTE_ORDER_MARK = "\ufeff"


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """CSV with header, marked as UTF-8 for spreadsheet programs.

    The mark is part of the first title, so it comes first in every part file. Part files are
    written where the rows are; nothing is gathered.
    """
    first = df.columns[0]
    marked = df.withColumnRenamed(first, BYTE_ORDER_MARK + first)
    marked.write.mode(mode).option("header", True).option("encoding", "UTF-8").csv(path)
