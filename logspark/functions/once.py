"""Costly expressions: compute them once per row, on all cores."""

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def evaluated(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add columns that are computed exactly once per row.

    A filter on a projected column is normally pushed below the projection with the whole
    expression copied into it, once per use. Generator output stops that: later filters and
    projections read the value instead of repeating a chain of regular expressions.
    """
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))

