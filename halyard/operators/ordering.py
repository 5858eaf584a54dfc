"""ORDER BY and LIMIT with the reference semantics: nulls last in both directions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key(name: str, descending: bool = False) -> Column:
    return F.col(name).desc_nulls_last() if descending else F.col(name).asc_nulls_last()


def top(df: DataFrame, n: int, *names: str) -> DataFrame:
    """The first n rows by ``names`` (a leading ``-`` is descending)."""
    return df.orderBy(*[key(x.lstrip("-"), x.startswith("-")) for x in names]).limit(n)
