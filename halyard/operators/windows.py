"""Ranks and running sums over few, large partitions: each is cut into parts by its first sort key, so work spreads over the cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts that a window partition is cut into, at most.
PARTS = 64


def _in_parts(rows: DataFrame, by: str, key: str, descending: bool) -> DataFrame:
    """Add _part: parts follow the key's order within ``by`` (nulls last), and equal keys share one."""
    shares = F.array(*[F.lit(k / PARTS) for k in range(1, PARTS)])
    bounds = rows.groupBy(by).agg(F.array_distinct(F.percentile_approx(key, shares, 1000)).alias("_bounds"))
    cut = rows.join(bounds.withColumnRenamed(by, "_by"), F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by")
    below = F.size(F.filter("_bounds", lambda b: b < F.col(key)))
    part = F.when(F.col(key).isNull() | F.col("_bounds").isNull(), PARTS).otherwise(F.lit(PARTS - 1) - below if descending else below)
    return cut.withColumn("_part", part).drop("_bounds")


def _with_before(rows: DataFrame, by: str, total: Column) -> DataFrame:
    """Add _before: the sum of ``total`` over the earlier parts, which is worked out on one row a part."""
    parts = rows.groupBy(by, "_part").agg(total.alias("_total"))
    before = F.coalesce(F.sum("_total").over(Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(F.col(by).alias("_by"), F.col("_part").alias("_p"), before.alias("_before"))
    return rows.join(parts, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_part") == F.col("_p"))).drop("_by", "_p")


def row_number(rows: DataFrame, by: str, key: str, descending: bool, ties: list[str], name: str) -> DataFrame:
    """Add ``name``: row_number() over (partition by ``by`` order by ``key`` (nulls last), ties)."""
    cut = _with_before(_in_parts(rows, by, key, descending), by, F.count(F.lit(1)))
    first = F.col(key).desc_nulls_last() if descending else F.col(key).asc_nulls_last()
    rank = F.row_number().over(Window.partitionBy(by, "_part").orderBy(first, *ties))
    return cut.withColumn(name, (rank + F.col("_before")).cast("int")).drop("_part", "_before")


def running_sum(rows: DataFrame, by: str, key: str, value: str, name: str) -> DataFrame:
    """Add ``name``: sum(``value``), which isn't null, over (partition by ``by`` order by ``key``), rows of equal key alike."""
    cut = _with_before(_in_parts(rows, by, key, False), by, F.sum(value))
    own = F.sum(value).over(Window.partitionBy(by, "_part").orderBy(F.col(key).asc_nulls_last()))
    return cut.withColumn(name, own + F.col("_before")).drop("_part", "_before")
