"""Reading and writing of other formats, by name; Spark's own sources do the work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FORMATS = ("parquet", "orc", "csv", "json", "text")


def read(spark: SparkSession, path: str, kind: str, schema: str | None = None, **options: str) -> DataFrame:
    """A table of a format; for csv and json a schema saves the pass that would guess one."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind!r}; there are {', '.join(FORMATS)}")
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def write(rows: DataFrame, path: str, kind: str, partition_by: list[str] | None = None, mode: str = "error", **options: str) -> None:
    """Write a result; ``partition_by`` gives a folder for each value."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind!r}; there are {', '.join(FORMATS)}")
    writer = rows.write.format(kind).options(**options).mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
