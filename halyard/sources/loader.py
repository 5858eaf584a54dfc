"""Loading of delimited text and raw columns, string coding, and column statistics."""

from __future__ import annotations

import hashlib
import itertools
import struct
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Columns of the star schema benchmark's text files.
TEXT_TABLES = {
    "lineorder": "lo_orderkey int, lo_linenumber int, lo_custkey int, lo_partkey int, lo_suppkey int, lo_orderdate int, lo_orderpriority string, lo_shippriority string, lo_quantity int, lo_extendedprice int, lo_ordtotalprice int, lo_discount int, lo_revenue int, lo_supplycost int, lo_tax int, lo_commitdate int, lo_shipmode string",
    "supplier": "s_suppkey int, s_name string, s_address string, s_city string, s_nation string, s_region string, s_phone string",
    "customer": "c_custkey int, c_name string, c_address string, c_city string, c_nation string, c_region string, c_phone string, c_mktsegment string",
    "part": "p_partkey int, p_name string, p_mfgr string, p_category string, p_brand1 string, p_color string, p_type string, p_size int, p_container string",
    "ddate": "d_datekey int, d_date string, d_dayofweek string, d_month string, d_year int, d_yearmonthnum int, d_yearmonth string, d_daynuminweek int, d_daynuminmonth int, d_daynuminyear int, d_monthnuminyear int, d_weeknuminyear int, d_sellingseason string, d_lastdayinweekfl int, d_lastdayinmonthfl int, d_holidayfl int, d_weekdayfl int",
}
_SORTED_BY = {"lineorder": ["lo_orderdate"]}


def load_star(spark: SparkSession, folder: str, target: str, delimiter: str = "|") -> None:
    """All star tables' text files (``<table>.tbl``) as Parquet, the fact table in order of its date."""
    for name, schema in TEXT_TABLES.items():
        load_table(spark, f"{folder}/{name}.tbl", schema, f"{target}/{name}", delimiter, _SORTED_BY.get(name))


def read_table(spark: SparkSession, path: str, schema: str, delimiter: str = "|") -> DataFrame:
    """Delimited text; a delimiter at the end of each line is allowed, empty fields are null."""
    return spark.read.csv(path, schema=schema, sep=delimiter, mode="PERMISSIVE")


def load_table(spark: SparkSession, path: str, schema: str, target: str, delimiter: str = "|", sort_by: list[str] | None = None) -> None:
    """Delimited text to Parquet, whose dictionary and run-length coding take the place of tools for them."""
    rows = read_table(spark, path, schema, delimiter)
    (rows.orderBy(*sort_by) if sort_by else rows).write.mode("overwrite").parquet(target)  # files are in order, and rows in them


def code_strings(rows: DataFrame, column: str, values: list[str], name: str) -> DataFrame:
    """Add ``name``: the index of ``column`` in a fixed list; null for others."""
    codes = F.create_map(*[x for k, v in enumerate(values) for x in (F.lit(v), F.lit(k))])
    return rows.withColumn(name, codes[F.col(column)])


def brand_code(brand: Column) -> Column:
    """``MFGR#<m><c><n>`` as ((m - 1) * 5 + c - 1) * 40 + n - 1."""
    digit = lambda at: F.substring(brand, at, 1).cast("int")
    return ((digit(6) - 1) * 5 + digit(7) - 1) * 40 + F.regexp_extract(brand, r"^MFGR#\d\d(\d+)$", 1).cast("int") - 1


def column_statistics(rows: DataFrame) -> DataFrame:
    """column_name, least, most (as strings), n_distinct, n_null and is_unique for every column.

    Each column is aggregated from its distinct values and their counts, so that no pass multiplies rows.
    """

    def of(c: str) -> DataFrame:
        counts = rows.groupBy(F.col(f"`{c}`").alias("v")).agg(F.count(F.lit(1)).alias("n"))
        value = F.col("v")
        return counts.agg(
            F.lit(c).alias("column_name"),
            F.min(value).cast("string").alias("least"),
            F.max(value).cast("string").alias("most"),
            F.count(value).alias("n_distinct"),
            F.coalesce(F.sum(F.when(value.isNull(), F.col("n"))), F.lit(0)).alias("n_null"),
            F.coalesce(F.max(F.when(value.isNotNull(), F.col("n"))) == 1, F.lit(True)).alias("is_unique"),
        )

    return reduce(DataFrame.unionByName, [of(c) for c in rows.columns])


def cached_statistics(spark: SparkSession, path: str, cache: str) -> DataFrame:
    """Statistics of a Parquet table, kept at ``cache`` under the sizes and times of the table's files, and made anew when these change."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = lambda p: hadoop(p).getFileSystem(spark._jsc.hadoopConfiguration())
    files, listing = [], fs(path).listFiles(hadoop(path), True)
    while listing.hasNext():
        f = listing.next()
        files.append(f"{f.getPath().getName()} {f.getLen()} {f.getModificationTime()}")
    kept = f"{cache}/{hashlib.sha256(chr(10).join([path, *sorted(files)]).encode()).hexdigest()}"
    if not fs(kept).exists(hadoop(f"{kept}/_SUCCESS")):
        column_statistics(spark.read.parquet(path)).coalesce(1).write.mode("overwrite").parquet(kept)
    return spark.read.parquet(kept)


def decode_validity(raw: bytes, rows: int, kind: str) -> np.ndarray:
    """Which rows are valid, from a sidecar of bytes (``valid8``, ``null8``) or of bits in 64-bit words (``valid64``, ``null64``)."""
    if kind.endswith("64"):
        if len(raw) != 8 * -(-rows // 64):
            raise ValueError("the bitmap's size doesn't fit the rows")
        bits = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")[:rows].astype(bool)
    else:
        if len(raw) != rows:
            raise ValueError("the bitmap's size doesn't fit the rows")
        bits = np.frombuffer(raw, np.uint8) != 0
    return ~bits if kind.startswith("null") else bits


def raw_column(raw: bytes, validity: bytes | None = None, kind: str = "valid64") -> list[int | None]:
    """A headerless file of 32-bit ints with an optional validity sidecar."""
    values = np.frombuffer(raw, "<i4")
    if validity is None:
        return values.tolist()
    return [v if ok else None for v, ok in zip(values.tolist(), decode_validity(validity, len(values), kind).tolist(), strict=True)]



def _numbered(spark: SparkSession, path: str, code: str, fields: str) -> DataFrame:
    """Fixed-length records of a headerless file with their numbers; splits of the file are read by different tasks."""
    records = spark.sparkContext.binaryRecords(path, struct.calcsize(code))
    counts = records.mapPartitions(lambda it: [sum(1 for _ in it)]).collect()  # one number a split
    starts = [0, *itertools.accumulate(counts)]
    numbered = records.mapPartitionsWithIndex(lambda k, it: ((starts[k] + i, *struct.unpack(code, x)) for i, x in enumerate(it)))
    return spark.createDataFrame(numbered, fields)


def read_raw_columns(spark: SparkSession, files: dict[str, str], validity: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Headerless files of 32-bit ints, one a column, with optional validity sidecars (path, kind), as a table with its row_number.

    Rows of the columns are brought together by their numbers; files of unequal length are an error.
    """
    out = None
    for name, path in files.items():
        column = _numbered(spark, path, "<i", f"row_number long, `{name}` int")
        if name in (validity or {}):
            side, kind = validity[name]
            if kind.endswith("64"):
                words = _numbered(spark, side, "<q", "_word long, _bits long")
                bit = F.col("row_number").bitwiseAND(F.lit(63)).cast("int")
                column = column.join(words, F.shiftright("row_number", 6) == F.col("_word"), "left").withColumn("_set", F.call_function("shiftright", F.col("_bits"), bit).bitwiseAND(F.lit(1)))
            else:
                column = column.join(_numbered(spark, side, "<b", "_byte long, _set byte"), F.col("row_number") == F.col("_byte"), "left")
            wrong = F.raise_error(F.lit(f"{side} doesn't fit the rows of {path}"))
            is_null = (F.col("_set") == 0) if kind.startswith("valid") else (F.col("_set") != 0)
            column = column.select("row_number", F.when(F.col("_set").isNull(), wrong).when(is_null, None).otherwise(F.col(f"`{name}`")).cast("int").alias(name))
        if out is None:
            out = column.withColumn("_there", F.lit(True))
        else:
            out = out.join(column.withColumnRenamed("row_number", "_row").withColumn("_here", F.lit(True)), F.col("row_number") == F.col("_row"), "full")
            fits = F.col("_there").isNotNull() & F.col("_here").isNotNull()
            out = out.withColumn("row_number", F.when(fits, F.col("row_number")).otherwise(F.raise_error(F.lit(f"{path} has another number of rows")).cast("long"))).drop("_row", "_here")
    return out.drop("_there")
