"""Star tables derived from the Parquet inputs, as DataFrames and as the same SQL for DuckDB.

Money is in cents and percentages are whole numbers, so sums are exact.  ``Star.lineorder`` joins only what the
requested columns come from: each line has its order and its part, and both keys are unique, so leaving
out a join changes no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The days that the date dimension covers.
FIRST_DAY, LAST_DAY = "1995-01-01", "2001-12-31"
#: Market segments by code, alphabetically.
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]

_DAY = "year({0}) * 10000 + month({0}) * 100 + day({0})"
_PRICE = "CAST(round(l_extendedprice * 100) AS BIGINT)"
_DISCOUNT = "CAST(round(l_discount * 100) AS INT)"
#: column -> (SQL with DIV for whole division, the tables beside lineitem that it needs)
LINEORDER = {
    "lo_orderkey": ("l_orderkey", ""),
    "lo_linenumber": ("l_linenumber", ""),
    "lo_custkey": ("o_custkey", "o"),
    "lo_partkey": ("l_partkey", ""),
    "lo_suppkey": ("l_suppkey", ""),
    "lo_orderdate": (f"CAST({_DAY.format('o_orderdate')} AS INT)", "o"),
    "lo_orderpriority": ("CAST(substr(o_orderpriority, 1, 1) AS INT)", "o"),
    "lo_shippriority": ("0", ""),
    "lo_quantity": ("CAST(l_quantity AS INT)", ""),
    "lo_extendedprice": (_PRICE, ""),
    "lo_ordtotalprice": ("CAST(round(o_totalprice * 100) AS BIGINT)", "o"),
    "lo_discount": (_DISCOUNT, ""),
    "lo_revenue": (f"({_PRICE} * (100 - {_DISCOUNT})) DIV 100", ""),
    "lo_supplycost": ("(6 * CAST(round(p_retailprice * 100) AS BIGINT) * CAST(l_quantity AS INT)) DIV 10", "p"),
    "lo_tax": ("CAST(round(l_tax * 100) AS INT)", ""),
    "lo_commitdate": (f"CAST({_DAY.format('l_shipdate')} AS INT)", ""),
    "lo_shipmode": ("CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END", ""),
}
#: Input files, in bytes, of lines for one part of a shuffle, and how many parts are left to Spark.
PART_BYTES, PARTS_LEAST = 16 << 20, 16
#: Dimensions and the fact table.
TABLES = ("lineorder", "ddate", "customer", "supplier", "part")
#: coded column -> (raw column, its side table, SQL of the least and of the first too large raw value for codes {low} to {high}): what a range of
#: codes implies for the raw column, so that the scan can skip row groups.  Rounded columns are given some room.
RAW = {
    "lo_quantity": ("l_quantity", "", "CAST({low} AS DOUBLE)", "CAST({high} + 1 AS DOUBLE)"),
    "lo_discount": ("l_discount", "", "CAST({low} / 100D - 0.0051D AS DOUBLE)", "CAST({high} / 100D + 0.0051D AS DOUBLE)"),
    "lo_tax": ("l_tax", "", "CAST({low} / 100D - 0.0051D AS DOUBLE)", "CAST({high} / 100D + 0.0051D AS DOUBLE)"),
    "lo_orderdate": ("o_orderdate", "o", "to_date('{low}', 'yyyyMMdd')", "date_add(to_date('{high}', 'yyyyMMdd'), 1)"),
    "lo_commitdate": ("l_shipdate", "", "to_date('{low}', 'yyyyMMdd')", "date_add(to_date('{high}', 'yyyyMMdd'), 1)"),
}
_BRAND = "CAST(substr(p_brand, 7) AS INT)"
_DIMENSIONS = {
    "customer": (
        "c_custkey, c_name, CAST(n_nationkey * 10 + c_custkey % 10 AS INT) AS c_city, n_nationkey AS c_nation, n_regionkey AS c_region, CASE c_mktsegment "
        + " ".join(f"WHEN '{s}' THEN {k}" for k, s in enumerate(SEGMENTS))
        + " END AS c_mktsegment",
        "customer JOIN nation ON c_nationkey = n_nationkey",
    ),
    "supplier": ("s_suppkey, s_name, CAST(n_nationkey * 10 + s_suppkey % 10 AS INT) AS s_city, n_nationkey AS s_nation, n_regionkey AS s_region", "supplier JOIN nation ON s_nationkey = n_nationkey"),
    "part": (f"p_partkey, p_name, ({_BRAND} - 1) DIV 5 AS p_mfgr, {_BRAND} - 1 AS p_category, CAST(({_BRAND} - 1) * 40 + p_partkey % 40 AS INT) AS p_brand1, p_type, p_size", "part"),
}
_DDATE = "CAST(year(d) * 10000 + month(d) * 100 + day(d) AS INT) AS d_datekey, CAST(year(d) AS INT) AS d_year, CAST(month(d) AS INT) AS d_month, CAST(year(d) * 100 + month(d) AS INT) AS d_yearmonthnum, CAST(day(d) AS INT) AS d_daynuminmonth, CAST(dayofyear(d) AS INT) AS d_daynuminyear"


def _spark(sql: str) -> str:
    """Whole division of ints is bigint in Spark; keep the narrow ones narrow."""
    return f"CAST({sql} AS INT)" if sql.startswith(f"({_BRAND}") and "DIV 5" in sql else sql


class Star:
    """The star tables over one data folder; every method gives a lazy DataFrame.

    With ``store``, they are read from there, where ``store_tables`` has written them.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, store: str | None = None):
        self.spark, self.sf_dir, self.store = spark, sf_dir, store

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def lineorder(self, *columns: str, within: dict[str, tuple[int, int]] | None = None) -> DataFrame:
        """The fact table's columns; ``within`` keeps rows whose coded columns lie in ranges (both ends included)."""
        columns, within = columns or tuple(LINEORDER), within or {}
        ranges = [F.col(c).between(low, high) for c, (low, high) in within.items()]
        if self.store:
            rows = self.spark.read.parquet(f"{self.store}/lineorder")
            for r in ranges:
                rows = rows.where(r)
            return rows.select(*columns)
        wanted = dict.fromkeys([*columns, *within])
        needs = {LINEORDER[c][1] for c in wanted}
        sources = {"": self.table("lineitem"), "o": self.table("orders"), "p": self.table("part")}
        for c, (low, high) in within.items():
            raw, side, least, beyond = RAW[c]
            sources[side] = sources[side].where(f"{raw} >= {least.format(low=low)} AND {raw} < {beyond.format(high=high)}")
        rows = sources[""]
        if "o" in needs:
            rows = self._met(rows, "l_orderkey", sources["o"], "o_orderkey", "orders")
        if "p" in needs:
            rows = self._met(rows, "l_partkey", sources["p"], "p_partkey", "part")
        rows = rows.selectExpr(*[f"{LINEORDER[c][0]} AS {c}" for c in wanted])
        for r in ranges:
            rows = rows.where(r)
        return rows.select(*columns)

    def _met(self, lines: DataFrame, key: str, other: DataFrame, own: str, name: str) -> DataFrame:
        """Lines joined with orders or parts; large ones in as many parts as their inputs ask for, so that what a task sorts doesn't grow with them."""
        parts = -(-_bytes(self.table("lineitem")) // PART_BYTES)
        if parts > PARTS_LEAST and _bytes(self.table(name)) > 2 * PART_BYTES:  # a smaller one may be broadcast
            lines, other = lines.repartition(parts, key), other.repartition(parts, own)
        return lines.join(other, F.col(key) == F.col(own))

    def _dimension(self, name: str) -> DataFrame:
        if self.store:
            return self.spark.read.parquet(f"{self.store}/{name}")
        rows = self.table(name)
        if name != "part":
            key = f"{name[0]}_nationkey"
            rows = rows.join(self.table("nation"), F.col(key) == F.col("n_nationkey"))
        return rows.selectExpr(*[_spark(c.rpartition(" AS ")[0]) + " AS " + c.rpartition(" AS ")[2] if " AS " in c else c for c in _split(_DIMENSIONS[name][0])])

    def customer(self) -> DataFrame:
        return self._dimension("customer")

    def supplier(self) -> DataFrame:
        return self._dimension("supplier")

    def part(self) -> DataFrame:
        return self._dimension("part")

    def ddate(self) -> DataFrame:
        if self.store:
            return self.spark.read.parquet(f"{self.store}/ddate")
        days = self.spark.range(1).selectExpr(f"explode(sequence(DATE'{FIRST_DAY}', DATE'{LAST_DAY}', INTERVAL 1 DAY)) AS d")
        return days.selectExpr(*_split(_DDATE))

    def register(self) -> None:
        """Temporary views lineorder, ddate, customer, supplier and part, for SQL texts."""
        for name in TABLES:
            getattr(self, name)().createOrReplaceTempView(name)

    def store_tables(self, target: str) -> Star:
        """Write the star tables as Parquet, the fact table in ranges of its order date, and give the star that reads them."""
        rows = self.lineorder()
        rows.repartitionByRange("lo_orderdate", "lo_orderkey", "lo_linenumber").sortWithinPartitions("lo_orderdate").write.mode("overwrite").parquet(f"{target}/lineorder")
        for name in TABLES[1:]:
            getattr(self, name)().coalesce(1).write.mode("overwrite").parquet(f"{target}/{name}")
        return Star(self.spark, self.sf_dir, target)

    def preload(self) -> None:
        """Hold the stored tables in memory (on disk, where memory ends); lineorder's batches keep their ranges, so filters skip some."""
        for name in TABLES:
            self.spark.read.parquet(f"{self.store}/{name}").cache().count()


def _bytes(rows: DataFrame) -> int:
    """Bytes of a table's files."""
    return int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def _split(items: str) -> list[str]:
    """Cut a SELECT list at its outer commas."""
    out, depth, start = [], 0, 0
    for k, c in enumerate(items):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(items[start:k].strip())
            start = k + 1
    return [*out, items[start:].strip()]


def duck_views() -> str:
    """The star tables as common table expressions for DuckDB: x_lineorder, x_ddate, x_customer, x_supplier, x_part."""
    whole = lambda sql: sql.replace(" DIV ", " // ")
    lines = ", ".join(f"{whole(sql)} AS {c}" for c, (sql, _) in LINEORDER.items())
    parts = [f"x_lineorder AS (SELECT {lines} FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"]
    parts += [f"x_{name} AS (SELECT {whole(select)} FROM {source})" for name, (select, source) in _DIMENSIONS.items()]
    parts.append(f"x_ddate AS (SELECT {_DDATE} FROM (SELECT unnest(generate_series(DATE '{FIRST_DAY}', DATE '{LAST_DAY}', INTERVAL 1 DAY)) AS d))")
    return "WITH " + ",\n".join(parts) + "\n"
