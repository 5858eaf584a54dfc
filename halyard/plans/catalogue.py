"""Registry of the star-schema queries: name -> DataFrame builder, name -> DuckDB SQL.

Years are those of the data at hand (the benchmark's, three later), and constants that select nothing in it are
replaced by ones that do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.operators.joins import or_key_join
from halyard.operators.ordering import top
from halyard.operators.reorder import changed, move_down
from halyard.operators.windows import row_number, running_sum
from halyard.sources.star import LINEORDER, Star, duck_views

C = F.col
REVENUE_LEAST = 45_600_000_000
#: query name -> (builder over Star, DuckDB SQL after the views)
_QUERIES: dict[str, tuple] = {}


def query(sql: str):
    def add(build):
        _QUERIES[build.__name__] = (build, sql)
        return build

    return add


def n(name: str = "n"):
    return F.count(F.lit(1)).alias(name)


def total(column, name: str):
    return F.sum(column).alias(name)


def _count(name: str, of: str) -> None:
    _QUERIES[name] = (lambda s: getattr(s, of)().agg(n()), f"SELECT count(*) AS n FROM x_{of}")


for _name, _of in zip(["health_01_count_lineorder", "health_02_count_customer", "health_03_count_part", "health_04_count_supplier", "health_05_count_ddate"], ["lineorder", "customer", "part", "supplier", "ddate"], strict=True):
    _count(_name, _of)


def _filter(name: str, columns: list[str], condition: str, within: dict[str, tuple[int, int]] | None = None) -> None:
    """A count; ``within`` gives the condition as ranges of columns, which reach the scan."""
    _QUERIES[name] = (lambda s: (s.lineorder(*columns, within=within) if within else s.lineorder(*columns).where(condition)).agg(n()), f"SELECT count(*) AS n FROM x_lineorder WHERE {condition}")


_filter("filter_01_eq", ["lo_quantity"], "lo_quantity = 25", {"lo_quantity": (25, 25)})
_filter("filter_02_range", ["lo_quantity"], "lo_quantity BETWEEN 25 AND 35", {"lo_quantity": (25, 35)})
_filter("filter_03_or", ["lo_discount"], "lo_discount = 1 OR lo_discount = 2", {"lo_discount": (1, 2)})
_filter("filter_04_arithmetic", ["lo_quantity", "lo_discount"], "lo_quantity * 2 < lo_discount * 10")
_filter("filter_05_not_is_null", ["lo_revenue"], "NOT (lo_revenue IS NULL)")
_filter("filter_06_complex_boolean", ["lo_quantity", "lo_discount"], "(lo_quantity BETWEEN 10 AND 20) OR (lo_discount BETWEEN 2 AND 4)")
_filter("filter_in_list", ["lo_quantity", "lo_shipmode"], "lo_quantity IN (3, 17, 42) AND lo_shipmode <> 2")
_filter("filter_column_to_column", ["lo_commitdate", "lo_orderdate"], "lo_commitdate >= lo_orderdate + 100")


@query("SELECT lo_orderkey FROM x_lineorder")
def proj_01_single_column(s: Star) -> DataFrame:
    return s.lineorder("lo_orderkey")


@query("SELECT lo_orderkey, lo_revenue FROM x_lineorder")
def proj_02_two_columns(s: Star) -> DataFrame:
    return s.lineorder("lo_orderkey", "lo_revenue")


@query("SELECT lo_revenue - lo_supplycost AS margin FROM x_lineorder")
def proj_03_arithmetic_expr(s: Star) -> DataFrame:
    return s.lineorder("lo_revenue", "lo_supplycost").select((C("lo_revenue") - C("lo_supplycost")).alias("margin"))


@query("SELECT lo_revenue IS NULL AND lo_revenue > 0 AS flag FROM x_lineorder")
def proj_04_boolean_expr(s: Star) -> DataFrame:
    return s.lineorder("lo_revenue").select((C("lo_revenue").isNull() & (C("lo_revenue") > 0)).alias("flag"))


@query("SELECT * FROM x_ddate")
def proj_05_select_star_small_dimension(s: Star) -> DataFrame:
    return s.ddate().select("*")


@query("SELECT count(*) AS n FROM x_lineorder")
def agg_01_count_star(s: Star) -> DataFrame:
    return s.lineorder("lo_orderkey").agg(n())


@query("SELECT count(lo_revenue) AS n FROM x_lineorder")
def agg_02_count_expr(s: Star) -> DataFrame:
    return s.lineorder("lo_revenue").agg(F.count("lo_revenue").alias("n"))


@query("SELECT CAST(sum(lo_revenue) AS BIGINT) AS total, min(lo_revenue) AS least, max(lo_revenue) AS most FROM x_lineorder")
def agg_03_sum_min_max(s: Star) -> DataFrame:
    return s.lineorder("lo_revenue").agg(total("lo_revenue", "total"), F.min("lo_revenue").alias("least"), F.max("lo_revenue").alias("most"))


@query("SELECT avg(lo_revenue) AS mean FROM x_lineorder")
def agg_04_avg(s: Star) -> DataFrame:
    return s.lineorder("lo_revenue").agg(F.avg("lo_revenue").alias("mean"))


@query("SELECT count(*) AS n, count(lo_revenue) AS n_revenue, CAST(sum(lo_revenue) AS BIGINT) AS total, min(lo_revenue) AS least, max(lo_revenue) AS most, avg(lo_revenue) AS mean FROM x_lineorder")
def agg_05_all_basic_aggs(s: Star) -> DataFrame:
    r = "lo_revenue"
    return s.lineorder(r).agg(n(), F.count(r).alias("n_revenue"), total(r, "total"), F.min(r).alias("least"), F.max(r).alias("most"), F.avg(r).alias("mean"))


@query("SELECT CAST(sum(lo_extendedprice * lo_discount) AS BIGINT) AS total, avg(lo_revenue - lo_supplycost) AS mean FROM x_lineorder")
def agg_06_aggregate_expression(s: Star) -> DataFrame:
    rows = s.lineorder("lo_extendedprice", "lo_discount", "lo_revenue", "lo_supplycost")
    return rows.agg(total(C("lo_extendedprice") * C("lo_discount"), "total"), F.avg(C("lo_revenue") - C("lo_supplycost")).alias("mean"))


_LINKS = {"ddate": ("lo_orderdate", "d_datekey"), "customer": ("lo_custkey", "c_custkey"), "supplier": ("lo_suppkey", "s_suppkey"), "part": ("lo_partkey", "p_partkey")}


def star_join(s: Star, measures: list[str], where: dict[str, str | None], within: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """Lineorder's ``measures`` joined with the dimensions in ``where``, each filtered before the join."""
    rows = s.lineorder(*dict.fromkeys([*measures, *[_LINKS[d][0] for d in where]]), within=within)
    for name, condition in where.items():
        dimension = getattr(s, name)()
        rows = rows.join(dimension.where(condition) if condition else dimension, C(_LINKS[name][0]) == C(_LINKS[name][1]))
    # customers belong to orders, and are joined with them before these meet their lines
    return changed(rows, move_down) if "customer" in where and not s.store else rows


def _star(name: str, keys: list[str], measure: str, columns: list[str], where: dict[str, str | None], over: str | None = None, alias: str = "revenue", within: dict[str, tuple[int, int]] | None = None) -> None:
    """A star query: ``measure`` grouped by ``keys``; ``over`` is a condition above the joins, ``within`` one of ranges of the fact table's columns."""

    def build(s: Star) -> DataFrame:
        rows = star_join(s, columns, where, within)
        rows = rows.where(over) if over else rows
        rows = rows.groupBy(*keys) if keys else rows
        return rows.agg(F.expr(measure).alias(alias))

    conditions = [f"{c} BETWEEN {low} AND {high}" for c, (low, high) in (within or {}).items()]
    conditions += [f"{_LINKS[d][0]} = {_LINKS[d][1]}" for d in where] + [f"({c})" for c in where.values() if c] + ([f"({over})"] if over else [])
    select = ", ".join([*keys, f"CAST({measure} AS BIGINT) AS {alias}"])
    sql = f"SELECT {select} FROM {', '.join(['x_lineorder', *[f'x_{d}' for d in where]])}"
    sql += f" WHERE {' AND '.join(conditions)}" if conditions else ""
    _QUERIES[name] = (build, sql + (f" GROUP BY {', '.join(keys)}" if keys else ""))


_R, _SUM, _PROFIT = ["lo_revenue"], "sum(lo_revenue)", "sum(lo_revenue - lo_supplycost)"
_PC = ["lo_revenue", "lo_supplycost"]
_FLAT = ["lo_extendedprice", "lo_discount", "lo_quantity", "lo_orderdate"]
_star("group_01_year_sum", ["d_year"], _SUM, _R, {"ddate": None})
_star("group_02_year_brand_sum_q21_shape", ["d_year", "p_brand1"], _SUM, _R, {"part": "p_category = 1", "supplier": "s_region = 1", "ddate": None})
_star("group_03_customer_nation_supplier_nation", ["c_nation", "s_nation"], _SUM, _R, {"customer": "c_region = 1", "supplier": "s_region = 1"})
_star("join_01_customer_filter", [], "count(1)", _R, {"customer": "c_region = 1"})
_star("join_02_supplier_filter", [], "count(1)", _R, {"supplier": "s_region = 1"})
_star("join_03_part_filter", [], "count(1)", _R, {"part": "p_category = 1"})
_star("join_04_date_filter", [], "count(1)", _R, {"ddate": "d_year = 2000"})
_star("join_05_four_table_count", [], "count(1)", _R, {"part": "p_category = 1", "supplier": "s_region = 1", "ddate": None})
_star("q11", [], "sum(lo_extendedprice * lo_discount)", _FLAT, {}, within={"lo_orderdate": (19960101, 19970101), "lo_discount": (1, 3), "lo_quantity": (0, 24)})
_star("q12", [], "sum(lo_extendedprice * lo_discount)", _FLAT, {}, within={"lo_orderdate": (19970101, 19970131), "lo_discount": (4, 6), "lo_quantity": (26, 35)})
_star("q13", [], "sum(lo_extendedprice * lo_discount)", _FLAT, {}, within={"lo_orderdate": (19970204, 19970210), "lo_discount": (5, 7), "lo_quantity": (26, 35)})
_star("q21", ["d_year", "p_brand1"], _SUM, _R, {"part": "p_category = 1", "supplier": "s_region = 1", "ddate": None})
_star("q22", ["d_year", "p_brand1"], _SUM, _R, {"part": "p_brand1 BETWEEN 260 AND 267", "supplier": "s_region = 2", "ddate": None})
_star("q23", ["d_year", "p_brand1"], _SUM, _R, {"part": "p_brand1 = 260", "supplier": "s_region = 3", "ddate": None})
_YEARS = "d_year BETWEEN 1995 AND 2000"
_star("q31", ["c_nation", "s_nation", "d_year"], _SUM, _R, {"customer": "c_region = 2", "supplier": "s_region = 2", "ddate": _YEARS})
_star("q32", ["c_city", "s_city", "d_year"], _SUM, _R, {"customer": "c_nation = 24", "supplier": "s_nation = 24", "ddate": _YEARS})
_star("q33", ["c_city", "s_city", "d_year"], _SUM, _R, {"customer": "c_city = 25 OR c_city = 65", "supplier": "s_city = 25 OR s_city = 65", "ddate": _YEARS})
_star("q34", ["c_city", "s_city", "d_year"], _SUM, _R, {"customer": "c_city = 25 OR c_city = 65", "supplier": "s_city = 25 OR s_city = 65", "ddate": "d_yearmonthnum = 199808"})
_MFGR = "p_mfgr = 0 OR p_mfgr = 1"
_star("q41", ["d_year", "c_nation"], _PROFIT, _PC, {"supplier": "s_region = 1", "customer": "c_region = 1", "part": _MFGR, "ddate": None}, alias="profit")
_star("q42", ["d_year", "s_nation", "p_category"], _PROFIT, _PC, {"customer": "c_region = 1", "supplier": "s_region = 1", "part": _MFGR, "ddate": "d_year = 2000 OR d_year = 2001"}, alias="profit")
_star("q43", ["d_year", "s_city", "p_brand1"], _PROFIT, _PC, {"supplier": "s_nation = 24", "customer": "c_region = 1", "part": "p_category = 3", "ddate": "d_year = 2000 OR d_year = 2001"}, alias="profit")
_star("p1", ["d_year", "c_nation"], "count(1)", _R, {"supplier": "s_region = 1", "customer": "c_region = 1", "part": _MFGR, "ddate": None}, alias="n")
_star("custom2", ["d_year"], _SUM, _R, {"customer": None, "ddate": None}, "(c_mktsegment = 1 AND d_year = 2001) OR (c_mktsegment = 2 AND d_year = 2000)")
_star("custom3", ["c_nation"], _SUM, _R, {"customer": "c_region = 1", "supplier": None}, "c_nation = s_nation")
_star(
    "custom4",
    ["c_region"],
    "sum(lo_extendedprice * lo_discount)",
    ["lo_extendedprice", "lo_discount", "lo_quantity", "lo_tax", "lo_revenue"],
    {"customer": None},
    "lo_quantity * 2 < lo_discount * 10 OR lo_tax + lo_discount BETWEEN 5 AND 10 OR (c_region = 2 AND lo_revenue > 1000000)",
    "profit",
)
_star("custom5", [], "count(lo_orderkey)", ["lo_orderkey", "lo_quantity"], {"part": None}, "lo_quantity >= p_size - 5 AND lo_quantity <= p_size + 5", "n")


@query("SELECT lo_quantity + lo_discount AS both, count(*) AS n FROM x_lineorder GROUP BY lo_quantity + lo_discount")
def group_04_group_by_expression(s: Star) -> DataFrame:
    return s.lineorder("lo_quantity", "lo_discount").groupBy((C("lo_quantity") + C("lo_discount")).alias("both")).agg(n())


@query("SELECT lo_orderkey, c_nation, c_region FROM x_lineorder JOIN x_customer ON lo_custkey = c_custkey WHERE c_region = 1")
def proj_join_01_selected_columns(s: Star) -> DataFrame:
    return star_join(s, ["lo_orderkey"], {"customer": "c_region = 1"}).select("lo_orderkey", "c_nation", "c_region")


@query("SELECT * FROM x_lineorder JOIN x_customer ON lo_custkey = c_custkey WHERE c_region = 1")
def proj_join_02_star_customer(s: Star) -> DataFrame:
    return star_join(s, list(LINEORDER), {"customer": "c_region = 1"})


@query("SELECT lo_orderkey, c_nation, s_nation, lo_revenue FROM x_lineorder JOIN x_customer ON lo_custkey = c_custkey JOIN x_supplier ON lo_suppkey = s_suppkey WHERE c_nation = s_nation")
def proj_join_03_three_table_selected(s: Star) -> DataFrame:
    return star_join(s, ["lo_orderkey", "lo_revenue"], {"customer": None, "supplier": None}).where("c_nation = s_nation").select("lo_orderkey", "c_nation", "s_nation", "lo_revenue")


@query("SELECT lo_revenue - lo_supplycost AS margin, c_nation FROM x_lineorder JOIN x_customer ON lo_custkey = c_custkey WHERE c_region = 1")
def proj_join_04_expression_after_join(s: Star) -> DataFrame:
    return star_join(s, _PC, {"customer": "c_region = 1"}).select((C("lo_revenue") - C("lo_supplycost")).alias("margin"), "c_nation")


@query(f"SELECT d_year, CAST(sum(lo_revenue) AS BIGINT) AS revenue FROM x_lineorder, x_ddate WHERE (lo_orderdate = d_datekey OR lo_commitdate = d_datekey) AND {_YEARS} GROUP BY d_year")
def custom1(s: Star) -> DataFrame:
    days = s.ddate().where(_YEARS)
    return or_key_join(s.lineorder("lo_orderdate", "lo_commitdate", "lo_revenue"), days, ["lo_orderdate", "lo_commitdate"], "d_datekey").groupBy("d_year").agg(total("lo_revenue", "revenue"))


@query("SELECT count(*) AS n, count(v) AS n_v, CAST(sum(v) AS BIGINT) AS total, avg(v) AS mean FROM (SELECT nullif(lo_discount, 0) AS v FROM x_lineorder)")
def nullable_agg(s: Star) -> DataFrame:
    return _nullable(s).agg(n(), F.count("v").alias("n_v"), total("v", "total"), F.avg("v").alias("mean"))


def _nullable(s: Star) -> DataFrame:
    return s.lineorder("lo_discount").select(F.nullif("lo_discount", F.lit(0)).alias("v"))


@query("SELECT nullif(lo_discount, 0) IS NULL AS missing FROM x_lineorder")
def nullable_is_null(s: Star) -> DataFrame:
    return _nullable(s).select(C("v").isNull().alias("missing"))


@query("SELECT count(*) AS n FROM x_lineorder WHERE nullif(lo_discount, 0) IS NULL")
def nullable_where(s: Star) -> DataFrame:
    return _nullable(s).where(C("v").isNull()).agg(n())


@query("SELECT count(*) AS n FROM x_lineorder WHERE NOT (nullif(lo_discount, 0) IS NULL)")
def three_valued_logic_1(s: Star) -> DataFrame:
    return _nullable(s).where(~C("v").isNull()).agg(n())


@query("SELECT v IS NULL OR v > 0 AS flag FROM (SELECT nullif(lo_discount, 0) AS v FROM x_lineorder)")
def three_valued_logic_2(s: Star) -> DataFrame:
    return _nullable(s).select((C("v").isNull() | (C("v") > 0)).alias("flag"))


@query("SELECT v IS NULL AND v > 0 AS flag, NOT (v > 5) AS negated FROM (SELECT nullif(lo_discount, 0) AS v FROM x_lineorder)")
def three_valued_logic_3(s: Star) -> DataFrame:
    return _nullable(s).select((C("v").isNull() & (C("v") > 0)).alias("flag"), (~(C("v") > 5)).alias("negated"))


def _by_year(s: Star) -> DataFrame:
    return star_join(s, _R, {"ddate": None}).groupBy("d_year").agg(total("lo_revenue", "total_revenue"))


_BY_YEAR = "SELECT d_year, CAST(sum(lo_revenue) AS BIGINT) AS total_revenue FROM x_lineorder, x_ddate WHERE lo_orderdate = d_datekey GROUP BY d_year"


@query(_BY_YEAR + " ORDER BY total_revenue DESC NULLS LAST LIMIT 5")
def topn_01_order_by_sum_desc_limit(s: Star) -> DataFrame:
    return top(_by_year(s), 5, "-total_revenue")


@query("SELECT lo_orderkey, lo_revenue FROM (SELECT * FROM x_lineorder ORDER BY lo_revenue DESC NULLS LAST, lo_orderkey, lo_linenumber, lo_partkey, lo_suppkey LIMIT 100)")
def topn_02_order_by_projection(s: Star) -> DataFrame:
    rows = s.lineorder("lo_orderkey", "lo_revenue", "lo_linenumber", "lo_partkey", "lo_suppkey")
    return top(rows, 100, "-lo_revenue", "lo_orderkey", "lo_linenumber", "lo_partkey", "lo_suppkey").select("lo_orderkey", "lo_revenue")


@query(_BY_YEAR + f" HAVING sum(lo_revenue) > {REVENUE_LEAST}")
def having_01_sum_threshold(s: Star) -> DataFrame:
    return _by_year(s).where(C("total_revenue") > REVENUE_LEAST)


@query("SELECT DISTINCT d_year FROM x_ddate")
def distinct_01_single_column(s: Star) -> DataFrame:
    return s.ddate().select("d_year").distinct()


@query("SELECT count(DISTINCT lo_custkey) AS n FROM x_lineorder")
def distinct_02_count_distinct(s: Star) -> DataFrame:
    return s.lineorder("lo_custkey").agg(F.countDistinct("lo_custkey").alias("n"))


@query("SELECT DISTINCT d_year, p_brand1 FROM x_lineorder, x_ddate, x_part WHERE lo_orderdate = d_datekey AND lo_partkey = p_partkey")
def distinct_03_multi_column(s: Star) -> DataFrame:
    return star_join(s, [], {"ddate": None, "part": None}).select("d_year", "p_brand1").distinct()


@query("SELECT lo_orderkey, c_nation FROM x_lineorder LEFT JOIN (SELECT * FROM x_customer WHERE c_region <> 3) ON lo_custkey = c_custkey")
def outer_01_left_join_customer(s: Star) -> DataFrame:
    some = s.customer().where("c_region <> 3")
    return s.lineorder("lo_orderkey", "lo_custkey").join(some, C("lo_custkey") == C("c_custkey"), "left").select("lo_orderkey", "c_nation")


@query(f"SELECT d_year, total_revenue FROM ({_BY_YEAR}) AS yearly")
def cte_01_basic(s: Star) -> DataFrame:
    return _by_year(s).select("d_year", "total_revenue")


@query(f"SELECT d_year, total_revenue FROM ({_BY_YEAR}) AS t WHERE total_revenue > {REVENUE_LEAST}")
def subquery_01_derived_table(s: Star) -> DataFrame:
    return _by_year(s).where(C("total_revenue") > REVENUE_LEAST)


_TIES = ["lo_orderkey", "lo_linenumber", "lo_partkey", "lo_suppkey", "lo_quantity", "lo_extendedprice", "lo_commitdate"]


@query(f"SELECT d_year, lo_revenue, CAST(row_number() OVER (PARTITION BY d_year ORDER BY lo_revenue DESC NULLS LAST, {', '.join(_TIES)}) AS INT) AS place FROM x_lineorder, x_ddate WHERE lo_orderdate = d_datekey")
def window_01_row_number(s: Star) -> DataFrame:
    rows = star_join(s, [*_R, *_TIES], {"ddate": None}).select("d_year", "lo_revenue", *_TIES)
    return row_number(rows, "d_year", "lo_revenue", True, _TIES, "place").select("d_year", "lo_revenue", "place")


@query("SELECT d_year, lo_orderkey, CAST(sum(lo_revenue) OVER (PARTITION BY d_year ORDER BY lo_orderkey) AS BIGINT) AS running FROM x_lineorder, x_ddate WHERE lo_orderdate = d_datekey")
def window_02_running_sum(s: Star) -> DataFrame:
    rows = star_join(s, ["lo_revenue", "lo_orderkey"], {"ddate": None}).select("d_year", "lo_orderkey", "lo_revenue")
    return running_sum(rows, "d_year", "lo_orderkey", "lo_revenue", "running").select("d_year", "lo_orderkey", "running")


_BUCKET = "CASE WHEN lo_quantity < 10 THEN 0 WHEN lo_quantity < 25 THEN 1 ELSE 2 END"


@query(f"SELECT {_BUCKET} AS qty_bucket, CAST(sum(lo_revenue) AS BIGINT) AS revenue FROM x_lineorder GROUP BY 1 ORDER BY revenue DESC NULLS LAST")
def case_01_bucketed_sum(s: Star) -> DataFrame:
    bucket = F.when(C("lo_quantity") < 10, 0).when(C("lo_quantity") < 25, 1).otherwise(2).alias("qty_bucket")
    return s.lineorder("lo_quantity", "lo_revenue").groupBy(bucket).agg(total("lo_revenue", "revenue")).orderBy(C("revenue").desc_nulls_last())


@query(
    "SELECT d_year, CAST(sum(CASE WHEN lo_quantity < 25 THEN lo_revenue ELSE 0 END) AS BIGINT) AS low_qty_revenue, CAST(sum(CASE lo_discount WHEN 1 THEN lo_revenue ELSE 0 END) AS BIGINT) AS discount_1_revenue"
    " FROM x_lineorder, x_ddate WHERE lo_orderdate = d_datekey GROUP BY d_year ORDER BY low_qty_revenue DESC NULLS LAST LIMIT 5"
)
def case_02_conditional_sum(s: Star) -> DataFrame:
    rows = star_join(s, ["lo_revenue", "lo_quantity", "lo_discount"], {"ddate": None})
    low, one = F.when(C("lo_quantity") < 25, C("lo_revenue")).otherwise(0), F.when(C("lo_discount") == 1, C("lo_revenue")).otherwise(0)
    return top(rows.groupBy("d_year").agg(total(low, "low_qty_revenue"), total(one, "discount_1_revenue")), 5, "-low_qty_revenue")


@query("SELECT c1.c_nation, count(*) AS n FROM x_customer AS c1, x_customer AS c2 WHERE c1.c_nation = c2.c_nation GROUP BY c1.c_nation")
def alias_01_self_join_customer_nation(s: Star) -> DataFrame:
    # the pairs of a nation are counted from its rows on either side, so no pair is made
    one, two = s.customer().groupBy("c_nation").agg(n("a")).alias("c1"), s.customer().groupBy("c_nation").agg(n("b")).alias("c2")
    return one.join(two, C("c1.c_nation") == C("c2.c_nation")).select("c1.c_nation", (C("a") * C("b")).alias("n"))


@query(f"SELECT d_year AS order_year, CAST(sum(lo_revenue) AS BIGINT) AS revenue FROM x_lineorder, x_ddate WHERE lo_orderdate = d_datekey GROUP BY d_year HAVING sum(lo_revenue) > {REVENUE_LEAST} ORDER BY revenue DESC NULLS LAST LIMIT 5")
def alias_02_table_column_aliases(s: Star) -> DataFrame:
    return top(_by_year(s).select(C("d_year").alias("order_year"), C("total_revenue").alias("revenue")).where(C("revenue") > REVENUE_LEAST), 5, "-revenue")


@query("SELECT c_city, count(*) AS n FROM x_customer, x_supplier WHERE c_city = s_city GROUP BY c_city")
def mht_01_non_unique_join_city(s: Star) -> DataFrame:
    return s.customer().join(s.supplier(), C("c_city") == C("s_city")).groupBy("c_city").agg(n())


@query("SELECT d_year, count(*) AS n FROM x_lineorder, x_ddate WHERE lo_orderdate = d_datekey OR lo_commitdate = d_datekey GROUP BY d_year")
def mht_02_or_join_dedup(s: Star) -> DataFrame:
    return or_key_join(s.lineorder("lo_orderdate", "lo_commitdate"), s.ddate(), ["lo_orderdate", "lo_commitdate"], "d_datekey").groupBy("d_year").agg(n())


@query("SELECT * FROM (SELECT lo_orderkey, lo_linenumber, lo_partkey, lo_suppkey, c_name, k FROM x_lineorder JOIN (SELECT c_custkey, c_name, unnest([0, 1]) AS k FROM x_customer) ON lo_custkey = c_custkey)")
def non_unique_projection(s: Star) -> DataFrame:
    twice = s.customer().select("c_custkey", "c_name", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    rows = s.lineorder("lo_orderkey", "lo_linenumber", "lo_partkey", "lo_suppkey", "lo_custkey")
    return rows.join(twice, C("lo_custkey") == C("c_custkey")).drop("lo_custkey", "c_custkey")


@query("SELECT CAST(round(avg(lo_extendedprice * lo_discount / CAST(100 AS DOUBLE))) AS BIGINT) AS mean FROM x_lineorder")
def types_01_decimal_avg(s: Star) -> DataFrame:
    share = C("lo_extendedprice") * C("lo_discount") / F.lit(100.0)
    return s.lineorder("lo_extendedprice", "lo_discount").agg(F.round(F.avg(share)).cast("long").alias("mean"))


@query("SELECT CAST(lo_orderdate // 10000 AS INT) AS year, count(*) AS n FROM x_lineorder GROUP BY 1")
def types_02_date_extract(s: Star) -> DataFrame:
    return s.lineorder("lo_orderdate").groupBy(F.expr("CAST(lo_orderdate DIV 10000 AS INT)").alias("year")).agg(n())


@query("SELECT count(*) AS n FROM x_customer WHERE c_name LIKE 'Customer#00000001%'")
def types_03_string_like(s: Star) -> DataFrame:
    return s.customer().where(C("c_name").like("Customer#00000001%")).agg(n())


@query("SELECT * FROM x_lineorder JOIN x_customer ON lo_custkey = c_custkey WHERE c_region = 1")
def stress_01_wide_star_customer(s: Star) -> DataFrame:
    return star_join(s, list(LINEORDER), {"customer": "c_region = 1"})


@query("SELECT * FROM x_lineorder JOIN x_customer ON lo_custkey = c_custkey JOIN x_supplier ON lo_suppkey = s_suppkey WHERE c_nation = s_nation")
def stress_02_wide_star_customer_supplier(s: Star) -> DataFrame:
    return star_join(s, list(LINEORDER), {"customer": None, "supplier": None}).where("c_nation = s_nation")


# --- inventory rows that no benchmark statement exercises ---


@query("SELECT count(*) AS n FROM (SELECT lo_orderkey FROM x_lineorder LIMIT 50)")
def limit_no_order(s: Star) -> DataFrame:
    return s.lineorder("lo_orderkey").limit(50).agg(n())


@query("SELECT lo_orderkey FROM x_lineorder LIMIT 0")
def limit_zero(s: Star) -> DataFrame:
    return s.lineorder("lo_orderkey").limit(0)


@query("SELECT v, lo_orderkey FROM (SELECT DISTINCT nullif(lo_discount, 0) AS v, lo_orderkey FROM x_lineorder WHERE lo_orderkey < 40) ORDER BY v NULLS LAST, lo_orderkey LIMIT 30")
def order_null_last(s: Star) -> DataFrame:
    rows = s.lineorder("lo_discount", "lo_orderkey").where("lo_orderkey < 40").select(F.nullif("lo_discount", F.lit(0)).alias("v"), "lo_orderkey").distinct()
    return top(rows, 30, "v", "lo_orderkey")


@query("SELECT CASE WHEN lo_quantity < 25 THEN 1 ELSE 0 END AS low, count(*) AS n FROM x_lineorder GROUP BY 1")
def case_when_function(s: Star) -> DataFrame:
    return s.lineorder("lo_quantity").groupBy(F.when(C("lo_quantity") < 25, 1).otherwise(0).alias("low")).agg(n())


@query("SELECT CAST(sum((lo_supplycost - lo_revenue) // 7) AS BIGINT) AS total, CAST(sum(lo_revenue // nullif(lo_discount, 0)) AS BIGINT) AS guarded FROM x_lineorder")
def int_division(s: Star) -> DataFrame:
    return s.lineorder("lo_supplycost", "lo_revenue", "lo_discount").agg(F.expr("sum((lo_supplycost - lo_revenue) DIV 7)").alias("total"), F.expr("sum(lo_revenue DIV nullif(lo_discount, 0))").alias("guarded"))


@query("SELECT NOT (lo_quantity < 25) AS high, lo_quantity = lo_discount AS same FROM x_lineorder")
def bool_projection(s: Star) -> DataFrame:
    return s.lineorder("lo_quantity", "lo_discount").select((~(C("lo_quantity") < 25)).alias("high"), (C("lo_quantity") == C("lo_discount")).alias("same"))


@query("SELECT nullif(lo_discount, 0) AS v, count(*) AS n, CAST(sum(lo_quantity) AS BIGINT) AS total FROM x_lineorder GROUP BY 1")
def group_by_null_key(s: Star) -> DataFrame:
    return s.lineorder("lo_discount", "lo_quantity").groupBy(F.nullif("lo_discount", F.lit(0)).alias("v")).agg(n(), total("lo_quantity", "total"))


@query("SELECT min(lo_revenue - lo_supplycost) AS least, max(lo_revenue - lo_supplycost) AS most, CAST(sum(CASE WHEN lo_revenue < lo_supplycost THEN lo_revenue - lo_supplycost END) AS BIGINT) AS losses FROM x_lineorder")
def min_max_negative(s: Star) -> DataFrame:
    margin = C("lo_revenue") - C("lo_supplycost")
    return s.lineorder(*_PC).agg(F.min(margin).alias("least"), F.max(margin).alias("most"), total(F.when(margin < 0, margin), "losses"))


@query("SELECT count(*) AS n, CAST(sum(lo_revenue) AS BIGINT) AS total, min(lo_revenue) AS least, avg(lo_revenue) AS mean FROM x_lineorder WHERE lo_quantity > 1000")
def empty_aggregate(s: Star) -> DataFrame:
    return s.lineorder("lo_revenue", "lo_quantity").where("lo_quantity > 1000").agg(n(), total("lo_revenue", "total"), F.min("lo_revenue").alias("least"), F.avg("lo_revenue").alias("mean"))


@query("SELECT lo_discount, count(*) AS n, avg(lo_quantity) AS mean FROM x_lineorder GROUP BY lo_discount HAVING CASE WHEN lo_discount < 5 THEN count(*) > 10 ELSE avg(lo_quantity) IS NOT NULL AND lo_discount % 2 = 0 END")
def having_case(s: Star) -> DataFrame:
    grouped = s.lineorder("lo_discount", "lo_quantity").groupBy("lo_discount").agg(n(), F.avg("lo_quantity").alias("mean"))
    return grouped.where(F.when(C("lo_discount") < 5, C("n") > 10).otherwise(C("mean").isNotNull() & (C("lo_discount") % 2 == 0)))


@query("SELECT count(*) AS n FROM x_customer JOIN x_supplier ON c_nation = s_nation AND c_city = s_city AND c_custkey > s_suppkey")
def composite_key_join(s: Star) -> DataFrame:
    return s.customer().join(s.supplier(), (C("c_nation") == C("s_nation")) & (C("c_city") == C("s_city")) & (C("c_custkey") > C("s_suppkey"))).agg(n())


@query("SELECT r_name, n_name FROM region, nation")
def cross_join(s: Star) -> DataFrame:
    return s.table("region").select("r_name").crossJoin(s.table("nation").select("n_name"))


_NUMBERS = [(1, 1, 10, 1), (2, 1, None, 1), (3, 1, 30, None), (4, 2, 5, 0), (5, 2, None, None), (6, 2, 15, 1), (7, 3, None, 0), (8, 3, 20, 1), (9, 3, 25, None), (10, 4, None, None), (11, 4, None, 1), (12, 4, 40, 0)]
_NUMBERS_SQL = "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else str(x) for x in r) + ")" for r in _NUMBERS) + ") AS t(id, grp, val, flag))"


def numbers(s: Star) -> DataFrame:
    return s.spark.createDataFrame(_NUMBERS, "id int, grp int, val int, flag int")


@query(f"SELECT count(*) AS n, count(val) AS n_val, CAST(sum(val) AS BIGINT) AS total, avg(val) AS mean FROM {_NUMBERS_SQL}")
def nullable_fixture_q1(s: Star) -> DataFrame:
    return numbers(s).agg(n(), F.count("val").alias("n_val"), total("val", "total"), F.avg("val").alias("mean"))


@query(f"SELECT grp, count(*) AS n, count(val) AS n_val, CAST(sum(val) AS BIGINT) AS total FROM {_NUMBERS_SQL} GROUP BY grp ORDER BY grp")
def nullable_fixture_q2(s: Star) -> DataFrame:
    return numbers(s).groupBy("grp").agg(n(), F.count("val").alias("n_val"), total("val", "total")).orderBy("grp")


@query(f"SELECT count(*) AS n FROM {_NUMBERS_SQL} WHERE val IS NULL")
def nullable_fixture_q3(s: Star) -> DataFrame:
    return numbers(s).where(C("val").isNull()).agg(n())


@query(f"SELECT count(*) AS n FROM {_NUMBERS_SQL} WHERE flag = 1")
def nullable_fixture_q4(s: Star) -> DataFrame:
    return numbers(s).where(C("flag") == 1).agg(n())


@query(f"SELECT grp, CAST(sum(CASE WHEN val IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing FROM {_NUMBERS_SQL} GROUP BY grp ORDER BY grp")
def nullable_fixture_q5(s: Star) -> DataFrame:
    return numbers(s).groupBy("grp").agg(total(F.when(C("val").isNull(), 1).otherwise(0), "missing")).orderBy("grp")


def build(name: str, star: Star) -> DataFrame:
    """The query over star tables, derived or stored."""
    return _QUERIES[name][0](star)


def queries() -> dict:
    return {name: (lambda spark, sf_dir, build=build: build(Star(spark, sf_dir))) for name, (build, _) in _QUERIES.items()}


def oracle_sql() -> dict:
    views = duck_views()
    return {name: views + sql for name, (_, sql) in _QUERIES.items()}
