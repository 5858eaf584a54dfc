"""Queries as SQL texts, run by ``Engine.sql``: every statement of the catalogue, and the inventory's rows that it leaves out.

A text is what DuckDB gets too, over ``x_`` views; where the engine's own meaning is to show (nulls last unsaid, ``/`` of whole
numbers, CASE_WHEN), the text for DuckDB spells it out.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from halyard.plans import catalogue
from halyard.plans.engine import Engine
from halyard.sources.star import duck_views

#: Statements of the catalogue that DuckDB has to be given in its own terms.
OWN_TERMS = {
    "non_unique_projection": "SELECT lo_orderkey, lo_linenumber, lo_partkey, lo_suppkey, c_name, k FROM lineorder JOIN (SELECT c_custkey, c_name, explode(array(0, 1)) AS k FROM customer) ON lo_custkey = c_custkey",
    "case_when_function": "SELECT CASE_WHEN(lo_quantity < 25, 1, 0) AS low, count(*) AS n FROM lineorder GROUP BY CASE_WHEN(lo_quantity < 25, 1, 0)",
    "alias_01_self_join_customer_nation": "SELECT c1.c_nation, count(*) AS n FROM customer AS c1, customer AS c2 WHERE c1.c_nation = c2.c_nation GROUP BY c1.c_nation",
}

_V = "(SELECT nullif(lo_discount, 0) AS v, lo_orderkey, lo_linenumber, lo_quantity, lo_revenue, lo_partkey, lo_suppkey FROM x_lineorder WHERE lo_orderkey < 400)"
_K = "(SELECT nullif(c_region, 2) AS k, c_custkey FROM x_customer)"
_S = "(SELECT nullif(s_region, 3) AS k, s_suppkey FROM x_supplier)"
_N = catalogue._NUMBERS_SQL
_TIE = "lo_orderkey, lo_linenumber, lo_partkey, lo_suppkey, lo_quantity"
#: name -> text, or (text of the engine, text of DuckDB)
TEXTS: dict[str, str | tuple[str, str]] = {
    # set operations
    "set_union_all": "SELECT c_nation AS x FROM x_customer UNION ALL SELECT s_nation FROM x_supplier",
    "set_union": "SELECT c_city AS x FROM x_customer UNION SELECT s_city FROM x_supplier",
    "set_intersect": "SELECT c_city AS x FROM x_customer INTERSECT SELECT s_city FROM x_supplier",
    "set_intersect_all": "SELECT c_city AS x FROM x_customer INTERSECT ALL SELECT s_city FROM x_supplier",
    "set_except": "SELECT c_city AS x FROM x_customer EXCEPT SELECT s_city FROM x_supplier",
    "set_except_all": "SELECT c_nation AS x FROM x_customer EXCEPT ALL SELECT s_nation FROM x_supplier",
    # subqueries
    "subquery_scalar": "SELECT count(*) AS n FROM x_lineorder WHERE lo_revenue > (SELECT avg(lo_revenue) FROM x_lineorder)",
    "subquery_scalar_correlated": "SELECT c_custkey, (SELECT count(*) FROM x_supplier WHERE s_nation = c_nation) AS n FROM x_customer",
    "subquery_in": "SELECT count(*) AS n FROM x_lineorder WHERE lo_custkey IN (SELECT c_custkey FROM x_customer WHERE c_region = 1)",
    "subquery_not_in": "SELECT count(*) AS n FROM x_customer WHERE c_city NOT IN (SELECT s_city FROM x_supplier)",
    "subquery_not_in_null": f"SELECT count(*) AS n FROM x_customer WHERE c_region NOT IN (SELECT k FROM {_S})",
    "subquery_exists": "SELECT count(*) AS n FROM x_customer WHERE EXISTS (SELECT 1 FROM x_supplier WHERE s_city = c_city)",
    "subquery_not_exists": "SELECT count(*) AS n FROM x_customer WHERE NOT EXISTS (SELECT 1 FROM x_supplier WHERE s_city = c_city)",
    "cte_text": "WITH y AS (SELECT d_year, CAST(sum(lo_revenue) AS BIGINT) AS r FROM x_lineorder, x_ddate WHERE lo_orderdate = d_datekey GROUP BY d_year), z AS (SELECT max(r) AS m FROM y) SELECT d_year, r FROM y, z WHERE r = m",
    # joins
    "join_right": f"SELECT c_custkey, s_suppkey FROM {_K} AS a RIGHT JOIN {_S} AS b ON a.k = b.k AND c_custkey % 7 = s_suppkey % 7",
    "join_full": "SELECT c_city, s_city, count(*) AS n FROM x_customer FULL JOIN x_supplier ON c_city = s_city GROUP BY c_city, s_city",
    "join_left_null_keys": f"SELECT c_custkey, s_suppkey FROM {_K} AS a LEFT JOIN {_S} AS b ON a.k = b.k AND c_custkey = s_suppkey",
    "join_null_keys": f"SELECT count(*) AS n FROM {_K} AS a JOIN {_S} AS b ON a.k = b.k",
    "join_semi": ("SELECT c_custkey FROM x_customer LEFT SEMI JOIN x_supplier ON c_city = s_city", "SELECT c_custkey FROM x_customer SEMI JOIN x_supplier ON c_city = s_city"),
    "join_anti": ("SELECT c_custkey FROM x_customer LEFT ANTI JOIN x_supplier ON c_city = s_city", "SELECT c_custkey FROM x_customer ANTI JOIN x_supplier ON c_city = s_city"),
    "join_using": f"SELECT k, c_custkey, s_suppkey FROM {_K} AS a JOIN {_S} AS b USING (k)",
    "join_natural": f"SELECT k, c_custkey, s_suppkey FROM {_K} AS a NATURAL JOIN {_S} AS b",
    "join_range": "SELECT count(*) AS n FROM x_supplier AS a JOIN x_part AS b ON b.p_size BETWEEN a.s_region * 5 AND a.s_region * 5 + 2 AND a.s_suppkey < 20",
    "join_or_keys": "SELECT d_year, count(*) AS n FROM x_lineorder, x_ddate WHERE (lo_orderdate = d_datekey OR lo_commitdate = d_datekey) AND d_year < 1999 AND lo_quantity > 10 GROUP BY d_year",
    "join_or_three_keys": "SELECT count(*) AS n FROM x_customer JOIN x_supplier ON c_custkey = s_suppkey OR c_city = s_city OR c_custkey = s_city",
    # windows
    "window_rank": f"SELECT lo_orderkey, lo_linenumber, CAST(rank() OVER (PARTITION BY lo_quantity ORDER BY v DESC NULLS LAST) AS BIGINT) AS r, CAST(dense_rank() OVER (PARTITION BY lo_quantity ORDER BY v DESC NULLS LAST) AS BIGINT) AS d FROM {_V} AS t",
    "window_lead_lag": f"SELECT lo_orderkey, lo_linenumber, lead(lo_revenue) OVER (PARTITION BY lo_orderkey ORDER BY {_TIE}) AS next, lag(lo_revenue, 2, -1) OVER (PARTITION BY lo_orderkey ORDER BY {_TIE}) AS back FROM {_V} AS t",
    "window_rows_frame": f"SELECT lo_orderkey, lo_linenumber, CAST(sum(lo_revenue) OVER (PARTITION BY lo_orderkey ORDER BY {_TIE} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS s FROM {_V} AS t",
    "window_range_frame": f"SELECT lo_orderkey, lo_linenumber, count(*) OVER (PARTITION BY lo_suppkey ORDER BY lo_quantity RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS n FROM {_V} AS t",
    "window_first_last": f"SELECT lo_orderkey, lo_linenumber, first_value(lo_quantity) OVER (PARTITION BY lo_orderkey ORDER BY {_TIE}) AS f, last_value(lo_quantity) OVER (PARTITION BY lo_orderkey ORDER BY {_TIE} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM {_V} AS t",
    "window_ntile": f"SELECT lo_orderkey, lo_linenumber, CAST(ntile(4) OVER (PARTITION BY lo_suppkey ORDER BY {_TIE}) AS BIGINT) AS q FROM {_V} AS t",
    "window_of_aggregate": "SELECT d_year, d_month, CAST(sum(sum(lo_revenue)) OVER (PARTITION BY d_year ORDER BY d_month) AS BIGINT) AS s FROM x_lineorder, x_ddate WHERE lo_orderdate = d_datekey GROUP BY d_year, d_month",
    "window_nulls_unsaid": (f"SELECT lo_orderkey, lo_linenumber, CAST(row_number() OVER (ORDER BY v, {_TIE}) AS BIGINT) AS n FROM {_V} AS t", f"SELECT lo_orderkey, lo_linenumber, CAST(row_number() OVER (ORDER BY v NULLS LAST, {_TIE}) AS BIGINT) AS n FROM {_V} AS t"),
    # aggregates
    "agg_in_expression": "SELECT c_region, sum(lo_revenue) / CAST(count(*) AS DOUBLE) AS mean, max(lo_quantity) - min(lo_quantity) AS spread FROM x_lineorder, x_customer WHERE lo_custkey = c_custkey GROUP BY c_region",
    "agg_ratio_cuts": ("SELECT lo_discount, sum(lo_revenue) / count(*) AS mean FROM x_lineorder GROUP BY lo_discount", "SELECT lo_discount, CAST(sum(lo_revenue) // count(*) AS BIGINT) AS mean FROM x_lineorder GROUP BY lo_discount"),
    "agg_rollup": "SELECT c_region, c_nation, count(*) AS n FROM x_customer GROUP BY ROLLUP (c_region, c_nation)",
    "agg_cube": "SELECT c_region, c_mktsegment, count(*) AS n FROM x_customer GROUP BY CUBE (c_region, c_mktsegment)",
    "agg_grouping_sets": "SELECT c_region, c_mktsegment, count(*) AS n, CAST(grouping(c_region) AS BIGINT) AS g FROM x_customer GROUP BY GROUPING SETS ((c_region), (c_mktsegment), ())",
    "agg_filter": "SELECT c_region, count(*) FILTER (WHERE c_mktsegment = 1) AS n FROM x_customer GROUP BY c_region",
    "agg_stddev": "SELECT lo_discount, round(stddev_samp(lo_quantity), 6) AS s, round(var_pop(lo_quantity), 6) AS v FROM x_lineorder GROUP BY lo_discount",
    "agg_count_distinct_two": "SELECT c_region, count(DISTINCT c_nation) AS a, count(DISTINCT c_city) AS b FROM x_customer GROUP BY c_region",
    "agg_avg_ordered": ("SELECT c_nation, avg(lo_revenue) AS mean FROM x_lineorder, x_customer WHERE lo_custkey = c_custkey GROUP BY c_nation ORDER BY mean DESC, c_nation LIMIT 5", "SELECT c_nation, avg(lo_revenue) AS mean FROM x_lineorder, x_customer WHERE lo_custkey = c_custkey GROUP BY c_nation ORDER BY mean DESC NULLS LAST, c_nation LIMIT 5"),
    "agg_count_column_one_to_n": f"SELECT c_city, count(k) AS n, count(*) AS m FROM x_customer JOIN (SELECT s_city, nullif(s_region, 1) AS k FROM x_supplier) ON c_city = s_city GROUP BY c_city",
    "agg_bool": "SELECT c_region, bool_and(c_mktsegment < 4) AS every_one, bool_or(c_mktsegment = 2) AS some_one FROM x_customer GROUP BY c_region",
    # order and limit
    "order_nulls_unsaid": (f"SELECT grp, val FROM {_N} ORDER BY val, id LIMIT 9", f"SELECT grp, val FROM {_N} ORDER BY val NULLS LAST, id LIMIT 9"),
    "order_nulls_unsaid_desc": (f"SELECT grp, val FROM {_N} ORDER BY val DESC, id LIMIT 9", f"SELECT grp, val FROM {_N} ORDER BY val DESC NULLS LAST, id LIMIT 9"),
    "order_nulls_first": f"SELECT grp, val FROM {_N} ORDER BY val NULLS FIRST, id LIMIT 5",
    "order_ordinal_and_case": (f"SELECT id, CASE WHEN val > 20 THEN 1 WHEN val > 0 THEN 0 END AS c FROM {_N} ORDER BY 2, CASE WHEN flag = 1 THEN 0 ELSE 1 END DESC, id LIMIT 7", f"SELECT id, CASE WHEN val > 20 THEN 1 WHEN val > 0 THEN 0 END AS c FROM {_N} ORDER BY 2 NULLS LAST, CASE WHEN flag = 1 THEN 0 ELSE 1 END DESC, id LIMIT 7"),
    "limit_offset": "SELECT c_custkey FROM x_customer ORDER BY c_custkey LIMIT 10 OFFSET 25",
    # predicates
    "where_case": "SELECT count(*) AS n FROM x_lineorder WHERE CASE WHEN lo_discount > 5 THEN lo_quantity > 30 ELSE lo_quantity < 5 END",
    "where_literal_left": "SELECT count(*) AS n FROM x_lineorder WHERE 25 > lo_quantity AND 3 = lo_discount",
    "where_float_literal": "SELECT count(*) AS n FROM x_lineorder WHERE lo_quantity > 24.5",
    "where_between_columns": "SELECT count(*) AS n FROM x_lineorder WHERE lo_discount BETWEEN lo_tax AND lo_quantity",
    "where_not_like": "SELECT count(*) AS n FROM x_customer WHERE c_name NOT LIKE '%7'",
    # expressions
    "divide_whole": ("SELECT id, val / 7 AS a, -val / 7 AS b, (val / 2) / 3 AS c, (val + 1) / (grp * 2) AS d FROM " + _N, "SELECT id, CAST(val // 7 AS BIGINT) AS a, CAST(-val // 7 AS BIGINT) AS b, CAST((val // 2) // 3 AS BIGINT) AS c, CAST((val + 1) // (grp * 2) AS BIGINT) AS d FROM " + _N),
    "divide_decimal": "SELECT id, val / CAST(8 AS DOUBLE) AS a FROM " + _N,
    "divide_in_predicate": ("SELECT count(*) AS n FROM x_lineorder WHERE lo_quantity / 10 = 2", "SELECT count(*) AS n FROM x_lineorder WHERE lo_quantity // 10 = 2"),
    "modulo_and_minus": f"SELECT id, -val AS m, val % 4 AS r, -val % 4 AS s, +val AS p FROM {_N}",
    "bit_operators": (f"SELECT id, val & 12 AS a, val | 3 AS b, val ^ 5 AS c, ~val AS d, shiftleft(val, 2) AS e FROM {_N}", f"SELECT id, val & 12 AS a, val | 3 AS b, xor(val, 5) AS c, ~val AS d, val << 2 AS e FROM {_N}"),
    "concatenation": "SELECT c_name || '/' || CAST(c_city AS VARCHAR(20)) AS x FROM x_customer",
    "string_functions": "SELECT upper(c_name) AS u, length(c_name) AS l, substr(c_name, 1, 8) AS s, replace(c_name, '#', '-') AS r, trim('  a ') AS t, reverse(c_name) AS v FROM x_customer",
    "date_functions": "SELECT CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, CAST(quarter(o_orderdate) AS BIGINT) AS q, CAST(extract(day FROM o_orderdate) AS BIGINT) AS d, count(*) AS n FROM orders GROUP BY 1, 2, 3, 4",
    "math_functions": f"SELECT id, abs(-val) AS a, CAST(floor(val / CAST(4 AS DOUBLE)) AS BIGINT) AS f, CAST(ceil(val / CAST(4 AS DOUBLE)) AS BIGINT) AS c, round(sqrt(val), 6) AS s, round(power(val, 2), 3) AS p, greatest(val, 12) AS g, least(val, 12) AS l, CAST(sign(val - 15) AS BIGINT) AS z FROM {_N} WHERE val IS NOT NULL",
    "conditional_functions": f"SELECT id, coalesce(val, -1) AS c, nullif(grp, 2) AS n, CASE grp WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE 'more' END AS w FROM {_N}",
    "case_when_unknown": (f"SELECT id, CASE_WHEN(val > 10, 1, 0) AS x, CASE_WHEN(val > 10, CASE_WHEN(flag = 1, 2, 3), NULL) AS y FROM {_N}", f"SELECT id, CASE WHEN val > 10 THEN 1 ELSE 0 END AS x, CASE WHEN val > 10 THEN CASE WHEN flag = 1 THEN 2 ELSE 3 END END AS y FROM {_N}"),
    "array_functions": ("SELECT c_region, array_sort(collect_set(c_nation)) AS a, size(collect_set(c_nation)) AS n FROM x_customer GROUP BY c_region", "SELECT c_region, list_sort(list(DISTINCT c_nation)) AS a, CAST(count(DISTINCT c_nation) AS INT) AS n FROM x_customer GROUP BY c_region"),
}
_TABLES = ("region", "nation", "orders")


def _plain(text: str) -> str:
    return re.sub(r"\bx_(lineorder|ddate|customer|supplier|part)\b", r"\1", text)


def _unsaid(text: str) -> str:
    """A statement of the catalogue as a user of the engine would write it: nulls last unsaid, ``/`` for whole division."""
    return _plain(text.replace(" NULLS LAST", "").replace("//", "/"))


def texts() -> dict[str, tuple[str, str]]:
    """name -> (text for the engine, text for DuckDB)."""
    out = {f"sql_{name}": (OWN_TERMS.get(name) or _unsaid(sql), sql) for name, (_, sql) in catalogue._QUERIES.items()}
    for name, text in TEXTS.items():
        own, duck = text if isinstance(text, tuple) else (text, text)
        out[f"sql_{name}"] = (_plain(own), duck)
    return out


def run(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    engine = Engine(spark, sf_dir)
    for name in _TABLES:
        engine.star.table(name).createOrReplaceTempView(name)
    return engine.sql(text)


def queries() -> dict:
    return {name: (lambda spark, sf_dir, text=text: run(spark, sf_dir, text)) for name, (text, _) in texts().items()}


def oracle_sql() -> dict:
    views = duck_views().rstrip()
    merged = {}
    for name, (_, sql) in texts().items():
        merged[name] = f"{views},\n{sql[5:]}" if sql.startswith("WITH ") else f"{views}\n{sql}"
    return merged
