import io

import pytest
from conftest import DATA, same_rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from halyard.functions import dialect
from halyard.operators import reorder
from halyard.operators.joins import or_key_join
from halyard.operators.ordering import top
from halyard.operators.windows import row_number, running_sum
from halyard.plans import catalogue, texts
from halyard.plans.engine import Config, Engine, QueryError, Shell, parse_size, statements
from halyard.sources import formats, loader, star
from halyard.sources.star import Star


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_query_equals_sql(spark, duck, name):
    same_rows(catalogue.queries()[name](spark, DATA), duck, catalogue.oracle_sql()[name])


@pytest.mark.parametrize("name", list(texts.queries()))
def test_text_equals_sql(spark, duck, name):
    same_rows(texts.queries()[name](spark, DATA), duck, texts.oracle_sql()[name])


def test_queries_and_sql_have_the_same_names():
    assert catalogue.queries().keys() == catalogue.oracle_sql().keys()


def test_or_key_join_with_nulls_and_repeated_keys(spark):
    left = spark.createDataFrame([(1, 5, 5), (2, 5, 6), (3, None, 6), (4, 7, None), (5, None, None), (6, 9, 8)], "id int, a int, b int")
    right = spark.createDataFrame([(5, "x"), (5, "y"), (6, "z"), (None, "n")], "k int, v string")
    plain = left.join(right, (F.col("a") == F.col("k")) | (F.col("b") == F.col("k")))
    assert sorted(map(tuple, or_key_join(left, right, ["a", "b"], "k").collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)


def test_or_key_join_is_not_a_nested_loop(spark):
    s = catalogue.Star(spark, DATA)
    plan = or_key_join(s.lineorder("lo_orderdate", "lo_commitdate"), s.ddate(), ["lo_orderdate", "lo_commitdate"], "d_datekey")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_nulls_come_last_both_ways(spark):
    df = spark.createDataFrame([(None,), (1,), (2,)], "v int")
    assert [r.v for r in top(df, 3, "v").collect()] == [1, 2, None]
    assert [r.v for r in top(df, 3, "-v").collect()] == [2, 1, None]


@pytest.mark.parametrize("sql, expected", [("true AND null", None), ("false AND null", False), ("null AND null", None), ("true OR null", True), ("false OR null", None), ("NOT null", None)])
def test_three_valued_logic(spark, sql, expected):
    assert spark.sql(f"SELECT {sql.replace('null', 'CAST(null AS BOOLEAN)')} AS v").collect()[0].v is expected


def plan_of(df):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")  # which cuts nothing short
    return df._jdf.queryExecution().explainString(mode)


def test_columns_and_ranges_reach_the_scan(spark):
    plan = plan_of(catalogue.queries()["filter_01_eq"](spark, DATA))
    assert "ReadSchema: struct<l_quantity:double>" in plan and "GreaterThanOrEqual(l_quantity,25.0)" in plan and "LessThan(l_quantity,26.0)" in plan
    plan = plan_of(catalogue.queries()["q11"](spark, DATA))
    assert all(x in plan for x in ("GreaterThanOrEqual(o_orderdate,1996-01-01", "LessThan(o_orderdate,1997-01-02", "LessThan(l_discount,0.0351)", "LessThan(l_quantity,25.0)"))


def test_ranges_lose_no_row(spark):
    s = Star(spark, DATA)
    for c, low, high in (("lo_discount", 0, 3), ("lo_tax", 2, 2), ("lo_quantity", 50, 50), ("lo_orderdate", 19960229, 19960301), ("lo_commitdate", 19951231, 19960101)):
        assert s.lineorder(c, within={c: (low, high)}).count() == s.lineorder(c).where(f"{c} BETWEEN {low} AND {high}").count() > 0


def test_stored_star(spark, duck, tmp_path):
    star = Star(spark, DATA).store_tables(str(tmp_path))
    for name in ("q11", "q21", "q43", "custom1", "mht_02_or_join_dedup"):
        same_rows(catalogue._QUERIES[name][0](star), duck, catalogue.oracle_sql()[name])
    plan = plan_of(catalogue._QUERIES["q11"][0](star))
    assert "GreaterThanOrEqual(lo_orderdate,19960101)" in plan and "LessThanOrEqual(lo_discount,3)" in plan
    engine = Engine(spark, DATA, store=str(tmp_path))
    assert "GreaterThanOrEqual(lo_quantity,25)" in plan_of(engine.sql("select count(*) as n from lineorder where lo_quantity between 25 and 35"))


@pytest.mark.parametrize("name", ["sql_custom1", "sql_mht_02_or_join_dedup", "sql_join_or_keys", "sql_join_or_three_keys"])
def test_or_joins_of_texts_are_no_nested_loops(spark, name):
    plan = plan_of(texts.queries()[name](spark, DATA))
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Union" in plan


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["sql_join_using", "sql_join_natural", "sql_join_right"])
@pytest.mark.parametrize("rows", [64 << 20, 0])
def test_joins_on_few_keys_are_dealt_evenly(spark, duck, monkeypatch, name, rows):
    monkeypatch.setattr(reorder, "SMALL_ROWS", rows)
    monkeypatch.setattr(reorder, "TILE", 3)
    df = texts.queries()[name](spark, DATA)
    assert ("Repartition 96" if rows else "explode") in _optimized(df)
    same_rows(df, duck, texts.oracle_sql()[name])


@pytest.mark.parametrize("side", ["LEFT", "RIGHT"])
def test_outer_joins_on_few_keys_keep_rows_without_partner(spark, side):
    left = spark.sql("SELECT * FROM VALUES (1, 'a'), (1, 'a'), (2, 'b'), (NULL, 'c'), (4, 'd') AS t(k, v)")
    right = spark.sql("SELECT * FROM VALUES (1, 7), (1, 8), (2, 7), (NULL, 9), (5, 1) AS t(j, w)")
    plain = left.join(right, F.col("k") == F.col("j"), side.lower())
    dealt = reorder.changed(plain, reorder.deal_evenly)
    assert dealt is not plain and dealt.schema == plain.schema and dealt.columns == plain.columns
    assert sorted(map(repr, dealt.collect())) == sorted(map(repr, plain.collect()))


@pytest.mark.parametrize("name", ["sql_alias_01_self_join_customer_nation", "sql_mht_01_non_unique_join_city", "sql_join_null_keys"])
def test_pairs_of_few_keys_are_counted_before_the_join(spark, duck, name):
    df = texts.queries()[name](spark, DATA)
    plan = _optimized(df)
    assert plan.count("Aggregate") == 3 and "count(1)" in plan.split("Join Inner", 1)[1]
    same_rows(df, duck, texts.oracle_sql()[name])


def test_counts_before_joins_keep_nulls_names_and_empty_results(spark):
    one = "(SELECT * FROM VALUES (1, 'x'), (1, NULL), (1, NULL), (2, 'y'), (NULL, 'z') AS t(k, g))"
    two = "(SELECT * FROM VALUES (1, 3), (1, 3), (2, 4), (NULL, 5) AS t(j, h))"
    for text in (
        f"SELECT h, count(*) AS many, g, count(1) AS again FROM {one} JOIN {two} ON k = j GROUP BY g, h",
        f"SELECT count(*) AS n FROM {one} JOIN {two} ON k + 10 = j",
        f"SELECT g, count(*) AS n FROM {one} JOIN {two} ON k = j AND k + 2 = h GROUP BY g ORDER BY n DESC, g",
    ):
        plain = spark.sql(text)
        counted = reorder.changed(plain, reorder.count_before_join)
        assert counted is not plain and counted.schema == plain.schema
        assert sorted(map(repr, counted.collect())) == sorted(map(repr, plain.collect()))
    for text in (f"SELECT count(g) AS n FROM {one} JOIN {two} ON k = j", f"SELECT count(*) AS n FROM {one} JOIN {two} ON k = j AND k < h", f"SELECT g, max(h) AS n FROM {one} JOIN {two} ON k = j GROUP BY g"):
        plain = spark.sql(text)
        assert reorder.changed(plain, reorder.count_before_join) is plain


@pytest.mark.parametrize("name", ["proj_join_02_star_customer", "stress_01_wide_star_customer", "stress_02_wide_star_customer_supplier"])
@pytest.mark.parametrize("rows", [64 << 20, 0])
def test_customers_meet_orders_before_lines(spark, duck, monkeypatch, name, rows):
    monkeypatch.setattr(reorder, "SMALL_ROWS", rows)
    for df in (catalogue.queries()[name](spark, DATA), texts.queries()[f"sql_{name}"](spark, DATA)):
        joins = [line.strip(" :+-") for line in _optimized(df).splitlines() if "Join Inner" in line]
        orders = next(i for i, line in enumerate(joins) if "l_orderkey" in line)
        assert "o_custkey" in joins[orders + 1] and not any("custkey" in line for line in joins[:orders])
        assert "p_partkey" in joins[0]  # parts come last, to the lines that are left
        same_rows(df, duck, catalogue.oracle_sql()[name])


def test_large_lines_meet_orders_and_parts_in_parts_of_their_size(spark, duck, monkeypatch):
    monkeypatch.setattr(star, "PART_BYTES", 1 << 12)
    for name in ("mht_02_or_join_dedup", "sql_mht_02_or_join_dedup", "sql_join_or_keys", "sql_stress_01_wide_star_customer", "stress_02_wide_star_customer_supplier"):
        found = catalogue.queries() | texts.queries()
        df = found[name](spark, DATA)
        parts = -(-star._bytes(Star(spark, DATA).table("lineitem")) // (1 << 12))
        assert "RepartitionByExpression [l_orderkey" in _optimized(df) and f"], {parts}" in _optimized(df)
        same_rows(df, duck, (catalogue.oracle_sql() | texts.oracle_sql())[name])


def test_joins_are_moved_below_filters_and_names(spark):
    lines, orders = "(SELECT id AS l, id % 7 AS o FROM range(100))", "(SELECT id AS ok, nullif(id % 3, 2) AS c FROM range(9))"
    customers = "(SELECT * FROM VALUES (0L, 'x'), (0L, 'y'), (1L, 'z'), (NULL, 'n') AS t(c_custkey, name))"
    plain = spark.sql(f"SELECT name, l, c2 FROM (SELECT l, ok, c AS c2 FROM {lines} JOIN {orders} ON o = ok WHERE l % 5 <> ok) JOIN {customers} ON c2 = c_custkey AND l > length(name)")
    moved = reorder.changed(plain, reorder.move_down)
    assert moved is not plain and moved.schema == plain.schema
    assert sorted(map(repr, moved.collect())) == sorted(map(repr, plain.collect()))


def test_dialect(spark):
    e = Engine(spark, DATA)
    value = lambda text: e.sql(text).collect()[0][0]
    assert (value("select 7/2 as a"), value("select -7/2 as a"), value("select 7.0/2 as a"), value("select 100/(7/2)/2 as a")) == (3, -3, 3.5, 16)
    assert value("select CASE_WHEN(null, 1, 2) as a") == 2 and value("select '1/2' as a -- x/y\n") == "1/2"
    assert value("select case when 9/2 = 4 then 7/3 else 0 end / 2 as a") == 1
    assert [r.v for r in e.sql("select v from values (1), (null), (2) as t(v) order by v").collect()] == [1, 2, None]
    assert [r.v for r in e.sql("select v from (select v from values (1), (null), (2) as t(v) order by v desc limit 3) limit 3").collect()] == [2, 1, None]
    assert dialect.nulls_last("select a from t order by f(a, b), b desc nulls first, c limit 2") == "select a from t order by f(a, b) NULLS LAST, b desc nulls first, c NULLS LAST limit 2"
    for bad in ("select sum(*) as a from part", "select sum(1, 2) as a", "select CASE_WHEN(true, 1) as a", "select nofunction(1) as a", "select sum() as a"):
        with pytest.raises(Exception):  # noqa: B017
            e.sql(bad)


def test_split_windows_with_nulls_and_ties(spark):
    rows = [(g, None if v == 5 else v % 4, i) for g in (None, 1, 2) for i, v in enumerate(range(40))]
    df = spark.createDataFrame(rows, "g int, v int, i int")
    plain = Window.partitionBy("g").orderBy(F.col("v").desc_nulls_last(), "i")
    expected = df.withColumn("n", F.row_number().over(plain))
    assert sorted(row_number(df, "g", "v", True, ["i"], "n").collect(), key=repr) == sorted(expected.collect(), key=repr)
    summed = df.withColumn("s", F.sum("i").over(Window.partitionBy("g").orderBy(F.col("v").asc_nulls_last())))
    assert sorted(running_sum(df, "g", "v", "i", "s").collect(), key=repr) == sorted(summed.collect(), key=repr)


def test_engine(spark):
    e = Engine(spark, DATA)
    assert e.sql("select 1 as a; select count(*) as n from ddate").collect()[0].n == 2557
    with pytest.raises(QueryError):
        e.sql("select 1 as a, 2 as A")
    with pytest.raises(QueryError):
        e.sql("drop table x")
    assert "Scan" in e.explain("select count(*) as n from lineorder")
    rows, n, names = e.tail("select d_datekey from ddate order by d_datekey", 2)
    assert ([r[0] for r in rows], n, names) == ([20011230, 20011231], 2557, ["d_datekey"])


def test_shell(spark):
    out = io.StringIO()
    Shell(Engine(spark, DATA), out).loop(["\\echo hi\n", "\\limit 1\n", "\\timing off\n", "select d_year\n", "from ddate order by d_datekey;\n", "select nope;\n", "\\what\n", "\\q\n", "select 1;\n"])
    said = out.getvalue()
    assert said.startswith("hi\nColumns: d_year\nRow 2556: 2001\nRows returned: 2557\n[ERROR]") and "unknown command" in said and "Row 0" not in said


def test_config():
    c = Config.parse("# note\ndisplay_rows = 5\nmemory_limit=2 GiB ; more\nreserve_fraction=0.5")
    assert (c.display_rows, c.memory_limit, c.reserve_fraction) == (5, 2 << 30, 0.5)
    for bad in ("nope=1", "reserve_fraction=0.95", "memory_limit=2 XB"):
        with pytest.raises(QueryError):
            Config.parse(bad)
    assert parse_size("3KiB") == 3072
    assert statements("select ';' -- a;b\n; ; select 2") == ["select ';'", "select 2"]


def test_loader(spark, tmp_path):
    (tmp_path / "t.tbl").write_text("1|MFGR#1239|x|\n2|MFGR#5540||\n")
    loader.load_table(spark, str(tmp_path / "t.tbl"), "id int, brand string, note string", str(tmp_path / "out"), sort_by=["id"])
    rows = spark.read.parquet(str(tmp_path / "out")).withColumn("code", loader.brand_code(F.col("brand"))).orderBy("id")
    assert [(r.id, r.code, r.note) for r in rows.collect()] == [(1, 78, "x"), (2, 999, None)]
    stats = {r.column_name: r for r in loader.column_statistics(rows).collect()}
    assert (stats["id"].least, stats["id"].n_distinct, stats["id"].is_unique, stats["note"].n_null) == ("1", 2, True, 1)
    coded = loader.code_strings(rows, "note", ["w", "x"], "n")
    assert [r.n for r in coded.orderBy("id").collect()] == [1, None]


def test_star_text_files(spark, tmp_path):
    values = {"int": ["3", "1", "2"], "string": ["x", "", "z"]}
    for name, schema in loader.TEXT_TABLES.items():
        kinds = [f.split()[1] for f in schema.split(", ")]
        (tmp_path / f"{name}.tbl").write_text("".join("|".join(values[k][i] for k in kinds) + "|\n" for i in range(3)))
    loader.load_star(spark, str(tmp_path), str(tmp_path / "out"))
    for name, schema in loader.TEXT_TABLES.items():
        rows = spark.read.parquet(str(tmp_path / "out" / name))
        assert rows.columns == [f.split()[0] for f in schema.split(", ")] and rows.count() == 3
    assert [r.lo_orderdate for r in spark.read.parquet(str(tmp_path / "out/lineorder")).coalesce(1).collect()] == [1, 2, 3]


@pytest.mark.parametrize("kind", ["parquet", "orc", "csv", "json"])
def test_formats(spark, tmp_path, kind):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "b c")], "id int, t string")
    formats.write(rows, str(tmp_path / "x"), kind)
    assert sorted(formats.read(spark, str(tmp_path / "x"), kind, "id int, t string").collect()) == sorted(rows.collect())
    formats.write(rows, str(tmp_path / "y"), kind, ["id"])
    assert (tmp_path / "y/id=2").is_dir()
    with pytest.raises(ValueError):
        formats.read(spark, "x", "nope")


def test_statistics_are_kept_until_files_change(spark, tmp_path):
    path, cache = str(tmp_path / "t"), str(tmp_path / "cache")
    spark.range(5).write.parquet(path)
    first = loader.cached_statistics(spark, path, cache).collect()
    assert first == loader.cached_statistics(spark, path, cache).collect() and first[0].n_distinct == 5 and len(list((tmp_path / "cache").iterdir())) == 1
    spark.range(7).write.mode("overwrite").parquet(path)
    assert loader.cached_statistics(spark, path, cache).collect()[0].most == "6" and len(list((tmp_path / "cache").iterdir())) == 2


def test_raw_columns(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"".join(i.to_bytes(4, "little", signed=True) for i in range(-50, 50)))
    (tmp_path / "b").write_bytes(b"".join((2 * i).to_bytes(4, "little") for i in range(100)))
    bits = sum(1 << i for i in range(100) if i % 3)
    (tmp_path / "b.valid64").write_bytes(bits.to_bytes(16, "little"))
    (tmp_path / "b.null8").write_bytes(bytes(i % 5 == 0 for i in range(100)))
    files = {"a": str(tmp_path / "a"), "b": str(tmp_path / "b")}
    rows = loader.read_raw_columns(spark, files, {"b": (str(tmp_path / "b.valid64"), "valid64")}).orderBy("row_number").collect()
    assert [tuple(r) for r in rows] == [(i, i - 50, 2 * i if i % 3 else None) for i in range(100)]
    rows = loader.read_raw_columns(spark, files, {"b": (str(tmp_path / "b.null8"), "null8")}).orderBy("row_number").collect()
    assert [r.b for r in rows] == [None if i % 5 == 0 else 2 * i for i in range(100)]
    (tmp_path / "c").write_bytes(bytes(8))
    with pytest.raises(Exception, match="another number of rows"):
        loader.read_raw_columns(spark, {"a": files["a"], "c": str(tmp_path / "c")}).collect()


def test_config_order_and_settings(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    monkeypatch.delenv("HALYARD_CONFIG", raising=False)
    monkeypatch.setenv("HOME", str(tmp_path))
    assert Config.load().display_rows == 1000
    (tmp_path / ".config/halyard").mkdir(parents=True)
    (tmp_path / ".config/halyard/config.conf").write_text("display_rows=3")
    assert Config.load().display_rows == 3
    (tmp_path / "halyard.conf").write_text("display_rows=4")
    (tmp_path / "own").write_text("display_rows=5")
    assert Config.load().display_rows == 4
    monkeypatch.setenv("HALYARD_CONFIG", str(tmp_path / "own"))
    assert Config.load().display_rows == 5
    few, many = (Config(memory_limit=x).settings(8) for x in (64 << 20, 64 << 30))
    assert int(few["spark.sql.files.maxPartitionBytes"]) < int(many["spark.sql.files.maxPartitionBytes"]) == 128 << 20
    assert int(Config(memory_limit=64 << 20, reserve_fraction=0.9).settings(8)["spark.sql.autoBroadcastJoinThreshold"]) < int(few["spark.sql.autoBroadcastJoinThreshold"])


def test_limit_all_streams(spark):
    out = io.StringIO()
    Shell(Engine(spark, DATA), out).loop(["\\limit all\n", "\\timing off\n", "select s_suppkey from supplier order by s_suppkey;\n", "select 1"])
    said = out.getvalue().splitlines()
    assert said[0] == "Columns: s_suppkey" and said[-2] == f"Rows returned: {len(said) - 3}" and said[-1] == "Query cancelled."


def test_validity():
    assert loader.decode_validity(bytes([1, 0, 1, 0, 1]), 5, "valid8").tolist() == [True, False, True, False, True]
    assert loader.decode_validity(bytes([0, 1, 0, 1, 0]), 5, "null8").tolist() == [True, False, True, False, True]
    assert loader.decode_validity((0b01010).to_bytes(8, "little"), 5, "null64").tolist() == [True, False, True, False, True]
    with pytest.raises(ValueError):
        loader.decode_validity(bytes(2), 3, "valid8")
    assert loader.raw_column((7).to_bytes(4, "little") + (9).to_bytes(4, "little"), bytes([1, 0]), "valid8") == [7, None]
