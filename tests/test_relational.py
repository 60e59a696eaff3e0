"""Operators on hand-made edge tables."""

import datetime
from collections import Counter

from pyspark.sql import functions as F

from millrace import functions as fx
from millrace.operators import relational as ops
from millrace.plans import tpcds
from millrace.sources import delimited
from millrace.sources.tpcds_schemas import TABLES


def values(df):
    return sorted(tuple(r) for r in df.collect())


def test_several_values_and_null_warehouses(spark):
    df = spark.createDataFrame([(1, None), (1, 1), (1, 2), (2, 1), (2, None), (3, None), (4, 5), (4, 5)], "o long, w long")
    assert values(ops.keys_with_several(df, "o", "w")) == [(1,)]
    capped = df.groupBy("o").agg(fx.capped_distinct(F.col("w")).alias("n"))
    assert values(capped) == [(1, 2), (2, 1), (3, 0), (4, 1)]
    part = df.groupBy("o", "w").agg(fx.capped_distinct_partial(F.col("w")).alias("s"))
    assert values(part.groupBy("o").agg(fx.capped_distinct_final("s").alias("n"))) == values(capped)


def test_multisets(spark):
    left = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    right = spark.createDataFrame([(1,), (2,), (2,), (3,)], "k int")
    assert values(ops.intersect(left, right, True)) == [(1,), (2,)]
    assert values(ops.difference(left, right, True)) == [(1,)]
    assert values(ops.intersect(left, right)) == [(1,), (2,)]
    assert values(ops.difference(left, right)) == []
    assert values(ops.semi_join_once(left, right, "k", "k")) == [(1,), (2,)]


def test_semi_join_once_counts_off_a_hot_key(spark):
    left = spark.createDataFrame([(1, x) for x in range(300)] + [(1, 7)] * 50 + [(2, 0), (2, 0), (None, 0)], "k int, x int")
    right = spark.createDataFrame([(1,)] * 330 + [(2,), (3,), (None,)], "k int")
    got = ops.semi_join_once(left, right, "k", "k")
    assert got.columns == left.columns
    rows, own = Counter(tuple(r) for r in got.collect()), Counter(tuple(r) for r in left.collect())
    assert not rows - own and Counter(k for k, _ in rows.elements()) == {1: 330, 2: 1}
    assert ops.semi_join_once(left, right.where("k is null"), "k", "k").count() == 0


def test_append_group_avg(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 4.0), (None, 5.0), (None, 7.0), (2, None)], "k int, v double")
    got = ops.append_group_avg(df, "k", "v", "usual")
    assert got.columns == ["k", "v", "usual"]
    assert Counter(tuple(r) for r in got.collect()) == Counter([(1, 2.0, 3.0), (1, 4.0, 3.0), (None, 5.0, 6.0), (None, 7.0, 6.0), (2, None, None)])
    assert ops.append_group_avg(df, "k", "v", "v").columns == ["k", "v"]


def test_order_report_with_missing_values(spark, tmp_path):
    """Nulls in supplier, flag, date and price, against the SQL."""
    import random

    import duckdb

    from millrace.plans import analogues

    rng = random.Random(8)
    maybe = lambda x: None if rng.random() < 0.15 else x
    lines = [
        (maybe(rng.randrange(40)), maybe(rng.randrange(3)), maybe(analogues.START + datetime.timedelta(rng.randrange(-20, 80))), maybe(rng.choice("ANRN")), maybe(rng.randrange(9999) / 100), 0.05)
        for _ in range(160)
    ]
    tables = {
        "lineitem": (lines, "l_orderkey long, l_suppkey long, l_shipdate date, l_returnflag string, l_extendedprice double, l_discount double"),
        "orders": ([(k, maybe(k % 7)) for k in range(40)], "o_orderkey long, o_custkey long"),
        "customer": ([(k, maybe(k % 3)) for k in range(7)], "c_custkey long, c_nationkey long"),
        "nation": ([(k, f"N{k}") for k in range(3)], "n_nationkey long, n_name string"),
    }
    duck = duckdb.connect()
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{tmp_path}/{name}.parquet")
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    for wants in (False, True):
        for nations in (["N0", "N1"], ["none"]):
            got = tuple(analogues.order_report(spark, f"file://{tmp_path}", nations, wants).first())
            assert got == duck.execute(analogues.order_report_sql(nations, wants)).fetchone()


def test_joins(spark):
    left = spark.createDataFrame([(5, "a"), (5, "b"), (None, "c")], "k int, x string")
    right = spark.createDataFrame([(5, "p"), (5, "q"), (6, "r"), (None, "s")], "k int, y string")
    assert len(values(ops.inner_join(left, right, "k", "k", ["x"], ["y"]))) == 4
    assert ops.semi_join(left, right, "k", "k").count() == 2
    assert [r["x"] for r in ops.anti_join(left, right, "k", "k").collect()] == ["c"]


def test_dates(spark):
    days = ["1998-01-31", "1998-02-01", "1998-02-02", "1998-12-31", "1999-01-01"]
    df = spark.createDataFrame([(datetime.date.fromisoformat(x),) for x in days], "d date")
    assert df.where(fx.in_year(F.col("d"), 1998)).count() == 4
    lo, hi = (F.lit(datetime.date.fromisoformat(x)) for x in (days[1], days[3]))
    assert df.where(fx.strictly_between(F.col("d"), lo, hi)).count() == 1


def test_slices(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    got = ops.contiguous_slices(df, ["k"], 3).groupBy("slice").agg(F.count("*").alias("n"), F.min("k").alias("lo"))
    assert values(got) == [(0, 3, 0), (1, 3, 3), (2, 4, 6)]
    assert values(ops.contiguous_slices(df.limit(2), ["k"], 3)) == [(0, 0), (1, 1)]
    assert ops.contiguous_slices(df.where("false"), ["k"], 3).count() == 0


def test_length_first(spark):
    df = spark.createDataFrame([("b",), ("aa",)], "s string")
    assert [r["s"] for r in df.orderBy(*fx.length_first(F.col("s"))).collect()] == ["b", "aa"]


def test_empty_group(spark):
    empty = spark.createDataFrame([], "k long, v double")
    assert empty.groupBy("k").agg(F.sum("v")).count() == 0
    assert tuple(tpcds.report(empty.withColumn("w", F.col("v")), "k", "v", "w").first()) == (0, None, None)


def test_delimited(spark, tmp_path):
    (tmp_path / "t_0.dat").write_text("1|2|\n3|4|2002-2-1\n")
    (tmp_path / "t_1.dat").write_text("5||2002-02-03|\n")
    got = delimited.read_chunks(spark, f"file://{tmp_path}/t", 0, 2, "a long, b long, c date")
    day = datetime.date
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == [(1, 2, None), (3, 4, day(2002, 2, 1)), (5, None, day(2002, 2, 3))]
    out = f"file://{tmp_path}/out"
    delimited.write_table(spark.range(10), out, rows_per_file=4)
    assert delimited.read_table(spark, out, "id long").count() == 10


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.dat").write_text("1|x\n2|y\n")
    kept = delimited.stream_table(spark, f"file://{tmp_path}/in", "a long, b string").where("a > 1")
    q = kept.writeStream.format("memory").queryName("streamed").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert values(spark.table("streamed")) == [(2, "y")]


def test_schemas(spark):
    widths = {t: len(spark.createDataFrame([], ddl).columns) for t, ddl in TABLES.items()}
    # Columns of the base tables.
    assert widths == {
        "web_sales": 34, "catalog_sales": 34, "web_returns": 24, "catalog_returns": 27, "store_returns": 20, "date_dim": 28,
        "customer_address": 13, "web_site": 26, "call_center": 31, "store": 29, "customer": 18,
    }


def test_tpcds_queries_against_their_sql(spark):
    """The DataFrame forms and the SQL texts agree on small frames with nulls."""
    import random

    rng = random.Random(4)
    maybe = lambda x: None if rng.random() < 0.1 else x
    sales = [(maybe(rng.randrange(12)), maybe(rng.randrange(3)), rng.randrange(100), rng.randrange(100), maybe(rng.randrange(6)), maybe(rng.randrange(3)), maybe(rng.randrange(2))) for _ in range(200)]
    names = ["order_number", "warehouse_sk", "ext_ship_cost", "net_profit", "ship_date_sk", "ship_addr_sk"]
    spark.createDataFrame(sales, [f"ws_{n}" for n in names] + ["ws_web_site_sk"]).createOrReplaceTempView("web_sales")
    spark.createDataFrame([(maybe(rng.randrange(12)),) for _ in range(5)], "wr_order_number long").createOrReplaceTempView("web_returns")
    first = datetime.date(1999, 2, 1)
    spark.createDataFrame([(k, first + datetime.timedelta(30 * k - 30), 1999) for k in range(6)], "d_date_sk long, d_date date, d_year long").createOrReplaceTempView("date_dim")
    spark.createDataFrame([(0, "IL"), (1, "IL"), (2, "NY")], "ca_address_sk long, ca_state string").createOrReplaceTempView("customer_address")
    spark.createDataFrame([(0, "pri"), (1, "ese")], "web_site_sk long, web_company_name string").createOrReplaceTempView("web_site")
    tables = [spark.table(t) for t in ("web_sales", "web_returns", "date_dim", "customer_address", "web_site")]
    for form, wants in ((tpcds.q94, False), (tpcds.q95, True)):
        sql = tpcds.order_sql("web_sales", "web_returns", tpcds.WEB, "wr_order_number", "web_site", "1999-02-01", "IL", "web_company_name = 'pri'", wants)
        assert tuple(form(*tables).first()) == tuple(spark.sql(sql).first())

    returns = [(maybe(rng.randrange(8)), maybe(rng.randrange(4)), rng.randrange(50), maybe(rng.randrange(6))) for _ in range(100)]
    spark.createDataFrame(returns, "sr_customer_sk long, sr_store_sk long, sr_fee long, sr_returned_date_sk long").createOrReplaceTempView("store_returns")
    spark.createDataFrame([(k, "MI" if k % 2 else "OH") for k in range(4)], "s_store_sk long, s_state string").createOrReplaceTempView("store")
    spark.createDataFrame([(k, f"C{k}") for k in range(8)], "c_customer_sk long, c_customer_id string").createOrReplaceTempView("customer")
    got = tpcds.q1(*(spark.table(t) for t in ("store_returns", "date_dim", "store", "customer")), year=1999)
    want = spark.sql(tpcds.Q1_SQL.format(amount="sr_fee", year=1999, state="MI"))
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()]


def test_plans_push_down(spark):
    """Filters and columns reach the scan."""
    from millrace import catalogue

    text = catalogue.queries()["filter_year"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate" in text
    assert "l_comment" not in text and "l_extendedprice" not in text


def test_many_to_many_join_deals_a_key_over_tasks(spark, monkeypatch):
    left, right = spark.range(30).selectExpr("1 as k", "id as a").coalesce(1), spark.range(400).selectExpr("1 as k", "id as b").coalesce(1)
    for most in (100, 20):  # the left side goes to all tasks; neither does
        monkeypatch.setattr(ops, "SMALL_SIDE", most, raising=False)
        for one, other, x, y in ((left, right, "a", "b"), (right, left, "b", "a")):
            got = ops.inner_join(one, other, "k", "k", [x], [y])
            assert got.columns == [x, y] and got.count() == got.distinct().count() == 12_000
            if most == 100:
                tasks = got.groupBy(F.spark_partition_id()).count().collect()
                assert len(tasks) > 1 and max(r["count"] for r in tasks) < 12_000
