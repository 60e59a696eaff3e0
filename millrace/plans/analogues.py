"""The four decision-support queries on the star schema of the test tables.

lineitem plays the sales fact (order, supplier as warehouse, ship date), its
returned lines the returns, customer and nation the address, orders with
lineitem the store returns, supplier the store.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.relational import semi_join
from millrace.sources.parquet import load, money

START = datetime.date(1998, 2, 1)
DAYS = 60


def _customers(spark: SparkSession, folder: str, nations: list[str]) -> DataFrame:
    nation = load(spark, folder, "nation").where(F.col("n_name").isin(*nations))
    return semi_join(load(spark, folder, "customer").select("c_custkey", "c_nationkey"), nation, "c_nationkey", "n_nationkey")


def order_report(spark: SparkSession, folder: str, nations: list[str], wants_returned: bool) -> DataFrame:
    """Orders shipped in the window to the nations, from several suppliers, with or without a returned line.

    The fact is read once: the nations' orders are told first, and one
    aggregation by order finds its suppliers, its returns and what was shipped
    in the window.
    """
    orders = semi_join(load(spark, folder, "orders").select("o_orderkey", "o_custkey"), _customers(spark, folder, nations), "o_custkey", "c_custkey")
    fact = load(spark, folder, "lineitem").select("l_orderkey", "l_suppkey", "l_shipdate", "l_returnflag", "l_extendedprice", "l_discount")
    shipped = (F.col("l_shipdate") >= F.lit(START)) & (F.col("l_shipdate") < F.lit(START + datetime.timedelta(DAYS + 1)))
    if not wants_returned:  # a line without a supplier differs from none
        shipped = shipped & F.col("l_suppkey").isNotNull()
    profit = money("l_extendedprice") * (1 - F.col("l_discount").cast("decimal(4,2)"))
    per = semi_join(fact, orders, "l_orderkey", "o_orderkey").groupBy("l_orderkey").agg(
        F.min("l_suppkey").alias("low"),
        F.max("l_suppkey").alias("high"),
        F.count_if(F.col("l_returnflag") == "R").alias("returned"),
        F.count_if(shipped).alias("lines"),
        F.sum(F.when(shipped, money("l_extendedprice"))).alias("cost"),
        F.sum(F.when(shipped, profit)).alias("profit"),
    )
    found = per.where("low < high and lines > 0").where("returned > 0" if wants_returned else "returned = 0")
    return found.agg(
        F.count("*").alias("order_count"),
        F.sum("cost").cast("double").alias("total_shipping_cost"),
        F.sum("profit").cast("double").alias("total_net_profit"),
    )


def store_report(spark: SparkSession, folder: str, year: int, nation: str, limit: int = 100) -> DataFrame:
    """Customers whose yearly total at a supplier is 1.2 times above the supplier's average."""
    orders = load(spark, folder, "orders").where((F.col("o_orderdate") >= F.lit(datetime.date(year, 1, 1))) & (F.col("o_orderdate") < F.lit(datetime.date(year + 1, 1, 1))))
    home = load(spark, folder, "nation").where(F.col("n_name") == nation)
    suppliers = semi_join(load(spark, folder, "supplier").select("s_suppkey", "s_nationkey"), home, "s_nationkey", "n_nationkey")
    lines = semi_join(load(spark, folder, "lineitem").select("l_orderkey", "l_suppkey", money("l_extendedprice").alias("fee")), suppliers, "l_suppkey", "s_suppkey")
    totals = lines.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "l_suppkey").agg(F.sum("fee").alias("total"))
    # total > 1.2 * sum / n, in whole numbers of cents: no rounding decides
    usual = totals.groupBy("l_suppkey").agg(F.sum("total").alias("all"), F.count("*").alias("n"))
    above = totals.join(usual, "l_suppkey").where("10 * total * n > 12 * all")
    found = above.join(load(spark, folder, "customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    return found.select("c_name").orderBy("c_name").limit(limit)


def order_report_sql(nations: list[str], wants_returned: bool) -> str:
    names = ", ".join(f"'{n}'" for n in nations)
    if wants_returned:
        extra = """l.l_orderkey IN (SELECT a.l_orderkey FROM lineitem a, lineitem b WHERE a.l_orderkey = b.l_orderkey AND a.l_suppkey <> b.l_suppkey)
  AND l.l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')"""
    else:
        extra = """EXISTS (SELECT * FROM lineitem b WHERE l.l_orderkey = b.l_orderkey AND l.l_suppkey <> b.l_suppkey)
  AND NOT EXISTS (SELECT * FROM lineitem r WHERE l.l_orderkey = r.l_orderkey AND r.l_returnflag = 'R')"""
    return f"""
SELECT count(DISTINCT l.l_orderkey) AS order_count,
       CAST(sum(CAST(l.l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total_shipping_cost,
       CAST(sum(CAST(l.l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l.l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS total_net_profit
FROM lineitem l, orders, customer, nation
WHERE CAST(l.l_shipdate AS DATE) BETWEEN DATE '{START}' AND DATE '{START}' + INTERVAL {DAYS} DAY
  AND l.l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n_nationkey AND n_name IN ({names})
  AND {extra}
"""


def store_report_sql(year: int, nation: str, limit: int = 100) -> str:
    return f"""
WITH totals AS (
  SELECT o_custkey, l_suppkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS total
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE year(o_orderdate) = {year} GROUP BY o_custkey, l_suppkey
)
SELECT c_name FROM totals t, supplier, nation, customer
WHERE t.l_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_name = '{nation}' AND o_custkey = c_custkey
  AND 10 * total * (SELECT count(*) FROM totals u WHERE u.l_suppkey = t.l_suppkey) > 12 * (SELECT sum(total) FROM totals u WHERE u.l_suppkey = t.l_suppkey)
ORDER BY c_name LIMIT {limit}
"""


NATIONS = [f"NATION_{k}" for k in range(1, 6)]
