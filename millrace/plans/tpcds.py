"""TPC-DS queries 1, 16, 94 and 95, with their templates' parameters.

Each query has its SQL text and a DataFrame form. The DataFrame forms differ
where the optimiser does not rewrite by itself: EXISTS over a different
warehouse becomes one aggregation of the fact (minimum and maximum warehouse),
and Q1's correlated average is an aggregation of the totals joined back.

Nulls follow SQL: a null warehouse equals nothing and differs from nothing; a
null order number is in no key set; sums over no rows are null.
"""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.relational import anti_join, keys_with_several, semi_join

Q1_SQL = """
WITH customer_total_return AS (
  SELECT sr_customer_sk AS ctr_customer_sk, sr_store_sk AS ctr_store_sk, sum({amount}) AS ctr_total_return
  FROM store_returns, date_dim
  WHERE sr_returned_date_sk = d_date_sk AND d_year = {year}
  GROUP BY sr_customer_sk, sr_store_sk
)
SELECT c_customer_id
FROM customer_total_return ctr1, store, customer
WHERE ctr1.ctr_total_return > (
        SELECT avg(ctr_total_return) * 1.2 FROM customer_total_return ctr2 WHERE ctr1.ctr_store_sk = ctr2.ctr_store_sk)
  AND s_store_sk = ctr1.ctr_store_sk AND s_state = '{state}' AND ctr1.ctr_customer_sk = c_customer_sk
ORDER BY c_customer_id LIMIT 100
"""


def q1(store_returns: DataFrame, date_dim: DataFrame, store: DataFrame, customer: DataFrame, year: int = 2002, state: str = "MI", amount: str = "sr_fee", limit: int = 100) -> DataFrame:
    """Customers whose returns at a store are 1.2 times above the store's average."""
    dates = date_dim.where(F.col("d_year") == year)
    returns = semi_join(store_returns.select("sr_customer_sk", "sr_store_sk", amount, "sr_returned_date_sk"), dates, "sr_returned_date_sk", "d_date_sk")
    totals = returns.groupBy("sr_customer_sk", "sr_store_sk").agg(F.sum(amount).alias("total"))
    # a store's average does not depend on other stores, so they go first
    here = semi_join(totals, store.where(F.col("s_state") == state), "sr_store_sk", "s_store_sk")
    # a row a store, combined before the shuffle: no task sees all customers of a store
    usual = here.groupBy("sr_store_sk").agg(F.avg("total").alias("usual"))
    above = here.join(usual, "sr_store_sk").where("total > usual * 1.2")
    found = above.join(customer.select("c_customer_sk", "c_customer_id"), F.col("sr_customer_sk") == F.col("c_customer_sk"))
    return found.select("c_customer_id").orderBy("c_customer_id").limit(limit)


@dataclass(frozen=True)
class Orders:
    """Column names of an order fact and its dimension."""

    prefix: str
    dimension_fk: str
    dimension_sk: str

    def __getattr__(self, name: str) -> str:
        return f"{self.prefix}_{name}"


CATALOG = Orders("cs", "cs_call_center_sk", "cc_call_center_sk")
WEB = Orders("ws", "ws_web_site_sk", "web_site_sk")


def report(slim: DataFrame, order: str, cost: str, profit: str) -> DataFrame:
    return slim.agg(
        F.count_distinct(order).alias("order_count"), F.sum(cost).alias("total_shipping_cost"), F.sum(profit).alias("total_net_profit")
    )


def order_query(sales: DataFrame, returned: DataFrame, date_dim: DataFrame, customer_address: DataFrame, dimension: DataFrame, names: Orders, dates: Column, state: str, dimension_filter: Column, wants_returned: bool) -> DataFrame:
    """Orders shipped from several warehouses, returned or not, to a state through some sites."""
    o, order, house = names, names.order_number, names.warehouse_sk
    several = keys_with_several(sales.select(order, house), order, house)
    slim = sales.select(order, house, o.ext_ship_cost, o.net_profit, o.ship_date_sk, o.ship_addr_sk, names.dimension_fk)
    # the selective dimensions first: they are small and shrink the fact before the joins on its own key
    slim = semi_join(slim, date_dim.where(dates), o.ship_date_sk, "d_date_sk")
    slim = semi_join(slim, customer_address.where(F.col("ca_state") == state), o.ship_addr_sk, "ca_address_sk")
    slim = semi_join(slim, dimension.where(dimension_filter), names.dimension_fk, names.dimension_sk)
    slim = semi_join(slim, several, order, order)
    key = returned.columns[0]
    slim = semi_join(slim, returned, order, key) if wants_returned else anti_join(slim.where(F.col(house).isNotNull()), returned, order, key)
    return report(slim, order, o.ext_ship_cost, o.net_profit)


def _window(first: str, days: int = 60) -> Column:
    start = datetime.date.fromisoformat(first)
    return F.col("d_date").between(F.lit(start), F.lit(start + datetime.timedelta(days)))


def q16(catalog_sales, catalog_returns, date_dim, customer_address, call_center, first: str = "2002-02-01", state: str = "GA", counties: tuple[str, ...] = ("Williamson County",)) -> DataFrame:
    return order_query(catalog_sales, catalog_returns.select("cr_order_number"), date_dim, customer_address, call_center, CATALOG, _window(first), state, F.col("cc_county").isin(*counties), False)


def q94(web_sales, web_returns, date_dim, customer_address, web_site, first: str = "1999-02-01", state: str = "IL", company: str = "pri") -> DataFrame:
    return order_query(web_sales, web_returns.select("wr_order_number"), date_dim, customer_address, web_site, WEB, _window(first), state, F.col("web_company_name") == company, False)


def q95(web_sales, web_returns, date_dim, customer_address, web_site, first: str = "1999-02-01", state: str = "IL", company: str = "pri") -> DataFrame:
    """Like q94, for returned orders; membership is by order, so rows without a warehouse stay."""
    return order_query(web_sales, web_returns.select("wr_order_number"), date_dim, customer_address, web_site, WEB, _window(first), state, F.col("web_company_name") == company, True)


def order_sql(fact: str, returns: str, names: Orders, return_key: str, dimension: str, first: str, state: str, condition: str, wants_returned: bool) -> str:
    """The query as SQL text, for sessions with the tables registered."""
    p = names.prefix
    if wants_returned:
        pairs = f"(SELECT a.{p}_order_number FROM {fact} a, {fact} b WHERE a.{p}_order_number = b.{p}_order_number AND a.{p}_warehouse_sk <> b.{p}_warehouse_sk)"
        extra = f"AND f.{p}_order_number IN {pairs} AND f.{p}_order_number IN (SELECT {return_key} FROM {returns})"
    else:
        extra = f"AND EXISTS (SELECT * FROM {fact} b WHERE f.{p}_order_number = b.{p}_order_number AND f.{p}_warehouse_sk <> b.{p}_warehouse_sk) AND NOT EXISTS (SELECT * FROM {returns} r WHERE f.{p}_order_number = r.{return_key})"
    return f"""
SELECT count(DISTINCT f.{p}_order_number) AS order_count, sum(f.{p}_ext_ship_cost) AS total_shipping_cost, sum(f.{p}_net_profit) AS total_net_profit
FROM {fact} f, date_dim, customer_address, {dimension}
WHERE d_date BETWEEN DATE '{first}' AND DATE '{first}' + INTERVAL 60 DAY AND f.{p}_ship_date_sk = d_date_sk
  AND f.{p}_ship_addr_sk = ca_address_sk AND ca_state = '{state}' AND f.{names.dimension_fk} = {names.dimension_sk} AND {condition}
  {extra}
"""
