"""All queries of the relational engine and their SQL, by name.

One query for each operator, run on the test tables, and the decision-support
queries. ``queries()`` and ``oracle_sql()`` share their keys.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import functions as fx
from millrace.elastic import model as elastic
from millrace.elastic import plan as planner
from millrace.operators import relational as ops
from millrace.plans import analogues, tpcds
from millrace.shared import fresh_path
from millrace.sources import delimited
from millrace.sources.parquet import load, money

Query = Callable[[SparkSession, str], DataFrame]
_FOUND: dict[str, tuple[Query, str]] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _FOUND[f.__name__] = (f, sql)
        return f

    return add


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _FOUND.items()}


LINE = ["l_orderkey", "l_linenumber", "l_quantity"]
LINE_SQL = "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE "


def _filtered(name: str, predicate: Callable, sql: str) -> None:
    _FOUND[name] = (lambda spark, d: ops.select_project(load(spark, d, "lineitem"), predicate(), LINE), LINE_SQL + sql)


# ---- whole queries ----


@query(analogues.store_report_sql(1998, "NATION_12"))
def q1_like(spark: SparkSession, d: str) -> DataFrame:
    return analogues.store_report(spark, d, 1998, "NATION_12")


@query(analogues.order_report_sql(analogues.NATIONS, False))
def q16_like(spark: SparkSession, d: str) -> DataFrame:
    return analogues.order_report(spark, d, analogues.NATIONS, False)


@query(analogues.order_report_sql(["NATION_3"], False))
def q94_like(spark: SparkSession, d: str) -> DataFrame:
    return analogues.order_report(spark, d, ["NATION_3"], False)


@query(analogues.order_report_sql(["NATION_3"], True))
def q95_like(spark: SparkSession, d: str) -> DataFrame:
    return analogues.order_report(spark, d, ["NATION_3"], True)


# ---- projection and selection ----


@query("SELECT l_orderkey, l_suppkey FROM lineitem")
def project(spark: SparkSession, d: str) -> DataFrame:
    return ops.project(load(spark, d, "lineitem"), ["l_orderkey", "l_suppkey"])


_filtered("filter_int_gt", lambda: F.col("l_linenumber") > 4, "l_linenumber > 4")
_filtered("filter_int_lt", lambda: F.col("l_linenumber") < 2, "l_linenumber < 2")
_filtered("filter_int_eq", lambda: F.col("l_linenumber") == 3, "l_linenumber = 3")
_filtered("filter_int_ne", lambda: F.col("l_linenumber") != 1, "l_linenumber <> 1")
_filtered("filter_int_ge", lambda: F.col("l_linenumber") >= 6, "l_linenumber >= 6")
_filtered("filter_int_le", lambda: F.col("l_linenumber") <= 2, "l_linenumber <= 2")
_filtered("filter_float_gt", lambda: F.col("l_quantity") > 45.0, "l_quantity > 45.0")
_filtered("filter_float_lt", lambda: F.col("l_quantity") < 5.0, "l_quantity < 5.0")
_filtered("filter_float_eq", lambda: F.col("l_quantity") == 17.0, "l_quantity = 17.0")
_filtered("filter_float_ne", lambda: F.col("l_quantity") != 17.0, "l_quantity <> 17.0")
_filtered("filter_string_eq", lambda: F.col("l_returnflag") == "R", "l_returnflag = 'R'")
_filtered("filter_in", lambda: F.col("l_returnflag").isin("A", "R"), "l_returnflag IN ('A', 'R')")
_filtered("filter_year", lambda: fx.in_year(F.col("l_shipdate"), 1998), "year(l_shipdate) = 1998")
_filtered(
    "filter_date_range",
    lambda: fx.strictly_between(F.col("l_shipdate"), F.lit(datetime.date(1998, 2, 1)), F.lit(datetime.date(1998, 4, 2))),
    "l_shipdate > DATE '1998-02-01' AND l_shipdate < DATE '1998-04-02'",
)


@query("SELECT o_orderkey, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > c_acctbal")
def compare_columns(spark: SparkSession, d: str) -> DataFrame:
    customer = load(spark, d, "customer").select("c_custkey", "c_acctbal")
    both = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return ops.select_project(both, F.col("o_totalprice") > F.col("c_acctbal"), ["o_orderkey", "o_totalprice"])


@query("SELECT p_partkey, p_retailprice * 1.2::DOUBLE AS p_retailprice FROM part")
def scalar_multiply(spark: SparkSession, d: str) -> DataFrame:
    return ops.scale(load(spark, d, "part").select("p_partkey", "p_retailprice"), "p_retailprice", 1.2)


# ---- joins ----


def _urgent(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey")


_URGENT = "(SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')"


@query(LINE_SQL + f"l_orderkey IN {_URGENT}")
def semi_join(spark: SparkSession, d: str) -> DataFrame:
    return ops.semi_join(load(spark, d, "lineitem").select(*LINE), _urgent(spark, d), "l_orderkey", "o_orderkey")


@query(LINE_SQL + f"l_orderkey IN {_URGENT} AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def semi_join_chained(spark: SparkSession, d: str) -> DataFrame:
    lines = load(spark, d, "lineitem").select(*LINE, "l_suppkey")
    lines = ops.semi_join(lines, load(spark, d, "supplier").where("s_acctbal > 0"), "l_suppkey", "s_suppkey")
    return ops.semi_join(lines, _urgent(spark, d), "l_orderkey", "o_orderkey").select(*LINE)


@query(LINE_SQL + f"l_orderkey IN {_URGENT}")
def semi_join_hash(spark: SparkSession, d: str) -> DataFrame:
    return ops.semi_join(load(spark, d, "lineitem").select(*LINE), _urgent(spark, d), "l_orderkey", "o_orderkey", "shuffle_hash")


@query(LINE_SQL + f"l_orderkey NOT IN {_URGENT}")
def anti_join(spark: SparkSession, d: str) -> DataFrame:
    return ops.anti_join(load(spark, d, "lineitem").select(*LINE), _urgent(spark, d), "l_orderkey", "o_orderkey")


@query("SELECT s_name, c_name FROM supplier JOIN customer ON s_nationkey = c_nationkey")
def inner_join_mn(spark: SparkSession, d: str) -> DataFrame:
    return ops.inner_join(load(spark, d, "supplier"), load(spark, d, "customer"), "s_nationkey", "c_nationkey", ["s_name"], ["c_name"])


@query(
    """WITH n AS (SELECT c_nationkey, row_number() OVER (PARTITION BY c_nationkey) AS k FROM customer),
s AS (SELECT s_nationkey, row_number() OVER (PARTITION BY s_nationkey) AS k FROM supplier)
SELECT c_nationkey FROM n WHERE EXISTS (SELECT 1 FROM s WHERE s_nationkey = c_nationkey AND s.k = n.k)"""
)
def exists_multiset(spark: SparkSession, d: str) -> DataFrame:
    return ops.semi_join_once(load(spark, d, "customer").select("c_nationkey"), load(spark, d, "supplier"), "c_nationkey", "s_nationkey")


@query("SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_suppkey) > 1")
def several_values(spark: SparkSession, d: str) -> DataFrame:
    return ops.keys_with_several(load(spark, d, "lineitem"), "l_orderkey", "l_suppkey")


# ---- grouping ----

_CENTS = "CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE)"


@query(f"SELECT l_suppkey, {_CENTS} AS total FROM lineitem GROUP BY l_suppkey")
def group_sum_1key(spark: SparkSession, d: str) -> DataFrame:
    return ops.group(load(spark, d, "lineitem"), ["l_suppkey"], F.sum(money("l_extendedprice")).cast("double").alias("total"))


@query(f"SELECT l_suppkey, l_linenumber, {_CENTS} AS total FROM lineitem GROUP BY l_suppkey, l_linenumber")
def group_sum_2key(spark: SparkSession, d: str) -> DataFrame:
    return ops.group(load(spark, d, "lineitem"), ["l_suppkey", "l_linenumber"], F.sum(money("l_extendedprice")).cast("double").alias("total"))


@query("SELECT l_suppkey, round(avg(l_quantity), 4) AS quantity FROM lineitem GROUP BY l_suppkey")
def group_avg(spark: SparkSession, d: str) -> DataFrame:
    return ops.group(load(spark, d, "lineitem"), ["l_suppkey"], F.round(F.avg("l_quantity"), 4).alias("quantity"))


@query("SELECT l_suppkey, count(*) AS n, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem GROUP BY l_suppkey")
def group_count_min_max(spark: SparkSession, d: str) -> DataFrame:
    return ops.group(load(spark, d, "lineitem"), ["l_suppkey"], F.count("*").alias("n"), F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"))


@query("SELECT l_orderkey, CAST(least(count(DISTINCT l_suppkey), 2) AS INTEGER) AS suppliers FROM lineitem GROUP BY l_orderkey")
def group_count_distinct_capped(spark: SparkSession, d: str) -> DataFrame:
    return ops.group(load(spark, d, "lineitem"), ["l_orderkey"], fx.capped_distinct(F.col("l_suppkey")).alias("suppliers"))


@query("SELECT l_orderkey, CAST(least(count(DISTINCT l_suppkey), 2) AS INTEGER) AS suppliers FROM lineitem GROUP BY l_orderkey")
def count_distinct_two_phase(spark: SparkSession, d: str) -> DataFrame:
    part = ops.group(load(spark, d, "lineitem"), ["l_orderkey", "l_returnflag"], fx.capped_distinct_partial(F.col("l_suppkey")).alias("state"))
    return ops.group(part, ["l_orderkey"], fx.capped_distinct_final("state").alias("suppliers"))


@query("SELECT l_orderkey, l_linenumber, round(avg(l_quantity) OVER (PARTITION BY l_suppkey), 4) AS usual FROM lineitem")
def group_avg_append(spark: SparkSession, d: str) -> DataFrame:
    lines = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    return ops.append_group_avg(lines, "l_suppkey", "l_quantity", "usual").select("l_orderkey", "l_linenumber", F.round("usual", 4).alias("usual"))


@query("SELECT count(DISTINCT l_orderkey) AS orders FROM lineitem")
def global_count_distinct(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lineitem").agg(F.count_distinct("l_orderkey").alias("orders"))


@query(f"SELECT {_CENTS} AS total, CAST(sum(l_linenumber) AS BIGINT) AS numbers FROM lineitem")
def global_sum(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lineitem").agg(F.sum(money("l_extendedprice")).cast("double").alias("total"), F.sum("l_linenumber").alias("numbers"))


# ---- distinct, order, sets ----


@query("SELECT DISTINCT o_custkey FROM orders")
def distinct(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").select("o_custkey").distinct()


@query("SELECT c_name, c_custkey FROM customer ORDER BY c_name")
def sort_one(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "customer").select("c_name", "c_custkey").orderBy("c_name")


@query("SELECT c_nationkey, c_custkey FROM customer ORDER BY c_nationkey, c_custkey")
def sort_two(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "customer").select("c_nationkey", "c_custkey").orderBy("c_nationkey", "c_custkey")


@query("SELECT p_name FROM part ORDER BY strlen(p_name), p_name LIMIT 50")
def sort_length_first(spark: SparkSession, d: str) -> DataFrame:
    return ops.top(load(spark, d, "part").select("p_name"), fx.length_first(F.col("p_name")), 50)


def _two(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return load(spark, d, "customer").select(F.col("c_nationkey").alias("k")), load(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_nationkey").alias("k"))


_C, _S = "SELECT c_nationkey AS k FROM customer", "SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 0"


@query(f"{_C} INTERSECT {_S}")
def intersect(spark: SparkSession, d: str) -> DataFrame:
    return ops.intersect(*_two(spark, d))


@query(f"{_C} INTERSECT ALL {_S}")
def intersect_all(spark: SparkSession, d: str) -> DataFrame:
    return ops.intersect(*_two(spark, d), repeats=True)


@query(f"SELECT k FROM ({_S}) WHERE k IN ({_C})")
def intersect_keep_repeats(spark: SparkSession, d: str) -> DataFrame:
    left, right = _two(spark, d)
    return ops.semi_join(right, left, "k", "k")


@query("SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal < 5000")
def difference(spark: SparkSession, d: str) -> DataFrame:
    return ops.difference(load(spark, d, "orders").select(F.col("o_custkey").alias("k")), load(spark, d, "customer").where("c_acctbal < 5000").select("c_custkey"))


@query(f"{_C} EXCEPT ALL {_S}")
def difference_all(spark: SparkSession, d: str) -> DataFrame:
    return ops.difference(*_two(spark, d), repeats=True)


@query(f"{_C} UNION ALL {_S}")
def union_all(spark: SparkSession, d: str) -> DataFrame:
    return ops.union_all(_two(spark, d))


@query(
    """WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS rn, count(*) OVER () AS n FROM customer)
SELECT c_custkey, CAST(least((rn - 1) // greatest(n // 7, 1), 6) AS BIGINT) AS slice FROM r"""
)
def contiguous_slice(spark: SparkSession, d: str) -> DataFrame:
    return ops.contiguous_slices(load(spark, d, "customer").select("c_custkey"), ["c_custkey"], 7)


# ---- input, output, exchange ----

_NATION = "n_nationkey int, n_name string, n_regionkey int"


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def pipe_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "pipe")
    delimited.write_table(load(spark, d, "nation"), path)
    return delimited.read_table(spark, path, _NATION)


@query("SELECT c_custkey, c_name FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) AS rn, count(*) OVER () AS n FROM customer) WHERE least((rn - 1) // greatest(n // 4, 1), 3) IN (1, 3)")
def chunked_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "chunks")
    delimited.write_slices(load(spark, d, "customer").select("c_custkey", "c_name"), ["c_custkey"], 4, path)
    return delimited.read_slices(spark, path, [1, 3], "c_custkey bigint, c_name string")


@query("SELECT n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def allgather_broadcast_join(spark: SparkSession, d: str) -> DataFrame:
    nation = ops.replicate(load(spark, d, "nation"))
    return load(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("customers"))


@query("SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def gather_scatter_shuffle(spark: SparkSession, d: str) -> DataFrame:
    dealt = ops.shuffle(ops.gather(ops.scatter(load(spark, d, "lineitem").select("l_returnflag", "l_orderkey"), 6), 3), 5, "l_orderkey")
    return dealt.groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("SELECT l_suppkey, count(*) AS n, 1::BIGINT AS consumers FROM lineitem GROUP BY l_suppkey")
def shuffle_keeps_keys(spark: SparkSession, d: str) -> DataFrame:
    """Each key comes to one consumer."""
    dealt = ops.shuffle(load(spark, d, "lineitem").select("l_suppkey"), 5, "l_suppkey").withColumn("at", F.spark_partition_id())
    return dealt.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_distinct("at").alias("consumers"))


@query("SELECT 6::BIGINT AS consumers, count(*) AS n, true AS even FROM lineitem")
def scatter_is_even(spark: SparkSession, d: str) -> DataFrame:
    """Each producer deals its rows round robin, so consumers differ by a row a producer at most."""
    lines = load(spark, d, "lineitem").select("l_orderkey")
    dealt = ops.scatter(lines, 6).withColumn("at", F.spark_partition_id()).groupBy("at").agg(F.count("*").alias("n"))
    producers = lines._jdf.queryExecution().toRdd().getNumPartitions()
    return dealt.agg(F.count("*").alias("consumers"), F.sum("n").alias("n"), (F.max("n") - F.min("n") <= producers).alias("even"))


@query("SELECT 6::BIGINT AS producers, 3::BIGINT AS consumers, count(*) AS n, 1::BIGINT AS most FROM lineitem")
def gather_keeps_producers(spark: SparkSession, d: str) -> DataFrame:
    """Each of 3 consumers takes whole producers: none of the 6 comes to two."""
    made = ops.scatter(load(spark, d, "lineitem").select("l_orderkey"), 6).withColumn("made", F.spark_partition_id())
    met = ops.gather(made, 3).withColumn("at", F.spark_partition_id()).groupBy("made").agg(F.count("*").alias("n"), F.collect_set("at").alias("at"))
    return met.agg(
        F.count("*").alias("producers"), F.size(F.array_distinct(F.flatten(F.collect_list("at")))).cast("long").alias("consumers"), F.sum("n").alias("n"), F.max(F.size("at")).cast("long").alias("most")
    )


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 4 IN (1, 2)")
def numbered_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Four numbered chunks of one file each; the middle two read as one table."""
    path = fresh_path(spark, "numbered")
    customer = load(spark, d, "customer").select("c_custkey", "c_name")
    for i, chunk in enumerate(delimited.chunk_paths(f"{path}/t", 0, 4)):
        delimited.write_single(customer.where(F.col("c_custkey") % 4 == i), chunk)
    return delimited.read_chunks(spark, f"{path}/t", 1, 2, "c_custkey bigint, c_name string")


_LOG = [(0, "time", 12.5), (0, "cost", 3.25), (1, "time", 11.0), (1, "cost", 4.0), (2, "time", 9.75)]


@query("SELECT * FROM (VALUES " + ", ".join(f"({r}::INTEGER, '{k}', {v}::DOUBLE)" for r, k, v in _LOG) + ") AS t(record, key, value)")
def metrics_log(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "log")
    spark.createDataFrame([("\n".join(f"{k}: {v}" if r % 2 else f"{k} {v}" for r, k, v in _LOG),)], "value string").coalesce(1).write.text(path)
    return delimited.read_metrics(spark, path).select("record", "key", "value")


# ---- time models ----

# Published stage totals in seconds at degrees 10, 20, 30, 60, 120.
TOTALS = [
    ("q1", "io", [147.854, 72.048, 48.341, 23.896, 14.561]),
    ("q1", "compute", [14.630, 7.290, 4.921, 2.879, 2.123]),
    ("q16", "io", [1059.924, 530.995, 356.537, 181.993, 88.508]),
    ("q16", "compute", [471.669, 345.522, 301.855, 256.205, 237.487]),
    ("q94", "io", [644.696, 311.484, 210.464, 104.482, 55.188]),
    ("q94", "compute", [229.617, 163.442, 139.133, 124.787, 118.503]),
    ("q95", "io", [534.318, 275.798, 183.368, 90.008, 45.236]),
    ("q95", "compute", [238.822, 169.340, 141.655, 119.983, 119.244]),
]
DEGREES = [10, 20, 30, 60, 120]
_ROWS = [(q, s, d, y) for q, s, ys in TOTALS for d, y in zip(DEGREES, ys, strict=True)]
_VALUES = ", ".join(f"('{q}', '{s}', {d}, {y}::DOUBLE)" for q, s, d, y in _ROWS)
_PROFILE = f"(VALUES {_VALUES}) AS t(query, stage, degree, ms)"


def _profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_ROWS, "query string, stage string, degree int, ms double").withColumn("phase", F.lit("compute"))


@query(f"SELECT query, stage, round(regr_slope(ms, 1.0 / degree), 3) AS a, round(regr_intercept(ms, 1.0 / degree), 3) AS b FROM {_PROFILE} GROUP BY query, stage")
def fit_time_model(spark: SparkSession, d: str) -> DataFrame:
    return elastic.fit(_profiles(spark)).select("query", "stage", F.round("a", 3).alias("a"), F.round("b", 3).alias("b"))


@query(
    f"SELECT query, stage, round(regr_slope(ms, 1.0 / degree) / 40 + regr_intercept(ms, 1.0 / degree), 3) AS seconds FROM {_PROFILE} GROUP BY query, stage"
)
def predict_time(spark: SparkSession, d: str) -> DataFrame:
    return elastic.predict(elastic.fit(_profiles(spark)), "compute", F.lit(40)).select("query", "stage", F.round("ms", 3).alias("seconds"))


_PHASE_MS = [(phase, 1000.0 * k + 60.0 / degree, degree) for degree in (2, 4) for k, phase in enumerate(elastic.PHASES)]
_TIMER_ROWS = ", ".join(f"(7, 3, {degree}, '{phase}', {ms * sum(p == phase for p in elastic.TIMERS.values())}::DOUBLE)" for phase, ms, degree in _PHASE_MS)


@query(f"SELECT * FROM (VALUES {_TIMER_ROWS}) AS t(query, stage, degree, phase, ms)")
def profile_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """A stage's profile file read back: timers of a phase are added, what is not of a phase is left out."""
    path = fresh_path(spark, "profiles")
    at = {(phase, degree): ms for phase, ms, degree in _PHASE_MS}
    text = "\n".join(f"{timer} {at.get((phase, degree), 5.0)}" for degree in (2, 4) for timer, phase in elastic.TIMERS.items())
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}/q7_stage3.profile")
    return elastic.read_profiles(spark, f"{path}/*", [2, 4])


# stage, single, input size, memory, weight
_STAGES = [(1, 0, 146.8, 154.605, 520.0), (2, 0, 7.81, 8.5379, 60.0), (3, 1, 0.737, 1.237, 1.0), (4, 0, 320.5, 330.25, 610.0), (5, 0, 20.25, 22.5, 44.0), (6, 0, 64.0, 70.125, 130.0)]
_STAGE_SQL = "(VALUES " + ", ".join(str(s) for s in _STAGES) + ") AS s(stage, single, size, mem, weight)"


def _stage_dag() -> planner.Dag:
    return {i: planner.Stage(i, single=bool(single), input_size=size, mem_parallel=mem) for i, single, size, mem, _ in _STAGES}


def _degrees(spark: SparkSession, degree: dict[int, int]) -> DataFrame:
    return spark.createDataFrame(sorted(degree.items()), "stage int, degree long")


def _dealt_sql(share: str) -> str:
    return f"""SELECT stage, CAST(CASE WHEN single = 1 THEN 1 ELSE greatest(1, floor(118 * {share} / sum(CASE WHEN single = 0 THEN {share} END) OVER ())) END AS BIGINT) AS degree FROM {_STAGE_SQL}"""


@query(_dealt_sql("sqrt(mem::DOUBLE * weight::DOUBLE)"))
def dop_by_cost(spark: SparkSession, d: str) -> DataFrame:
    return _degrees(spark, planner.by_cost(_stage_dag(), {i: mem * weight for i, _, _, mem, weight in _STAGES}, 120))


@query(_dealt_sql("size::DOUBLE"))
def dop_by_size(spark: SparkSession, d: str) -> DataFrame:
    return _degrees(spark, planner.by_size(_stage_dag(), 120))


# stage, degree, memory, pre, read1, read2, compute, write (ms)
_TASKS = [(1, 24, 6.5, 70, 32345, 0, 74, 856), (2, 12, 0.75, 40, 900, 0, 120, 310), (3, 1, 1.25, 35, 450, 700, 800, 20), (6, 6, 11.5, 90, 2100, 650, 3000, 480)]
_TASK_SQL = "(VALUES " + ", ".join(str(t) for t in _TASKS) + ") AS t(stage, degree, mem, pre, read1, read2, compute, write)"


@query(f"SELECT stage, CAST(pre + compute + least(read1, 600) + read2 + least(write, 600) AS BIGINT) AS charged, round(degree * mem::DOUBLE * (pre + compute + least(read1, 600) + read2 + least(write, 600)) / 1000.0::DOUBLE, 4) AS cost FROM {_TASK_SQL}")
def charge_cost(spark: SparkSession, d: str) -> DataFrame:
    tasks = spark.createDataFrame(_TASKS, "stage int, degree int, mem double, pre long, read1 long, read2 long, compute long, write long")
    ms = fx.charged_ms(F.col("pre"), F.col("read1"), F.col("read2"), F.col("compute"), F.col("write"), (True, False, True))
    return tasks.select("stage", ms.alias("charged"), F.round(F.col("degree") * F.col("mem") * ms / 1000.0, 4).alias("cost"))


# ---- the planner on a plan of six stages: 1 and 2 feed 3, 3 and 4 feed 5, 5 ends in 6 ----

_DAG = """
Stage 1
is_leaf 1
input_chunks 48
to_id 3
transfer_op gather
mem_parall 120
mem_fixed 0.5
input_size 96
Stage 2
is_leaf 1
input_chunks 30
to_id 3
transfer_op allgather
mem_parall 20
mem_fixed 0.25
input_size 12
Stage 3
to_id 5
transfer_op gather
from_id 2 1
pre_id 2
mem_parall 60
mem_fixed 0.5
input_size 40
Stage 4
is_leaf 1
input_chunks 36
to_id 5
transfer_op shuffle
mem_parall 30
mem_fixed 0.25
input_size 18
Stage 5
to_id 6
transfer_op allgather
from_id 3 4
mem_parall 10
mem_fixed 0.25
input_size 6
Stage 6
is_single 1
to_id -1
from_id 5
mem_parall 1
mem_fixed 0.25
input_size 1
"""
# stage, a of read1, read2, compute, write, pre; b of compute (ms)
_MODELS = [(1, 9000.0, 0.0, 1600.0, 900.0, 50.0, 20.0), (2, 2000.0, 0.0, 400.0, 100.0, 50.0, 10.0), (3, 300.0, 700.0, 3000.0, 350.0, 100.0, 40.0), (4, 4000.0, 0.0, 800.0, 200.0, 50.0, 10.0), (5, 150.0, 250.0, 900.0, 90.0, 80.0, 15.0), (6, 40.0, 0.0, 30.0, 5.0, 20.0, 5.0)]
_MODEL_SQL = "(VALUES " + ", ".join(f"({i}, " + ", ".join(f"{x}::DOUBLE" for x in xs) + ")" for i, *xs in _MODELS) + ") AS m(stage, r1, r2, c, w, p, b)"


def _plan_dag() -> planner.Dag:
    dag = planner.parse_dag(_DAG)
    for i, r1, r2, c, w, p, b in _MODELS:
        dag[i].model = elastic.Coefficients({"read1": r1, "read2": r2, "compute": c, "write": w, "pre": p}, {"compute": b})
    return dag


# 1, 3 and 5 are a chain of gathers; 3 reads 2 ahead and hence 1 second; 5 reads 3 first
_MODE_ROWS = "(VALUES (1, 1, 1, 'read_compute'), (3, 1, 2, 'read1_compute'), (5, 1, 3, 'read2_compute_write'), (2, 2, 1, 'read_compute_write'), (4, 3, 1, 'read_compute_write'), (6, 4, 1, 'read_compute_write')) AS g(stage, grp, place, mode)"
_SHARED = 1 / elastic.SHARED_SPEEDUP
#: a stage's slope in its mode
_SLOPE = f"CASE mode WHEN 'read_compute' THEN r1 + r2 + c WHEN 'read1_compute' THEN r1 + {_SHARED} * r2 + c WHEN 'read2_compute_write' THEN {_SHARED} * r1 + r2 + c + w ELSE r1 + r2 + c + w END"
_WEIGHED = f"WITH x AS (SELECT stage, mode, {_SLOPE} AS slope, p, b FROM {_MODEL_SQL} JOIN {_MODE_ROWS} USING (stage))"


@query(f"SELECT stage, grp, place, mode FROM {_MODE_ROWS}")
def plan_fusion(spark: SparkSession, d: str) -> DataFrame:
    dag = _plan_dag()
    groups = planner.fuse(dag)
    mode = planner.modes(dag, groups)
    return spark.createDataFrame([(i, k, j, mode[i]) for k, g in enumerate(groups, 1) for j, i in enumerate(g, 1)], "stage int, grp int, place int, mode string")


@query(_WEIGHED + " SELECT stage, round(slope, 6) AS time_weight, round(mem * (slope + p), 6) AS cost_weight FROM x JOIN (VALUES (1, 120), (2, 20), (3, 60), (4, 30), (5, 10), (6, 1)) AS y(stage, mem) USING (stage)")
def plan_weights(spark: SparkSession, d: str) -> DataFrame:
    dag = _plan_dag()
    mode = planner.modes(dag, planner.fuse(dag))
    time, cost = planner.time_weights(dag, mode), planner.cost_weights(dag, mode)
    return spark.createDataFrame([(i, round(time[i], 6), round(cost[i], 6)) for i in dag], "stage int, time_weight double, cost_weight double")


# siblings share by their times, a stage and what is below it by square roots; stage 6 has one task
_BY_TIME_SQL = (
    _WEIGHED
    + """, v AS (
  SELECT max(CASE WHEN stage = 1 THEN slope END) AS w1, max(CASE WHEN stage = 2 THEN slope END) AS w2, max(CASE WHEN stage = 3 THEN slope END) AS w3,
         max(CASE WHEN stage = 4 THEN slope END) AS w4, max(CASE WHEN stage = 5 THEN slope END) AS w5 FROM x
), t AS (SELECT *, power(sqrt(w1 + w2) + sqrt(w3), 2) AS t3 FROM v
), f AS (SELECT *, sqrt(t3 + w4) / (sqrt(t3 + w4) + sqrt(w5)) AS below5, sqrt(w1 + w2) / (sqrt(w1 + w2) + sqrt(w3)) AS below3, t3 / (t3 + w4) AS side3 FROM t
), s(stage, share) AS (
  SELECT 1, below5 * side3 * below3 * w1 / (w1 + w2) FROM f UNION ALL SELECT 2, below5 * side3 * below3 * w2 / (w1 + w2) FROM f
  UNION ALL SELECT 3, below5 * side3 * (1 - below3) FROM f UNION ALL SELECT 4, below5 * (1 - side3) FROM f UNION ALL SELECT 5, 1 - below5 FROM f
)
SELECT stage, CAST(greatest(1, floor(118 * share)) AS BIGINT) AS degree FROM s UNION ALL SELECT 6, 1
"""
)


@query(_BY_TIME_SQL)
def plan_by_time(spark: SparkSession, d: str) -> DataFrame:
    dag = _plan_dag()
    return _degrees(spark, planner.by_time(dag, planner.time_weights(dag, planner.modes(dag, planner.fuse(dag))), 120))


# 40 of 48 chunks: 48 is the next divisor but 8 above, so 24; 3 reads 1 by gather: 13 goes up to 24;
# 11 of 30 chunks goes down to 10 (15 is 4 above: up); 17 of 36 up to 18; 5 reads 3: 7 up to 8, then doubled while slots last
@query("SELECT * FROM (VALUES (1, 24::BIGINT), (2, 15::BIGINT), (3, 24::BIGINT), (4, 18::BIGINT), (5, 24::BIGINT), (6, 1::BIGINT)) AS t(stage, degree)")
def plan_tuned(spark: SparkSession, d: str) -> DataFrame:
    return _degrees(spark, planner.tune(_plan_dag(), {1: 40, 2: 11, 3: 13, 4: 17, 5: 7, 6: 1}, 120))


# bundles of 1, 3 and 5 take 4 + 4 + 1 slots, 4 bundles over three servers in turn; the rest goes where most is free, the first of equals
@query("SELECT * FROM (VALUES (1, 0, 8), (1, 1, 4), (1, 2, 4), (3, 0, 8), (3, 1, 4), (3, 2, 4), (5, 0, 2), (5, 1, 1), (5, 2, 1), (2, 0, 2), (2, 1, 3), (2, 2, 1), (6, 0, 1), (6, 1, 0), (6, 2, 0)) AS t(stage, server, tasks)")
def plan_placed(spark: SparkSession, d: str) -> DataFrame:
    tasks, _ = planner.place([[1, 3, 5], [2], [6]], {1: 16, 3: 16, 5: 4, 2: 6, 6: 1}, [24, 16, 14])
    return spark.createDataFrame([(i, k, n) for i, row in tasks.items() for k, n in enumerate(row)], "stage int, server int, tasks int")


_FIXED_DEGREE = "CASE WHEN stage = 6 THEN 1 ELSE 10 END"


@query(_WEIGHED + f", y AS (SELECT x.*, fixed, par, leaf FROM x JOIN (VALUES (1, 0.5, 120, 1), (2, 0.25, 20, 1), (3, 0.5, 60, 0), (4, 0.25, 30, 1), (5, 0.25, 10, 0), (6, 0.25, 1, 0)) AS z(stage, fixed, par, leaf) USING (stage)) SELECT round(sum({_FIXED_DEGREE} * (fixed + par / {_FIXED_DEGREE}) * (slope / 10 + b + p / 10 + CASE leaf WHEN 1 THEN 0 ELSE 1500 END) / 1000), 6) AS cost FROM y")
def plan_cost(spark: SparkSession, d: str) -> DataFrame:
    dag = _plan_dag()
    total = planner.cost(dag, planner.fixed(dag, 10), planner.modes(dag, planner.fuse(dag)))
    return spark.createDataFrame([(round(total, 6),)], "cost double")


@query(_WEIGHED + ", e AS (SELECT stage, slope / 10 + b AS work, p / 10 AS ready FROM x) SELECT round(greatest((SELECT work + ready FROM e WHERE stage = 1), (SELECT work + ready FROM e WHERE stage = 2)) + (SELECT sum(work) FROM e WHERE stage IN (3, 5, 6)), 6) AS completion_ms")
def plan_completion(spark: SparkSession, d: str) -> DataFrame:
    """The longest path is from stage 1 or 2: stage 4 is short."""
    dag = _plan_dag()
    return spark.createDataFrame([(round(planner.completion_ms(dag, planner.fixed(dag, 10), planner.modes(dag, planner.fuse(dag))), 6),)], "completion_ms double")


# a chain without fusion: each stage is prepared just when its input has come
@query(f"WITH e AS (SELECT stage, (r1 + r2 + c + w) / 10 + b AS work, p / 10 AS ready FROM {_MODEL_SQL}), s AS (SELECT stage, work, ready FROM e WHERE stage IN (1, 5, 6)) SELECT stage, round(CASE stage WHEN 1 THEN 0 WHEN 5 THEN (SELECT work + ready FROM s WHERE stage = 1) - ready ELSE (SELECT work + ready FROM s WHERE stage = 1) + (SELECT work FROM s WHERE stage = 5) - ready END, 6) AS start_ms FROM s")
def plan_launch(spark: SparkSession, d: str) -> DataFrame:
    whole = _plan_dag()
    dag = {i: whole[i] for i in (1, 5, 6)}
    dag[5].sources, dag[1].to = [1], 5
    groups = planner.fuse(dag, 1)
    start = planner.launch_times(dag, planner.fixed(dag, 10), planner.modes(dag, groups), groups)
    return spark.createDataFrame([(i, round(x, 6)) for i, x in start.items()], "stage int, start_ms double")


@query(
    f"SELECT stage, mode, round({_SLOPE} / 12 + b, 6) AS ms FROM {_MODEL_SQL}, (VALUES ('read_compute'), ('read1_compute'), ('read2_compute_write'), ('read_compute_write')) AS k(mode) "
    f"UNION ALL SELECT stage, 'compute_write', round(({_SHARED} * (r1 + r2) + c + w) / 12 + b, 6) FROM {_MODEL_SQL} UNION ALL SELECT stage, 'read1_compute_write', round((r1 + {_SHARED} * r2 + c + w) / 12 + b, 6) FROM {_MODEL_SQL} "
    f"UNION ALL SELECT stage, 'read2_compute', round(({_SHARED} * r1 + r2 + c) / 12 + b, 6) FROM {_MODEL_SQL} UNION ALL SELECT stage, 'all_shared', round(({_SHARED} * (r1 + r2 + w) + c) / 12 + b, 6) FROM {_MODEL_SQL} "
    f"UNION ALL SELECT stage, 'write', round(w / 12, 6) FROM {_MODEL_SQL} UNION ALL SELECT stage, 'pre', round(p / 12, 6) FROM {_MODEL_SQL} UNION ALL SELECT stage, 'read', round((r1 + r2) / 12, 6) FROM {_MODEL_SQL} "
    f"UNION ALL SELECT stage, 'read1', round(r1 / 12, 6) FROM {_MODEL_SQL} UNION ALL SELECT stage, 'compute', round(c / 12 + b, 6) FROM {_MODEL_SQL} UNION ALL SELECT stage, 'total', round((r1 + r2 + c + w + p) / 12 + b, 6) FROM {_MODEL_SQL}"
)
def predict_modes(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(i, m, round(s.model.predict(m, 12), 6)) for i, s in _plan_dag().items() for m in elastic.MODES], "stage int, mode string, ms double")


# ---- the TPC-DS queries, on tables of their shape made from the test tables ----

_DAY0 = "DATE '1990-01-01'"


def _sales_sql(p: str, site: str) -> str:
    return f"""SELECT l_orderkey AS {p}_order_number, CAST(CASE WHEN l_linenumber % 5 <> 0 THEN l_suppkey % 3 END AS BIGINT) AS {p}_warehouse_sk, {{days}} AS {p}_ship_date_sk,
  CAST(l_partkey % 40 AS BIGINT) AS {p}_ship_addr_sk, CAST(l_orderkey % 6 AS BIGINT) AS {site}, CAST(l_extendedprice AS DECIMAL(18,2)) AS {p}_ext_ship_cost,
  CAST(l_quantity AS DECIMAL(18,2)) AS {p}_net_profit FROM lineitem"""


#: Table -> SQL that both engines run; ``{days}`` is the number of days of l_shipdate since the first.
_SHAPES = {
    "catalog_sales": _sales_sql("cs", "cs_call_center_sk"),
    "web_sales": _sales_sql("ws", "ws_web_site_sk"),
    "catalog_returns": "SELECT l_orderkey AS cr_order_number FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1",
    "web_returns": "SELECT l_orderkey AS wr_order_number FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 2",
    "date_dim": "SELECT DISTINCT {days} AS d_date_sk, CAST(l_shipdate AS DATE) AS d_date, year(l_shipdate) AS d_year FROM lineitem",
    "customer_address": "SELECT DISTINCT CAST(l_partkey % 40 AS BIGINT) AS ca_address_sk, CASE WHEN l_partkey % 40 < 20 THEN 'GA' ELSE 'IL' END AS ca_state FROM lineitem",
    "call_center": "SELECT DISTINCT CAST(l_orderkey % 6 AS BIGINT) AS cc_call_center_sk, CASE l_orderkey % 6 WHEN 0 THEN 'Williamson County' WHEN 1 THEN 'Ziebach County' WHEN 2 THEN 'Walker County' ELSE 'Barrow County' END AS cc_county FROM lineitem",
    "web_site": "SELECT DISTINCT CAST(l_orderkey % 6 AS BIGINT) AS web_site_sk, CASE WHEN l_orderkey % 6 < 3 THEN 'pri' ELSE 'able' END AS web_company_name FROM lineitem",
    "store_returns": "SELECT CAST(l_partkey % 150 AS BIGINT) AS sr_customer_sk, CAST(l_suppkey % 10 AS BIGINT) AS sr_store_sk, {days} AS sr_returned_date_sk, CAST(l_extendedprice AS DECIMAL(18,2)) AS sr_fee FROM lineitem WHERE l_returnflag = 'R'",
    "store": "SELECT DISTINCT CAST(l_suppkey % 10 AS BIGINT) AS s_store_sk, CASE WHEN l_suppkey % 10 < 7 THEN 'MI' ELSE 'TN' END AS s_state FROM lineitem",
    "customer": "SELECT DISTINCT CAST(l_partkey % 150 AS BIGINT) AS c_customer_sk, 'C' || CAST(1000 + l_partkey % 150 AS VARCHAR(9)) AS c_customer_id FROM lineitem",
}


def _shaped(spark: SparkSession, d: str, *names: str) -> list[DataFrame]:
    days = f"CAST(datediff(CAST(l_shipdate AS DATE), {_DAY0}) AS BIGINT)"
    return [spark.sql(_SHAPES[n].replace("{days}", days).replace("FROM lineitem", "FROM {lineitem}"), lineitem=load(spark, d, "lineitem")) for n in names]


def _with(names: list[str], query: str) -> str:
    days = f"CAST(datediff('day', {_DAY0}, CAST(l_shipdate AS DATE)) AS BIGINT)"
    return "WITH " + ", ".join(f"{n} AS ({_SHAPES[n].replace('{days}', days)})" for n in names) + query


def _totals(report: DataFrame) -> DataFrame:
    return report.select("order_count", *[F.col(c).cast("double").alias(c) for c in ("total_shipping_cost", "total_net_profit")])


def _totals_sql(names: list[str], query: str) -> str:
    return _with(names, f" SELECT order_count, CAST(total_shipping_cost AS DOUBLE) AS total_shipping_cost, CAST(total_net_profit AS DOUBLE) AS total_net_profit FROM ({query}) AS q")


_Q1 = ["store_returns", "date_dim", "store", "customer"]
_Q16 = ["catalog_sales", "catalog_returns", "date_dim", "customer_address", "call_center"]
_Q9X = ["web_sales", "web_returns", "date_dim", "customer_address", "web_site"]
#: The template of Q16 takes five counties.
_COUNTIES = ("Williamson County", "Ziebach County", "Walker County", "Daviess County", "Luce County")
_IN_COUNTIES = "cc_county IN (" + ", ".join(f"'{c}'" for c in _COUNTIES) + ")"


@query(_with(_Q1, ", " + tpcds.Q1_SQL.format(amount="sr_fee", year=1998, state="MI").strip().removeprefix("WITH ")))
def tpcds_q1(spark: SparkSession, d: str) -> DataFrame:
    return tpcds.q1(*_shaped(spark, d, *_Q1), year=1998)


@query(_totals_sql(_Q16, tpcds.order_sql("catalog_sales", "catalog_returns", tpcds.CATALOG, "cr_order_number", "call_center", "1998-02-01", "GA", _IN_COUNTIES, False)))
def tpcds_q16(spark: SparkSession, d: str) -> DataFrame:
    return _totals(tpcds.q16(*_shaped(spark, d, *_Q16), first="1998-02-01", counties=_COUNTIES))


@query(_totals_sql(_Q9X, tpcds.order_sql("web_sales", "web_returns", tpcds.WEB, "wr_order_number", "web_site", "1999-02-01", "IL", "web_company_name = 'pri'", False)))
def tpcds_q94(spark: SparkSession, d: str) -> DataFrame:
    return _totals(tpcds.q94(*_shaped(spark, d, *_Q9X)))


@query(_totals_sql(_Q9X, tpcds.order_sql("web_sales", "web_returns", tpcds.WEB, "wr_order_number", "web_site", "1999-02-01", "IL", "web_company_name = 'pri'", True)))
def tpcds_q95(spark: SparkSession, d: str) -> DataFrame:
    return _totals(tpcds.q95(*_shaped(spark, d, *_Q9X)))
