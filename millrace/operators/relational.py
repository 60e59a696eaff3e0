"""Relational operators as DataFrame compositions.

Names follow what they compute. None uses a UDF or an RDD; each is the
shortest plan that Catalyst can optimise: filters and column lists reach the
scan, key sets become semi or anti joins, grouping is two-phase.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.shared import settle

# ---- projection and selection ----


def project(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns)


def select(df: DataFrame, *predicates: Column) -> DataFrame:
    for p in predicates:
        df = df.where(p)
    return df


def select_in(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    return df.where(F.col(column).isin(*values))


def select_project(df: DataFrame, predicate: Column, columns: Sequence[str]) -> DataFrame:
    return df.where(predicate).select(*columns)


def scale(df: DataFrame, column: str, factor: float) -> DataFrame:
    return df.withColumn(column, F.col(column) * F.lit(factor))


# ---- joins ----


def semi_join(left: DataFrame, keys: DataFrame, left_key: str, key: str, hint: str | None = None) -> DataFrame:
    """Rows of ``left`` whose key is among ``keys``; order and repeats of ``left`` are kept.

    Size statistics decide between broadcast and shuffle unless ``hint``
    ("shuffle_hash", "merge") says otherwise.
    """
    side = keys.select(F.col(key).alias("__key"))
    side = side.hint(hint) if hint else side
    return left.join(side, left[left_key] == F.col("__key"), "left_semi")


def anti_join(left: DataFrame, keys: DataFrame, left_key: str, key: str) -> DataFrame:
    side = keys.select(F.col(key).alias("__key"))
    return left.join(side, left[left_key] == F.col("__key"), "left_anti")


def inner_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_columns: Sequence[str], right_columns: Sequence[str]) -> DataFrame:
    """m:n equi-join with a projection of either side before the shuffle.

    Its rows may grow with the product of the sides, on few keys. Where a side
    has at most ``SMALL_SIDE`` rows it goes to all tasks and the other is dealt
    evenly, whatever its keys, so no key is one task's work; two larger sides
    meet by the optimiser's choice, which splits skewed partitions.
    """
    a = left.select(F.col(left_key).alias("__l"), *left_columns)
    b = right.select(F.col(right_key).alias("__r"), *right_columns)
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    small = lambda df: df.limit(SMALL_SIDE + 1).count() <= SMALL_SIDE
    if small(a):
        a, b = F.broadcast(a), b.repartition(n)
    elif small(b):
        a, b = a.repartition(n), F.broadcast(b)
    return a.join(b, F.col("__l") == F.col("__r")).drop("__l", "__r")


#: Up to so many rows a side of an m:n join goes to all tasks.
SMALL_SIDE = 100_000
#: Into how many parts the rows of a key are dealt where they have to be counted off.
PARTS = 64


def semi_join_once(left: DataFrame, keys: DataFrame, left_key: str, key: str) -> DataFrame:
    """Each entry of ``keys`` lets through one row of ``left`` with that key; null keys let through none.

    Equal rows are counted before the shuffle, different rows of a key are
    dealt over ``PARTS`` buckets by their hash, and running counts within and
    over buckets tell which are let through: no key is one task's work.
    """
    columns = left.columns
    own = left.where(F.col(left_key).isNotNull()).groupBy(*columns).agg(F.count("*").alias("__n")).withColumn("__hash", F.xxhash64(*columns))
    own = own.withColumn("__bucket", F.pmod("__hash", F.lit(PARTS)))
    quota = keys.groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("__quota"))
    buckets = own.groupBy(F.col(left_key).alias("__key"), F.col("__bucket").alias("__of")).agg(F.sum("__n").alias("__rows")).join(quota, "__key")
    earlier = F.sum("__rows").over(Window.partitionBy("__key").orderBy("__of")) - F.col("__rows")
    buckets = buckets.select("__key", "__of", (F.col("__quota") - earlier).alias("__left")).where("__left > 0")
    within = Window.partitionBy(left_key, "__bucket").orderBy("__hash").rowsBetween(Window.unboundedPreceding, 0)
    counted = own.withColumn("__before", F.sum("__n").over(within) - F.col("__n"))
    met = counted.join(buckets, (F.col(left_key) == F.col("__key")) & (F.col("__bucket") == F.col("__of")))
    taken = met.withColumn("__take", F.least("__n", F.col("__left") - F.col("__before"))).where("__take > 0")
    return taken.withColumn("__turn", F.explode(F.sequence(F.lit(1).cast("long"), "__take"))).select(*columns)


# ---- grouping ----


def group(df: DataFrame, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    return df.groupBy(*keys).agg(*aggregates)


def append_group_avg(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """The key's average on each row; rows without a key are a group.

    Averages are combined before their shuffle and joined back, by broadcast
    where they are small; a key with very many rows is no single task's work.
    """
    usual = df.groupBy(F.col(key).alias("__key")).agg(F.avg(value).alias("__avg"))
    return df.join(usual, F.col(key).eqNullSafe(F.col("__key"))).withColumn(name, F.col("__avg")).drop("__key", "__avg")


def keys_with_several(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with two or more distinct non-null values: EXISTS (... <> ...) as one aggregation.

    The state of a key is a minimum and a maximum, so it is combined before
    the shuffle whatever the number of rows of the key.
    """
    return df.groupBy(key).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi")).where("__lo < __hi").select(key)


# ---- sets, order, slices ----


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def intersect(left: DataFrame, right: DataFrame, repeats: bool = False) -> DataFrame:
    return left.intersectAll(right) if repeats else left.intersect(right)


def difference(left: DataFrame, right: DataFrame, repeats: bool = False) -> DataFrame:
    return left.exceptAll(right) if repeats else left.subtract(right)


def top(df: DataFrame, order: Sequence[Column | str], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def contiguous_slices(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """``slice`` (0 to n - 1): runs of equal row count in the given order, the last with the remainder.

    Row numbers come from sorted ranges and the ranges' counts, so no task
    sees more than its range; with fewer rows than slices all but the last
    row's successors are empty.
    """
    ranged = settle(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "slices")
    counts = sorted((r["__range"], r["count"]) for r in ranged.groupBy("__range").count().collect())
    total = sum(c for _, c in counts)
    before, offsets = 0, []
    for k, c in counts:
        offsets.append((k, before))
        before += c
    if not total:
        return df.withColumn("slice", F.lit(0).cast("long"))
    each = max(1, total // n)
    offset = F.create_map(*[F.lit(x) for kv in offsets for x in kv])[F.col("__range")]
    number = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1 + offset
    return ranged.withColumn("slice", F.least(F.floor(number / each), F.lit(n - 1)).cast("long")).drop("__range")


# ---- exchanges ----


def gather(df: DataFrame, n: int) -> DataFrame:
    """n consumers, each of whole producer partitions: no shuffle."""
    return df.coalesce(n)


def scatter(df: DataFrame, n: int) -> DataFrame:
    """Rows dealt over n consumers."""
    return df.repartition(n)


def shuffle(df: DataFrame, n: int, *keys: str) -> DataFrame:
    return df.repartition(n, *keys)


def replicate(df: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """To all consumers: a broadcast if the table has at most ``most_rows`` rows, else left to the optimiser."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df
