"""What the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of code points that are not ASCII white space (fixed by the contracts).
WORD = r"[^\x20\x09-\x0D]+"
ARROW_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
ARROW_ROWS = 250
SPACES = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none (tests on one machine) is one made here.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        where = "file://" + tempfile.mkdtemp(prefix="millrace-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    # with the scheme of the cluster's default file system where the setting has none
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/millrace/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Python workers get ``ARROW_ROWS`` rows at a time at most: texts are long."""
    rows = spark.conf.get(ARROW_SETTING)
    spark.conf.set(ARROW_SETTING, str(min(ARROW_ROWS, int(rows)) if int(rows) > 0 else ARROW_ROWS))
    try:
        yield
    finally:
        spark.conf.set(ARROW_SETTING, rows)


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage so that a lost executor costs a re-read, not a recomputation,
    and fixes results that later passes must see identically.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many partitions as there are cores, where its files give fewer: Python work takes longer than the shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def give_back() -> None:
    """Return freed memory to the machine, at the end of a task's rows: Python workers are used again and again."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Keys with more than this part of all rows are hot.
HOT = 1000


def join_dealt(rows: DataFrame, few: DataFrame, keys: list[str], weight: str, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``few``, which has a row a key and in ``weight`` how many rows have it.

    Hot keys, more than one in ``HOT`` of all that ``weight`` counts each and
    hence fewer than ``HOT``, are broadcast: their rows stay where they are. The
    others meet by shuffle, and none of them fills a task.
    """
    total = few.agg(F.sum(weight)).first()[0] or 0
    heavy = F.col(weight) * HOT > F.lit(total)
    hot, rest = few.where(heavy).drop(weight), few.where(~heavy).drop(weight)
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(rest, keys, how)
    return rows.join(F.broadcast(hot), keys).unionByName(cold)


def components(links: DataFrame, spark: SparkSession) -> DataFrame:
    """Connected components of ``links`` (a, b long) as (id, component).

    component is the smallest id reachable. Alternating large-star and
    small-star rounds until the edge set no longer changes: each round is a
    shuffle on ids, none gathers a component in one task beyond Spark's own
    sort-based windows, and O(log n) rounds suffice in practice. Rounds are
    settled in the shared folder. Self links and nulls are ignored; an empty
    input gives an empty result.
    """
    edges = settle(
        links.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).where("v < u").distinct(),
        "cc",
    )  # v < u: u hangs below v
    if edges.isEmpty():
        return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        # each node with its least neighbour, itself included; joined back, never gathered as a list
        least = pairs.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("low"))
        joined = pairs.join(least, "n")
        out = joined.where(F.col("m") > F.col("n")) if large else joined
        out = out.select(F.col("low").alias("v"), F.col("m").alias("u"))
        if not large:
            out = out.union(least.select(F.col("low").alias("v"), F.col("n").alias("u")))
        return out.where("v < u").distinct()

    seen = None
    while True:
        both = edges.select(F.col("u").alias("n"), F.col("v").alias("m")).union(
            edges.select(F.col("v").alias("n"), F.col("u").alias("m"))
        )
        big = star(both, True)
        # small star: each node with its lesser neighbours
        edges = settle(star(big.select(F.col("u").alias("n"), F.col("v").alias("m")), False), "cc")
        mark = tuple(
            edges.agg(
                F.count("*"),
                F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1_000_000_007))),
            ).first()
        )
        if mark == seen:
            break
        seen = mark
    # a star forest: every node below its root
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
