"""Profiles of stages, measured: what the time models are fitted from."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

from millrace.shared import fresh_path

from .plan import apply_degree

SCHEMA = "query int, stage int, degree int, phase string, ms double"


def _ms(work: Callable[[], object]) -> float:
    began = time.perf_counter()
    work()
    return (time.perf_counter() - began) * 1000


def _run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def profile_stage(source: Callable[[], DataFrame], compute: Callable[[DataFrame], DataFrame], degrees: Sequence[int], query: int, stage: int) -> DataFrame:
    """(query, stage, degree, phase, ms) of a stage that reads ``source()`` and returns ``compute`` of it, at each degree.

    Spark runs the phases of a stage together, so each is the difference
    between a run up to its end and a run up to its beginning, never below
    zero: reading, reading and computing, and all with the writing of Parquet
    to the shared folder. "pre" is the planning, which is done on the driver.
    """
    spark, rows = source().sparkSession, []
    for degree in degrees:
        pre = _ms(lambda d=degree: compute(apply_degree(source(), d))._jdf.queryExecution().executedPlan())
        read = _ms(lambda d=degree: _run(apply_degree(source(), d)))
        both = _ms(lambda d=degree: _run(compute(apply_degree(source(), d))))
        path = fresh_path(spark, "profiled")
        whole = _ms(lambda d=degree, p=path: compute(apply_degree(source(), d)).write.parquet(p))
        parts = {"pre": pre, "read1": read, "compute": max(0.0, both - read), "write": max(0.0, whole - both)}
        rows += [(query, stage, degree, phase, ms) for phase, ms in parts.items()]
    return spark.createDataFrame(rows, SCHEMA)
