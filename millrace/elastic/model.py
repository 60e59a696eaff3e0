"""Per-stage time models: y = a / degree + b for each phase, fitted from profiles.

Fitting and prediction are DataFrame aggregations and expressions, so any
number of queries, stages and samples fit at once. ``Coefficients`` is the
same model for one stage, for the planner.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import inverse_fit

PHASES = ("pre", "read1", "read2", "compute", "write")
#: How much faster a transfer is through memory shared by fused stages (fixed value).
SHARED_SPEEDUP = 50

#: Prediction modes: the weight of each phase. A transfer within a fused group counts 1 / SHARED_SPEEDUP.
_S = 1 / SHARED_SPEEDUP
MODES: dict[str, dict[str, float]] = {
    "read_compute": {"read1": 1, "read2": 1, "compute": 1},
    "compute_write": {"read1": _S, "read2": _S, "compute": 1, "write": 1},
    "read1_compute_write": {"read1": 1, "read2": _S, "compute": 1, "write": 1},
    "read2_compute_write": {"read1": _S, "read2": 1, "compute": 1, "write": 1},
    "read_compute_write": {"read1": 1, "read2": 1, "compute": 1, "write": 1},
    "write": {"write": 1},
    "pre": {"pre": 1},
    "read": {"read1": 1, "read2": 1},
    "compute": {"compute": 1},
    "read1_compute": {"read1": 1, "read2": _S, "compute": 1},
    "read2_compute": {"read1": _S, "read2": 1, "compute": 1},
    "read1": {"read1": 1},
    "all_shared": {"read1": _S, "read2": _S, "compute": 1, "write": _S},
    "total": {p: 1 for p in PHASES},
}

#: Keys of the profile files and the phase each timer belongs to (fixed values).
TIMERS = {
    "PreTime.tpre": "pre",
    "PreTime.tread": "pre",
    "PreTime.tcomp": "pre",
    "EffectTime.tread1": "read1",
    "EffectTime.tread2": "read2",
    "EffectTime.tcomp": "compute",
    "EffectTime.twrite": "write",
    "EffectTime.tpost": "post",
}


@dataclass
class Coefficients:
    a: dict[str, float] = field(default_factory=dict)
    b: dict[str, float] = field(default_factory=dict)

    def slope(self, mode: str) -> float:
        return sum(w * self.a.get(p, 0.0) for p, w in MODES[mode].items())

    def predict(self, mode: str, degree: int) -> float:
        return sum(w * (self.a.get(p, 0.0) / degree + self.b.get(p, 0.0)) for p, w in MODES[mode].items())


def read_profiles(spark: SparkSession, path: str, degrees: list[int]) -> DataFrame:
    """Profile files ``q<query>_stage<stage>.profile`` as (query, stage, degree, phase, ms).

    A file holds one block of ``len(TIMERS)`` lines for each degree.
    """
    files = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    lines = files.select(
        F.regexp_extract("file", r"q(\d+)_stage", 1).cast("int").alias("query"),
        F.regexp_extract("file", r"_stage(\d+)", 1).cast("int").alias("stage"),
        F.posexplode(F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")).alias("pos", "line"),
    )
    name, ms = F.split("line", " ")[0], F.split("line", " ")[1].cast("double")
    phase = F.create_map(*[F.lit(x) for kv in TIMERS.items() for x in kv])[name]
    sample = F.floor(F.col("pos") / len(TIMERS)).cast("int")
    known = F.array(*[F.lit(d) for d in degrees])
    rows = lines.select("query", "stage", F.get(known, sample).alias("degree"), phase.alias("phase"), ms.alias("ms"))
    return rows.where("degree is not null and phase <> 'post'").groupBy("query", "stage", "degree", "phase").agg(F.sum("ms").alias("ms"))


def average_tasks(logs: DataFrame) -> DataFrame:
    """Task timers (query, stage, degree, task, phase, ms) to a stage's profile."""
    return logs.groupBy("query", "stage", "degree", "phase").agg(F.avg("ms").alias("ms"))


def fit(profiles: DataFrame) -> DataFrame:
    """(query, stage, phase, a, b) by least squares over the degrees."""
    a, b = inverse_fit(F.col("ms"), F.col("degree"))
    return profiles.groupBy("query", "stage", "phase").agg(a.alias("a"), b.alias("b"))


def predict(fitted: DataFrame, mode: str, degree: Column) -> DataFrame:
    """(query, stage, ms) of a mode at a degree, which may be a column of ``fitted``."""
    weight = F.create_map(*[F.lit(x) for p, w in MODES[mode].items() for x in (p, float(w))])[F.col("phase")]
    return fitted.where(weight.isNotNull()).groupBy("query", "stage").agg(F.sum(weight * (F.col("a") / degree + F.col("b"))).alias("ms"))


def coefficients(fitted: DataFrame, query: int) -> dict[int, Coefficients]:
    """Models by stage: a few numbers a stage come to the driver."""
    out: dict[int, Coefficients] = {}
    for r in fitted.where(F.col("query") == query).collect():
        c = out.setdefault(r["stage"], Coefficients())
        c.a[r["phase"]], c.b[r["phase"]] = r["a"], r["b"]
    return out
