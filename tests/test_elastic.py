"""Time models and the planner."""

import math

import pytest
from pyspark.sql import functions as F

from millrace.elastic import measure, model, plan, settings

DAG = """
Query 9
Stage 1
is_single 0
is_leaf 1
input_chunks 24
to_id 2
transfer_op gather
from_id
mem_parall 154
mem_fixed 0
input_size 146
Stage 2
is_single 0
is_leaf 0
to_id 3
transfer_op allgather
from_id 1
mem_parall 8
mem_fixed 0
input_size 8
Stage 3
is_single 1
is_leaf 0
to_id -1
transfer_op
from_id 2
mem_parall 1
mem_fixed 0
input_size 1
"""


def dag():
    d = plan.parse_dag(DAG)
    for i, (io, c) in {1: (900.0, 100.0), 2: (40.0, 60.0), 3: (1.0, 4.0)}.items():
        d[i].model = model.Coefficients({"read1": io, "compute": c, "write": io / 10}, {"compute": 2.0})
    return d


def test_fit(spark):
    rows = [(1, 1, n, "compute", 12.0 / n + 3) for n in (2, 4, 6, 12)] + [(1, 1, n, "read1", 8.0 / n) for n in (2, 4, 6, 12)]
    fitted = model.fit(spark.createDataFrame(rows, "query int, stage int, degree int, phase string, ms double"))
    c = model.coefficients(fitted, 1)[1]
    assert math.isclose(c.a["compute"], 12) and math.isclose(c.b["compute"], 3)
    assert math.isclose(c.predict("read_compute", 4), 8.0)
    assert math.isclose(c.predict("compute_write", 4), 6 + 2 / model.SHARED_SPEEDUP)
    got = model.predict(fitted, "compute_write", F.lit(4)).first()["ms"]
    assert math.isclose(got, c.predict("compute_write", 4))


def test_profiles(spark, tmp_path):
    block = "".join(f"{k} {v}\n" for v, k in enumerate(model.TIMERS, 1))
    (tmp_path / "q7_stage3.profile").write_text(block + block.replace(" 6\n", " 60\n"))
    got = {(r["degree"], r["phase"]): r["ms"] for r in model.read_profiles(spark, f"file://{tmp_path}", [2, 4]).collect()}
    assert got[2, "pre"] == 6 and got[2, "compute"] == 6 and got[4, "compute"] == 60 and (2, "post") not in got


def test_parse_and_fuse():
    d = plan.parse_dag(DAG)
    assert d[2].sources == [1] and d[3].single and d[1].chunks == 24 and d[3].to == -1
    assert plan.fuse(d) == [[1, 2], [3]]
    assert plan.fuse(d, 1) == [[1], [2], [3]]
    assert plan.modes(d, plan.fuse(d)) == {1: "read_compute", 2: "read2_compute_write", 3: "read_compute_write"}


def test_degrees():
    d = dag()
    w = {1: 900.0, 2: 100.0, 3: 1.0}
    got = plan.by_time(d, w, 42)  # a chain shares by square roots: 3 to 1
    assert got == {1: 30, 2: 10, 3: 1}
    assert plan.by_cost(d, {1: 900.0, 2: 100.0, 3: 1.0}, 42) == {1: 30, 2: 10, 3: 1}
    assert plan.by_size(d, 156) == {1: 146, 2: 8, 3: 1}
    tuned = plan.tune(d, {1: 23, 2: 5, 3: 1}, 40)
    assert tuned[1] == 24 and 24 % tuned[2] == 0 and sum(tuned.values()) <= 40


def test_siblings_end_together():
    s = plan.Stage
    d = {1: s(1, leaf=True, to=3), 2: s(2, leaf=True, to=3), 3: s(3, sources=[1, 2])}
    got = plan.by_time(d, {1: 300.0, 2: 100.0, 3: 400.0}, 802)
    assert got == {1: 300, 2: 100, 3: 400}


def test_plan():
    d = dag()
    for goal in ("time", "cost"):
        for strategy in ("elastic", "fusion", "degree", "size", "fixed"):
            p = plan.plan(d, plan.zipf_slots(28, 2, 0.9), goal, strategy)
            assert all(sum(p.tasks[i]) == p.degree[i] for i in d)
            assert p.start_ms[1] == 0 and p.start_ms[3] >= p.start_ms[2] and p.cost > 0
        assert plan.lower_bound(d, [14, 14], goal) > 0
    assert plan.plan(d, [40, 40]).completion_ms < plan.plan(d, [4, 4]).completion_ms


def test_placement_splits_what_does_not_fit():
    d = dag()
    tasks, groups = plan.place([[1, 2], [3]], {1: 8, 2: 2, 3: 1}, [4, 8])
    assert sum(tasks[1]) == 8 and sum(tasks[2]) == 2
    assert sorted(map(len, groups)) == [1, 1, 1]


def test_apply_degree(spark):
    assert plan.apply_degree(spark.range(100), 7).rdd.getNumPartitions() == 7


def test_settings():
    text = "# slots\nnum_cpus 4\nproc_step algorithm\nalgorithm elastic\n\nmode cost \ndistribution 25 12 8\nbase_deg 6\nexternal Redis\nunknown 1\n"
    got = settings.parse_settings(text)
    assert got == settings.Settings(cpus=4, step="algorithm", algorithm="elastic", goal="cost", slots=[25, 12, 8], degree=6, storage="Redis")
    assert settings.even_slots(got).slots == [15, 15, 15] and settings.even_slots(settings.Settings(slots=[7, 0, 1])).slots == [3, 3, 2]
    assert settings.parse_settings("mode JCT").goal == "time" and settings.even_slots(settings.parse_settings("")).slots == []
    for bad in ("mode fast", "external disk", "mode"):
        with pytest.raises(ValueError):
            settings.parse_settings(bad)


def test_measured_profile_feeds_the_models(spark):
    source = lambda: spark.range(20_000).selectExpr("id", "id % 7 as k")
    got = measure.profile_stage(source, lambda df: df.groupBy("k").count(), [1, 2], 7, 1)
    assert {(r["degree"], r["phase"]) for r in got.collect()} == {(d, p) for d in (1, 2) for p in ("pre", "read1", "compute", "write")}
    assert got.where("ms < 0 or ms is null").count() == 0
    fitted = model.coefficients(model.fit(got), 7)
    assert set(fitted[1].a) == {"pre", "read1", "compute", "write"}
