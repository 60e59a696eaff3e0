import random

import pytest
from pyspark.sql import functions as F

from millrace.llm import mixing


def brute_targets(sizes):
    """Water filling step by step."""
    order = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    w = {s: k % 3 + 1 for k, s in enumerate(order)}
    done = {}
    while True:
        left = sum(sizes.values()) - sum(done.values())
        free = [s for s in order if s not in done]
        share = {s: left * w[s] / sum(w[f] for f in free) for s in free}
        over = {s: 3.0 * sizes[s] for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return done | share
        done |= over


def test_targets():
    sizes = {"a": 1000, "b": 10, "é": 400, "z": 5, None: 200}
    got, want = mixing.targets(list(sizes.items())), brute_targets(sizes)
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))
    assert got["b"] == 30.0
    assert mixing.targets([("a", 0)]) == {"a": 0.0}


def test_taken_words(spark, docs):
    rng = random.Random(1)
    rows = [(k, " ".join("w" * rng.randrange(1, 400)), rng.choice(["a", "b", "c", "d", None])) for k in range(300)]
    rows.append((300, "tiny source", "q"))
    sized = mixing.sizes(docs(rows))
    got = mixing.mix(sized, block=32)
    by = {r["source"]: r for r in got.groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("w"), F.sum("size").alias("n"), F.max("source_size").alias("m")).collect()}
    assert len(by) == 6
    for r in by.values():
        assert abs(r["t"] - r["w"]) <= 1 and r["n"] == r["m"]
    assert got.where("taken > 3 * size or taken < 0").count() == 0 and got.count() == 301
    again = mixing.mix(sized, block=32)
    assert got.exceptAll(again).count() == 0


def test_schedule_is_even(spark):
    need = {0: 500, 1: 300, 2: 200}
    slots = mixing.schedule(spark, need, {0: 0.5, 1: 0.3, 2: 0.2})
    rows = sorted((r["slot"], r["s"], r["rank"]) for r in slots.collect())
    assert len(rows) == 1000 and len({r[0] for r in rows}) == 1000
    seen = {0: 0, 1: 0, 2: 0}
    for k, (_, s, rank) in enumerate(rows, 1):
        assert rank == seen[s]
        seen[s] += 1
        if k < 990:
            assert all(abs(seen[j] - k * need[j] / 1000) <= 6 for j in need)


def test_odd(odd, none):
    got = mixing.mix(mixing.sizes(odd))
    assert got.count() == odd.count() and got.where("size = 0 and taken > 0").count() == 0
    assert mixing.mix(mixing.sizes(none)).count() == 0
    assert mixing.mix(mixing.sizes(odd.where("trim(text) = ''"))).agg(F.sum("taken")).first()[0] == 0
    kept = mixing.mixed(odd)
    assert kept.columns == odd.columns and kept.where("doc_id is null").count() == 0
