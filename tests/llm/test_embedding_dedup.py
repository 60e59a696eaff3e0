import numpy as np
from pyspark.sql import functions as F

from millrace.llm import embedding_dedup as ed


def brute(rows, least):
    ok = {}
    for k, (i, e, label) in enumerate(rows):
        if i is None or label is None or e is None or any(v is None for v in e):
            continue
        x = np.array(e, np.float64)
        if len(x) and np.isfinite(x).all() and np.linalg.norm(x) > 0:
            ok[k] = x / np.linalg.norm(x)
    links = {k: set() for k in range(len(rows))}
    for a in ok:
        for b in ok:
            if a != b and rows[a][2] == rows[b][2] and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= least:
                links[a].add(b)
    out = []
    for k in range(len(rows)):
        seen, todo = {k}, [k]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out.append((rows[k][0], len(links[k]), min((rows[j][0] for j in seen), default=None) if rows[k][0] is not None else None))
    return sorted(out, key=str)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ed, "TILE", 7)
    rng = np.random.default_rng(0)
    rows = []
    for k in range(300):
        base = np.random.default_rng(k % 40).normal(size=16)
        x = base + rng.normal(size=16) * rng.choice([0.02, 0.15, 0.25])
        rows.append((k, [float(v) for v in x.astype(np.float32)], int(k % 2)))
    rows += [(300 + k, rows[5][1], 1) for k in range(20)]  # copies
    rows += [(400, None, 1), (401, [0.0] * 16, 1), (402, [float("nan")] * 16, 1), (403, rows[5][1], None), (404, [None] + [1.0] * 15, 1), (405, [1.0, 2.0], 1), (406, [], 1), (407, [float("inf")] * 16, 1), (None, rows[5][1], 1)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, id int, cell string")
    got = ed.near_vectors(df)
    have = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got.collect()), key=str)
    assert have == brute(rows, 0.98)
    assert got.where("vec_id is not null and kept != (vec_id = component_id)").count() == 0
    assert ed.near_vectors(df.where("false")).count() == 0


def test_any_grid(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(30, 12)) * np.array([3, 2, 1] + [0.3] * 9)
    rows = [(k, [float(v) for v in x[k % 30] + rng.normal(size=12) * 0.1], "a") for k in range(240)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    want, axes = brute(rows, 0.98), []
    grid = ed._grid
    monkeypatch.setattr(ed, "_grid", lambda *a: axes.append(grid(*a)) or axes[-1])
    for tile, cost in ((5, 0), (256, 10**6)):
        monkeypatch.setattr(ed, "TILE", tile)
        monkeypatch.setattr(ed, "COPY_COST", cost)
        assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in ed.near_vectors(df).collect()), key=str) == want
    assert [a[12][1] for a in axes] == [ed.MOST_AXES, 0]


def test_doubles_whose_squares_overflow(spark):
    rows = [(1, [1e200, 2e200], 1), (2, [1e-200, 2e-200], 1), (3, [1.0, 2.0], 1), (4, [2.0, -1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(map(tuple, ed.near_vectors(df).collect())) == [(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 0, 4, True)]


def test_axes_lead():
    x = np.random.default_rng(1).normal(size=(200, 8)) * np.array([1, 1, 9, 1, 1, 1, 1, 1])
    y = x @ ed.axes_of(x)
    assert y.var(axis=0).argmax() == 0 and np.allclose(x @ x.T, y @ y.T)
