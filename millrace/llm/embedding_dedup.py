"""Near-duplicate vectors by PCA-ordered tiled comparison.

Vectors of one label and length are scaled to norm 1 and turned into the
principal axes of a bounded sample, so most of a product is in the leading
dimensions. Vectors of cosine c are sqrt(2 - 2 c) apart, in every axis and in
any few of them: a grid of that width over the first axes leaves only
neighbouring cells to compare, and of those only vectors near enough to the
cell. A vector is copied to every cell it visits, so the grid runs over the
number of axes, none included, for which the sample says that copies and
comparisons together cost least at the number of vectors there are; the result
is the same for any. Cells are cut into tiles of ``TILE`` vectors and at most
``TILE_BYTES`` bytes or so.

A task holds two tiles. It adds up the products of the leading dimensions,
bounds the rest by the norms of the vectors' remaining parts, and stops for
every pair that cannot reach the threshold any more; the pairs left after the
last dimension are decided by the cosine of the original vectors in double
precision. A task emits, per vector, its number of links and one link to its
group's least id, never all pairs. Equal vectors are one class beforehand.

Defined results: null vectors, zero vectors, vectors with null or non-finite
components, null labels and null ids link with nothing (their component is
their own id); vectors of different lengths never link; rows that repeat a
vec_id count as vectors of their own, with one component; an empty table gives
an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, join_dealt, settle, table

#: Vectors of a tile on average, and bytes of them as doubles.
TILE = 8192
TILE_BYTES = 8 << 20
#: Products that a task holds at a time.
STRIP = 1 << 18
#: Pairs whose whole vectors a task holds at a time.
PAIRS = 1 << 14
#: Comparisons of leading dimensions that cost as much as one copy of a vector to a tile.
COPY_COST = 2000
#: Rows that the axes and the grid are fitted on; every row is compared whatever the sample.
SAMPLE = 4000
#: Lists of cells up to this many rows (about 50 bytes each) are broadcast.
SMALL = 200_000
STEP = 8
MOST_AXES = 4
MARGIN = 1e-9


def unit(raw: np.ndarray) -> np.ndarray:
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def axes_of(x: np.ndarray) -> np.ndarray:
    """Principal axes of unit vectors, of most spread first."""
    centred = x - x.mean(axis=0)
    _, v = np.linalg.eigh(centred.T @ centred)
    return np.ascontiguousarray(v[:, ::-1])


def _packed(x: np.ndarray) -> bytes:
    """Components as floats where that loses nothing, else as doubles."""
    with np.errstate(over="ignore"):
        short = x.astype(np.float32)
    return short.tobytes() if (short == x).all() else x.tobytes()


def _vectors(raws, dim: int) -> np.ndarray:
    raws = list(raws)
    out = np.empty((len(raws), dim))
    short = np.fromiter((len(r) == 4 * dim for r in raws), bool, len(raws))
    for pick, kind in ((short, np.float32), (~short, np.float64)):
        if pick.any():
            out[pick] = np.frombuffer(b"".join(itertools.compress(raws, pick)), kind).reshape(-1, dim)
    return out


def _tile(dim):
    """Vectors of a tile, from a number or a column."""
    if isinstance(dim, int):
        return max(1, min(TILE, TILE_BYTES // (8 * dim)))
    return F.greatest(F.lit(1), F.least(F.lit(TILE), F.floor(F.lit(TILE_BYTES) / (8 * dim))))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label, dim, raw (doubles) of the vectors that can link."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in parts:
            out = []
            for i, label, e in zip(df["vec_id"], df["label"], df["embedding"], strict=True):
                x = np.array([math.nan if v is None else v for v in e] if e.dtype == object else e, np.float64)
                if len(x) and np.isfinite(x).all() and x.any():
                    largest = math.frexp(np.abs(x).max())[1]
                    if abs(largest) > 400:  # squares would leave the doubles: a power of two takes nothing from the cosine
                        x = np.ldexp(x, -largest)
                    out.append((i, label, len(x), _packed(x)))
            yield pd.DataFrame(out, columns=["vec_id", "label", "dim", "raw"]).astype({"vec_id": "int64", "label": "string", "dim": "int32"})

    named = vectors.where("vec_id is not null and label is not null and embedding is not null")
    return named.select("vec_id", F.col("label").cast("string").alias("label"), "embedding").mapInPandas(run, "vec_id long, label string, dim int, raw binary")


def _moves(g: int) -> list[tuple]:
    """Cells that a vector goes to, its own first: each pair of neighbours once."""
    return [m for m in itertools.product((-1, 0, 1), repeat=g) if m >= (0,) * g]


def _visits(y: np.ndarray, width: float) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(which vectors, cell of each, whether it is their own) of the places ``y`` on the grid's axes."""
    home = np.floor(y / width).astype(np.int64)
    for move in _moves(y.shape[1]):
        cell = home + np.array(move, np.int64)
        gap = np.maximum(np.maximum(cell * width - y, y - (cell + 1) * width), 0)
        near = np.ones(len(y), bool) if not any(move) else (gap**2).sum(axis=1) <= width**2
        yield near, cell[near], not any(move)


def _cost(y: np.ndarray, width: float, scale: float, tile: int) -> float:
    """What a grid over the axes of ``y`` costs, a sample of one label, each row of it standing for ``scale`` vectors."""
    homes: dict[tuple, float] = {}
    guests: dict[tuple, float] = {}
    for _, cells, own in _visits(y, width):
        for c in map(tuple, cells.tolist()):
            to = homes if own else guests
            to[c] = to.get(c, 0) + scale
    copies = pairs = 0.0
    for c, n in homes.items():
        m = guests.get(c, 0)
        lt, rt = math.ceil(n / tile), math.ceil(m / tile)
        copies += n * (lt + rt) + m * lt
        pairs += n * (n / 2 + m)
    return copies * COPY_COST + pairs


def _grid(sample: list, totals: dict[int, int], width: float) -> dict[int, tuple[np.ndarray, int]]:
    """Per vector length: axes, and over how many of them the grid runs, by what it costs the sample's labels."""
    out = {}
    for dim in {r["dim"] for r in sample}:
        rows = [r for r in sample if r["dim"] == dim]
        x = unit(_vectors([r["raw"] for r in rows], dim))
        v = axes_of(x)
        y = x @ v[:, :MOST_AXES]
        scale = totals.get(dim, len(rows)) / len(rows)
        _, of = np.unique([r["label"] for r in rows], return_inverse=True)
        parts = [y[of == k] for k in range(of.max() + 1)]
        costs = [sum(_cost(part[:, :g], width, scale, _tile(dim)) for part in parts) for g in range(y.shape[1] + 1)]
        out[dim] = (v, int(np.argmin(costs)))
    return out


def _on_grid(raw: list, dim: int, fitted: dict) -> np.ndarray:
    v, g = fitted.get(dim, (None, 0))
    return unit(_vectors(raw, dim)) @ v[:, :g] if g else np.zeros((len(raw), 0))


def _names(cells: np.ndarray) -> list[str]:
    return [",".join(map(str, c)) for c in cells.tolist()]


def _sizes(fitted: dict, width: float):
    """Rows (label, dim, cell, n0, n1): how many vectors, of a batch, a cell is the own cell of, and how many come to it in all."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in parts:
            for dim, rows in df.groupby("dim"):
                for near, cells, own in _visits(_on_grid(rows["raw"].tolist(), dim, fitted), width):
                    if near.any():
                        part = rows.loc[near, ["label", "dim"]].assign(cell=_names(cells), n0=int(own), n1=1)
                        yield part.groupby(["label", "dim", "cell"], as_index=False).sum()

    return run


def _place(fitted: dict, width: float):
    """Rows (cell, side, ...): each vector in its own cell (side 0) and in the neighbours it may have links in (side 1)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in parts:
            for dim, rows in df.groupby("dim"):
                base = rows[["id", "copies", "label", "dim", "raw"]]
                for near, cells, own in _visits(_on_grid(rows["raw"].tolist(), dim, fitted), width):
                    if near.any():
                        yield base[near].assign(cell=_names(cells), side=0 if own else 1)

    return run


def _reaching(x: np.ndarray, y: np.ndarray, xr: np.ndarray, yr: np.ndarray, least: float, same: bool) -> Iterator[tuple]:
    """(i, j, products) of the pairs that the leading dimensions leave, a strip of rows at a time."""
    step = max(1, STRIP // max(1, len(y)))
    for at in range(0, len(x), step):
        total = x[at : at + step] @ y.T
        i, j = np.nonzero(total + xr[at : at + step, None] * yr[None, :] >= least)
        if same:
            later = i + at < j
            i, j = i[later], j[later]
        yield i + at, j, total[i, j]


def _join(root: np.ndarray, p: np.ndarray, q: np.ndarray) -> None:
    """Let the trees of p and q, each node above its least, be one tree, for all pairs; roots point to themselves."""
    while True:
        a, b = root[p], root[q]
        apart = a != b
        if not apart.any():
            return
        p, q, a, b = p[apart], q[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def _links(fitted: dict, least: float):
    def run(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        dim = int(df["dim"].iloc[0])
        left, right = df[df["part"] <= 1], df[df["part"] >= 1]  # 0 left, 1 both, 2 right
        if not len(left) or not len(right):
            return pd.DataFrame({"id": [], "links": [], "root": []}).astype("int64")
        same = bool((df["part"] == 1).any())
        a, b = _vectors(left["raw"], dim), _vectors(right["raw"], dim)
        an, bn = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
        v = fitted[dim][0] if dim in fitted else np.eye(dim)
        x, y = a / an[:, None] @ v, b / bn[:, None] @ v
        # norms of what is left of each vector after k dimensions
        suffix = lambda z: {k: np.sqrt(np.maximum((z[:, k:] ** 2).sum(axis=1), 0)) for k in [*range(STEP, dim, STEP), dim]}
        xr, yr = suffix(x), suffix(y)
        la, ra = left["id"].to_numpy(), right["id"].to_numpy()
        lc, rc = left["copies"].to_numpy(), right["copies"].to_numpy()
        ids, where = np.unique(np.concatenate([la, ra]), return_inverse=True)
        lw, rw = where[: len(la)], where[len(la) :]
        links = np.zeros(len(ids), np.int64)
        # least id of each group of linked vectors here
        root = np.arange(len(ids))
        first = min(STEP, dim)
        for i, j, total in _reaching(x[:, :first], y[:, :first], xr[first], yr[first], least - MARGIN, same):
            k = first
            while k < dim and len(i):
                to = min(k + STEP, dim)
                total = total + np.einsum("nd,nd->n", x[i, k:to], y[j, k:to])
                live = total + xr[to][i] * yr[to][j] >= least - MARGIN
                i, j, total = i[live], j[live], total[live]
                k = to
            sure = np.empty(len(i), bool)
            for at in range(0, len(i), PAIRS):
                p, q = i[at : at + PAIRS], j[at : at + PAIRS]
                sure[at : at + PAIRS] = np.einsum("nd,nd->n", a[p], b[q]) / (an[p] * bn[q]) >= least
            i, j = i[sure], j[sure]
            p, q = lw[i], rw[j]
            np.add.at(links, p, rc[j])
            np.add.at(links, q, lc[i])
            _join(root, p, q)
        hit = links > 0
        return pd.DataFrame({"id": ids[hit], "links": links[hit], "root": ids[root[hit]]}).astype("int64")

    return run


def near_vectors(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept: a row per row of ``vectors`` (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    good = settle(usable(vectors).withColumn("key", F.sha1("raw")), "vectors")
    classes = good.groupBy("label", "dim", "key").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("raw").alias("raw"))
    classes = settle(classes, "vector-classes")
    width = math.sqrt(max(0.0, 2 - 2 * least)) + 1e-6
    totals = {r["dim"]: r["n"] for r in classes.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n")).limit(SAMPLE).collect()}
    fitted = _grid(classes.select("dim", "label", "raw").orderBy(F.xxhash64("id")).limit(SAMPLE).collect(), totals, width)
    group = ["label", "dim", "cell"]
    sizes = classes.select("label", "dim", "raw").mapInPandas(_sizes(fitted, width), "label string, dim int, cell string, n0 long, n1 long")
    sizes = settle(sizes.groupBy(*group).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where("n0 > 0 and n1 > 1").withColumn("n", F.col("n1")), "vector-cells")
    placed = classes.select("id", "copies", "label", "dim", "raw").mapInPandas(_place(fitted, width), "id long, copies long, label string, dim int, raw binary, cell string, side int")
    dealt = placed.join(F.broadcast(sizes.drop("n")), group) if sizes.count() <= SMALL else join_dealt(placed, sizes, group, "n")
    size = _tile(F.col("dim"))
    lt, rt = F.ceil(F.col("n0") / size).cast("int"), F.ceil((F.col("n1") - F.col("n0")) / size).cast("int")
    mine = F.pmod(F.xxhash64("id", F.lit(3)), F.when(F.col("side") == 0, lt).otherwise(rt)).cast("int")
    dealt = dealt.withColumn("mine", mine).withColumn("lt", lt).withColumn("rt", rt)
    tile = lambda i, j, part: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), part.cast("int").alias("part"))
    m = F.col("mine")
    # home vectors meet home vectors (tiles i <= j) and the visitors (tiles numbered from lt on)
    at_home = F.transform(F.sequence(F.lit(0), F.col("lt") - 1), lambda o: tile(F.least(m, o), F.greatest(m, o), F.when(m == o, 1).when(m < o, 0).otherwise(2)))
    to_guests = F.transform(F.when(F.col("rt") > 0, F.sequence(F.lit(0), F.col("rt") - 1)).otherwise(F.array().cast("array<int>")), lambda o: tile(m, F.col("lt") + o, F.lit(0)))
    guest = F.transform(F.sequence(F.lit(0), F.col("lt") - 1), lambda o: tile(o, F.col("lt") + m, F.lit(2)))
    spread = dealt.withColumn("t", F.explode(F.when(F.col("side") == 0, F.concat(at_home, to_guests)).otherwise(guest)))
    found = spread.select(*group, "id", "copies", "raw", F.col("t.i").alias("i"), F.col("t.j").alias("j"), F.col("t.part").alias("part"))
    found = settle(found.groupBy(*group, "i", "j").applyInPandas(_links(fitted, least), "id long, links long, root long"), "vector-links")
    part = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")), spark)
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    of_class = classes.select("label", "dim", "key", "id", "copies").join(links, "id", "left").join(part, "id", "left")
    of_class = of_class.select("label", "dim", "key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    # a common vector's class is looked up from 16 salts
    salt = lambda c: F.pmod(F.xxhash64(c, F.lit(5)), F.lit(16)).cast("int")
    salted = of_class.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    told = good.select("vec_id", "label", "dim", "key", salt("vec_id").alias("salt")).join(salted, ["label", "dim", "key", "salt"]).select("vec_id", "n_links", "component_id")
    rest = vectors.select("vec_id").exceptAll(good.select("vec_id")).select("vec_id", F.lit(0).cast("long"), "vec_id")
    return told.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op3_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


#: DuckDB: all pairs of a label in double precision, reachability by recursion.
ORACLE_SQL = {
    "op3_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), ok AS (
  SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS n FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM ok AS a JOIN ok AS b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.98
), r(id, root) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT l.y, r.root FROM r JOIN l ON l.x = r.id
), c AS (SELECT id, min(root) AS component_id FROM r GROUP BY id),
n AS (SELECT x, count(*) AS n_links FROM l GROUP BY x)
SELECT v.vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON c.id = v.vec_id LEFT JOIN n ON n.x = v.vec_id
"""
}
