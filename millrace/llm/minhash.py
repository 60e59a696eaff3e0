"""MinHash near-dedup by fast similarity sketching, banding and exact checks.

Sketch: in round i every shingle hash falls into one bin of t with a value in
[i, i + 1); in rounds t to 2t - 1 all fall into bin i - t. A bin keeps its least
value, and rounds end when every bin is filled, which the second half
guarantees. Coordinates agree with probability J, concentrated as for t
independent hashes, at the cost of about one pass for sets larger than t.

Banding: t coordinates in bands of ``ROWS``; documents that share a band meet.
Documents with equal sets become one class first, so exact copies cost one row.
Members of a bucket are tied to its smallest id (a star), and the components of
these ties are clusters outside of which no documents meet. Clusters are cut
into tiles; a task holds two tiles of a cluster and confirms links on the full
shingle sets, pairs of most agreeing sketches first. Pairs that are connected
already are passed over, so a group of n copies costs about n confirmations, and
a task emits the links of a forest, never all pairs. Pairs whose sketches agree
too little are left out (``SLACK`` standard deviations below the threshold, 1e-8
of true links). No bucket, candidate or partner is capped.

Defined results: a null or blank text has an empty set and is linked with
nothing; a text with fewer words than a shingle is one shingle as a whole;
rows of one doc_id share a component; a null doc_id is linked with nothing,
has a null component and is kept; an empty table gives an empty result.
Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, give_back, join_dealt, settle, table

BINS = 128
ROWS = 4
SLACK = 5.7
TILE = 512
TILE_BYTES = 4 << 20
#: Lists of ids up to this many rows (8 bytes each) are broadcast, longer ones are joined by shuffle.
SMALL = 500_000
U = np.uint64


class WordHashes(dict):
    """Stable 64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 100_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def shingle_set(text: str | None, k: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles, A-Z lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and white space alone
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(known.__getitem__, words), np.uint64, n)
    m = min(k, n)
    h = np.full(n - m + 1, m, np.uint64)
    for j in range(m):
        h = _mix(h + ids[j : n - m + 1 + j]) * U(0x9E3779B97F4A7C15)
    return np.unique(h)


_ROUNDS = [np.array([i], np.uint64) for i in range(2 * BINS)]
_SEEDS = _mix(np.arange(1, 2 * BINS + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The BINS coordinates of a non-empty set."""
    out = np.zeros(BINS, np.uint64)
    empty = np.ones(BINS, bool)
    for i in range(2 * BINS):
        v = _mix(hashes ^ _SEEDS[i])
        if i < BINS:
            b = (v >> U(57)).astype(np.int64)
            order = np.argsort(v)
            bins, first = np.unique(b[order], return_index=True)
            new = empty[bins]
            # equal values of different rounds are different coordinates
            out[bins[new]] = _mix(v[order[first[new]]] + _ROUNDS[i])
            empty[bins] = False
        elif empty[i - BINS]:
            out[i - BINS] = _mix(v.min() + _ROUNDS[i])[0]
            empty[i - BINS] = False
        if not empty.any():
            break
    return out


def _sketches(k: int, rows: int):
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for texts in parts:
            got = []
            for t in texts:
                s = shingle_set(t, k, known)
                if not len(s):
                    got.append((0, None, None, None))
                    continue
                c = sketch(s)
                bands = c.reshape(-1, rows)
                h = np.arange(1, len(bands) + 1, dtype=np.uint64)
                for j in range(rows):
                    h = _mix(h + bands[:, j]) * U(0x9E3779B97F4A7C15)
                got.append((len(s), xxhash.xxh3_128_hexdigest(s.tobytes()), h.view(np.int64), (c & U(255)).astype(np.uint8).tobytes()))
            yield pd.DataFrame(got, columns=["n_shingles", "set_key", "bands", "marks"])
        known.clear()
        give_back()

    kind = T.StructType(
        [T.StructField("n_shingles", T.LongType()), T.StructField("set_key", T.StringType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("marks", T.BinaryType())]
    )
    return F.pandas_udf(run, kind)


def _set_bytes(k: int):
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = WordHashes()
        for texts in parts:
            yield pd.Series([shingle_set(t, k, known).tobytes() for t in texts])
        known.clear()
        give_back()

    return run


def least_agreement(percent: int) -> int:
    j = percent / 100
    return math.floor(BINS * j - SLACK * math.sqrt(BINS * j * (1 - j)))


def link_forest(marks: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links (i, j) that connect all of left x right that links connect, found from the most agreeing pairs on."""
    least = least_agreement(percent)
    agree = np.empty((len(left), len(right)), np.int16)
    other = marks[right]
    for k, i in enumerate(left):
        agree[k] = (other == marks[i]).sum(axis=1)
    p, q = np.nonzero(agree >= least)
    order = np.argsort(-agree[p, q], kind="stable")
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i, j in zip(left[p[order]].tolist(), right[q[order]].tolist(), strict=True):
        a, b = find(i), find(j)
        if a == b:
            continue
        x, y = sets[i], sets[j]
        n = len(x) + len(y)
        if (100 + percent) * min(len(x), len(y)) < percent * n:  # even if one held the other
            continue
        at = np.searchsorted(x, y)
        at[at == len(x)] = 0
        common = int((x[at] == y).sum())
        if 100 * common >= percent * (n - common):
            root[max(a, b)] = min(a, b)
            out.append((i, j))
    return out


def _links(tiles: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of each pair of tiles."""

    def run(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        marks = np.frombuffer(b"".join(df["marks"]), np.uint8).reshape(-1, BINS)
        sets = [np.frombuffer(x, np.uint64) for x in df["set"]]
        side = df["side"].to_numpy()  # 0 left, 1 both, 2 right
        found = link_forest(marks, sets, np.flatnonzero(side <= 1), np.flatnonzero(side >= 1), percent)
        ids = df["id"].to_numpy()
        return pd.DataFrame([(ids[i], ids[j]) for i, j in found], columns=["a", "b"]).astype("int64")

    return tiles.groupBy("cluster", "i", "j").applyInPandas(run, "a long, b long")


def near_groups(docs: DataFrame, k: int = 5, percent: int = 80, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, a row per row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    made = settle(docs.select("doc_id", _sketches(k, rows)("text").alias("s")).select("doc_id", "s.*"), "minhash")
    live = made.where("doc_id is not null and n_shingles > 0")
    classes = settle(live.groupBy("set_key").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies")), "minhash-classes")
    shared = classes.where("copies > 1")
    # a class's sketch is that of its smallest document; met by both keys, so that copies of one text are spread
    least = classes.select("set_key", F.col("id").alias("doc_id"))
    first = live.join(least, ["set_key", "doc_id"], "left_semi").dropDuplicates(["set_key", "doc_id"])
    reps = settle(first.select(F.col("doc_id").alias("id"), "bands", "marks"), "minhash-reps")

    bands = reps.select("id", F.explode("bands").alias("band"))
    met = bands.groupBy("band").agg(F.min("id").alias("centre"), F.count("*").alias("n")).where("n > 1")
    stars = bands.join(met, "band").where("id != centre").select(F.col("centre").alias("a"), F.col("id").alias("b"))
    below = components(stars, spark)
    roots = below.select(F.col("component").alias("id"), "component").distinct()
    cluster = settle(below.union(roots).select("id", F.col("component").alias("cluster")), "minhash-clusters")

    build = F.pandas_udf(_set_bytes(k), T.BinaryType())
    ids = cluster.select(F.col("id").alias("doc_id"))
    few = cluster.count() <= SMALL
    own = docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    sets = own.select(F.col("doc_id").alias("id"), build("text").alias("set")).where(F.octet_length("set") > 0)
    sets = settle(sets.withColumn("bytes", F.octet_length("set")), "minhash-sets")
    held = cluster.join(reps.select("id", "marks"), "id").join(sets, "id")
    load = F.ceil(F.greatest(F.count("*") / TILE, F.sum("bytes") / TILE_BYTES)).cast("int")
    tiles = settle(cluster.join(sets.select("id", "bytes"), "id").groupBy("cluster").agg(load.alias("tiles"), F.count("*").alias("members")), "minhash-tiles")
    own_tile = F.pmod(F.xxhash64("id", F.lit(9)), F.col("tiles")).cast("int")
    spread = join_dealt(held, tiles, ["cluster"], "members").withColumn("tile", own_tile).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    t, o = F.col("tile"), F.col("other")
    pairs = spread.select("cluster", "id", "marks", "set", F.least(t, o).alias("i"), F.greatest(t, o).alias("j"), F.when(t == o, 1).when(t < o, 0).otherwise(2).alias("side"))
    part = components(settle(_links(pairs, percent), "minhash-links"), spark)

    # from class representatives back to all documents
    groups = settle(shared.join(part, "id", "left").select("set_key", F.coalesce("component", "id").alias("of_class"), "copies"), "minhash-groups")
    out = join_dealt(made.select("doc_id", "n_shingles", "set_key"), groups, ["set_key"], "copies", "left").join(part.toDF("doc_id", "of_doc"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("of_class", "of_doc", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """near_groups with ``kept``: one document of each group, the one of smallest id."""
    return near_groups(docs, k, percent).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, all columns; rows that repeat a doc_id stay together."""
    gone = near_groups(docs, k, percent).where("doc_id != component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")


def op10_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), 3, 85)


#: DuckDB: shingle sets in full, all pairs that share a shingle, reachability by recursion.
ORACLE_SQL = {
    "op10_minhash": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [w] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i:i+2]) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), l AS (
  SELECT x, y FROM p JOIN n AS a ON a.doc_id = x JOIN n AS b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)
), e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(id, root) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.id
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, r.component_id, d.doc_id = r.component_id AS kept
FROM documents AS d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT id, min(root) AS component_id FROM r GROUP BY id) AS r ON r.id = d.doc_id
"""
}
