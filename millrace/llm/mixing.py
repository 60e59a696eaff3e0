"""Mixing sources to target weights by a low-discrepancy schedule.

Each source is a line of words: its documents in a fixed shuffled order (by id
hash), cut into blocks of ``block`` words. The schedule is a sequence of slots;
slot i maps the golden-ratio point frac(i * phi) through the cumulative target
shares to a source, so that every stretch of the schedule holds the sources
near their shares. The rank of a slot within its source names the block it
takes, wrapping around as often as the target needs. A source's last slot is
cut to the word, and slots by which the sequence falls short of a source are
appended, so what is taken equals the target up to rounding to whole words.

Everything is joins and windows on (source, block): texts are never moved.
Positions and ranks are prefix sums in two levels (per bucket, then over the
buckets of a source), both about the square root of the rows, hence a source
with a third of all rows is no single task's work. Per-source totals come to
the driver: one row a source.

Defined results: null text has size 0 and takes 0 words; a null source is a
source of its own, last; a null doc_id is ordered by the hash of null;
repeated rows are rows of their own (each takes its share of the line); an
empty table gives an empty result; if all texts are empty, targets are 0.
Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, settle, table

#: phi = (sqrt(5) - 1) / 2
PHI = (math.sqrt(5) - 1) / 2
MOST_PASSES = 3


def _phi_high() -> float:
    """frac(2**20 * phi) to full precision: slot numbers are split there, so that products keep theirs."""
    scale = 10**40
    phi = (math.isqrt(5 * scale * scale) - scale) // 2
    return ((phi << 20) % scale) / scale


def targets(sizes: list[tuple[str | None, int]], most: int = MOST_PASSES) -> dict[str | None, float]:
    """Target words by source: weights 1, 2, 3, repeating by code point order, null last, shares of all words.

    No target exceeds ``most`` times its source's size; what is above is dealt
    again by weight among the others until none is above.
    """
    order = sorted((s for s, _ in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if any(s is None for s, _ in sizes) else [])
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    size = dict(sizes)
    left, free, out = float(sum(size.values())), list(order), {}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > most * size[s]]
        if not over:
            out |= {s: left * weight[s] / total for s in free}
            break
        for s in over:
            out[s] = float(most * size[s])
        left -= sum(out[s] for s in over)
        free = [s for s in free if s not in set(over)]
    return out


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def _prefix(df: DataFrame, line: str, bucket: str, order: list, amount: str, out: str) -> DataFrame:
    """Exclusive running sum of ``amount`` along each line, in two levels."""
    sums = df.groupBy(line, bucket).agg(F.sum(amount).alias("__sum"))
    before = sums.withColumn("__before", F.sum("__sum").over(Window.partitionBy(line).orderBy(bucket)) - F.col("__sum")).drop("__sum")
    w = Window.partitionBy(line, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("__in", F.sum(amount).over(w) - F.col(amount)).join(before, [line, bucket]).withColumn(out, F.col("__before") + F.col("__in")).drop("__before", "__in")


def schedule(spark, need: dict[int, int], share: dict[int, float]) -> DataFrame:
    """Slots as (slot, s, rank): the source index of each and its rank in the source.

    ``need`` has the number of slots of each source index, ``share`` its part
    of the schedule. Each source gets exactly its number.
    """
    n = sum(need.values())
    chunk = max(1, math.isqrt(max(n, 1)))
    edges, total = [], 0.0
    for s in sorted(need):
        total += share[s]
        edges.append(total)
    i = F.col("id")
    x = (F.shiftright(i, 20) * F.lit(_phi_high()) + i.bitwiseAND(F.lit((1 << 20) - 1)) * F.lit(PHI)) % 1.0
    bounds = F.array(*[F.lit(e) for e in edges[:-1]]) if len(edges) > 1 else F.array().cast("array<double>")
    index = F.size(F.filter(bounds, lambda b: b <= x))
    names = F.array(*[F.lit(s) for s in sorted(need)])
    slots = spark.range(n).select(i.alias("slot"), F.element_at(names, index + 1).alias("s"), F.expr(f"id div {chunk}").alias("c"), F.lit(1).cast("long").alias("one"))
    ranked = _prefix(slots, "s", "c", ["slot"], "one", "rank")
    quota = F.element_at(F.array(*[F.lit(need[s]) for s in sorted(need)]), F.array_position(names, F.col("s")).cast("int"))
    kept = ranked.where(F.col("rank") < quota).select("slot", "s", "rank")
    got = {r["s"]: r["n"] for r in slots.groupBy("s").agg(F.count("*").alias("n")).collect()}
    short = [(n + k, s, got.get(s, 0), need[s] - 1) for k, s in enumerate(sorted(need)) if got.get(s, 0) < need[s]]
    if short:
        tail = spark.createDataFrame(short, "slot long, s int, a long, b long")
        kept = kept.union(tail.select("slot", "s", F.explode(F.sequence("a", "b")).alias("rank")))
    return kept


def mix(sized: DataFrame, block: int = 512, seed: int = 1) -> DataFrame:
    """doc_id, source, size -> doc_id, source, size, source_size, target, taken.

    ``taken`` is the number of words the schedule takes of a document, repeats
    counted, never over three times its size.
    """
    spark = sized.sparkSession
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")).collect()
    if not per:
        return sized.select("doc_id", "source", "size", F.col("size").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).cast("long").alias("taken"))
    want = targets([(r["source"], r["source_size"]) for r in per])
    total = sum(want.values()) or 1.0
    need, share, lines = {}, {}, []
    for s, r in enumerate(sorted(per, key=lambda r: (r["source"] is None, r["source"] or ""))):
        size, goal = r["source_size"], want[r["source"]]
        words = min(MOST_PASSES * size, math.floor(goal + 0.5))
        blocks = -(-size // block)
        passes, rest = divmod(words, size) if size else (0, 0)
        lines.append((s, r["source"], size, goal, blocks, passes, rest))
        if words:
            need[s] = passes * blocks + -(-rest // block)
            share[s] = goal / total
    info = spark.createDataFrame(lines, "s int, source string, source_size long, target double, blocks long, passes long, rest long")
    buckets = max(1, math.isqrt(max(r["rows"] for r in per)))
    key = F.xxhash64(F.col("doc_id"), F.lit(seed))
    # one row a source: broadcast whatever the corpus size
    rows = sized.alias("d").join(F.broadcast(info).alias("i"), F.col("d.source").eqNullSafe(F.col("i.source"))).select("d.doc_id", "d.source", "d.size", "i.s", "i.source_size", "i.target", key.alias("key"))
    rows = rows.withColumn("bucket", F.pmod("key", F.lit(buckets)))
    placed = settle(_prefix(rows, "s", "bucket", ["key", "doc_id", "size"], "size", "start"), "mix-lines")
    cols = ["doc_id", "source", "size", "source_size", "target"]
    if not need:
        return placed.select(*cols, F.lit(0).cast("long").alias("taken"))
    slots = schedule(spark, need, share).join(F.broadcast(info.select("s", "blocks", "passes", "rest")), "s")
    number, turn = F.col("rank") % F.col("blocks"), F.expr("rank div blocks")
    cut = F.when(turn < F.col("passes"), F.lit(block)).otherwise(F.least(F.lit(block), F.col("rest") - number * block))
    takes = slots.select("s", number.alias("block"), cut.alias("cut")).groupBy("s", "block").agg(F.count_if(F.col("cut") == block).alias("whole"), F.max(F.when(F.col("cut") < block, F.col("cut"))).alias("part"))
    pieces = placed.where("size > 0").select(*cols, "s", "start", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))).alias("block"))
    lo = F.greatest(F.col("start") - F.col("block") * block, F.lit(0))
    hi = F.least(F.col("start") + F.col("size") - F.col("block") * block, F.lit(block))
    words = F.col("whole") * (hi - lo) + F.greatest(F.least(hi, F.coalesce("part", F.lit(0))) - lo, F.lit(0))
    taken = pieces.join(takes, ["s", "block"], "left").groupBy(*cols, "s", "start").agg(F.coalesce(F.sum(words), F.lit(0)).cast("long").alias("taken"))
    return taken.select(*cols, "taken").union(placed.where("size = 0").select(*cols, F.lit(0).cast("long").alias("taken")))


def sizes(docs: DataFrame) -> DataFrame:
    return settle(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, rounded to whole documents; all columns.

    Rows that share a doc_id are taken alike. Rows without words, which no mix
    of words takes, and rows without an id go.
    """
    of = mix(sizes(docs)).where("size > 0").groupBy("doc_id").agg((F.sum("taken") / F.sum("size")).alias("__turns"))
    turns = of.select(F.col("doc_id").alias("__id"), F.floor(F.col("__turns") + 0.5).cast("int").alias("__turns")).where("__turns > 0")
    taken = docs.join(turns, docs["doc_id"] == F.col("__id"))
    return taken.withColumn("__turn", F.explode(F.sequence(F.lit(1), F.col("__turns")))).drop("__turn", "__turns", "__id")


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(sizes(table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken")
