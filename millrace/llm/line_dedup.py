"""Line dedup by a segment-partition edit join, in DataFrame functions only.

Lines are what ``\\n`` splits. A line goes if an earlier line (by doc_id, then
place in the text) equals it or, where both have ``least`` characters or more,
is within ``edits`` edits of it (insertions, deletions or substitutions of a
character). Any threshold and any floor, 0 included, can be asked of the
operator; the query asks for one edit and 24 characters, as its SQL says.

Equal lines become classes first, keyed by 128 bits of hash, with partial
aggregation, so a very common line is one row. The edit join works on the
classes, in a run for each distance from one to ``edits``. A line is cut into
segments, more than the distance, and the edits fall into some of them: an index
entry is the line's length, how many edits which segments hold (such a segment
is open), and all the others' characters. Probes look up their own length and
the lengths up to the distance less, where what follows an open segment
stands as many places on or back as its edits can move it. Entries are hashes.
What an entry leaves open is cut again, round after round, for the lines that
meet, until it is single characters and gaps between them, one for each edit,
and only lines that still meet go on: many variants of one line that differ in a
word or a number meet in a part of the line, but in the end only those that differ
at no more places than there are edits. An entry also ends when all its lines
agree in an open part: they are nearer to each other than its distance, and an
earlier run has them. As lines that meet in the end are all within the distance,
each is paired with the earliest of them alone. The pairs are confirmed on
their texts by Hyyro's banded bit-parallel edit distance, written as a fold over
the characters.

Rows a line in the first table of a run: 8 at distance 1, 52 at 2, 208 at 3.

Defined results: a null text has no lines; white-space lines are never removed
or compared; an empty text stays empty; rows with a null doc_id are left as
they are and compared with nothing; rows of one doc_id count as one document
(equal places keep each other); an empty table gives an empty result; columns
other than doc_id and text pass through ``dedup`` unchanged, and its own column
names begin with two underscores.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_dealt, settle, table

#: Of the query and the pipeline: edits, and the characters under which a line goes only if equal.
EDITS = 1
LEAST = 24
#: Segments of a line in its first entries, at least.
SEGMENTS = 4
#: Parts that a round cuts an open part into: at distance 1, and beyond, where two parts or more can stay open.
PARTS, FEWER = 8, 4
#: Lists of ids up to this many rows (16 bytes each) are broadcast, longer ones are joined by shuffle.
SMALL = 500_000


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, pos, line: the lines with something in them, of documents with an id."""
    every = docs.where("doc_id is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return every.where(_filled("line"))


def _filled(text) -> Column:
    """Whether there is more than white space in a text; reads as far as the first such character."""
    return F.ltrim(text, F.lit(" \n\t\x0b\x0c\r")) != ""


def _keys(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("k1"), F.xxhash64(F.lit(7), line).alias("k2")]


def _shared_out(edits: int, pieces: int) -> Iterator[list[tuple[int, int]]]:
    """All ways to deal ``edits`` edits out to pieces in a row, as lists of (piece, edits of it)."""
    for k in range(1, min(edits, pieces) + 1):
        for at in combinations(range(pieces), k):
            for cuts in combinations(range(1, edits), k - 1):
                ends = (0, *cuts, edits)
                yield [(piece, ends[i + 1] - ends[i]) for i, piece in enumerate(at)]


def _segments(edits: int) -> int:
    return max(SEGMENTS, edits + 1)


def _states(edits: int) -> list[tuple[int, bool, list[tuple[int, int, int]]]]:
    """The first entries of a line: (number, probe, open segments), a segment as (which, edits, by how much a probe's is longer).

    Entries that may meet have the same number. Probes are no shorter than
    the line they look up. One that nothing moves is the index entry itself,
    but for segments of more edits, in which later cuts can move it.
    """
    out = []
    for number, held in enumerate(_shared_out(edits, _segments(edits))):
        out.append((number, False, [(k, e, 0) for k, e in held]))
        for moved in product(*[range(-e, e + 1) for _, e in held]):
            if 0 <= sum(moved) <= edits and (any(moved) or any(e > 1 for _, e in held)):
                out.append((number, True, [(k, e, d) for (k, e), d in zip(held, moved, strict=True)]))
    return out


def _can_hold(size: Column, e: Column, d: Column) -> Column:
    """Whether a part of ``size`` characters and one that is ``d`` longer can be ``e`` edits apart, no fewer."""
    return (size > 0) & (size + d >= 0) & (F.greatest(size, size + d) >= e)


def _entries(line: Column) -> list[Column]:
    """A line's entries at distance 1 in the order of ``_states``, written out for all lines as they are read; ``_met`` folds those of more edits."""
    n = F.char_length(line)
    out = []
    for number, _, [(k, _, d)] in _states(1):
        m = n - d
        low, high = (F.floor(m * x / SEGMENTS).cast("int") for x in (k, k + 1))
        entry = F.xxhash64(m, F.lit(number), F.substring(line, F.lit(1), low), F.lit("|"), F.substring(line, high + d + 1, m - high))
        out.append(F.when(high > low, entry))
    return out


def within_edits(a: Column, b: Column, most: int) -> Column:
    """Whether two strings are within ``most`` edits: banded bit-parallel edit distance.

    A word of 2 * most + 1 bits holds the cells of a column next to the
    diagonal; each character of b moves it one column on.
    """
    width = 2 * most + 1
    mask = (1 << width) - 1
    top = 1 << (width - 1)
    x, y = F.split(a, ""), F.split(b, "")
    n, m = F.char_length(a), F.char_length(b)
    full = lambda c: c.bitwiseAND(F.lit(mask))
    no = lambda c: c.bitwiseXOR(F.lit(mask))
    bit = lambda c, k: F.when(c, F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long"))

    def let(value: Column, body) -> Column:
        return F.transform(F.array(value), body)[0]

    def move(s: Column, j: Column) -> Column:
        def met(k: int) -> Column:
            i = j - most + k
            return bit((i >= 0) & (i < n) & F.coalesce(F.get(x, i) == F.get(y, j), F.lit(False)), k)

        pm = met(0)
        for k in range(1, width):
            pm = pm.bitwiseOR(met(k))
        vp, vn, dist = s["vp"], s["vn"], s["dist"]

        def with_d0(d0: Column) -> Column:
            hp, hn = vn.bitwiseOR(no(d0.bitwiseOR(vp))), d0.bitwiseAND(vp)
            down = F.shiftright(d0, 1)
            # the traced cell goes down the band's lower edge, then along the last row
            past = j + most - n + 1
            at = F.when(past <= 0, F.lit(0)).otherwise(past)
            seen = lambda w: F.shiftright(w, (F.lit(width - 1) - at).cast("int")).bitwiseAND(F.lit(1))
            on_edge = dist + F.when(d0.bitwiseAND(F.lit(top)) == 0, 1).otherwise(0)
            on_row = dist
            for k in range(1, width):
                on_row = F.when(past == k, dist + F.shiftright(hp, width - 1 - k).bitwiseAND(F.lit(1)) - F.shiftright(hn, width - 1 - k).bitwiseAND(F.lit(1))).otherwise(on_row)
            return F.struct(
                full(hn.bitwiseOR(no(down.bitwiseOR(hp)))).alias("vp"),
                down.bitwiseAND(hp).alias("vn"),
                F.when(past <= 0, on_edge).otherwise(on_row).cast("long").alias("dist"),
            )

        return let(pm, lambda p: let(full((p.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(p).bitwiseOR(vn)), with_d0))

    start = F.struct(
        F.lit(mask ^ ((1 << most) - 1)).cast("long").alias("vp"),
        F.lit(0).cast("long").alias("vn"),
        F.lit(most).cast("long").alias("dist"),
    )
    steps = F.when(m > 0, F.sequence(F.lit(0), m - 1)).otherwise(F.array().cast("array<int>"))
    near = F.aggregate(steps, start, move, lambda s: s["dist"]) <= most
    # a string no longer than the threshold has no lower edge to trace
    short = F.least(n, m) <= most
    return F.when(F.abs(n - m) > most, F.lit(False)).when(short, F.levenshtein(a, b) <= most).otherwise(near)


def _several(rows: DataFrame, parts: int = 0) -> DataFrame:
    """entry, n: the entries that two or more lines have, and rows of each; combined before the shuffle.

    With ``parts``, only if in each open part (at most so many) two lines or more differ.
    """
    ends = [f(k).alias(f"{name}{k}") for k in ("k1", "k2") for name, f in (("lo", F.min), ("hi", F.max))]
    ends += [f(F.get("held", F.lit(k))).alias(f"{name}{k}") for k in range(parts) for name, f in (("least", F.min), ("most", F.max))]
    found = rows.groupBy("entry").agg(F.count("*").alias("n"), *ends).where("lok1 != hik1 or lok2 != hik2")
    for k in range(parts):
        found = found.where(f"least{k} is null or least{k} != most{k}")
    return found.select("entry", "n")


def _part(low: Column, high: Column, e: Column, d: Column, done: Column) -> Column:
    """An open part: its places at the entry's length, its edits, by how much a probe's is longer, whether it is cut no more."""
    return F.struct(low.cast("int").alias("low"), high.cast("int").alias("high"), e.cast("int").alias("e"), d.cast("int").alias("d"), done.alias("done"))


def _moved(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0), lambda total, p: total + p["d"])


def _closed(line: Column, parts: Column, low: Column, high: Column, moved: Column, seed: Column) -> Column:
    """Hash of the characters from low to high (places at the entry's length) outside open parts."""
    run = lambda a, until: F.xxhash64(a["h"], F.substring(line, a["at"] + a["moved"] + 1, until - a["at"]))
    start = F.struct(low.cast("int").alias("at"), moved.cast("int").alias("moved"), seed.cast("long").alias("h"))
    step = lambda a, p: F.struct(p["high"].alias("at"), (a["moved"] + p["d"]).alias("moved"), run(a, p["low"]).alias("h"))
    return F.aggregate(parts, start, step, lambda a: run(a, high))


def _held(line: Column, parts: Column) -> Column:
    """Hashes of what a line has in its open parts."""
    before = lambda k: _moved(F.slice(parts, F.lit(1), k))
    return F.transform(parts, lambda p, k: F.xxhash64(F.substring(line, p["low"] + before(k) + 1, p["high"] - p["low"] + p["d"])))


def _with_open(rows: DataFrame, edits: int) -> DataFrame:
    """``rows`` (n characters, state) with number and probe of the state, the length m of the entry and its open parts."""
    states, count = _states(edits), _segments(edits)
    segments = lambda held: F.array(*[F.struct(F.lit(k).alias("k"), F.lit(e).alias("e"), F.lit(d).alias("d")) for k, e, d in held])
    every = F.array(*[F.struct(F.lit(number).alias("number"), F.lit(probe).alias("probe"), F.lit(sum(d for *_, d in held)).alias("moved"), segments(held).alias("held")) for number, probe, held in states])
    own = rows.withColumn("of", F.element_at(every, F.col("state") + 1)).withColumns({"number": F.col("of.number"), "probe": F.col("of.probe"), "m": F.col("n") - F.col("of.moved")})
    bound = lambda k: F.floor(F.col("m") * k / count)
    return own.withColumn("open", F.transform("of.held", lambda s: _part(bound(s["k"]), bound(s["k"] + 1), s["e"], s["d"], F.lit(False))))


def _met(classes: DataFrame, edits: int, least: int) -> DataFrame:
    """k1, k2, entry, state (its number in ``_states``) of the lines that meet others in an entry."""
    long = classes.where(F.col("n_chars") >= least)
    if "line" not in classes.columns:
        each = F.array(*[F.struct(F.col(f"e{k}").alias("entry"), F.lit(k).alias("state")) for k in range(len(_states(1)))])
        rows = long.select("k1", "k2", F.explode(each).alias("e")).select("k1", "k2", "e.entry", "e.state").where("entry is not null")
    else:
        each = long.select("k1", "k2", "line", F.col("n_chars").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(len(_states(edits)) - 1))).alias("state"))
        each = _with_open(each, edits)
        able = lambda p: (p["high"] > p["low"]) & (~F.col("probe") | _can_hold(p["high"] - p["low"], p["e"], p["d"]))
        entry = _closed(F.col("line"), F.col("open"), F.lit(0), F.col("m"), F.lit(0), F.xxhash64("m", "number"))
        rows = each.where((F.col("m") > 0) & F.forall("open", able)).select("k1", "k2", entry.alias("entry"), "state")
    several = settle(_several(rows), f"lines-entries{edits}")
    # most rows meet none: they stay where they are
    met = rows.join(F.broadcast(several.drop("n")), "entry") if several.count() <= SMALL else join_dealt(rows, several, ["entry"], "n")
    return settle(met.select(rows.columns), f"lines-met{edits}")


ROW = ["k1", "k2", "entry", "probe", "open"]


def _still_meet(rows: DataFrame, edits: int, name: str) -> DataFrame:
    """``rows`` (ROW and line) whose entries other lines have too, ones that differ in every open part."""
    if edits > 1:
        rows = rows.withColumn("held", _held(F.col("line"), F.col("open")))
    # few rows by now; the adaptive join splits an entry that very many of them share
    return settle(rows.join(_several(rows, edits if edits > 1 else 0), "entry").select(ROW), name)


def _open_part(met: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """ROW: the met lines with the parts that their entries leave open."""
    n = F.char_length("line").alias("n")
    if edits == 1:
        return settle(_with_open(met.join(texts.select("k1", "k2", n), ["k1", "k2"]), edits).select(ROW), "lines-open")
    return _still_meet(_with_open(met.join(texts.select("k1", "k2", "line", n), ["k1", "k2"]), edits), edits, f"lines-open{edits}")


def _cuts(spark: SparkSession, edits: int, parts: int) -> DataFrame:
    """last, e, probe, d, number, pieces: the ways on from an open part with e edits, a probe's d longer.

    It is cut into ``parts`` pieces, of which those with edits stay open, or, in
    the last cut, into gaps and characters by turns (2 * parts + 1): a gap
    takes insertions, a character is put in place of another or deleted.
    """
    rows, number = [], 0
    for last in (False, True):
        for e in range(1, edits + 1):
            for held in _shared_out(e, 2 * parts + 1 if last else parts):
                if last and any(k % 2 and x > 1 for k, x in held):
                    continue
                number += 1
                ways = [([0] if k % 2 else [x]) + [-1] * (k % 2) if last else list(range(-x, x + 1)) for k, x in held]
                for probe, moves in ((False, [[0] * len(held)]), (True, product(*ways))):
                    for moved in moves:
                        pieces = ", ".join(f"named_struct('k', {k}, 'e', {x}, 'd', {d})" for (k, x), d in zip(held, moved, strict=True))
                        rows.append(f"({last}, {e}, {probe}, {sum(moved)}, {number}, array({pieces}))")
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(last, e, probe, d, number, pieces)")


def _refined(rows: DataFrame, texts: DataFrame, cuts: DataFrame, edits: int, parts: int) -> DataFrame:
    """Each row as one for every way to cut its longest open part; those that still meet."""
    sizes = F.transform("open", lambda p: F.when(p["done"], -1).otherwise(p["high"] - p["low"]))
    chosen = rows.withColumn("at", F.array_position(sizes, F.array_max(sizes)).cast("int")).withColumn("x", F.element_at("open", F.col("at")))
    size = F.col("x.high") - F.col("x.low")
    chosen = chosen.withColumns({"e": F.col("x.e"), "d": F.col("x.d"), "last": size <= parts})
    each = chosen.join(texts.select("k1", "k2", "line"), ["k1", "k2"]).join(F.broadcast(cuts), ["last", "e", "d", "probe"])
    cut = lambda k: F.col("x.low") + F.floor(size * k / parts)
    place = lambda k: F.col("x.low") + F.floor(k / 2)
    low, high = (lambda k: F.when(F.col("last"), place(k)).otherwise(cut(k))), (lambda k: F.when(F.col("last"), place(k + 1)).otherwise(cut(k + 1)))
    each = each.withColumn("new", F.transform("pieces", lambda s: _part(low(s["k"]), high(s["k"]), s["e"], s["d"], F.col("last"))))
    able = lambda p: (p["high"] > p["low"]) & (~F.col("probe") | _can_hold(p["high"] - p["low"], p["e"], p["d"]))
    each = each.where(F.when(F.col("last"), F.forall("pieces", lambda s: s["k"] <= 2 * size)).otherwise(F.forall("new", able)))
    before = F.slice("open", F.lit(1), F.col("at") - 1)
    entry = _closed(F.col("line"), F.col("new"), F.col("x.low"), F.col("x.high"), _moved(before), F.xxhash64("entry", "number"))
    after = F.slice("open", F.col("at") + 1, F.size("open"))
    parted = each.select("k1", "k2", entry.alias("entry"), "probe", F.concat(before, F.col("new"), after).alias("open"), "line")
    return _still_meet(parted, edits, f"lines-refined{edits}")


def _narrowed(rows: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """Rows refined until their entries leave only single characters and gaps open: as many rounds as the open parts have powers of the parts."""
    parts = PARTS if edits == 1 else FEWER
    cuts = _cuts(rows.sparkSession, edits, parts)
    ended = F.forall("open", lambda p: p["done"])
    done = rows.where(ended)
    while not rows.where(~ended).isEmpty():
        rows = _refined(rows.where(~ended), texts, cuts, edits, parts)
        done = done.unionByName(rows.where(ended))
    # 64 more bits of all that an entry fixes, as its lines are not compared with one another
    line = F.col("line")
    m = F.char_length(line) - _moved(F.col("open"))
    check = _closed(line, F.col("open"), F.lit(0), m, F.lit(0), F.lit(11))
    return settle(done.join(texts, ["k1", "k2"]).select("k1", "k2", "entry", check.alias("check"), "probe", "first"), f"lines-ended{edits}")


def _near_pairs(rows: DataFrame) -> DataFrame:
    """Pairs of class keys, (ak1, ak2) the earlier: each line with the earliest that it meets, among the indexed and, if it is indexed, the probes."""
    who = F.struct("first", "k1", "k2")
    least = rows.groupBy("entry", "check").agg(F.min(F.when(~F.col("probe"), who)).alias("indexed"), F.min(F.when(F.col("probe"), who)).alias("probing"))
    other = F.explode(F.array("indexed", F.when(~F.col("probe"), F.col("probing"))))
    pairs = rows.join(least, ["entry", "check"]).select("first", F.col("k1").alias("bk1"), F.col("k2").alias("bk2"), other.alias("a")).where("a.first < first")
    return settle(pairs.select(F.col("a.k1").alias("ak1"), F.col("a.k2").alias("ak2"), "bk1", "bk2").distinct(), "lines-pairs")


def _late(met: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """k1, k2 of classes that begin after one at this distance, or nearer."""
    pairs = _near_pairs(_narrowed(_open_part(met, texts, edits), texts, edits))
    one = lambda s: texts.select(*[F.col(c).alias(f"{s}{c}") for c in ("k1", "k2", "line")])
    sides = pairs.join(one("a"), ["ak1", "ak2"]).join(one("b"), ["bk1", "bk2"])
    return sides.where(within_edits(F.col("aline"), F.col("bline"), edits)).select(F.col("bk1").alias("k1"), F.col("bk2").alias("k2"))


def _texts(docs: DataFrame, classes: DataFrame, met: DataFrame) -> DataFrame:
    """k1, k2, first, line of the lines that meet, from their first places."""
    places = settle(classes.join(met.select("k1", "k2").distinct(), ["k1", "k2"]).select("k1", "k2", "first", F.col("first.doc_id").alias("doc_id"), F.col("first.pos").alias("pos")), "lines-places")
    sought = places.groupBy("doc_id").agg(F.collect_set("pos").alias("at"))
    n = places.count()
    own = docs.where("doc_id is not null").select("doc_id", "text").join(F.broadcast(sought) if n <= SMALL else sought, "doc_id")
    split = own.select("doc_id", F.split("text", "\n").alias("all"), "at").select("doc_id", F.explode(F.transform("at", lambda p: F.struct(p.alias("pos"), F.get("all", p).alias("line")))).alias("x")).select("doc_id", "x.*").withColumns({"k1": _keys(F.col("line"))[0], "k2": _keys(F.col("line"))[1]})
    # rows of one doc_id may have different lines at a place
    split = split.dropDuplicates(["doc_id", "pos", "k1", "k2"])
    return settle(places.join(split, ["doc_id", "pos", "k1", "k2"]).select("k1", "k2", "first", "line"), "lines-texts")


def removed_lines(docs: DataFrame, edits: int = EDITS, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lines, removed): doc_id, pos, n_chars of all lines; doc_id, pos, near of those to remove."""
    if edits < 0:
        raise ValueError("edits can't be negative")
    # entries of one edit are smaller than most lines; those of more are not, and are made of the classes' lines
    carried = {f"e{k}": e for k, e in enumerate(_entries(F.col("line")))} if edits == 1 else {"line": F.col("line")} if edits else {}
    keyed = lines(docs).select("doc_id", "pos", *_keys(F.col("line")), F.char_length("line").alias("n_chars"), *[e.alias(c) for c, e in carried.items()])
    every = settle(keyed.select("doc_id", "pos", "k1", "k2", "n_chars"), "lines")
    classes = settle(
        keyed.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.count("*").alias("n"), F.first("n_chars").alias("n_chars"), *[F.first(c).alias(c) for c in carried]),
        "lines-classes",
    )
    late = classes.select("k1", "k2").where("false")
    for distance in range(1, edits + 1):
        met = _met(classes, distance, least)
        texts = _texts(docs, classes, met) if edits == 1 else settle(classes.join(met.select("k1", "k2").distinct(), ["k1", "k2"]).select("k1", "k2", "first", "line"), f"lines-texts{distance}")
        late = late.unionByName(_late(met, texts, distance))
    late = late.distinct().withColumn("late", F.lit(True))
    told = settle(classes.select("k1", "k2", "first", "n").join(late, ["k1", "k2"], "left").where("n > 1 or late"), "lines-told")
    gone = join_dealt(every, told, ["k1", "k2"], "n").withColumn("again", F.struct("doc_id", "pos") != F.col("first")).where("again or late")
    return every, settle(gone.select("doc_id", "pos", "n_chars", (~F.col("again")).alias("near")), "lines-gone")


def dedup(docs: DataFrame, edits: int = EDITS, least: int = LEAST) -> DataFrame:
    """``docs`` with the removed lines taken out of ``text``; all rows and other columns stay."""
    _, gone = removed_lines(docs, edits, least)
    at = gone.groupBy("doc_id").agg(F.collect_set("pos").alias("__gone")).withColumnRenamed("doc_id", "__id")
    joined = docs.join(at, docs["doc_id"] == F.col("__id"), "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("__gone", i)), "\n")
    return joined.withColumn("text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(kept)).drop("__gone", "__id")


def dedup_documents(docs: DataFrame, edits: int = EDITS, least: int = LEAST) -> DataFrame:
    """``dedup``, with n_chars of the new text, without the documents of which no line with something in it is left."""
    filled = _filled(F.coalesce("text", F.lit("")))
    marked = docs.withColumn("__had", filled)
    out = dedup(marked, edits, least).withColumn("__has", filled).where(~F.col("__had") | F.col("__has"))
    return out.drop("__had", "__has").withColumn("n_chars", F.char_length("text").cast("long"))


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Per document: its lines, the equal and the near ones removed, and the characters of lines kept."""
    docs = table(spark, sf_dir, "documents")
    every, gone = removed_lines(docs)
    marked = every.select("doc_id", F.lit(0).alias("again"), F.lit(0).alias("near"), F.lit(1).alias("line"), F.col("n_chars").alias("chars")).union(
        gone.select("doc_id", (~F.col("near")).cast("int"), F.col("near").cast("int"), F.lit(0), -F.col("n_chars"))
    ).union(docs.select("doc_id", F.lit(0), F.lit(0), F.lit(0), F.lit(0)))
    return marked.groupBy("doc_id").agg(
        F.sum("line").alias("n_lines"), F.sum("again").alias("n_equal_removed"), F.sum("near").alias("n_near_removed"), F.sum("chars").alias("kept_chars")
    )


#: DuckDB: earlier lines that are equal, or for long lines within one edit; candidates agree on one half of the line.
ORACLE_SQL = {
    "op6_line_dedup": """
WITH l AS (
  SELECT doc_id, generate_subscripts(x, 1) AS pos, unnest(x) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE doc_id IS NOT NULL)
), w AS (
  SELECT doc_id, pos, line, length(line) AS n FROM l
  WHERE trim(translate(line, chr(9) || chr(11) || chr(12) || chr(13), '    ')) <> ''
), c AS (
  SELECT line, n, min((doc_id, pos)) AS first, row_number() OVER (ORDER BY min((doc_id, pos))) AS seq FROM w GROUP BY line, n
), s AS (
  SELECT seq, line, n, unnest([left(line, n // 2), right(line, n // 2 - 1)]) AS part, unnest([0, 1]) AS side FROM c WHERE n >= 24
), t AS (
  SELECT seq, line, n, m, unnest([left(line, m // 2), right(line, m // 2 - 1)]) AS part, unnest([0, 1]) AS side
  FROM (SELECT seq, line, n, unnest([n - 1, n, n + 1]) AS m FROM c WHERE n >= 24)
), near AS (
  SELECT DISTINCT b.line FROM s AS a JOIN t AS b ON a.n = b.m AND a.side = b.side AND a.part = b.part AND a.seq < b.seq
  WHERE levenshtein(a.line, b.line) <= 1
), d AS (
  SELECT w.doc_id, w.n, (w.doc_id, w.pos) <> c.first AS again, near.line IS NOT NULL AS late
  FROM w JOIN c ON w.line = c.line LEFT JOIN near ON near.line = w.line
)
SELECT e.doc_id, count(d.n) AS n_lines,
       CAST(coalesce(sum(CASE WHEN again THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_equal_removed,
       CAST(coalesce(sum(CASE WHEN late AND NOT again THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_near_removed,
       CAST(coalesce(sum(CASE WHEN again OR late THEN 0 ELSE d.n END), 0) AS BIGINT) AS kept_chars
FROM (SELECT DISTINCT doc_id FROM documents) AS e LEFT JOIN d ON d.doc_id = e.doc_id
GROUP BY e.doc_id
"""
}
