import random

import pytest
from pyspark.sql import functions as F

from millrace.llm import line_dedup as ld


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def edited(rng, s, n):
    b = list(s)
    for _ in range(n):
        i, kind = rng.randrange(len(b) + 1), rng.random()
        if kind < 0.34:
            b.insert(i, rng.choice("abz😀"))
        elif b and kind < 0.67:
            b.pop(min(i, len(b) - 1))
        elif b:
            b[min(i, len(b) - 1)] = rng.choice("abz")
    return "".join(b)


def test_within_edits(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(1500):
        a = "".join(rng.choice("abé😀") for _ in range(rng.randrange(14)))
        rows.append((a, edited(rng, a, rng.randrange(5))))
    df = spark.createDataFrame(rows, "a string, b string")
    for most in (1, 2, 3):
        for r in df.select("a", "b", ld.within_edits(F.col("a"), F.col("b"), most).alias("g")).collect():
            assert r["g"] == (distance(r["a"], r["b"]) <= most), (r, most)


def brute(rows):
    """doc_id -> kept lines, by comparing every line with all before it."""
    lines = sorted((d, p, x) for d, t in rows if d is not None and t is not None for p, x in enumerate(t.split("\n")) if x.strip(" \t\n\r\x0b\x0c"))
    gone = set()
    for k, (d, p, x) in enumerate(lines):
        for d2, p2, y in lines[:k]:
            if (d2, p2) != (d, p) and (x == y or (min(len(x), len(y)) >= ld.LEAST and abs(len(x) - len(y)) <= 1 and distance(x, y) <= 1)):
                gone.add((d, p))
                break
    return {d: "\n".join(x for p, x in enumerate(t.split("\n")) if (d, p) not in gone) for d, t in rows if d is not None and t is not None}


def test_against_brute_force(docs):
    rng = random.Random(9)
    base = ["".join(rng.choice("abcdef ") for _ in range(rng.randrange(20, 50))) for _ in range(25)]
    rows = []
    for k in range(60):
        lines = [edited(rng, rng.choice(base), rng.choice([0, 0, 1, 1, 2, 3])) for _ in range(rng.randrange(1, 6))]
        rows.append((k, rng.choice(["\n", "\n\n", "\n \n"]).join(lines)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (None, base[0])]
    got = ld.dedup(docs(rows))
    assert got.count() == len(rows)
    want = brute(rows)
    for r in got.where("doc_id is not null").collect():
        assert (r["text"] or "") == want.get(r["doc_id"], "")
    assert got.where("doc_id is null").first()["text"] == base[0]


def test_odd(odd, none):
    got = ld.dedup(odd)
    assert got.columns == odd.columns and got.count() == odd.count()
    assert got.where("doc_id = 6").select("text").distinct().count() == 1  # rows of one id keep each other
    assert got.where("doc_id = 7").first()["text"] == ""
    assert ld.dedup(none).count() == 0
    assert ld.dedup_documents(odd).where("doc_id = 7").count() == 0
    assert ld.dedup_documents(odd).where("doc_id in (1, 2, 3)").count() == 3


def test_counters_in_a_long_line_are_not_paired_up(docs, monkeypatch):
    rng = random.Random(5)
    head, tail = ("".join(rng.choice("abcdef ") for _ in range(n)) for n in (310, 320))
    numbers = [f"{rng.randrange(10**10):010d}" for _ in range(120)]
    near = [n[:4] + str((int(n[4]) + 1) % 10) + n[5:] for n in numbers[:5]]
    rows = [(k, head + n + tail) for k, n in enumerate([*numbers, *near])]
    seen = []
    plain = ld._near_pairs
    monkeypatch.setattr(ld, "_near_pairs", lambda r: seen.append(plain(r)) or seen[-1])
    got = {r["doc_id"]: r["text"] for r in ld.dedup(docs(rows)).collect()}
    assert [k for k, t in got.items() if not t] == list(range(120, 125))
    assert seen[0].count() == 5  # of 7,750 pairs


def test_rows_of_one_id_with_other_lines(docs):
    a, b = "a line of thirty characters xx", "another line of characters yyy"
    rows = [(1, a), (1, b), (2, a[:-1] + "z"), (3, b[:-1] + "z")]
    got = ld.dedup(docs(rows)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == [(1, a), (1, b), (2, ""), (3, "")]


def test_join_dealt(spark):
    from millrace.llm import common

    rows = spark.range(20_000).selectExpr("id", "if(id % 3 = 0, 0, id) as k")
    few = rows.where("k != 5").groupBy("k").count()
    for how, n in (("inner", 19_999), ("left", 20_000)):
        got = common.join_dealt(rows, few, ["k"], "count", how)
        assert got.count() == n and got.columns == ["k", "id"]
    assert few.where(f"count * {common.HOT} > 19999").count() == 1


def kept(rows, edits, least):
    """doc_id -> kept lines, by comparing every line with all before it, for any threshold and floor."""
    lines = sorted((d, p, x) for d, t in rows for p, x in enumerate(t.split("\n")) if x.strip(" \t\n\r\x0b\x0c"))
    near = {}

    def meet(x, y):
        if (x, y) not in near:
            near[x, y] = x == y or (min(len(x), len(y)) >= least and abs(len(x) - len(y)) <= edits and distance(x, y) <= edits)
        return near[x, y]

    gone = {(d, p) for k, (d, p, x) in enumerate(lines) if any(meet(x, y) for *_, y in lines[:k])}
    return {d: "\n".join(x for p, x in enumerate(t.split("\n")) if (d, p) not in gone) for d, t in rows}


@pytest.mark.parametrize(("edits", "least"), [(0, 0), (1, 0), (2, 0), (2, 24), (3, 8)])
def test_any_threshold_against_brute_force(docs, edits, least):
    rng = random.Random(edits * 100 + least)
    base = ["".join(rng.choice("abcdef ") for _ in range(rng.choice([1, 2, 3, 5, 8, 12, 20, 30, 45, 70]))) for _ in range(40)]
    base += ["ab" * 15, "a" * 30, "-" * 26]  # edits can be put at many places
    texts = [(k, "\n".join(edited(rng, rng.choice(base), rng.choice([0, 1, 2, 2, 3, 4])) for _ in range(rng.randrange(1, 5)))) for k in range(80)]
    got = {r["doc_id"]: r["text"] for r in ld.dedup(docs(texts), edits, least).collect()}
    assert got == kept(texts, edits, least)


def test_near_lines_that_one_edit_leaves(docs):
    rng = random.Random(8)
    long = "".join(rng.choice("abcdefghij ") for _ in range(300))
    swapped = long[:120] + long[121] + long[120] + long[122:] if long[120] != long[121] else long[:119] + "?!" + long[121:]
    rows = [(1, long), (2, long[:40] + "#" + long[41:250] + "#" + long[251:]), (3, swapped), (4, long[:200] + "17" + long[202:]), (5, "Home page"), (6, "Home pages")]
    left = lambda *how: {r["doc_id"] for r in ld.dedup_documents(docs(rows), *how).collect()}
    assert left() == {1, 2, 3, 4, 5, 6}
    assert left(2) == {1, 5, 6}
    assert left(2, 0) == {1, 5}


def test_two_edits_in_a_template_are_not_paired_up(docs, monkeypatch):
    rng = random.Random(6)
    head, tail = ("".join(rng.choice("abcdef ") for _ in range(n)) for n in (150, 160))
    numbers = [f"{rng.randrange(10**10):010d}" for _ in range(80)]
    near = [str((int(n[0]) + 1) % 10) + n[1:7] + str((int(n[7]) + 1) % 10) + n[8:] for n in numbers[:5]]
    rows = [(k, head + n + tail) for k, n in enumerate([*numbers, *near])]
    seen = []
    plain = ld._near_pairs
    monkeypatch.setattr(ld, "_near_pairs", lambda r: seen.append(plain(r)) or seen[-1])
    got = {r["doc_id"]: r["text"] for r in ld.dedup(docs(rows), 2).collect()}
    assert [k for k, t in got.items() if not t] == list(range(80, 85))
    assert [s.count() for s in seen] == [0, 5]  # of 3,570 pairs


def test_classes_with_one_first_place(docs):
    a = "a line of thirty characters xx"
    got = ld.dedup(docs([(1, a), (1, a[:-1] + "y"), (2, a[:-1] + "z")])).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == [(1, a), (1, a[:-1] + "y"), (2, "")]
