import random
from collections import Counter

import numpy as np

from millrace.llm import minhash as mh


def sets_of(rows, k):
    out = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        out.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    return out


def brute(rows, k, percent):
    sets = sets_of(rows, k)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            same_id = rows[i][0] == rows[j][0]
            if rows[i][0] is not None and rows[j][0] is not None and a and b and (same_id or 100 * len(a & b) >= percent * len(a | b)):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted((str(d), len(sets[i]), None if d is None else low[find(i)]) for i, (d, _) in enumerate(rows))


def test_against_brute_force(docs, monkeypatch):
    monkeypatch.setattr(mh, "TILE", 5)
    rng = random.Random(3)
    rows = []
    for base in range(12):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(3, 120))]
        for _ in range(rng.randrange(1, 14)):
            v = list(words)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                v[rng.randrange(len(v))] = f"W{rng.randrange(500)}"
            rows.append((len(rows), rng.choice([" ", "\n"]).join(v)))
    rows += [(900, None), (901, " \t"), (902, "One two"), (903, "one TWO"), (904, "one"), (None, rows[0][1]), (None, rows[0][1]), (3, rows[3][1])]
    rng.shuffle(rows)
    for k, percent in ((3, 85), (5, 80)):
        got = sorted((str(r[0]), r[1], r[2]) for r in mh.near_groups(docs(rows), k, percent).collect())
        assert got == brute(rows, k, percent)


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    for j in (0.3, 0.6, 0.85):
        hits = []
        for _ in range(60):
            n = 300
            common = rng.integers(0, 2**63, int(n * j)).astype(np.uint64)
            x, y = (np.unique(np.concatenate([common, rng.integers(0, 2**63, (n - len(common)) // 2).astype(np.uint64)])) for _ in range(2))
            hits.append((mh.sketch(x) == mh.sketch(y)).mean())
        assert abs(np.mean(hits) - j) < 0.03
    for n in (1, 2, 5):  # every coordinate fills, whatever the set
        s = mh.sketch(rng.integers(0, 2**63, n).astype(np.uint64))
        assert (s != 0).all() and len(Counter(s.tolist())) > 100


def test_one_stays(docs, odd, none):
    text = " ".join(f"w{k}" for k in range(50))
    rows = [(5, text), (3, text + " x"), (9, text.upper()), (7, "something else entirely here now")]
    assert sorted(r["doc_id"] for r in mh.drop_near_duplicates(docs(rows)).collect()) == [3, 7]
    got = mh.near_duplicates(odd, 3, 85)
    assert got.count() == odd.count() and got.where("doc_id is null and not kept").count() == 0
    assert mh.near_groups(none).count() == 0 and mh.drop_near_duplicates(odd).columns == odd.columns
