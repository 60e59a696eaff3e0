import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import toxicity as tx


def brute_segments(at, score, drift):
    """Maximal segments by their definition: recursively the best segment, then both sides."""
    n = (at[-1] + 1) if len(at) else 0
    x = [-drift] * n
    for p, s in zip(at, score):
        x[p] = s

    def best(lo, hi):
        found = None
        for i in range(lo, hi):
            total = 0.0
            for j in range(i, hi):
                total += x[j]
                if total > 1e-12 and (found is None or total > found[2] + 1e-9):
                    found = (i, j, total)
        if found is None:
            return []
        return best(lo, found[0]) + [found] + best(found[1] + 1, hi)

    return best(0, n)


def test_maximal_segments():
    rng = random.Random(3)
    for _ in range(200):
        at = sorted(rng.sample(range(30), rng.randrange(0, 10)))
        score = [rng.choice([1.5, 2.25, 0.7, -1.1, 3.3]) + rng.random() / 10 for _ in at]
        got = tx.maximal_segments(np.array(at, np.int64), np.array(score), 0.4)
        want = brute_segments(at, score, 0.4)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([s for *_, s in got], [s for *_, s in want])


def corpus(docs, spark, n=300):
    rng = random.Random(5)
    plain = ["".join(p) for p in itertools.product("bcd", "aei", "lmn", "ou")]
    rows, labels = [], []
    for k in range(n):
        toxic = k % 6 == 0
        words = [rng.choice(plain) for _ in range(rng.randrange(20, 200))]
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["grumbag", "Snotrel,", "vexoid" + rng.choice(["a", "en", "ish"])]))
        rows.append((k, " ".join(words)))
        labels.append((k, 1, int(toxic)))
    return docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out(docs, spark):
    d, labels = corpus(docs, spark)
    model = tx.train(d, labels.where(~tx.held_out()))
    assert "grumbag" in model.weights and any(w.startswith("vexo") for w in model.weights)
    scored = d.select("doc_id", tx.held_out().alias("h"), tx.toxicity(F.col("text"), model).alias("score")).where("h").join(labels, "doc_id")
    right = scored.where("(score >= 0.7) = (toxic = 1)").count()
    assert right >= 0.97 * scored.count() and scored.where("score < 0 or score > 1").count() == 0
    passages = tx.toxic_passages("bal " * 30 + "grumbag grumbag " + "bal " * 30, model)
    assert [(a, b) for a, b, *_ in passages] == [(30, 31)]


def test_sampled_classes_keep_their_shares(docs, spark):
    rng = random.Random(7)
    plain = ["".join(p) for p in itertools.product("bcd", "aei", "lmn", "ou")]
    rows, labels = [], []
    for k in range(900):
        toxic = k % 9 == 0
        words = [rng.choice(plain) for _ in range(60)]
        # some clean documents have a slur as well, some toxic ones none
        if rng.random() < (0.8 if toxic else 0.05):
            words.insert(rng.randrange(60), "grumbag")
        rows.append((k, " ".join(words)))
        labels.append((k, 1, int(toxic)))
    d, labels = docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")

    def odds(max_docs):
        model = tx.train(d, labels, max_docs=max_docs)
        n, found = tx.segments("bal " * 30 + "grumbag " + "bal " * 30, model)
        return [model.slope * np.log1p(x) + model.bias for x in (0.0, tx.evidence(n, found, model))]

    whole, even = odds(4000), odds(100)  # even: 100 documents of each class, of 800 and 100
    assert np.abs(np.subtract(whole, even)).max() < 1  # log(8) is 2.08


def test_odd(odd, none, spark):
    labels = spark.createDataFrame([(4, 1, 1), (5, 1, 0), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int")
    model = tx.train(odd, labels)
    got = odd.select(tx.toxicity(F.col("text"), model).alias("s"))
    assert got.where("s >= 0 and s <= 1").count() == odd.count()
    assert tx.train(none, labels).weights == {} and tx.train(odd, labels.where("false")).weights == {}
    assert none.select(tx.toxicity(F.col("text"), model)).count() == 0


def test_held_out_is_crc32(docs):
    rows = docs([(k, "x") for k in range(-50, 300)] + [(None, "x")])
    got = {r["doc_id"]: r["h"] for r in rows.select("doc_id", tx.held_out().alias("h")).collect()}
    assert got == {d: d is not None and zlib.crc32(str(d).encode()) % 3 == 1 for d in got}


def test_counts_and_calibration_against_brute_force(docs, spark):
    d, labels = corpus(docs, spark)
    rows = [(r["doc_id"], r["text"]) for r in d.collect()]
    rows += [(1000 + k, rows[0][1] + " bal") for k in range(4)]  # near copies of a toxic document count once
    more = spark.createDataFrame([(1000 + k, 1, 1) for k in range(4)], "doc_id long, quality int, toxic int")
    labels = labels.union(more)
    model = tx.train(docs(rows), labels)
    toxic = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    once = [(i, t) for i, t in rows if i < 1000]
    n = Counter(toxic[i] for i, _ in once)
    count = {0: Counter(), 1: Counter()}
    for i, t in once:
        count[toxic[i]].update(tx.tokens(t))
    for _, t in rows[-4:]:  # the copies' own token joins those of their group
        assert set(tx.tokens(t)) - set(tx.tokens(rows[0][1])) <= {"bal"}
    if "bal" not in tx.tokens(rows[0][1]):
        count[1]["bal"] += 1
    want = {}
    for w in count[0] | count[1]:
        k, total = (count[0][w], count[1][w]), n[0] + n[1]
        rate = sum(k) / total
        gain = 0.0
        for y in (0, 1):
            gain += k[y] * math.log(k[y] / n[y] / rate) if k[y] else 0
            gain += (n[y] - k[y]) * math.log((1 - k[y] / n[y]) / (1 - rate)) if k[y] < n[y] and rate < 1 else 0
        a = tx.PRIOR * rate
        odds = [math.log((k[y] + a) / (n[y] + tx.PRIOR - k[y] - a)) for y in (0, 1)]
        if gain > math.log(len(count[0] | count[1])) and abs(odds[1] - odds[0]) > math.log(2):
            want[w] = odds[1] - odds[0]
    assert model.weights.keys() == want.keys() and all(abs(model.weights[w] - x) < 1e-9 for w, x in want.items())

    # shares of words without a score, and lambda: scores of random clean words weigh 1 in the mean
    words = {y: [w for i, t in rows if toxic[i] == y for w in tx.words_of(t)] for y in (0, 1)}
    plain = {y: sum(tx.word_score(w, model.weights) is None for w in words[y]) / len(words[y]) for y in (0, 1)}
    assert abs(model.drift - max(tx.DRIFT, math.log(plain[0] / plain[1]))) < 1e-9
    found = [tx.word_score(w, model.weights) for w in words[0]]
    total = sum(math.exp(model.lam * (-model.drift if x is None else x)) for x in found)
    total += 0.5 * math.exp(model.lam * max(model.weights.values()))
    assert abs(total / (len(found) + 0.5) - 1) < 1e-6

    # K: the best segments of clean documents have the Gumbel mean
    peaks = []
    for i, t in rows:
        if toxic[i] == 0:
            k, segments = tx.segments(t, model)
            peaks.append(model.lam * max((s for *_, s in segments), default=0.0) - math.log(k))
    assert abs(model.log_k - max(-12, min(4, sum(peaks) / len(peaks) - 0.5772))) < 1e-9


def test_copies():
    rng = random.Random(6)
    words = [f"w{k}" for k in range(400)]
    base = rng.choices(words, k=300)
    half = base[:150] + rng.choices(words, k=150)
    other = rng.choices(words, k=300)
    marks = {1: tx.signature(other), 2: tx.signature(base), 3: tx.signature(base), 4: tx.signature(base[:-3]), 5: tx.signature(half), 6: tx.signature(["a"])}
    assert tx.copy_groups(marks) == {1: 1, 2: 2, 3: 2, 4: 2, 5: 5, 6: 6}


def test_clashing_columns(docs, spark):
    d, labels = corpus(docs, spark, 120)
    names = ["toxic", "w", "copy", "t", "c", "score", "n", "marks", "scores", "gain", "held_out"]
    odd = d.select("*", *[F.lit(1).alias(x) for x in names if x not in d.columns])
    assert tx.train(odd, labels).weights == tx.train(d, labels).weights
