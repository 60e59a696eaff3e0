import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import quality_rules as qr


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    wins = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(wins)
    hit = {j for i, w in enumerate(wins) if n[w] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit)


def test_stats_against_brute_force():
    rng = random.Random(2)
    for k in range(400):
        words = [rng.choice(["a", "b", "é#", "x|", " y", "z\x1c"]) for _ in range(rng.randrange(60))]
        text = None if k == 0 else "".join(w + rng.choice([" ", "\n", "\t", "  ", "\r\n"]) for w in words)
        assert qr.text_stats(text)[:5] == brute(text)


def test_em_finds_the_junk():
    good, bad = [qr.GOOD] * len(qr.RULES), [qr.GOOD] * len(qr.RULES)
    code = lambda v: sum(x * 3**k for k, x in enumerate(v))
    counts = {code(good): 9000}
    for k in (2, 4, 6):
        v = list(bad)
        v[k] = qr.BAD
        counts[code(v)] = 300
    p = qr.fit(counts)
    assert p[code(good)] > 0.9 and all(x < 0.5 for c, x in p.items() if c != code(good))
    assert qr.fit({}) == {} and qr.fit({code(good): 5})[code(good)] > 0.5


def test_labels(spark):
    d = "/root/testdata/sf0.01"
    got = qr.op9_quality_rules(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("not base_failed")
    good, junk = got.where("quality = 1"), got.where("quality = 0")
    assert good.where("kept").count() >= 0.97 * good.count()
    assert junk.where("kept").count() <= 0.2 * junk.count()


def test_odd(odd, none):
    got = qr.score_quality(odd)
    assert got.count() == odd.count()
    want = sorted(brute(r["text"]) for r in odd.collect())
    assert sorted(tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for r in got.collect()) == want
    assert got.where("base_failed and kept").count() == 0
    assert qr.score_quality(none).count() == 0 and qr.filter_good(none).count() == 0
    kept = qr.filter_good(odd)
    assert kept.columns == odd.columns
    assert kept.count() == got.where("kept").count() and kept.where(F.col("text").isNull()).count() == 0


def test_em_against_brute_force():
    """Each step written out over every document of all 27 patterns of three rules."""
    rng = random.Random(9)
    patterns = [(a, b, c) for a in range(3) for b in range(3) for c in range(3)]
    docs = rng.choices(patterns, [9 if p == (1, 1, 1) else 1 + p.count(0) for p in patterns], k=400)
    believed = [0.05, 0.01, 0.02]
    habit, catch, share = list(believed), [qr.CATCH] * 3, qr.SHARE

    def posterior(p):
        good, bad = share, 1 - share
        for vote, a, b in zip(p, habit, catch):
            if vote == qr.BAD:
                good, bad = good * a, bad * b
            elif vote == qr.GOOD:
                good, bad = good * (1 - a), bad * (1 - b)
        return good / (good + bad)

    for _ in range(500):
        post = [posterior(p) for p in docs]
        rates = []
        for weight, prior, trust in ((post, believed, qr.TRUST[0]), ([1 - x for x in post], [qr.CATCH] * 3, qr.TRUST[1])):
            now = []
            for k in range(3):
                x = sum(w for w, p in zip(weight, docs) if p[k] == qr.BAD)
                n = sum(w for w, p in zip(weight, docs) if p[k] != qr.ABSTAIN)
                now.append((1 - trust) * (x / n) + trust * prior[k])
            rates.append(now)
        share = (1 - qr.TRUST[2]) * sum(post) / len(post) + qr.TRUST[2] * qr.SHARE
        catch = rates[1]
        habit = [min(a, b) for a, b in zip(rates[0], catch)]
    n = Counter(docs)
    model = qr.learn(np.array(list(n)), np.array(list(n.values()), float), np.array(believed))
    assert np.allclose(model.posterior(np.array(patterns)), [posterior(p) for p in patterns], atol=1e-6)


def test_column_gives_the_posterior(spark):
    rng = random.Random(3)
    counts = {sum(rng.choices((0, 1, 2), (1, 8, 1))[0] * 3**k for k in range(len(qr.RULES))): rng.randrange(1, 90) for _ in range(200)}
    model, want = qr.learn_rules(counts), qr.fit(counts)
    rows = spark.createDataFrame([(c,) for c in counts], "pattern long").select("pattern", qr._posterior(F.col("pattern"), model).alias("p"))
    assert all(abs(r["p"] - want[r["pattern"]]) < 1e-9 for r in rows.collect())


def test_verdict_is_the_models(spark):
    """Neither all must pass nor the majority: lone votes of lax rules are forgiven, few votes of strict ones are not."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    stats = qr.score_quality(docs).where("not base_failed").toPandas()
    v = qr.votes(stats)
    bad, good = (v == qr.BAD).sum(1), (v == qr.GOOD).sum(1)
    kept = stats["kept"].to_numpy()
    assert (kept & (bad > 0)).sum() >= 20  # all must pass would reject them
    assert (~kept & (good > bad)).sum() >= 20  # a majority would keep them
    model = qr.learn_rules(Counter(qr.pattern_code(qr.votes(qr.score_quality(docs).toPandas())).tolist()))
    assert np.array_equal(kept, model.posterior(v) >= 0.5)
