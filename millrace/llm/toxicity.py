"""Toxicity by maximum-scoring segments.

Training (bounded): token counts of at most ``max_docs`` labelled documents of
each class give every token a log-odds score under an informative Dirichlet
prior (the pooled counts, scaled). A token is a word or a stem, the first 4 to
7 letters of a word; a word scores as the longest of its tokens that has a
score. Counts are of documents, near copies once (26 of 32 least hashes of three
words agree). Tokens whose counts differ between the classes by more than the
number of tokens tried explains keep their log-odds, toxic or clean; their number
is bounded by the sample, no other bound cuts it. All other words share one
score, the log-odds of being such a word, from the word counts of both classes;
it is just below zero, so that a random text scores below zero on average.

Scoring: one linear pass over the token scores of a whole text finds every
maximal scoring segment (Ruzzo and Tompa), i.e. all passages that no extension
or cut improves. Segment scores become E-values, K n exp(-lambda S), with
lambda from the scores of all words of the clean training documents and K from
an extreme-value (Gumbel) fit of their best segments. The evidence of the
significant segments is summed per document and mapped to a probability by a
logistic fit on the training documents, weighted so that each class counts as
often as it does among all labels, however many of it were sampled.

The model is a closure of the scored tokens and five numbers. Scoring shuffles nothing and reads nothing but the text.

Defined results: a null or empty text has no segment and gets the score of no
evidence; repeated rows give a row each; documents without a label are scored
alike; an empty label table, or one with a single class, gives score 0 for
all; null labels or ids are not trained on; of rows that share a doc_id the
least text trains; a row without a doc_id is not held out. Extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, settle, spread, table

#: A token is a run of letters, lower-cased.
TOKEN = re.compile(r"[^\W\d_]+")
#: The least that a word without a score of its own costs.
DRIFT = 0.002
HASHES, AGREE, BAND = 32, 26, 4
PRIOR = 20.0
STEMS = (4, 5, 6, 7)


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    lam: float = 1.0
    log_k: float = 0.0
    drift: float = DRIFT
    slope: float = 0.0
    bias: float = -50.0


def words_of(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


def tokens(text: str | None) -> list[str]:
    """Distinct words and stems; a stem ends with a dash."""
    words = set(words_of(text))
    return sorted(words | {f"{w[:k]}-" for w in words for k in STEMS if len(w) >= k})


def word_score(word: str, weights: dict[str, float]) -> float | None:
    """The score of the longest scored token of a word: the word itself, then its stems."""
    x = weights.get(word)
    for k in reversed(STEMS):
        if x is not None:
            break
        x = weights.get(f"{word[:k]}-") if len(word) >= k else None
    return x


class Scores(dict):
    """Scores of the words seen so far, a cache of bounded size."""

    def __init__(self, weights: dict[str, float], most: int = 200_000):
        super().__init__()
        self.weights, self.most = weights, most

    def __missing__(self, word: str) -> float | None:
        if len(self) >= self.most:
            self.clear()
        x = self[word] = word_score(word, self.weights)
        return x


def maximal_segments(at: np.ndarray, score: np.ndarray, drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal scoring segments as (first token, last token, score).

    ``at`` has the positions of the scored tokens, in order, ``score`` their
    scores; every token between them costs ``drift``. Each segment begins and
    ends at a scored token, hence the pass is linear in the scored tokens.
    """
    stack: list[list] = []  # [first, last, sum before, sum through]
    total, last = 0.0, -1
    for p, s in zip(at.tolist(), score.tolist(), strict=True):
        total -= drift * (p - last - 1)
        last = p
        if s <= 0:
            total += s
            continue
        new = [p, p, total, total + s]
        total += s
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= new[2]:
                j -= 1
            if j < 0 or stack[j][3] >= new[3]:
                # segments to the right of j keep their place
                stack.append(new)
                break
            new = [stack[j][0], new[1], stack[j][2], new[3]]
            del stack[j:]
    return [(a, b, hi - lo) for a, b, lo, hi in stack]


def segments(text: str | None, model: Model, scores: Scores | None = None) -> tuple[int, list[tuple[int, int, float]]]:
    words = words_of(text)
    got = list(map((Scores(model.weights) if scores is None else scores).__getitem__, words))
    at = np.array([i for i, x in enumerate(got) if x is not None], np.int64)
    return len(words), maximal_segments(at, np.array([got[i] for i in at], np.float64), model.drift)


def evidence(n: int, found: list[tuple[int, int, float]], model: Model) -> float:
    """Summed excess of the segments over what chance gives in n tokens, in nats."""
    if not found or n == 0:
        return 0.0
    chance = model.log_k + math.log(n)
    return sum(max(0.0, model.lam * s - chance) for _, _, s in found)


def toxic_passages(text: str | None, model: Model) -> list[tuple[int, int, float, float]]:
    """The significant segments of a text: first and last token, score, E-value (below 1)."""
    n, found = segments(text, model)
    e = [(a, b, s, math.exp(min(50.0, model.log_k + math.log(max(n, 1)) - model.lam * s))) for a, b, s in found]
    return [x for x in e if x[3] < 1]


def log_odds(t: Column, c: Column, nt: int, nc: int, prior: float = PRIOR) -> tuple[Column, Column]:
    """(log-odds, log-likelihood gain over equal rates) of a token in t of nt toxic and c of nc clean documents."""
    rate = (t + c) / F.lit(nt + nc)
    a = F.lit(prior) * rate

    def odds(k: Column, n: int) -> Column:
        return F.log((k + a) / (F.lit(n + prior) - k - a))

    def gain(k: Column, n: int) -> Column:
        own = F.when(k > 0, k * F.log(k / F.lit(n) / rate)).otherwise(0.0)
        rest = F.when((k < n) & (rate < 1), (F.lit(n) - k) * F.log((1 - k / F.lit(n)) / (1 - rate))).otherwise(0.0)
        return own + rest

    return odds(t, nt) - odds(c, nc), gain(t, nt) + gain(c, nc)


def signature(words: list[str]) -> np.ndarray:
    """HASHES least hashes of the three-word shingles of a document with words."""
    own = [zlib.crc32(" ".join(words[k : k + 3]).encode("utf-8", "surrogatepass")) for k in range(max(1, len(words) - 2))]
    h = np.unique(np.array(own, np.uint64))
    out = np.empty(HASHES, np.int64)
    for k in range(HASHES):
        x = (h + np.uint64(k << 32)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
        out[k] = int((x >> np.uint64(1)).min())
    return out


def copy_groups(marks: dict[int, np.ndarray]) -> dict[int, int]:
    """doc_id -> least doc_id of its near copies; documents that share a band are compared with the band's least."""
    group = {d: d for d in marks}

    def root(d: int) -> int:
        while group[d] != d:
            group[d] = group[group[d]]
            d = group[d]
        return d

    for k in range(0, HASHES, BAND):
        first: dict[bytes, int] = {}
        for d in sorted(marks):
            e = first.setdefault(marks[d][k : k + BAND].tobytes(), d)
            if e != d and (marks[d] == marks[e]).sum() >= AGREE:
                x, y = sorted((root(d), root(e)))
                group[y] = x
    return {d: root(d) for d in marks}


def _solve_lambda(steps: np.ndarray, share: np.ndarray) -> float:
    lo, hi = 1e-6, 20.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if float((share * np.exp(np.minimum(mid * steps, 700))).sum()) > 1 else (mid, hi)
    return (lo + hi) / 2


def calibrate(model: Model, dealt: list[tuple[int, float | None, int]]) -> None:
    """drift and lambda from (class, score, words with it), None for words without a score."""
    every, plain = Counter(), Counter()
    for y, x, n in dealt:
        every[y] += n
        plain[y] += n if x is None else 0
    if plain[1] and plain[0]:
        model.drift = max(DRIFT, math.log(plain[0] / every[0]) - math.log(plain[1] / every[1]))
    clean = [(-model.drift if x is None else x, n) for y, x, n in dealt if y == 0]
    top = max(model.weights.values())
    # half a word with the highest score, so that there is one
    steps = np.array([*(x for x, _ in clean), top])
    share = np.array([*(n for _, n in clean), 0.5])
    model.lam = _solve_lambda(steps, share / share.sum())


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Slope and bias by Newton steps with a weak ridge; each row counts ``weight`` times."""
    xs = np.stack([x, np.ones_like(x)], axis=1)
    w, ridge = np.zeros(2), np.diag([1e-2, 1e-4])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(xs @ w, -30, 30)))
        step = np.linalg.solve((xs * (weight * p * (1 - p))[:, None]).T @ xs + ridge, xs.T @ (weight * (y - p)) - ridge @ w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def train(docs: DataFrame, labels: DataFrame, max_docs: int = 4000) -> Model:
    """Fit on at most ``max_docs`` labelled documents of each class, the ones of least id hash.

    ``labels`` has doc_id and toxic. The bound makes what is collected, the
    sample's signatures, its stand-out tokens and one row of figures a document,
    independent of the corpus size.
    """
    marked = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = [
        r
        for y in (0, 1)
        for r in marked.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs).collect()
    ]
    ids = {r["doc_id"]: int(r["toxic"]) for r in picked}
    if len(set(ids.values())) < 2:
        return Model()
    spark = docs.sparkSession
    chosen = spark.createDataFrame([(k, v) for k, v in ids.items()], "doc_id long, toxic int")
    # settled, else the filters below are pushed under the join and all texts are split; a row a document, at most 2 * max_docs
    own = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = settle(own.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "toxic-sample")

    def mark(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in parts:
            words = [words_of(t) for t in df["text"]]
            yield pd.DataFrame({"doc_id": df["doc_id"], "marks": [signature(w).tobytes() if w else None for w in words]})

    marks = rows.mapInPandas(mark, "doc_id long, marks binary").collect()
    group = copy_groups({r["doc_id"]: np.frombuffer(r["marks"], np.int64) for r in marks if r["marks"] is not None})
    size = Counter(y for y, _ in {(ids[d], g) for d, g in group.items()})
    nt, nc = size[1], size[0]
    if not nt or not nc:
        return Model()

    def split(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in parts:
            for d, y, text in zip(df["doc_id"], df["toxic"], df["text"], strict=True):
                ws = tokens(text)
                if ws:
                    yield pd.DataFrame({"toxic": y, "copy": group[d], "w": ws})

    once = rows.mapInPandas(split, "toxic int, copy long, w string").distinct()
    counted = settle(once.groupBy("w").agg(F.count_if(F.col("toxic") == 1).alias("t"), F.count_if(F.col("toxic") == 0).alias("c")), "toxic-counts")
    score, gain = log_odds(F.col("t"), F.col("c"), nt, nc)
    least = math.log(max(counted.count(), 2))  # of the tokens tried
    listed = counted.select("w", score.alias("score"), gain.alias("gain")).where((F.col("gain") > least) & (F.abs("score") > math.log(2))).collect()
    model = Model(weights={r["w"]: r["score"] for r in listed})
    if not any(x > 0 for x in model.weights.values()):
        return Model()

    def spread_of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scores = Scores(model.weights)
        for df in parts:
            seen: Counter = Counter()
            for y, text in zip(df["toxic"], df["text"], strict=True):
                seen.update((y, scores[w]) for w in words_of(text))
            yield pd.DataFrame([(y, x, n) for (y, x), n in seen.items()], columns=["toxic", "score", "n"])

    # a row for each class and score: bounded by the scored tokens; null: words without a score
    dealt = rows.mapInPandas(spread_of, "toxic int, score double, n long").groupBy("toxic", "score").agg(F.sum("n").alias("n")).collect()
    calibrate(model, [(r["toxic"], r["score"], r["n"]) for r in dealt])

    def best(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scores = Scores(model.weights)
        for df in parts:
            got = [segments(t, model, scores) for t in df["text"]]
            yield pd.DataFrame({"toxic": df["toxic"], "n": [n for n, _ in got], "scores": [[s for _, _, s in f] for _, f in got]})

    seen = rows.mapInPandas(best, "toxic int, n long, scores array<double>").collect()  # a row a sampled document
    # Gumbel: the best segment of n clean tokens has mean (log K n + gamma) / lambda
    peaks = [(r["n"], max(r["scores"], default=0.0)) for r in seen if r["toxic"] == 0 and r["n"]]
    model.log_k = max(-12.0, min(4.0, float(np.mean([model.lam * s - math.log(n) for n, s in peaks])) - 0.5772)) if peaks else 0.0
    x = np.array([evidence(r["n"], [(0, 0, s) for s in r["scores"]], model) for r in seen])
    y = np.array([r["toxic"] for r in seen], np.float64)
    # the two classes count as often as they do among all labels; the rows' weights sum to their number
    labelled = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    sampled = Counter(ids.values())
    weight = np.where(y == 1, labelled[1] / sampled[1], labelled[0] / sampled[0])
    model.slope, model.bias = _logistic(np.log1p(x), y, weight / weight.mean())
    return model


def toxicity(text: Column, model: Model) -> Column:
    """Probability (0 to 1) that a text is toxic."""

    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scores = Scores(model.weights)
        for texts in parts:
            x = np.array([evidence(*segments(t, model, scores), model) for t in texts], np.float64)
            yield pd.Series(1 / (1 + np.exp(-np.clip(model.slope * np.log1p(x) + model.bias, -60, 60))))
        give_back()

    return F.pandas_udf(score, T.DoubleType())(text)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.where(~held_out()))
    scored = spread(docs.select("doc_id", "text")).select("doc_id", held_out().alias("held_out"), toxicity(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
