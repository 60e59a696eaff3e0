"""Quality rules by weak supervision.

Each rule looks at one statistic of a text and votes good, votes bad or
abstains. Nothing is labelled: expectation-maximisation over the counts of
vote patterns estimates, per rule, how often it votes bad on good and on bad
documents, and the share of good documents. A document's verdict is the
posterior probability of "good" given its votes, instead of "every rule must
pass": a bad vote of a rule that seldom has others beside it (a short text, a
line without its full stop) weighs little, several bad votes settle it, and an
abstention says nothing.

Which class is which, and what a rule's bad votes mean where no other rule ever
speaks with it, patterns alone cannot tell. So rates have priors: ``HABIT`` is
how often each rule is believed to vote bad on good documents, ``CATCH`` on bad
ones. A prior counts as a fixed share of its class's documents (``TRUST``), so
verdicts are alike at every size. No rate is cut off and no verdict is set by
hand: data overrule priors.

The corpus is read once for the statistics. What reaches the driver is the
count of each vote pattern, at most ``3 ** len(RULES)`` numbers whatever the
corpus size. The statistics need no shuffle, and the posterior is a sum of
one weight a rule, also for patterns that were never counted.

Defined results: a null text counts as empty (no words, hence rejected); a
null doc_id is kept as null; repeated rows give a row each; an empty table
gives an empty result; other columns of the input pass through ``filter_good``
untouched, and clashing names do no harm because only ``text`` is read and the
added columns are named by the caller.
"""

from __future__ import annotations

import operator
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES, give_back, settle, spread

WINDOW = 8
SYMBOLS = "#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended", "n_upper", "n_lower", "n_bangs", "n_top", "n_echoes", "n_distinct", "n_letters", "n_mark_runs")
GOOD, BAD, ABSTAIN = 1, 0, 2
#: A mark that is neither letter, digit nor space, and its repeats.
MARKS = re.compile(r"([^\w\s])\1+")


def repeated_window_words(words: list, window: int = WINDOW) -> int:
    """Words that lie in a ``window``-word window found twice or more in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(window):
        h = h * np.uint64(0x9E3779B97F4A7C15) + (ids[k : k + n] ^ (ids[k : k + n] >> np.uint64(29)))
    if len(np.unique(h)) == n:  # equal windows have equal hashes
        return 0
    first: dict = {}
    code = np.fromiter((first.setdefault(tuple(words[i : i + window]), i) for i in range(n)), np.int64, n)
    twice = np.bincount(code, minlength=n)[code] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(twice), 1)
    np.add.at(edge, np.flatnonzero(twice) + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def text_stats(text: str | None) -> tuple:
    """The statistics named in ``STATS`` of one whole text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at ASCII white space alone
    n = len(words)
    word_chars = len(text) - sum(text.count(c) for c in SPACES)
    seen: set = set()
    dup = lines = ended = 0
    for line in text.split("\n"):
        bare = line.strip(SPACES)
        if not bare:
            continue
        lines += 1
        ended += bare[-1] in ".!?…\"'”’»)"
        if line in seen:
            dup += 1
        seen.add(line)
    small = text.lower()
    changed = sum(map(str.__ne__, text, small)) if len(text) == len(small) and small != text else 0
    cased = sum(map(str.__ne__, small, small.upper())) if len(small) == len(small.upper()) else len(small)
    often = Counter(words)
    top = max(often.values(), default=0)
    echoes = sum(map(operator.eq, words, words[1:]))
    letters = len("".join(filter(str.isalpha, text)))
    runs = sum(m.end() - m.start() - 1 for m in MARKS.finditer(text))
    return (n, word_chars, sum(text.count(c) for c in SYMBOLS), dup, repeated_window_words(words), lines, ended, changed, max(0, cased - changed), text.count("!"), top, echoes, len(often), letters, runs)


def _share(x: str, of: str, good: float, bad: float, high_is_bad: bool = True):
    """A rule on the share x / of: good on one side of ``good``, bad beyond ``bad``, else it abstains."""

    def vote(s: dict) -> np.ndarray:
        n = s[of].to_numpy(np.float64)
        share = s[x].to_numpy(np.float64) / np.maximum(n, 1)
        ok, ko = (share <= good, share >= bad) if high_is_bad else (share >= good, share <= bad)
        return np.where(n == 0, ABSTAIN, np.where(ko, BAD, np.where(ok, GOOD, ABSTAIN)))

    return vote


def _length(s: dict) -> np.ndarray:
    n = s["n_words"].to_numpy()
    return np.where(n < 40, BAD, np.where(n >= 60, GOOD, ABSTAIN))


def _word_length(s: dict) -> np.ndarray:
    n = s["n_words"].to_numpy(np.float64)
    mean = s["word_chars"].to_numpy(np.float64) / np.maximum(n, 1)
    return np.where(n == 0, ABSTAIN, np.where((mean < 2) | (mean > 16), BAD, np.where((mean >= 3) & (mean <= 11), GOOD, ABSTAIN)))


#: name -> function of the statistics to votes
RULES = {
    "length": _length,
    "word_length": _word_length,
    "symbols": _share("n_symbols", "n_words", 0.05, 0.25),
    "dup_lines": _share("n_dup_lines", "n_lines", 0.1, 0.4),
    "repeats": _share("n_repeat_words", "n_words", 0.1, 0.4),
    "endings": _share("n_ended", "n_lines", 0.5, 0.05, False),
    "capitals": _share("n_upper", "n_lower", 0.3, 1.0),
    "bangs": _share("n_bangs", "n_words", 0.1, 0.4),
    "top_word": _share("n_top", "n_words", 0.2, 0.35),
    "echoes": _share("n_echoes", "n_words", 0.05, 0.2),
    "variety": _share("n_distinct", "n_words", 0.55, 0.3, False),
    "letters": _share("n_letters", "word_chars", 0.93, 0.8, False),
    "mark_runs": _share("n_mark_runs", "n_words", 0.02, 0.2),
}
#: Believed shares of bad votes on good documents, where above ``HABIT_ELSE``: clean texts may be short, or lack full stops.
HABIT = {"length": 0.05, "endings": 0.05, "top_word": 0.02, "variety": 0.02, "word_length": 0.02, "letters": 0.02}
HABIT_ELSE, CATCH, SHARE = 0.001, 0.1, 0.9
#: What the priors weigh, of all: of the rates on good documents, on bad ones, and of the share of good ones.
TRUST = (0.8, 0.5, 0.5)


def votes(stats: pd.DataFrame) -> np.ndarray:
    return np.stack([f(stats) for f in RULES.values()], axis=1).astype(np.int64)


def pattern_code(v: np.ndarray) -> np.ndarray:
    return (v * 3 ** np.arange(v.shape[1])).sum(axis=1)


def pattern_votes(code: int) -> list[int]:
    return [code // 3**k % 3 for k in range(len(RULES))]


def _stats(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in parts:
        out = pd.DataFrame([text_stats(t) for t in texts], columns=list(STATS), dtype=np.int64)
        out["pattern"] = pattern_code(votes(out)) if len(out) else np.zeros(0, np.int64)
        yield out
    give_back()


def quality_stats(text: Column) -> Column:
    """A struct of ``STATS`` and the vote pattern of a text column."""
    kind = T.StructType([T.StructField(c, T.LongType()) for c in (*STATS, "pattern")])
    return F.pandas_udf(_stats, kind)(text)


@dataclass
class Model:
    """share: of good documents; habit, catch: each rule's rate of bad votes on good and on bad ones."""

    share: float
    habit: np.ndarray
    catch: np.ndarray

    def weights(self) -> tuple[float, np.ndarray]:
        """The log-odds of good before any vote, and those that each vote (BAD, GOOD, ABSTAIN) of each rule adds."""
        added = np.stack([np.log(self.habit / self.catch), np.log((1 - self.habit) / (1 - self.catch)), np.zeros(len(self.habit))])
        return float(np.log(self.share / (1 - self.share))), added

    def posterior(self, v: np.ndarray) -> np.ndarray:
        prior, added = self.weights()
        odds = prior + added[v, np.arange(v.shape[1])].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))


def learn(v: np.ndarray, w: np.ndarray, habit: np.ndarray, rounds: int = 500, tol: float = 1e-10) -> Model:
    """EM over vote patterns ``v`` (patterns x rules) that ``w`` documents have; begins at the priors.

    A rule may not vote bad more often on good documents than on bad ones.
    """
    catch = np.full(len(habit), CATCH)
    now = Model(SHARE, habit, np.maximum(habit, catch))
    bad, good = (v == BAD).astype(np.float64), (v == GOOD).astype(np.float64)

    def rate(weight: np.ndarray, believed: np.ndarray, trust: float) -> np.ndarray:
        x, y = weight @ bad, weight @ good
        seen = np.divide(x, x + y, out=believed.copy(), where=x + y > 0)
        return (1 - trust) * seen + trust * believed

    for _ in range(rounds):
        p = now.posterior(v)
        found = rate(w * p, habit, TRUST[0]), rate(w * (1 - p), catch, TRUST[1])
        share = (1 - TRUST[2]) * float((w * p).sum() / w.sum()) + TRUST[2] * SHARE
        then = Model(share, np.minimum(*found), found[1])
        moved = max(abs(then.share - now.share), np.abs(then.habit - now.habit).max(), np.abs(then.catch - now.catch).max())
        now = then
        if moved < tol:
            break
    return now


def learn_rules(counts: dict[int, int]) -> Model:
    """The model of ``RULES`` from the counts of their vote patterns; without counts, the priors."""
    habit = np.array([HABIT.get(name, HABIT_ELSE) for name in RULES])
    if not counts:
        return Model(SHARE, habit, np.full(len(habit), CATCH))
    codes = sorted(counts)
    return learn(np.array([pattern_votes(c) for c in codes]), np.array([counts[c] for c in codes], np.float64), habit)


def fit(counts: dict[int, int]) -> dict[int, float]:
    """Posterior probability of good for each vote pattern that was counted."""
    codes = sorted(counts)
    if not codes:
        return {}
    p = learn_rules(counts).posterior(np.array([pattern_votes(c) for c in codes]))
    return {int(c): float(x) for c, x in zip(codes, p, strict=True)}


def pattern_counts(patterns: DataFrame) -> dict[int, int]:
    """Counts of the ``pattern`` column: at most 3 ** len(RULES) rows come to the driver."""
    return {r["pattern"]: r["n"] for r in patterns.groupBy("pattern").agg(F.count("*").alias("n")).collect()}


def _posterior(pattern: Column, model: Model) -> Column:
    """The model's posterior as a sum over the votes that a pattern holds."""
    prior, added = model.weights()
    odds = F.lit(prior)
    for k in range(added.shape[1]):
        vote = F.floor(pattern / F.lit(3**k)).cast("int") % 3
        odds = odds + F.element_at(F.array(*[F.lit(float(x)) for x in added[:, k]]), vote + 1)
    return 1 / (1 + F.exp(-odds))


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 20) | (100 * n_repeat_words > 30 * n_words)


def score_quality(docs: DataFrame, keep_at: float = 0.5) -> DataFrame:
    """One row per document: doc_id, the statistics, probability, base_failed, kept."""
    stats = settle(spread(docs.select("doc_id", "text")).select("doc_id", quality_stats(F.col("text")).alias("q")).select("doc_id", "q.*"), "quality")
    p = _posterior(F.col("pattern"), learn_rules(pattern_counts(stats)))
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    return stats.withColumns({"p_good": p, "base_failed": failed}).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= keep_at))


def filter_good(docs: DataFrame, keep_at: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns.

    The texts are judged in one pass and written once with what was counted.
    """
    q = "__quality"
    seen = settle(spread(docs).withColumn(q, quality_stats(F.col("text"))), "quality-votes")
    model = learn_rules(pattern_counts(seen.select(F.col(q)["pattern"].alias("pattern"))))
    keep = ~base_failed(F.col(q)["n_words"], F.col(q)["n_repeat_words"]) & (_posterior(F.col(q)["pattern"], model) >= keep_at)
    return seen.where(keep).drop(q)


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return score_quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good"
    )
