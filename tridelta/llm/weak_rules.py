"""Quality rules as weak supervision.

Each rule votes good (+1), bad (-1) or abstains (0) on a whole text.
Expectation-maximisation over the counts of vote patterns estimates every
rule's accuracies and the share of good documents; a document is kept if its
posterior probability of being good reaches ``keep_at``. Accuracies are kept
apart for good and bad documents. The driver sees only
the pattern counts (at most 3 to the power of the number of rules), which are
summed over all documents.

Two base rules stand outside the vote: fewer than ``min_words`` words, or more
than ``max_repeat_pct`` % of the words in repeated five-word windows, fail.

Null and empty text: no words, fails the base rules. Repeated rows are judged
alike, each for itself. Columns of the input are kept in a struct and cannot
clash. Very long texts are counted whole. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, store
from .textstats import TextStats

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """Votes bad outside [bad_low, bad_high], good inside [good_low, good_high]."""

    name: str
    value: Callable[[TextStats], float]
    bad_low: float
    good_low: float
    good_high: float
    bad_high: float

    def vote(self, stats: TextStats) -> int:
        v = self.value(stats)
        if v < self.bad_low or v > self.bad_high:
            return -1
        return 1 if self.good_low <= v <= self.good_high else 0


INF = float("inf")
RULES = (
    Rule("length", lambda s: s.n_words, 10, 25, INF, INF),
    Rule("symbols per word", lambda s: s.n_symbols / max(1, s.n_words), 0, 0, 0.03, 0.2),
    Rule("odd words", lambda s: s.odd_words / max(1, s.n_words), 0, 0, 0.05, 0.2),
    Rule("repeated lines", lambda s: s.n_dup_lines / max(1, s.n_lines), 0, 0, 0.1, 0.45),
    Rule("repeated windows", lambda s: s.n_repeat_words / max(1, s.n_words), 0, 0, 0.05, 0.2),
    Rule("most frequent word", lambda s: s.top / max(1, s.n_words), 0, 0, 0.12, 0.3),
    Rule("upper case", lambda s: s.upper / max(1, s.letters), 0, 0, 0.15, 0.5),
    Rule("exclamations per word", lambda s: s.exclaims / max(1, s.n_words), 0, 0, 0.05, 0.3),
    Rule("letters and digits", lambda s: (s.letters + s.digits) / max(1, s.word_chars), 0.72, 0.85, 1.0, 1.0),
    Rule("doubled words", lambda s: s.stutters / max(1, s.n_words), 0, 0, 0.1, 0.3),
)


def votes(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES,
          min_words: int = 10, max_repeat_pct: int = 20, keep: list[str] | None = None) -> DataFrame:
    """row, the base counts, base_failed and pattern (the votes in base 3)."""

    def make():
        def run(texts: list) -> list:
            out: list[list] = [[] for _ in range(len(STATS) + 2)]
            for text in texts:
                s = TextStats(text)
                for k, name in enumerate(STATS):
                    out[k].append(getattr(s, name))
                out[-2].append(s.n_words < min_words or 100 * s.n_repeat_words > max_repeat_pct * s.n_words)
                out[-1].append(sum((r.vote(s) + 1) * 3 ** j for j, r in enumerate(rules)))
            return out

        return run

    fields = ", ".join(f"{name} bigint" for name in STATS) + ", base_failed boolean, pattern int"
    return map_texts(docs, text_col, make, fields, keep)


@dataclass(frozen=True)
class VoteModel:
    """on_good[j], on_bad[j]: shares of (bad, good) among the votes that rule j
    gives on documents of that class; prior: share of good documents."""

    on_good: tuple[tuple[float, ...], ...]
    on_bad: tuple[tuple[float, ...], ...]
    prior: float
    posterior: dict[int, float]

    def accuracies(self) -> list[float]:
        """Per rule, the chance that a vote it gives is right."""
        out = []
        for g, b in zip(self.on_good, self.on_bad):
            out.append(self.prior * g[1] + (1 - self.prior) * b[0])
        return out


# What is believed of a rule before any document is seen, and for how large a
# share of the documents that belief counts: bad votes are rare on good
# documents, and a rule knows only some of the ways in which one can be bad.
START_GOOD, START_BAD, START_SHARE = (0.002, 0.998), (0.2, 0.8), 0.01


def fit(counts: dict[int, int], n_rules: int, rounds: int = 200, prior: float = 0.9) -> VoteModel:
    """EM over pattern counts, with each rule's accuracy on good and on bad
    documents apart: a good vote of a rule that looks at something else says
    little, a bad vote says much, and an abstention says nothing. The start
    fixes which class is which."""
    patterns = np.array(sorted(counts), dtype=np.int64)
    start = np.array([START_GOOD, START_BAD])
    table = np.repeat(start[:, None, :], n_rules, axis=1)  # class, rule, vote
    if not len(patterns):
        return VoteModel(tuple(map(tuple, table[0].tolist())), tuple(map(tuple, table[1].tolist())), prior, {})
    n = np.array([counts[p] for p in patterns.tolist()], dtype=float)
    v = (patterns[:, None] // 3 ** np.arange(n_rules)) % 3
    given = np.stack([v == 0, v == 2], axis=2).astype(float)  # pattern, rule, vote
    post = np.full(len(patterns), -1.0)
    for _ in range(rounds):
        like = np.einsum("prv,crv->pc", given, np.log(table))
        new = 1 / (1 + np.exp(np.clip(np.log((1 - prior) / prior) + like[:, 1] - like[:, 0], -500, 500)))
        done, post = np.abs(new - post).max() < 1e-12, new
        for c, weight in enumerate((n * post, n * (1 - post))):
            seen = np.einsum("p,prv->rv", weight, given) + START_SHARE * n.sum() * start[c]
            table[c] = seen / seen.sum(1, keepdims=True)
        prior = float(np.clip(n @ post / n.sum(), 0.01, 0.999))
        if done:
            break
    return VoteModel(tuple(map(tuple, table[0].tolist())), tuple(map(tuple, table[1].tolist())), prior,
                     dict(zip(patterns.tolist(), post.tolist())))


def judge(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, keep_at: float = 0.5,
          keep: list[str] | None = None, **base) -> DataFrame:
    """row, base counts, base_failed, posterior, kept; every row of ``docs``."""
    spark = docs.sparkSession
    voted = store(votes(docs, text_col, rules, keep=keep, **base), "votes")
    counts = {r["pattern"]: r["count"] for r in voted.groupBy("pattern").count().collect()}
    model = fit(counts, len(rules))
    table = spark.createDataFrame(list(model.posterior.items()), "pattern int, posterior double")
    return (voted.join(F.broadcast(table), "pattern")  # at most 3 ** len(rules) rows
            .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= F.lit(keep_at)))
            .select("row", *STATS, "base_failed", "posterior", "kept"))


def reject(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns."""
    return judge(docs, **options).where("kept").select("row.*")
