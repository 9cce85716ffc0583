"""Quality by weak supervision, with DataFrame functions alone.

Rules vote good or bad on a document, or abstain. No rule is trusted outright, and none can reject a document alone:
expectation-maximisation estimates, from how votes agree over the whole corpus, what share of the documents is good
and how often each rule votes good, votes bad or abstains on good and on bad documents. The posterior probability
that a document is good decides. The estimate runs on the counts of vote patterns, of which there are at most
3 ** len(RULES) whatever the corpus.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

SPACE, NO_SPACE = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
MARKS = r"[#*$%&|<>!@=+_{}\[\]~^/\\\"()0-9]"
WINDOW = 8
#: Rounds at most, and the change of the log likelihood a document under which they end.
ROUNDS, SETTLED = 200, 1e-9
#: Weight of what is first assumed in each estimate, as a number of documents.
SMOOTH = 20.0


@dataclass(frozen=True)
class Rule:
    """Looks at the share top / bottom: votes good up to `good`, bad from `bad` on, and abstains between them."""

    name: str
    top: str
    bottom: str
    good: float
    bad: float

    def vote(self) -> Column:
        share = F.col(self.top) / F.greatest(F.col(self.bottom), F.lit(1))
        return F.when(F.col("n_words") == 0, 0).when(share >= self.bad, -1).when(share <= self.good, 1).otherwise(0)


RULES = (
    Rule("symbols", "n_symbols", "n_words", 0.02, 0.1),
    Rule("lines", "n_dup_lines", "n_lines", 0.1, 0.3),
    Rule("repeats", "n_repeat_words", "n_words", 0.05, 0.2),
    Rule("capitals", "n_upper", "word_chars", 0.1, 0.3),
    Rule("digits", "n_digits", "word_chars", 0.02, 0.15),
    Rule("shouts", "n_shouts", "n_words", 0.02, 0.2),
    Rule("letters", "word_chars", "n_words", 6.5, 7.5),
    Rule("plain", "n_marks", "word_chars", 0.05, 0.1),
)
#: What is first assumed: the share of good documents, and how often a rule votes bad, abstains, votes good on
#: good documents and on bad ones.
PRIOR, ON_GOOD, ON_BAD = 0.8, (0.05, 0.25, 0.70), (0.40, 0.25, 0.35)


def _found(pattern: str) -> Column:
    """How often a text has this."""
    return F.regexp_count("t", F.lit(pattern))


def measures(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id and the counts that rules look at, all long; a null text has no words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("t"))
    d = d.select(
        "doc_id",
        F.filter(F.split("t", SPACE), lambda w: w != "").alias("words"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(NO_SPACE)).alias("lines"),
        _found(SYMBOLS).alias("n_symbols"),
        _found("[A-Z]").alias("n_upper"),
        _found("[0-9]").alias("n_digits"),
        _found("!").alias("n_shouts"),
        _found(MARKS).alias("n_marks"),
    )
    d = d.withColumns({
        "n_words": F.size("words"),
        "word_chars": F.length(F.array_join("words", "")),
        "n_lines": F.size("lines"),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
    }).withColumn("h", F.expr("transform(words, w -> xxhash64(w))"))
    for step in (1, 2, 4):  # the hash of a window is that of its two halves' hashes
        d = d.withColumn("h", F.expr(f"zip_with(h, slice(h, {step + 1}, n_words), (a, b) -> xxhash64(a, b))"))
    d = d.withColumn("hashes", F.expr(f"slice(h, 1, greatest(0, n_words - {WINDOW - 1}))")).drop("h")
    d = d.drop("words", "lines")
    # Only a text with a window found twice sorts its windows, to bring equal ones together.
    d = d.withColumn("sorted", F.expr("IF(size(array_distinct(hashes)) < size(hashes), array_sort(transform(hashes, (h, i) -> struct(h, i))), array())")).drop("hashes")
    d = d.withColumn("twice", F.expr("sort_array(transform(filter(transform(sorted, (s, i) -> struct(s.i AS i, coalesce(get(sorted, i - 1).h = s.h, false) OR coalesce(get(sorted, i + 1).h = s.h, false) AS twice)), s -> s.twice), s -> s.i))")).drop("sorted")
    covered = F.expr(f"aggregate(twice, struct(-{WINDOW} AS last, 0 AS n), (a, i) -> struct(i AS last, a.n + least({WINDOW}, i - a.last) AS n), a -> a.n)")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_upper", "n_digits", "n_shouts", "n_marks")
    return d.select("doc_id", *(F.col(n).cast("long").alias(n) for n in names), covered.cast("long").alias("n_repeat_words"))


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> tuple[float, list[tuple[tuple[float, ...], tuple[float, ...]]]]:
    """Expectation-maximisation over (votes, count): the share of good documents, and for each rule how often it
    votes bad, abstains, votes good on good documents and on bad ones."""
    prior, rates, total = PRIOR, [(ON_GOOD, ON_BAD)] * len(RULES), sum(n for _, n in patterns)
    before = -math.inf
    for _ in range(rounds):
        sums = [([SMOOTH * x for x in ON_GOOD], [SMOOTH * x for x in ON_BAD]) for _ in RULES]
        good, likelihood = 0.0, 0.0
        for votes, n in patterns:
            g = math.log(prior) + sum(math.log(r[0][v + 1]) for v, r in zip(votes, rates, strict=True))
            b = math.log(1.0 - prior) + sum(math.log(r[1][v + 1]) for v, r in zip(votes, rates, strict=True))
            most = max(g, b)
            likelihood += n * (most + math.log(math.exp(g - most) + math.exp(b - most)))
            p = posterior(g - b)
            good += n * p
            for v, s in zip(votes, sums, strict=True):
                s[0][v + 1] += n * p
                s[1][v + 1] += n * (1.0 - p)
        prior = (good + SMOOTH * PRIOR) / (total + SMOOTH)
        rates = [tuple(tuple(x / sum(s) for x in s) for s in rule) for rule in sums]
        if abs(likelihood - before) <= SETTLED * max(1, total):
            break
        before = likelihood
    return prior, rates


def posterior(logit: float) -> float:
    return 1.0 / (1.0 + math.exp(-logit)) if logit >= 0 else math.exp(logit) / (1.0 + math.exp(logit))


def judge(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """(doc_id, text) -> the counts, base_failed, p_good and kept, one row per input row.

    kept needs p_good >= least and the base conditions: at least 20 words, and at most 30 in 100 words inside
    windows of eight that the text has twice or more. All rules abstain on a text without words, null texts among
    them; it fails the base conditions. Equal rows are judged alike, a null doc_id is kept as it is, and an empty
    table gives none. The estimate is over all rows, so a document's p_good depends on its corpus.
    """
    found = materialize(measures(docs), "quality-measures")
    votes = {f"v_{r.name}": r.vote() for r in RULES}
    voted = found.select("*", *(v.alias(n) for n, v in votes.items()))
    counts = voted.groupBy(*votes).agg(F.count("*").alias("n")).collect()  # 3 ** len(RULES) rows at most
    prior, rates = estimate(sorted((tuple(r[n] for n in votes), r["n"]) for r in counts))
    logit = F.lit(math.log(prior / (1.0 - prior)))
    for name, (on_good, on_bad) in zip(votes, rates, strict=True):
        weight = [math.log(g / b) for g, b in zip(on_good, on_bad, strict=True)]
        logit = logit + F.when(F.col(name) < 0, weight[0]).when(F.col(name) > 0, weight[2]).otherwise(weight[1])
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    p = 1.0 / (1.0 + F.exp(-logit))
    return voted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), p.alias("p_good"), (~failed & (p >= least)).alias("kept"))
