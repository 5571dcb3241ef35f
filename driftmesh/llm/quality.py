"""Quality rules with risk-controlled thresholds; DataFrame functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, WS_CLASS, materialize, without_ws

SYMBOLS = "#*$%&|<>"
#: The features of the score and where each is cut into levels.
GRID = {
    "symbol_share": (0.02, 0.04, 0.06, 0.08, 0.1, 0.15, 0.2, 0.3),
    "dup_line_share": (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8),
    "repeat_share": (0.02, 0.05, 0.08, 0.1, 0.12, 0.15, 0.18),
    "upper_share": (0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8),
    "bang_share": (0.02, 0.05, 0.1, 0.15, 0.2, 0.3),
    "long_word": (8.0, 10.0, 12.0, 14.0, 16.0, 20.0),
}
#: Strata by number of words: up to and including each bound, and above.
STRATA = (100, 400)
#: Every third labelled document teaches the score; the others are the holdout that certifies its cutoffs.
TEACHING = 3
#: The cutoffs that are tried, from strict to lax: these shares of the bad teaching documents reach them.
SHARES = tuple(k / 20 for k in range(1, 20))


def features(docs: DataFrame) -> DataFrame:
    r"""doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the features of GRID.

    Repeated 5-word windows: windows' hashes are sorted with their places; a place counts if a neighbour
    has its hash; a window at place p covers p to p + 4, so each place adds the distance to the next, 5 at
    most, and the last one 5.  Texts whose windows all differ skip the sort.  All is done within the row.
    """
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(without_ws(x)) > 0)
    step1 = docs.select(
        "doc_id",
        F.transform(F.filter(F.split(text, WS_CLASS + "+"), lambda x: x != ""), lambda x: F.xxhash64(x)).alias("w"),
        F.length(without_ws(text)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length(text) - F.length(F.translate(text, UPPER, ""))).alias("upper"),
        (F.length(text) - F.length(F.translate(text, "!", ""))).alias("bangs"),
        lines.alias("lines"),
    )
    n = F.size("w")
    windows = F.when(n < 5, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - 4, F.lit(1))), lambda i: F.xxhash64(F.slice("w", i, 5))))
    step2 = step1.withColumn("v", windows).withColumn("repeats", F.size(F.array_distinct("v")) < F.size("v"))
    pairs = F.sort_array(F.transform("v", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # bound once as s: a lambda's variable isn't evaluated again for each element
    places = F.transform(
        F.array(pairs),
        lambda s: F.sort_array(F.transform(F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | F.coalesce(x["h"] == F.get(s, i + 1)["h"], F.lit(False))), lambda x: x["i"])),
    )[0]
    covered = F.transform(
        F.array("places"), lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(5), F.coalesce(F.get(p, i + 1) - x, F.lit(5)))), F.lit(0), lambda a, x: a + x)
    )[0]
    step3 = step2.withColumn("places", F.when(F.col("repeats"), places))
    n_lines, chars = F.size("lines"), F.greatest(F.col("word_chars"), F.lit(1))
    dup = n_lines - F.size(F.array_distinct("lines"))
    rep = F.when(F.col("places").isNull(), F.lit(0)).otherwise(covered).cast("long")
    base = step3.select("doc_id", n.cast("long").alias("n_words"), "word_chars", "n_symbols", dup.cast("long").alias("n_dup_lines"), rep.alias("n_repeat_words"), n_lines.alias("n_lines"), "upper", "bangs")
    words = F.greatest(F.col("n_words"), F.lit(1))
    return base.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("n_symbols") / chars).alias("symbol_share"),
        (F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))).alias("dup_line_share"),
        (F.col("n_repeat_words") / words).alias("repeat_share"),
        (F.col("upper") / chars).alias("upper_share"),
        (F.col("bangs") / chars).alias("bang_share"),
        (F.col("word_chars") / words).alias("long_word"),
    )


def _stratum() -> Column:
    return sum(((F.col("n_words") > b).cast("int") for b in STRATA), F.lit(0))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial with n trials and chance p."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p) for j in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in logs))


@dataclass
class Rules:
    """Points of each feature by level, and each stratum's certified cutoff: reject from that score on."""

    points: dict[str, list[float]]
    cut: dict[int, float]

    def score(self) -> Column:
        """The sum of the features' points; rounded, so that the order of the sum doesn't matter."""
        out = F.lit(0.0)
        for f, cuts in GRID.items():
            level = sum(((F.col(f) > c).cast("int") for c in cuts), F.lit(0))
            out = out + F.element_at(F.array(*map(F.lit, self.points[f])), level + 1)
        return F.round(out, 6)

    def rejected(self) -> Column:
        out = F.lit(False)
        for s, c in sorted(self.cut.items()):
            out = out | ((_stratum() == s) & (self.score() >= c))
        return out


def points(beyond: dict[int, list[int]], total: dict[int, int]) -> list[float]:
    """Log odds of bad against good for each level of a feature, smoothed; a higher level never gets fewer points.

    ``beyond[q]``: how many documents of quality q exceed each cut; ``total[q]``: how many there are.
    """
    share = {}
    for q in (0, 1):
        up = [total[q], *beyond[q], 0]
        share[q] = [(a - b + 0.5) / (total[q] + 0.5 * (len(up) - 1)) for a, b in zip(up, up[1:], strict=False)]
    out: list[float] = []
    for bad, good in zip(share[0], share[1], strict=True):
        out.append(max([math.log(bad / good), *out[-1:]]))
    return out


def certified(scores: list[float], rejected: dict[int, list[int]], n: dict[int, int], risk: float, error: float) -> dict[int, float]:
    """The laxest certified cutoff of each stratum that has one.

    In a stratum the cutoffs are tested in their order, strict ones first.  A test passes if the exact
    binomial bound refutes, at level ``error`` / strata (Bonferroni over strata), that the cutoff rejects
    ``risk`` or more of the good documents; the first that fails ends the sequence, so the tests within a
    stratum need no further correction.
    """
    out: dict[int, float] = {}
    for s in sorted(n):
        for c, k in zip(scores, rejected[s], strict=True):
            if n[s] == 0 or k >= risk * n[s] or binomial_tail(k, n[s], risk) > error / (len(STRATA) + 1):
                break
            out[s] = c
    return out


def learn(feats: DataFrame, labels: DataFrame, risk: float = 0.02, error: float = 0.05) -> Rules:
    """Points from the teaching documents, cutoffs certified on the holdout; see ``points`` and ``certified``.

    All labelled documents count that the base keeps (the base rejects the others whatever the score).  They
    come to the driver as counts: a row a quality, a row of quantiles, and a row a stratum.
    """
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("good")).where("good IN (0, 1)")
    labelled = feats.join(good, "doc_id").where(~_base_failed()).withColumn("teaches", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(TEACHING)) == 0)
    tests = [(f, c) for f, cs in GRID.items() for c in cs]
    rows = labelled.where("teaches").groupBy("good").agg(F.count("*").alias("n"), *[F.count_if(F.col(f) > c).alias(f"t{i}") for i, (f, c) in enumerate(tests)]).collect()
    total = {0: 0, 1: 0} | {r["good"]: r["n"] for r in rows}
    by = {r["good"]: r for r in rows}
    beyond = {q: [by[q][f"t{i}"] if q in by else 0 for i in range(len(tests))] for q in (0, 1)}
    at, rules = 0, Rules({}, {})
    for f, cuts in GRID.items():
        rules.points[f] = points({q: beyond[q][at : at + len(cuts)] for q in (0, 1)}, total)
        at += len(cuts)
    if not total[0]:
        return rules
    scored = labelled.withColumn("score", rules.score())
    levels = scored.where("teaches AND good = 0").agg(F.percentile("score", F.array(*[F.lit(1 - x) for x in SHARES])).alias("c")).first()["c"]
    scores = sorted(set(levels), reverse=True)
    counts = scored.where("NOT teaches AND good = 1").groupBy(_stratum().alias("s")).agg(F.count("*").alias("n"), *[F.count_if(F.col("score") >= c).alias(f"r{i}") for i, c in enumerate(scores)]).collect()
    rules.cut = certified(scores, {r["s"]: [r[f"r{i}"] for i in range(len(scores))] for r in counts}, {r["s"]: r["n"] for r in counts}, risk, error)
    return rules


def _base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def quality_rules(docs: DataFrame, labels: DataFrame, risk: float = 0.02, error: float = 0.05) -> DataFrame:
    """One row per document: doc_id, the counts of ``features``, base_failed and kept.

    base_failed: under 10 words, or over a fifth of the words in repeated 5-word windows.  kept is false
    for these and for documents whose score reaches the certified cutoff of their stratum (see ``learn``):
    with confidence 1 - ``error`` less than ``risk`` of the good documents of every stratum are rejected
    so.  A stratum needs about 200 good documents in the holdout at the default risk; with fewer nothing is
    certified and only the base counts.

    Null or empty text has no words and fails the base.  A null doc_id has no label.  Of labels that
    repeat a doc_id the lowest counts, null labels not at all.  Repeated rows give repeated results; an empty table none.
    Nothing shuffles but slim rows for the join with the labels; each text is worked on within its row.
    """
    feats = materialize(features(docs))
    rules = learn(feats, labels, risk, error)
    return feats.select("*", _base_failed().alias("base_failed"), (~_base_failed() & ~rules.rejected()).alias("kept"))
