"""URL filters: host and path rules, and for all other URLs two character language models, of accepted and of rejected ones."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, maybe_broadcast

#: Marks before the first and behind the last character of a URL.
BEGIN, END = "\x02", "\x03"
#: Log-likelihoods are whole millionths, so that sums are exact in any order.
UNIT = 1_000_000
#: Rows of a broadcast table of grams or of values at most; larger ones join by shuffle.
BROADCAST = 400_000


@dataclass
class UrlModel:
    """Table gram, d (log ratio of its last character after the others), b (log ratio of both models' weight of a shorter context); longest context; b of the empty context; cutoff; number of grams by length."""

    grams: DataFrame
    order: int
    root: int
    cutoff: float
    sizes: dict[int, int]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    url = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(rules: tuple[tuple[str, str], ...], host: Column, path: Column) -> Column:
    """The longest fitting rule as a struct of rule and verdict, null without one.  Rules (host/path, verdict) are few: each is a condition."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r)):
        h, slash, p = rule.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(slash + p)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _positions(urls: DataFrame, order: int, *keep: str) -> DataFrame:
    """A row for each character of a URL and its end: the grams g1 to g<order + 1> that end there, and the contexts h1 to h<order> before it."""
    marked = F.split(F.concat(F.lit(BEGIN * order), F.coalesce("url", F.lit("")), F.lit(END)), "")
    chars = urls.select(*keep, F.filter(marked, lambda c: c != "").alias("__c"))

    def ends(i: Column) -> Column:
        at = [F.get("__c", i - k) for k in reversed(range(order + 1))]
        grams = [F.concat(*at[order + 1 - n :]).alias(f"g{n}") for n in range(1, order + 2)]
        return F.struct(*grams, *[F.concat(*at[order - n : order]).alias(f"h{n}") for n in range(1, order + 1)])

    places = F.sequence(F.lit(order), F.size("__c") - 1)
    return chars.select(*keep, F.inline(F.transform(places, ends)))


def _valued(rows: DataFrame, model: UrlModel) -> DataFrame:
    """Rows of ``_positions`` with value, the log-likelihood difference of their last character."""
    longest, whole = model.order + 1, sum(model.sizes.values()) <= BROADCAST

    def level(n: int, col: str, alias: str) -> DataFrame:
        if whole:
            return F.broadcast(model.grams.select("gram", col).alias(alias))
        grams = model.grams.where(F.length("gram") == n).select("gram", col)
        return maybe_broadcast(grams, model.sizes.get(n, 0), BROADCAST // 4).alias(alias)

    for n in range(1, longest + 1):
        rows = rows.join(level(n, "d", f"d{n}"), F.col(f"g{n}") == F.col(f"d{n}.gram"), "left")
    for n in range(1, longest):
        rows = rows.join(level(n, "b", f"b{n}"), F.col(f"h{n}") == F.col(f"b{n}.gram"), "left")
    # the longest gram that is known counts, with the weights of the contexts that are given up for it
    value = F.lit(model.root).cast("long")
    given_up = [F.coalesce(F.col(f"b{n}.b"), F.lit(0)) for n in range(1, longest)]
    for x in given_up:
        value = value + x
    for n in range(1, longest + 1):
        known = F.col(f"d{n}.d")
        for x in given_up[n - 1 :]:
            known = known + x
        value = F.when(F.col(f"d{n}.d").isNotNull(), known).otherwise(value)
    return rows.withColumn("value", value)


def _least(counts: DataFrame, most: int) -> int:
    """The least count from 2 on that at most ``most`` rows reach, from rows (count, rows of it)."""
    least, left = 2, 0
    for count, n in sorted(map(tuple, counts.collect()), reverse=True):  # a row a count
        left += n
        if left > most:
            return max(least, count + 1)
    return least


def _scored(urls: DataFrame, model: UrlModel, *keep: str) -> DataFrame:
    """keep, score: the log-likelihood difference a character; ``keep`` tells the rows of urls apart.

    A model too large to be broadcast values each different longest gram once.  The commonest values are broadcast, so that no key of
    the join with the others is in many URLs.
    """
    score = (F.col("s") / (F.col("n") * UNIT)).alias("score")
    sums = F.sum("value").alias("s"), F.count("*").alias("n")
    if sum(model.sizes.values()) <= BROADCAST:
        rows = _valued(_positions(urls, model.order, *keep), model)
        return rows.groupBy(*keep).agg(*sums).select(*keep, score)
    urls = materialize(urls.select(*dict.fromkeys((*keep, "url"))).withColumn("__n", F.monotonically_increasing_id()))
    rows, gram = _positions(urls, model.order, "__n"), f"g{model.order + 1}"
    windows = materialize(rows.groupBy(*rows.columns[1:]).agg(F.count("*").alias("times")))
    values = materialize(_valued(windows, model).select(gram, "value", "times"))
    least = _least(values.groupBy("times").agg(F.count("*")), BROADCAST)
    common = values.where(F.col("times") >= least).select(gram, "value")
    rows = rows.select("__n", gram).join(F.broadcast(common), gram, "left")
    rare = rows.where("value IS NULL").select("__n", gram).join(values.where(F.col("times") < least).select(gram, "value"), gram)
    found = rows.where("value IS NOT NULL").select("__n", "value").unionByName(rare.select("__n", "value")).groupBy("__n").agg(*sums)
    return urls.join(found, "__n").select(*keep, score)


def fit_grams(sample: DataFrame, order: int, weight: float, max_grams: int | None = None) -> tuple[DataFrame, int]:
    """The table of grams of both models and the empty context's b, from urls and accepted (boolean).

    A class's share of character c after context h is (n(hc) + weight * share of c after h without its first character) / (n(h) + weight),
    and one over the number of characters before any context.  The order varies: grams that are seen once are left to shorter contexts.
    With ``max_grams`` those seen less than m times are, m the least count from 2 on that leaves so many at most.
    """
    parts = int(sample.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sample = sample.repartition(parts, "url")  # few bytes of a file are many grams
    flat = _positions(sample, order, "accepted").select("accepted", F.explode(F.array(*[F.struct(F.lit(n).alias("len"), F.col(f"g{n}").alias("gram")) for n in range(1, order + 2)])).alias("x"))
    counts = materialize(flat.groupBy("x.len", "x.gram").agg(F.count_if("accepted").alias("na"), F.count_if(~F.col("accepted")).alias("nr")))
    prefix, suffix = F.expr("left(gram, len - 1)"), F.expr("right(gram, len - 1)")
    contexts = counts.groupBy(prefix.alias("gram")).agg(F.sum("na").alias("ca"), F.sum("nr").alias("cr"))
    least = 2 if max_grams is None else _least(counts.groupBy((F.col("na") + F.col("nr")).alias("t")).agg(F.count("*")), max_grams)
    kept = counts.where(F.col("na") + F.col("nr") >= least).withColumns({"prefix": prefix, "suffix": suffix})
    kept = kept.join(contexts.withColumnRenamed("gram", "prefix"), "prefix")
    chars = counts.where("len = 1").count() + 1
    shorter, levels = None, []
    for n in range(1, order + 2):
        level = kept.where(F.col("len") == n)
        level = level.withColumns({"pa": F.lit(1.0 / chars), "pr": F.lit(1.0 / chars)}) if shorter is None else level.join(shorter, "suffix")
        now = [((F.col(c) + weight * F.col(p)) / (F.col(t) + weight)).alias(p) for c, p, t in (("na", "pa", "ca"), ("nr", "pr", "cr"))]
        shorter = materialize(level.select("gram", *now))
        levels.append(shorter)
        shorter = shorter.withColumnRenamed("gram", "suffix")
    shares = levels[0]
    for level in levels[1:]:
        shares = shares.unionByName(level)
    whole = lambda c: F.round(c * UNIT).cast("long")
    b = whole(F.log((F.col("cr") + weight) / (F.col("ca") + weight)))
    table = shares.join(contexts, "gram", "left").select("gram", whole(F.log(F.col("pa") / F.col("pr"))).alias("d"), F.coalesce(b, F.lit(0)).alias("b"))
    root = contexts.where("gram = ''").select(b.alias("b")).first()["b"]
    return materialize(table), root


def cutoff_of(scores: list[tuple[int, int, int]]) -> float:
    """The score from which on URLs are allowed, from rows (score in thousandths, accepted, rejected).

    It has the least mean of both classes' error shares; of equals it is the one nearest to 0, where both models agree, then the lesser.  Without both classes it is 0.
    """
    accepted, rejected = sum(r[1] for r in scores), sum(r[2] for r in scores)
    if not accepted or not rejected:
        return 0.0
    scores = sorted(scores)
    lost, caught, best = 0, 0, None
    for (v, a, r), above in zip([(None, 0, 0), *scores], [*(x[0] for x in scores), None], strict=True):
        lost, caught = lost + a, caught + r
        at = 0 if v is None else max(v + 1, 0)  # all cutoffs above v, up to the next score, err alike
        at = at if above is None else min(at, above)
        now = (lost * rejected + (rejected - caught) * accepted, abs(at), at)
        best = min(best or now, now)
    return best[2] / 1000


def train_urls(labelled: DataFrame, order: int = 4, weight: float = 4.0, max_chars: int | None = None) -> UrlModel | None:
    """Both models and the cutoff, from url and verdict (allow or block); None without URLs of both verdicts.

    All different URLs with a verdict are used (of up to ``max_chars`` characters, if that is given): three quarters of them, by a hash, fit
    the models, the others are held out and give the cutoff alone.
    """
    urls = labelled.select("url", (F.col("verdict") == "allow").alias("accepted")).where("url IS NOT NULL AND accepted IS NOT NULL")
    if max_chars is not None:
        urls = urls.where(F.length("url") <= max_chars)
    known = materialize(urls.distinct().withColumn("held_out", F.substring(F.md5("url"), 1, 1) < "4"))
    fitted = known.where("NOT held_out")
    if fitted.select("accepted").distinct().count() < 2:
        return None
    grams, root = fit_grams(fitted, order, weight)
    sizes = {r["n"]: r["rows"] for r in grams.groupBy(F.length("gram").alias("n")).agg(F.count("*").alias("rows")).collect()}  # a row a length
    model = UrlModel(grams, order, root, 0.0, sizes)
    held = _scored(known.where("held_out"), model, "url", "accepted").groupBy(F.floor(F.col("score") * 1000).cast("long").alias("v"))
    model.cutoff = cutoff_of([tuple(r) for r in held.agg(F.count_if("accepted"), F.count_if(~F.col("accepted"))).collect()])
    return model


def filter_urls(pages: DataFrame, rules: tuple[tuple[str, str], ...], order: int = 4, max_chars: int | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block), score of each row of pages.

    Rules are host/path with a verdict; one fits its host and all subdomains if the path starts with the rule's.  The longest fitting
    rule decides.  All URLs that a rule decides (of up to ``max_chars`` characters, if that is given) train two smoothed Markov models of
    characters, of allowed and of blocked URLs, whose order varies up to ``order``.  All others are allowed when the difference of both log-likelihoods, a character, is at least the cutoff that
    held-out URLs give; score is that difference, null where a rule decides.

    The host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; the path what follows up to ``?``, ``#`` or
    the end; both are empty without ``://``.  A null url counts as empty and is judged like any other.  Without rule-decided URLs of
    both verdicts nothing tells the others apart: they are allowed with a null score.  Repeated rows give repeated results, an empty table none.
    Other columns are ignored.  URLs of any length are scored whole.

    The models' table is broadcast up to 400,000 grams.  Then each character is a row only within its task: sums combine
    before the one shuffle, which has a row a URL that no rule decides.  A larger table joins by shuffle.  DataFrame functions only.
    """
    host, path = url_parts(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("__r", rule_of(rules, F.col("host"), F.col("path"))).select("page_id", "url", "host", "path", "__r.rule", "__r.verdict")
    ruled, other = rows.where(F.col("rule").isNotNull()), rows.where(F.col("rule").isNull())
    model = train_urls(ruled, order, max_chars=max_chars)
    out = ["page_id", "host", "path", "rule", "verdict"]
    decided = ruled.select(*out, F.lit(None).cast("double").alias("score"))
    if model is None:
        return decided.unionByName(other.select("page_id", "host", "path", "rule", F.lit("allow").alias("verdict"), F.lit(None).cast("double").alias("score")))
    keys = ("__row", "page_id", "host", "path")
    judged = _scored(other.withColumn("__row", F.monotonically_increasing_id()), model, *keys)
    allowed = F.when(F.floor(F.col("score") * 1000) >= round(model.cutoff * 1000), "allow").otherwise("block")
    return decided.unionByName(judged.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), allowed.alias("verdict"), "score"))
