"""Source divergence audit: how far the sources of a language are apart, and by which terms, in plain relational steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, maybe_broadcast

#: Letters a-z and characters from U+0080 on, in texts whose A-Z are lower-cased.
TERM = r"[^\x00-\x60\x7B-\x7F]+"


def _lower(text: Column) -> Column:
    """A-Z lower-cased; for texts of one byte a character, lower() does that faster."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(ascii_lower(text))


def _share(count: str, total: str, smoothing: int, scale: int) -> Column:
    """1 + floor(scale * (count + smoothing) / total) in exact decimals; null without a total."""
    return F.expr(f"1 + (cast({scale} AS decimal(18,0)) * cast({count} + {smoothing} AS decimal(18,0))) div cast({total} AS decimal(18,0))")


def numbered_groups(docs: DataFrame) -> tuple[DataFrame, int]:
    """lang, source, g of each group that occurs, g a hash of both by a seed (returned too) that gives each group its own."""
    pairs = materialize(docs.select("lang", "source").distinct())
    n = pairs.count()
    for seed in range(100):
        groups = pairs.withColumn("g", F.xxhash64("lang", "source", F.lit(seed)))
        if groups.select("g").distinct().count() == n:
            return groups, seed
    raise RuntimeError("no seed tells the groups apart")


def term_counts(docs: DataFrame, seed: int) -> DataFrame:
    """g, term, n (occurrences), d (rows of docs that have it), with one pass over the texts.

    Each match is a row, and each document's distinct matches are rows once more; both are combined before the shuffle.
    """
    terms = docs.select(F.xxhash64("lang", "source", F.lit(seed)).alias("g"), F.regexp_extract_all(_lower(F.col("text")), F.lit(TERM), F.lit(0)).alias("ts"))
    each = terms.select("g", F.size("ts").alias("all"), F.posexplode(F.concat("ts", F.array_distinct("ts"))).alias("pos", "term"))
    return each.groupBy("g", "term").agg(F.count_if(F.col("pos") < F.col("all")).alias("n"), F.count_if(F.col("pos") >= F.col("all")).alias("d"))


def source_divergence(docs: DataFrame, min_docs: int = 30, smoothing: int = 5, scale: int = 10**9, top: int = 50, broadcast_groups: int = 100_000) -> DataFrame:
    r"""lang, source, part, item, value, rank: each (lang, source) group against the other groups of its language and against the language.

    Terms are runs of letters A-Z, a-z and characters from U+0080 on, A-Z lower-cased.  A language keeps the V
    terms that at least ``min_docs`` of its documents have.  A kept term's share in a group, or in the language,
    is p = 1 + floor(scale * (count + smoothing) / (N + smoothing * V)), N the count of all kept terms there.

    part ``pair``: a row for each other source of the language; value is the sum over all kept terms of the
    distance of both shares (0 without kept terms); all ranks.  part ``term``: kept terms that the group has and
    whose share is above the language's; value is the difference; ranks up to ``top``.  Ranks count from 1 a group and part, by value
    downward, then by item in UTF-8 order.

    Steps: terms are counted by group, and a window adds up each term's documents in its language; groups
    are joined with their language's kept terms, so that absent terms get their share too; sources of a language
    meet by term, each two once; sums combine before they shuffle.  A common term is one row a
    group after counting, and its rows meet by (lang, term), so neither a hot source nor a hot word lands in one
    task.  Groups and their totals are broadcast up to ``broadcast_groups`` groups, else joined by shuffle.

    Every row of docs is a document, whatever its doc_id.  Null text, lang and source count as ''.  Groups
    without terms have their rows of part ``pair``.  Other columns are ignored.  An empty table gives no rows.
    """
    docs = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")])
    by_term = Window.partitionBy("lang", "term")
    names, seed = numbered_groups(docs)
    names = maybe_broadcast(names, names.count(), broadcast_groups)
    counts = term_counts(docs, seed).join(names, "g").withColumns({"docs": F.sum("d").over(by_term), "lang_n": F.sum("n").over(by_term)})
    kept = materialize(counts.where(F.col("docs") >= min_docs).select("lang", "source", "term", "n", "lang_n"))
    vocabulary = kept.select("lang", "term").distinct()
    langs = kept.groupBy("lang", "term").agg(F.first("lang_n").alias("c")).groupBy("lang").agg(F.sum("c").alias("lang_sum"), F.count("*").alias("v"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_sum"))
    groups = names.join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    totals = ((F.coalesce(F.col(c), F.lit(0)) + smoothing * F.col("v")).alias(t) for c, t in (("group_sum", "group_total"), ("lang_sum", "lang_total")))
    groups = materialize(groups.select("lang", "source", *totals).withColumn("absent", _share("0", "group_total", smoothing, scale)))
    small = maybe_broadcast(groups, groups.count(), broadcast_groups)

    shares = kept.join(small, ["lang", "source"])
    shares = shares.select("lang", "source", "term", _share("n", "group_total", smoothing, scale).alias("p"), _share("lang_n", "lang_total", smoothing, scale).alias("q"))
    top_terms = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))

    dense = vocabulary.join(small.select("lang", "source", "absent"), "lang").join(shares.drop("q"), ["lang", "source", "term"], "left")
    dense = materialize(dense.select("lang", "source", "term", F.coalesce("p", "absent").alias("p")))
    other = dense.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"))
    apart = dense.join(other, ["lang", "term"]).where("source < item").groupBy("lang", "source", "item").agg(F.sum(F.abs(F.col("p") - F.col("q"))).alias("value"))
    both = apart.unionByName(apart.select("lang", F.col("source").alias("item"), F.col("item").alias("source"), "value"))
    # languages without kept terms have pairs too
    pairs = small.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    pairs = pairs.join(both, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    ranked = top_terms.select("*", rank).where(F.col("rank") <= top)
    return pairs.select("*", rank).unionByName(ranked)
