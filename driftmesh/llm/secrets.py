"""Secret scans: fixed patterns, and sliding-window entropy over candidate strings; DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower
from .spans import SPAN, joined, matches, meets, ordered

#: Fixed patterns of the base; [a-z] there stands for either case, spelled out so that only A-Z and a-z count.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "entropy")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"
WINDOW = 20
#: Bits a character that a window needs, by the class of the candidate's characters.
THRESHOLDS = {"hex": 3.2, "alnum": 3.75, "base64": 3.9}
#: Strings that look random and aren't secret: UUIDs, integrity digests, runs of the alphabet.
ALLOWED = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$|^sha(1|256|384|512)-|abcdefghij|0123456789|qwertyuiop|example|placeholder|^[A-Za-z]*$|^[0-9=_/+-]*$"
#: How an address or an embedded image begins; it ends at the next white space, however far.
ALLOWED_HEAD = r"(?:https?://|www\.|data:image/)"


def _entropy_bounds(hit: Column, threshold: Column) -> Column:
    """First and last end of the windows that reach the threshold (-1: none).

    Counts by character are kept from window to window: the character that comes in and the one that goes
    out change the sum of c * log2(c) by a looked-up difference; entropy is log2(n) - sum / n.
    """
    logs = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 2)])
    place = lambda c: F.instr(F.lit(ALPHABET), c)
    start = F.struct(F.array_repeat(F.lit(0), len(ALPHABET)).alias("n"), F.lit(0.0).alias("sum"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))

    def put(state: Column, k: Column, d: int) -> Column:
        """The state after one character more (d = 1) or less (d = -1); nothing where k is null."""
        old = F.coalesce(F.get(state["n"], k - 1), F.lit(0))
        return F.when(k.isNull(), state).otherwise(
            F.struct(
                F.transform(state["n"], lambda n, j: n + F.when(j == k - 1, F.lit(d)).otherwise(F.lit(0))).alias("n"),
                (state["sum"] + F.get(logs, old + d) - F.get(logs, old)).alias("sum"),
                state["first"].alias("first"),
                state["last"].alias("last"),
            )
        )

    def mark(state: Column, i: Column) -> Column:
        good = (i >= WINDOW - 1) & (F.lit(math.log2(WINDOW)) - state["sum"] / WINDOW >= threshold)
        return F.struct(
            state["n"].alias("n"),
            state["sum"].alias("sum"),
            F.when(good & (state["first"] < 0), i).otherwise(state["first"]).alias("first"),
            F.when(good, i).otherwise(state["last"]).alias("last"),
        )

    def bind(value: Column, f) -> Column:
        return F.transform(F.array(value), f)[0]

    codes = F.transform(F.split(hit, ""), place)
    steps = F.transform(F.array(codes), lambda cs: F.transform(cs, lambda c, i: F.struct(c.alias("come"), F.get(cs, i - WINDOW).alias("go"), i.alias("i"))))[0]
    # the character that goes comes off first, so no count passes WINDOW
    step = lambda a, x: bind(put(a, x["go"], -1), lambda b: bind(put(b, x["come"], 1), lambda c: mark(c, x["i"])))
    return F.aggregate(F.filter(steps, lambda x: x["come"] > 0), start, step, lambda a: F.struct(a["first"], a["last"]))


def secret_scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, base and added (arrays of kind, start, end, hit).

    base has the fixed patterns' spans, leftmost and non-overlapping per kind: ``assign`` with a value of 8
    characters or more, ``access`` of 16 or more, ``hex`` of 32 or more; matches that fail are dropped and
    not tried again.  added has ``entropy`` spans: in runs of 20 or more characters of ALPHABET that touch
    no base span, aren't allow-listed and aren't inside an address or embedded image, windows of WINDOW characters slide; the span goes from the first
    to the last window that reaches the class's threshold.

    Null or empty text has no spans.  Repeated rows give repeated results, an empty table none; other
    columns are ignored.  All is done within the row, nothing shuffles; cheap tests spare most texts the
    patterns.  Patterns hold no nested repetition, so long texts neither blow the stack nor take square time.
    """
    t = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    low = ascii_lower(F.col("text"))
    flags = t.withColumns({"word": low.rlike("passw|secret|token|api_?key"), "akia": F.contains("text", F.lit("AKIA")), "run": F.col("text").rlike(CANDIDATE)})
    value = lambda x: F.length(F.regexp_extract(x["hit"], ASSIGN, 1)) >= 8
    base = flags.select(
        "doc_id",
        "text",
        F.filter(matches(F.col("text"), ASSIGN, "assign", F.col("word")), value).alias("assign"),
        F.filter(matches(F.col("text"), ACCESS, "access", F.col("akia")), lambda x: F.length(x["hit"]) >= 16).alias("access"),
        matches(F.col("text"), HEX, "hex", F.col("run")).alias("hex"),
        F.filter(matches(F.col("text"), CANDIDATE, "entropy", F.col("run")), lambda x: x["hit"].rlike("[0-9]") & x["hit"].rlike("[A-Za-z]") & ~x["hit"].rlike(ALLOWED)).alias("runs"),
    ).withColumn("base", F.concat("assign", "access", "hex"))
    # addresses are looked for only where runs are left
    addresses = F.filter(matches(F.col("text"), ALLOWED_HEAD + r"\S*+", "address", F.size("runs") > 0), lambda x: x["hit"].rlike(CANDIDATE))
    head = lambda a: a["start"] + F.length(F.regexp_extract(a["hit"], ALLOWED_HEAD, 0))
    tails = F.transform(addresses, lambda a: F.struct(head(a).alias("start"), a["end"].alias("end")))
    begin = lambda x: F.struct(x["start"].alias("start"), (x["start"] + 1).alias("end"))
    known = lambda x: meets(x, F.col("assign")) | meets(x, F.col("access")) | meets(x, F.col("hex"))
    # bound to a name, so that they are looked for once a text and not once a run
    left = F.transform(F.array(tails), lambda ts: F.filter("runs", lambda x: ~known(x) & ~meets(begin(x), ts)))[0]
    limit = lambda x: (
        F.when(x["hit"].rlike("^([0-9a-f]+|[0-9A-F]+)$"), THRESHOLDS["hex"]).when(x["hit"].rlike("^[A-Za-z0-9]+$"), THRESHOLDS["alnum"]).otherwise(THRESHOLDS["base64"])
    )
    found = F.transform("left", lambda x: F.struct(x["start"].alias("at"), x["hit"].alias("hit"), _entropy_bounds(x["hit"], limit(x)).alias("w")))
    cut = F.transform(
        F.filter("found", lambda x: x["w"]["first"] >= 0),
        lambda x: F.struct(
            F.lit("entropy").alias("kind"),
            (x["at"] + x["w"]["first"] - (WINDOW - 1)).alias("start"),
            (x["at"] + x["w"]["last"] + 1).alias("end"),
            F.substring(x["hit"], x["w"]["first"] - (WINDOW - 2), x["w"]["last"] - x["w"]["first"] + WINDOW).alias("hit"),
        ),
    )
    return base.withColumn("left", left).withColumn("found", found).select("doc_id", F.col("base").cast(SPAN).alias("base"), cut.cast(SPAN).alias("added"))


def secret_digest(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of secret_scan's rows."""
    n = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", *map(n, KINDS[:3]), F.sha2(joined(ordered(F.col("base"), KINDS, True)), 256).alias("base_sha256"), joined(ordered(F.concat("base", "added"), KINDS, True)).alias("spans")
    )
