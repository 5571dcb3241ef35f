"""Personal data: generators propose spans, boosted trees score them, calibrated thresholds select; DataFrame functions only."""

from __future__ import annotations

import json
import math
import random
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .spans import SPAN, groups, joined, matches, meets, ordered, overlaps, part_of, pieces

#: Fixed patterns of the base.  Possessive repetition and what stands before \G or a run's start change no
#: match; they keep long runs from taking square time or deep stacks.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
PART = r"^0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})$"

#: Generators of high recall.  Their spans may overlap: anything around an at-sign, also a written one; digits with
#: up to three separators between them, once with spaces and once without.
LOOSE_AT = r"(?:\G|(?<![^\s@<>()\[\]]))[^\s@<>()\[\]]++(?:@|\x20?[\[(](?:at|AT)[\])]\x20?)[^\s@<>()\[\]]++(?:\x20?[\[(](?:dot|DOT)[\])]\x20?[A-Za-z0-9-]++)*+"
LOOSE_NUMBER = r"[+(]?[0-9](?:[\x20().-]{0,3}+[0-9])++"
TIGHT_NUMBER = r"[+(]?[0-9](?:[().-]{0,2}+[0-9])++"
#: Numbers of fewer digits are no candidates.
LEAST_DIGITS = 7
#: A candidate's context is so many characters before it.
CONTEXT = 24
#: Contexts are looked up in pieces of so many characters.
PIECE = 1024


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's test."""
    double = lambda d: d * 2 - F.when(d > 4, 9).otherwise(0)
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, double(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """The base's spans of each kind; failing matches are dropped, not tried again."""
    n = lambda x: F.length(_digits(x["hit"]))
    digit = text.rlike("[0-9]")
    return {
        "email": matches(text, EMAIL, "email", F.contains(text, F.lit("@"))),
        "ip": F.filter(matches(text, IP, "ip", digit), lambda x: F.forall(F.split(x["hit"], r"\."), lambda p: p.rlike(PART))),
        "card": F.filter(matches(text, CARD, "card", digit), lambda x: n(x).between(13, 19) & luhn(_digits(x["hit"]))),
        "phone": F.filter(matches(text, PHONE, "phone", F.contains(text, F.lit("+"))), lambda x: n(x).between(9, 15)),
    }


#: Features of a candidate and how many levels (from 0) each has; their product bounds the number of profiles.
LEVELS = {"digits": 7, "dots": 4, "plus": 2, "at": 4, "gaps": 3, "luhn": 2, "parts": 2, "shape": 6, "context": 6, "glued": 2}


def _profile(x: Column, text: Column) -> Column:
    """Format and context features of a candidate, each a small number; ``text`` is the text in pieces."""
    hit, d = x["hit"], F.length(_digits(x["hit"]))
    before = F.lower(part_of(text, PIECE, F.greatest(x["start"] - CONTEXT, F.lit(0)), F.least(x["start"], F.lit(CONTEXT))))
    after = part_of(text, PIECE, x["end"], F.lit(2))
    inner = F.regexp_replace(hit, r"^[^0-9]+|[^0-9]+$", "")
    host = r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++|\x20?[\[(](?:dot|DOT)[\])]\x20?[A-Za-z0-9-]++)++[.,;:!?]?$"  # possessive, so that long ones need no deep stack
    flag = lambda c: c.cast("int")
    f = {
        "digits": F.when(d < 7, 0).when(d < 9, 1).when(d < 12, 2).when(d < 13, 3).when(d < 16, 4).when(d < 20, 5).otherwise(6),
        "dots": F.least(F.length(hit) - F.length(F.replace(hit, F.lit("."), F.lit(""))), F.lit(3)),
        "plus": flag(hit.rlike(r"^\+")),
        "at": F.when(hit.rlike(r"^[A-Za-z0-9._%+-]+@" + host), 3).when(hit.rlike(r"^[A-Za-z0-9._%+-]+\x20?[\[(](at|AT)[\])]\x20?" + host), 2).when(hit.rlike(r"@|[\[(](at|AT)[\])]"), 1).otherwise(0),
        "gaps": F.when(hit.rlike(r"[\x20().-]{3}"), 2).when(hit.rlike(r"[\x20()-]"), 1).otherwise(0),
        "luhn": flag(F.when(d.between(13, 19), luhn(_digits(hit))).otherwise(False)),
        "parts": flag(inner.rlike(r"^[0-9]+(\.[0-9]+){3}$") & F.forall(F.split(inner, r"\."), lambda p: p.rlike(PART))),
        "shape": F.when(hit.rlike(r"^(\+?1[\x20.-]?)?\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}$"), 1)
        .when(hit.rlike(r"^([0-9]{4}[\x20.-]+){3}[0-9]{1,7}$"), 2)
        .when(hit.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|^[0-9]{1,2}[.-][0-9]{1,2}[.-][0-9]{2,4}"), 3)
        .when(hit.rlike(r"^\(?0[0-9]*\)?[\x20().-]+[0-9]"), 4)
        .when(hit.rlike(r"^[0-9]+$"), 5)
        .otherwise(0),
        "context": F.when(before.rlike(r"e-?mail|write to"), 1).when(before.rlike(r"\btel|phone|\bcall|\bfax|mobile|\bcell\b|whatsapp"), 2).when(before.rlike(r"\bcard|visa|mastercard|iban"), 3)
        .when(before.rlike(r"\bip\b|host|server"), 4).when(before.rlike(r"order|isbn|version|release|invoice|ticket|\bid\b|total|price|\bno\b"), 5).otherwise(0),
        "glued": flag(F.substring(before, -1, 1).rlike(r"[\w.-]") | after.rlike(r"^[\w]|^[.-][0-9]")),
    }
    return F.struct(*[f[k].cast("int").alias(k) for k in LEVELS])


def with_candidates(rows: DataFrame) -> DataFrame:
    """Adds base (the base's spans) and cands: spans of all generators with their profiles; known: whether a base span overlaps."""
    text = F.col("text")
    digits = text.rlike("[0-9](?:[\\x20().-]{0,3}[0-9]){6}")
    loose = F.concat(
        matches(text, LOOSE_AT, "email", text.rlike(r"@|[\[(](?:at|AT)[\])]")),
        matches(text, LOOSE_NUMBER, "number", digits),
        matches(text, TIGHT_NUMBER, "number", digits),
    )
    enough = F.filter(loose, lambda x: (x["kind"] == "email") | (F.length(_digits(x["hit"])) >= LEAST_DIGITS))
    rows = rows.withColumns({f"__{k}": v.cast(SPAN) for k, v in base_spans(text).items()}).withColumn("__loose", enough)
    rows = rows.withColumn("__pieces", F.when(F.size("__loose") > 0, pieces(text, PIECE)))
    known = lambda x: meets(x, F.col("__email")) | meets(x, F.col("__ip")) | meets(x, F.col("__card")) | meets(x, F.col("__phone"))
    scored = F.transform(
        "__loose", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["hit"].alias("hit"), known(x).alias("known"), _profile(x, F.col("__pieces")).alias("p"))
    )
    base = F.concat(*[F.col(f"__{k}") for k in KINDS])
    return rows.withColumns({"base": base, "cands": scored}).drop("__loose", "__pieces", *[f"__{k}" for k in KINDS])


#: Made-up forms by family; 9 stands for any digit, 8 for one that isn't 0, L for a checked card, N for one that fails
#: the check, w for a word, P for a part of an address (0 to 255).
PRIVATE = {
    "email": ("w.w@w.com", "w99@mail.w.org", "e-mail w@w-w.net"),
    "written_at": ("w.w [at] w.com", "w (at) w.w.org", "w99 [AT] w [dot] net", "write to w[at]w.de", "w (at) w (dot) com"),
    "ip": ("P.P.P.P", "host P.P.P.P", "server P.P.P.P"),
    "card": ("L", "card L", "L with dots", "visa L with dots", "L with two spaces"),
    "phone_plus": ("+8 (999) 999-9999", "+89 99 9999999", "tel +89.99.9999999"),
    "phone_groups": ("(899) 999-9999", "899-999-9999", "call 899-999-9999", "phone (899) 999-9999", "899 999-9999"),
    "phone_dots": ("899.999.9999", "call 899.999.9999", "mobile 899.999.9999"),
    "phone_zero": ("0089 99 9999999", "tel 089 9999999", "phone (089) 999 99 99", "fax 089-99999", "call 089 99 99 99 99"),
    "phone_near_word": ("tel 899-9999", "call 8999999", "phone 899 9999", "mobile 89999999999", "fax 8999999"),
}
PUBLIC = (
    "8999-01-22", "22.01.2024 11-30", "release 8.9.9.9.9", "version 8.99.999.9999", "isbn 978-8-99-999999-9", "order 899999999", "order 8999999999999", "N", "card N", "89999999999", "899999999999",
    "8990-8995 2001-2005", "total 8.999.999.999", "52.89999 13.49999", "899 999 999 999", "89 99 999 9 99 999", "3.89999999", "@w", "w @ w", "w@w", "w@", "899.999.999", "invoice 2024-999999", "id 8999-9999-99",
    "8 999 999", "price 8.999.999", "8999999", "89999999", "ticket 89999999", "8-9-9-9-9-9-9-9", "899999999999999999999999", "P.P.P.999", "8.9.9 999.999", "8999 9999", "11:22 8999 999 999", "no 899-999",
)


#: Words before a form's span.
LEAD = re.compile(r"(?:(?:e-mail|write to|host|server|card|visa|tel|call|phone|mobile|fax|release|version|isbn|order|total|invoice|id|price|ticket|no|11:22) )?")


def labelled_texts(n: int, seed: int, without: tuple[str, ...] = ()) -> list[tuple[str, int, int]]:
    """Made-up texts, each with one span and its places; an empty span where the text has nothing private."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvwyz") for _ in range(rng.randint(2, 8)))
    families = [k for k in PRIVATE if k not in without]

    def card(good: bool) -> str:
        d = [rng.choice("3456")] + [rng.choice("0123456789") for _ in range(rng.choice((14, 14, 13, 11)))]
        total = sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(d)))
        check = (-total) % 10
        d.append(str(check if good else (check + rng.randint(1, 9)) % 10))
        return "".join(d)

    def grouped(x: str, by: str) -> str:
        return by.join(x[i : i + 4] for i in range(0, len(x), 4))

    def made(form: str) -> tuple[str, str]:
        """What stands before, and the span."""
        lead = LEAD.match(form)[0]
        form = form[len(lead) :]
        if form[:1] in "LN":
            x = card(form[0] == "L")
            return lead, grouped(x, "." if "dots" in form else "  ") if "with" in form else rng.choice((x, grouped(x, " "), grouped(x, "-")))
        one = {"9": lambda: rng.choice("0123456789"), "8": lambda: rng.choice("123456789"), "w": word, "P": lambda: str(rng.randint(0, 255))}
        return lead, "".join(one[c]() if c in one and not form[i - 1 : i + 2].isalpha() else c for i, c in enumerate(form))

    rows = []
    for i in range(n):
        private = i % 2 == 0
        lead, x = made(rng.choice(PRIVATE[rng.choice(families)] if private else PUBLIC))
        before = "".join(word() + " " for _ in range(rng.randint(0, 6))) + lead
        after = rng.choice(["", "", ".", ","]) + "".join(" " + word() for _ in range(rng.randint(1, 6)))
        rows.append((before + x + after, len(before) if private else 0, len(before) + len(x) if private else 0))
    return rows


def _tallies(spark: SparkSession, texts: list[tuple[str, int, int]]) -> list[tuple[dict[str, int], int, int]]:
    """How many candidates of each profile are a labelled span (ends may be off by one), and how many aren't; parts of one don't count."""
    made = json.dumps([{"text": t, "s": a, "e": b} for t, a, b in texts])
    t = spark.range(1).select(F.explode(F.from_json(F.lit(made), "array<struct<text:string,s:int,e:int>>")).alias("r")).select("r.*").repartition(8)
    each = with_candidates(t).select("s", "e", F.explode("cands").alias("x"))
    hit = (F.col("e") > 0) & (F.abs(F.col("x.start") - F.col("s")) <= 1) & (F.abs(F.col("x.end") - F.col("e")) <= 1)
    part = (F.col("x.start") >= F.col("s") - 1) & (F.col("x.end") <= F.col("e") + 1)
    rows = each.where(hit | ~part).groupBy(F.col("x.p").alias("p")).agg(F.sum(hit.cast("long")).alias("pos"), F.count("*").alias("n")).collect()
    return sorted(((r["p"].asDict(), r["pos"], r["n"] - r["pos"]) for r in rows), key=lambda x: tuple(x[0].values()))


@dataclass
class Node:
    """A tree: a leaf's value, or a split (feature <= cut goes left)."""

    value: float = 0.0
    feature: str = ""
    cut: int = 0
    left: Node | None = None
    right: Node | None = None

    def score(self, p: dict[str, int]) -> float:
        if self.left is None:
            return self.value
        return (self.left if p[self.feature] <= self.cut else self.right).score(p)

    def column(self, p: Column) -> Column:
        if self.left is None:
            return F.lit(self.value)
        return F.when(p[self.feature] <= self.cut, self.left.column(p)).otherwise(self.right.column(p))


def _grow(rows: list, depth: int, rate: float) -> Node:
    """rows: (profile, gradient sum, hessian sum).  The split that gains most, as in second-order boosting."""
    g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    leaf, gain, best = Node(rate * g / (h + 1.0)), 1e-6, None
    for f, n in LEVELS.items() if depth else ():
        for cut in range(n - 1):
            a = [r for r in rows if r[0][f] <= cut]
            if a and len(a) < len(rows):
                ga, ha = sum(r[1] for r in a), sum(r[2] for r in a)
                now = ga**2 / (ha + 1) + (g - ga) ** 2 / (h - ha + 1) - g**2 / (h + 1)
                if now > gain:
                    gain, best = now, (f, cut)
    if not best:
        return leaf
    f, cut = best
    return Node(0.0, f, cut, _grow([r for r in rows if r[0][f] <= cut], depth - 1, rate), _grow([r for r in rows if r[0][f] > cut], depth - 1, rate))


def boost(counts: list[tuple[dict[str, int], int, int]], rounds: int = 20, depth: int = 4, rate: float = 0.5) -> list[Node]:
    """Gradient-boosted trees for logistic loss over (profile, positives, negatives)."""
    trees: list[Node] = []
    scores = [0.0] * len(counts)
    for _ in range(rounds if counts else 0):
        rows = []
        for (p, pos, neg), s in zip(counts, scores, strict=True):
            q = 1 / (1 + math.exp(-s))
            rows.append((p, pos - (pos + neg) * q, (pos + neg) * q * (1 - q)))
        trees.append(_grow(rows, depth, rate))
        scores = [s + trees[-1].score(p) for (p, _, _), s in zip(counts, scores, strict=True)]
    return trees


def calibrate(counts: list[tuple[dict[str, int], int, int]], trees: list[Node], precision: float = 0.98) -> float | None:
    """The lowest score from which up the candidates' precision is kept; None if there is none."""
    scored = sorted(((sum(t.score(p) for t in trees), pos, neg) for p, pos, neg in counts), key=lambda x: -x[0])
    best, pos, neg = None, 0, 0
    for i, (s, a, b) in enumerate(scored):
        pos, neg = pos + a, neg + b
        if (i + 1 == len(scored) or scored[i + 1][0] < s - 1e-9) and pos >= precision * (pos + neg) and s > 0:
            best = s
    return best


@dataclass
class Detector:
    trees: list[Node]
    least: float | None


def train(spark: SparkSession, texts: int = 4000, precision: float = 0.98, without: tuple[str, ...] = ()) -> Detector:
    """Trees from one half of ``texts`` made-up texts, the threshold from the other; profiles are counted by the same columns that the scan uses."""
    trees = boost(_tallies(spark, labelled_texts(texts // 2, 1, without)))
    return Detector(trees, calibrate(_tallies(spark, labelled_texts(texts // 2, 2, without)), trees, precision))


def find_pii(docs: DataFrame, detector: Detector | None = None) -> DataFrame:
    r"""One row per document: doc_id, base and added (arrays of kind, start, end, hit).

    base has the fixed patterns' spans (see ``base_spans``) and always stays.  Generators of high recall
    propose further spans, which may overlap (see ``with_candidates``).  Each has a profile of small format and
    context features, the context being the CONTEXT characters before it.  Boosted trees, trained on
    made-up labelled texts with forms that the base lacks and with look-alikes that aren't private, score
    the profile; they are column expressions.  The threshold is the lowest that keeps the precision on
    texts that the trees haven't seen.  Candidates above it that overlap no base span are added, the
    highest first where they overlap each other, the longer first of equals.

    Without ``detector`` one is trained.  Null or empty text has no spans.  Repeated rows give repeated
    results, an empty table none.  Other columns are ignored.  Texts are read once and nothing shuffles.
    Time grows with text and matches, not with the square of the matches, but for spans that overlap in one long chain.
    """
    detector = detector or train(docs.sparkSession)
    t = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if detector.least is None:
        return t.select("doc_id", F.concat(*base_spans(F.col("text")).values()).cast(SPAN).alias("base"), F.array().cast(SPAN).alias("added"))
    rows = with_candidates(t).withColumn("cands", F.filter("cands", lambda x: ~x["known"]))
    score = lambda p: sum((tree.column(p) for tree in detector.trees[1:]), detector.trees[0].column(p))
    scored = F.transform("cands", lambda x: F.struct(x["start"].alias("start"), (x["start"] - x["end"]).alias("short"), (-score(x["p"])).alias("s"), x["end"].alias("end"), x["kind"].alias("kind"), x["hit"].alias("hit")))
    new = F.sort_array(F.filter(scored, lambda x: x["s"] <= -detector.least + 1e-9))
    best_first = lambda xs: F.sort_array(F.transform(xs, lambda x: F.struct(x["s"].alias("s"), x["short"].alias("short"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), x["hit"].alias("hit"))))
    span = lambda x: F.struct(_kind(x["kind"], x["hit"]).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["hit"].alias("hit"))
    # of spans that meet, directly or by others between them, the best is taken first
    picked = lambda xs: F.aggregate(best_first(xs), F.array().cast(SPAN), lambda a, x: F.when(overlaps(x, a), a).otherwise(F.concat(a, F.array(span(x))).cast(SPAN)))
    rows = rows.withColumn("new", F.when(F.size("cands") > 0, new).otherwise(F.slice(new, 1, 0)))
    return rows.select("doc_id", "base", F.when(F.size("new") == 0, F.array().cast(SPAN)).otherwise(F.flatten(F.transform(groups(F.col("new")), picked)).cast(SPAN)).alias("added"))


def _kind(kind: Column, hit: Column) -> Column:
    n = F.length(_digits(hit))
    return F.when(kind == "email", kind).when(hit.rlike(r"^[0-9]+(\.[0-9]+){3}$"), "ip").when(hit.rlike(r"^\+") | (n < 13), "phone").otherwise("card")


def pii_digest(found: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_spans (all spans) of find_pii's rows."""
    n = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", *map(n, KINDS), F.sha2(joined(ordered(F.col("base"), KINDS, False)), 256).alias("base_sha256"), joined(ordered(F.concat("base", "added"), KINDS, False)).alias("spans"),
        (F.size("base") + F.size("added")).cast("long").alias("n_spans"),
    )
