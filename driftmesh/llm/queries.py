"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_encode
from .common import WS_CLASS, table
from .divergence import source_divergence
from .exact_dedup import exact_dedup
from .html_extract import extract_main_text
from .jaccard import jaccard_components
from .langid import held_out, identify_language, train
from .line_dedup import line_dedup
from .mixing import mix
from .periodic import periodic_runs
from .pii import find_pii, pii_digest
from .quality import quality_rules
from .secrets import secret_digest, secret_scan
from .url_filter import filter_urls

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
URL_RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bpe_encode(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, decode=True)
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), digest_all=True)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(secret_scan(table(spark, sf_dir, "documents")))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify_language(docs, train(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(find_pii(table(spark, sf_dir, "documents")))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


def op12_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES, max_chars=2000)  # the SQL learns from URLs of up to 2000 characters


def planted(docs: DataFrame) -> DataFrame:
    """doc_id, text: documents whose crc32 of the id is divisible by 10 get a periodic end, from word a on with period p; a null id gets none."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), f"{WS_CLASS}+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).cast("long").alias("g"), F.when(h % 10 == 0, words).alias("ws"))
    rows = rows.withColumn("n", F.size("ws")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    source = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("ws", source(i))), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, text).otherwise(F.col("text")).alias("text"))


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = periodic_runs(planted(table(spark, sf_dir, "documents")))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("minus"), r["start"].alias("start"), r["period"].alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))), "")
    found = rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("x"), listed.alias("listed"), "text")
    return found.select(
        "doc_id",
        "n_runs",
        "x.start",
        (-F.col("x.minus")).alias("length"),
        "x.period",
        F.floor(-1000 * F.col("x.minus") / F.col("x.period")).cast("long").alias("exponent_milli"),
        F.sha2("listed", 256).alias("runs_sha256"),
        F.sha2("text", 256).alias("collapsed_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_line_dedup, op2_bpe, op3_mixing, op4_exact_dedup, op5_quality, op6_jaccard, op7_html, op8_secrets, op9_language, op10_pii, op11_divergence, op12_urls, op13_periodic)
    return {f.__name__: f for f in own}


_TRIM = r"regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, ls[i] AS x, i FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
k AS (SELECT doc_id, x, i, {_LOWER.format(_TRIM)} AS key FROM l),
r AS (SELECT key, min(doc_id) AS lo FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1)
SELECT k.doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (r.lo < k.doc_id)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (r.lo IS NULL OR r.lo = k.doc_id), '')) AS kept_sha256
FROM k LEFT JOIN r USING (key) GROUP BY k.doc_id"""

OP4_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  doc_id = first(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)"""

OP6_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 4], ' ') END AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r(doc_id, to_id) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.to_id)
SELECT d.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(r.to_id) AS component_id
FROM documents d JOIN r ON r.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id"""

OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
t AS (SELECT row, lang, source, unnest(regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
v AS (SELECT lang, term, count(*) AS c FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
o AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN v USING (lang, term) GROUP BY ALL),
f AS (SELECT g.lang, g.source, v.term, coalesce(o.n, 0) AS n, v.c FROM g JOIN v USING (lang) LEFT JOIN o USING (lang, source, term)),
p AS (SELECT lang, source, term, n,
  1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER w + 5 * count(*) OVER w) AS p,
  1 + (1000000000::HUGEINT * (c + 5)) // (sum(c) OVER w + 5 * count(*) OVER w) AS q
  FROM f WINDOW w AS (PARTITION BY lang, source)),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank FROM (
  SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM r)
WHERE part = 'pair' OR rank <= 50"""


def op12_sql(order: int = 4, weight: float = 4.0) -> str:
    """The same models in SQL."""
    w, top = f"{weight}::DOUBLE", order + 1

    def fits(rule: str) -> str:
        h, _, p = rule.partition("/")
        return f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}')"

    longest_first = sorted(URL_RULES, key=lambda r: -len(r[0]))
    case = lambda i: "CASE " + " ".join(f"WHEN {fits(r[0])} THEN '{r[i]}'" for r in longest_first) + " END"
    marked = f"repeat(chr(2), {order}) || coalesce(url, '') || chr(3)"
    share = lambda x, p: f"(n{x} + {w} * {p}) / (c{x} + {w}) AS p{x}"
    levels = [f"p1 AS (SELECT k.g, {share('a', '(1.0::DOUBLE / chars)')}, {share('r', '(1.0::DOUBLE / chars)')} FROM k JOIN c ON c.h = '', chars WHERE n = 1 AND na + nr >= 2)"]
    for n in range(2, top + 1):
        levels.append(f"p{n} AS (SELECT k.g, {share('a', 'p.pa')}, {share('r', 'p.pr')} FROM k JOIN c ON c.h = left(k.g, {n - 1}) JOIN p{n - 1} p ON p.g = right(k.g, {n - 1}) WHERE n = {n} AND na + nr >= 2)")
    less = lambda n: "".join(f" + coalesce(b{j}.b, 0)" for j in range(n, top))
    value = "CASE " + " ".join(f"WHEN d{n}.d IS NOT NULL THEN d{n}.d{less(n)}" for n in range(top, 0, -1)) + f" ELSE root{less(1)} END"
    joins = " ".join(f"LEFT JOIN m d{n} ON d{n}.g = substr(s, i - {n - 1}, {n})" for n in range(1, top + 1)) + " " + " ".join(f"LEFT JOIN m b{n} ON b{n}.g = substr(s, i - {n}, {n})" for n in range(1, top))
    return rf"""
WITH u AS (SELECT page_id, url, {_LOWER.format("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")} AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
v AS (SELECT *, {case(0)} AS rule, {case(1)} AS said FROM u),
l AS (SELECT DISTINCT url, said = 'allow' AS acc, left(md5(url), 1) < '4' AS held FROM v WHERE rule IS NOT NULL AND length(url) <= 2000),
f AS (SELECT acc, t.n, substr(s, i - t.n + 1, t.n) AS g FROM (SELECT acc, {marked} AS s, unnest(range({top}, {order} + length(url) + 2)) AS i FROM l WHERE NOT held), range(1, {top + 1}) t(n)),
k AS (SELECT n, g, count(*) FILTER (acc) AS na, count(*) FILTER (NOT acc) AS nr FROM f GROUP BY n, g),
c AS (SELECT left(g, n - 1) AS h, sum(na)::BIGINT AS ca, sum(nr)::BIGINT AS cr FROM k GROUP BY 1),
chars AS (SELECT count(*) + 1 AS chars FROM k WHERE n = 1),
{", ".join(levels)},
b AS (SELECT h, round(ln((cr + {w}) / (ca + {w})) * 1000000)::BIGINT AS b FROM c),
m AS (SELECT g, round(ln(pa / pr) * 1000000)::BIGINT AS d, coalesce(b, 0) AS b FROM ({" UNION ALL ".join(f"SELECT * FROM p{n}" for n in range(1, top + 1))}) LEFT JOIN b ON h = g),
root AS (SELECT b AS root FROM b WHERE h = ''),
x AS (SELECT url, s, unnest(range({top}, length(s) + 1)) AS i FROM (SELECT DISTINCT coalesce(url, '') AS url, {marked} AS s FROM v WHERE rule IS NULL UNION SELECT url, {marked} FROM l WHERE held)),
y AS (SELECT url, sum({value})::BIGINT::DOUBLE / (count(*) * 1000000)::DOUBLE AS score FROM x {joins}, root GROUP BY url),
z AS (SELECT floor(score * 1000)::BIGINT AS v, count(*) FILTER (acc) AS a, count(*) FILTER (NOT acc) AS r FROM l JOIN y USING (url) WHERE held GROUP BY 1),
t AS (SELECT coalesce(sum(a), 0) AS accepted, coalesce(sum(r), 0) AS rejected FROM z),
w AS (SELECT v AS lo, lead(v) OVER (ORDER BY v) AS hi, sum(a) OVER (ORDER BY v) AS lost, sum(r) OVER (ORDER BY v) AS caught FROM z UNION ALL SELECT NULL, min(v), 0, 0 FROM z),
cuts AS (SELECT lost * rejected + (rejected - caught) * accepted AS err, least(CASE WHEN lo IS NULL THEN 0 ELSE greatest(lo + 1, 0) END, coalesce(hi, 1000000000)) AS place FROM w, t WHERE accepted > 0 AND rejected > 0),
cut AS (SELECT coalesce((SELECT place FROM cuts ORDER BY err, abs(place), place LIMIT 1), 0) AS place)
SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN said WHEN floor(score * 1000) >= place THEN 'allow' ELSE 'block' END AS verdict, CASE WHEN rule IS NULL THEN score END AS score
FROM v LEFT JOIN y ON y.url = coalesce(v.url, '') AND rule IS NULL, cut"""


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1_SQL, "op4_exact_dedup": OP4_SQL, "op6_jaccard": OP6_SQL, "op11_divergence": OP11_SQL, "op12_urls": op12_sql()}
