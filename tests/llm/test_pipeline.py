"""The pipeline's stages and run() against brute force, with null and repeated ids."""

import base64
import hashlib
import random
from collections import Counter, defaultdict

import corpus_pipeline as P
import public_tokenizers
import pytest
import tiktoken
from driftmesh.llm.langid import identify_language, train
from driftmesh.llm.mixing import mix

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    rng = random.Random(4)
    text = lambda: [f"w{rng.choice('abcdefgh')}{rng.randrange(10**5)}" for _ in range(30)]
    base = [text() for _ in range(12)]
    near = lambda ws: " ".join([*ws[:15], "changed", *ws[16:]])
    out = []
    for i, ws in enumerate(base):
        t = f"A line that all of them have {i % 3}\n" + " ".join(ws)
        out += [(i, t), (i + 20, " ".join(ws)), (None, near(ws)) if i % 2 else (i, near(ws))]
    v = text()
    out += [(None, " ".join(v)), (None, near(v)), (None, " ".join(v)), (None, " ".join(text()) + "\nA line that all of them have 1"), (50, "1 2 3"), (None, "7"), (None, None)]
    out += [(40, " ".join(base[0]))] * 3 + [(41, z := " ".join(text()))] * 4 + [(42, " ".join(text())), (42, " ".join(text()))]
    return [(i, t, "en", ["s1", None, "s2"][k % 3], len(t or "")) for k, (i, t) in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


def got(df):
    assert df.columns == list(P.COLUMNS)
    return Counter(map(tuple, df.collect()))


def test_language_stage(spark, docs):
    told = {r["doc_id"]: not r["ambiguous"] for r in identify_language(spark.createDataFrame([(k, r[1]) for k, r in enumerate(rows())], "doc_id long, text string"), train(docs)).collect()}
    out = got(P.language(spark, docs, ""))
    assert out == Counter(r for k, r in enumerate(rows()) if told[k])
    assert sum(n for r, n in out.items() if r[0] is None) >= 8


def test_lines_stage(spark, docs):
    rid = lambda i: 2**63 - 1 if i is None else i
    key = lambda x: x.strip().lower()
    first = defaultdict(set)
    for r in rows():
        for x in (r[1] or "").split("\n"):
            if len(key(x)) >= 10:
                first[key(x)].add(rid(r[0]))
    want = Counter()
    for i, t, lang, source, _ in rows():
        t = "\n".join(x for x in (t or "").split("\n") if rid(i) == min(first.get(key(x), {rid(i)})))
        want[i, t, lang, source, len(t)] += 1
    assert got(P.lines(spark, docs, "")) == want


def brute_near(data):
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))) if (w := (r[1] or "").lower().split()) else None for r in data]
    comp = list(range(len(data)))
    for a in range(len(data)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = comp[a], comp[b]
                comp = [y if c == x else c for c in comp]
    groups = defaultdict(list)
    for r, c in zip(data, comp, strict=True):
        groups[c].append(r)
    return list(groups.values())


def check_near(out, groups):
    """All rows of the group's smallest id and no others; one row of a group without ids."""
    for g in groups:
        ids = [r[0] for r in g if r[0] is not None]
        if ids:
            out.subtract(r for r in g if r[0] == min(ids))
        else:
            one = next(r for r in g if out[r] > 0)
            out[one] -= 1
    assert not any(out.values())


def test_near_duplicates_stage(spark, docs):
    check_near(got(P.near_duplicates(spark, docs, "")), brute_near(rows()))


def check_mix(before, after, planned):
    """Rows of a source and size come as often as planned, no row more than three times or less than others by over one."""
    times = Counter()
    size = lambda r: len((r[1] or "").split())
    for r, n in after.items():
        assert 0 < n <= 3 * before[r]
        times[r[3], size(r)] += n
    want = Counter()
    for r in planned:
        want[r["source"], r["size"]] += r["repeats"]
    assert times == +want


def test_mixing_stage(spark, docs):
    check_mix(Counter(rows()), got(P.mixing(spark, docs, "")), mix(docs).collect())


def test_run(spark, docs, tmp_path):
    docs.coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    table = docs
    for _, stage in P.STAGES[:-1]:
        table = P.materialize(stage(spark, table, ""))
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
    out = P.run(spark, str(tmp_path)).collect()
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    tokens = Counter((r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in P.tokens(spark, table, "").collect())
    assert tokens == Counter((r["doc_id"], len(enc.encode_ordinary(r["text"])), digest(r["text"])) for r in table.collect())
    assert Counter((r["doc_id"]) for r in out).keys() == Counter(r["doc_id"] for r in table.collect()).keys()
    assert 0 < len(out) < 3 * len(rows()) and any(r["doc_id"] is None for r in out)
