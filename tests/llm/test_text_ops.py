"""The training-data operators against brute force, on small made-up tables and on whole sf0.001 tables."""

import base64
import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import public_tokenizers
import pytest
import tiktoken
from driftmesh.llm import queries as Q
from driftmesh.llm.bpe import bpe_decode, bpe_encode
from driftmesh.llm.exact_dedup import exact_dedup
from driftmesh.llm.jaccard import jaccard_components
from driftmesh.llm.line_dedup import line_dedup
from driftmesh.llm.mixing import fit_budget, mix

WS = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, h string, n string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def rows():
    rng = random.Random(3)
    w = [f"w{i}" for i in range(40)] + ["Ünï", "AB", "ab", "'s", "1234", "x y"]
    base = [" ".join(rng.choice(w) for _ in range(rng.randint(0, 60))) for _ in range(25)]
    texts = [None, "", " \t\n ", "\n\n", "one two", "one two", "ONE  two", "only five words are here", "a" * 5000, "a b " * 3000]
    for t in base:
        ws = t.split(" ")
        near = ws[:]
        if near:
            near[rng.randrange(len(near))] = "changed"
        texts += [t, t.upper() if rng.random() < 0.3 else t, " ".join(near), "A shared line of text\n" + t + "\n  a SHARED line of text \t\nshort\nshort", t.replace(" ", "\n", 3)]
    out = [(i * 3, t, "en", [None, "s1", "S2", "s3"][i % 4], None, "clash", "clash", "clash") for i, t in enumerate(texts)]
    return out + [(None, "null id\nA shared line of text", None, None, None, "c", None, None), out[15], out[15]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs, empty):
    norm = lambda t: (t or "").translate({ord(c): None for c in WS})
    groups = defaultdict(list)
    for r in rows():
        groups[norm(r[1])].append(r)
    want = Counter()
    for k, g in groups.items():
        keep = min(g, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0]))[0]
        for r in g:
            want[r[0], keep, len(g), r[0] == keep, sha(k)] += 1
    for broadcast in (1_000_000, 0):
        assert Counter(map(tuple, exact_dedup(docs, broadcast_rows=broadcast, digest_all=True).collect())) == want
    assert exact_dedup(empty).count() == 0


def test_line_dedup(docs, empty):
    key = lambda x: x.strip(WS).translate(LOWER)
    big = 2**63 - 1
    holders = defaultdict(set)
    for r in rows():
        for x in (r[1] or "").split("\n"):
            if len(key(x)) >= 10:
                holders[key(x)].add(big if r[0] is None else r[0])
    want = Counter()
    for r in rows():
        ls = (r[1] or "").split("\n")
        kept = [x for x in ls if not (len(h := holders.get(key(x), ())) > 1 and min(h) < (big if r[0] is None else r[0]))]
        want[r[0], "\n".join(kept), len(ls), len(ls) - len(kept)] += 1
    for bits in (29, 3):  # a filter that is full lets lines through; results stay
        assert Counter(map(tuple, line_dedup(docs, max_log2_bits=max(bits, 20)).collect())) == want
    assert line_dedup(empty).count() == 0


def encoding():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(spark, docs, empty):
    enc, path = encoding(), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rng = random.Random(1)
    alphabet = "ab cd\n\t  éß中文'sll've’123٣!?\x1c\x85  🙂\x0b"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(400)] + ["xyzq" * 900 + " " + "\n" * 300, "abcab" * 79]
    texts += ["".join(rng.choice(["word ", " two", "  spaces", " \n", f"{rng.randrange(10**6)}."]) for _ in range(3000)) for _ in range(3)]
    odd = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for df in (docs, odd):
        got = bpe_encode(df, path, public_tokenizers.PATTERN, decode=True)
        want = Counter((r["doc_id"], tuple(enc.encode_ordinary(r["text"] or "")), (r["text"] or "").encode()) for r in df.select("doc_id", "text").collect())
        assert Counter((r["doc_id"], tuple(r["ids"]), bytes(r["decoded"])) for r in got.collect()) == want
        back = bpe_decode(got.select("doc_id", "ids"), path, public_tokenizers.PATTERN)
        assert Counter((r["doc_id"], bytes(r["decoded"])) for r in back.collect()) == Counter((i, t) for i, _, t in want.elements())
    assert bpe_encode(empty, path, public_tokenizers.PATTERN).count() == 0


def test_bpe_with_small_rounds_and_a_full_cache(monkeypatch):
    """Rounds of a few rows, words that push each other out of the cache, and long words by the heap give the same ids."""
    from driftmesh.llm import bpe

    enc = encoding()
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(0, 50))) + "  x" * rng.randint(0, 3) for _ in range(300)]
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        vocabulary = f.read()
    for places, long_word, a_query in ((64, 400, 20_000), (1 << 12, 12, 300)):
        monkeypatch.setattr(bpe, "CACHE_PLACES", places)
        monkeypatch.setattr(bpe, "LONG_WORD", long_word)
        monkeypatch.setattr(bpe, "WORDS_A_QUERY", a_query)
        coder = bpe.Coder(vocabulary, public_tokenizers.PATTERN)
        for a in [*range(0, 300, 40), 0]:
            ids, cut = coder.encode(texts[a : a + 40])
            want = [enc.encode_ordinary(t) for t in texts[a : a + 40]]
            assert [ids[x:y].tolist() for x, y in zip(cut[:-1], cut[1:], strict=True)] == want
            data, cut = coder.decode(ids, cut)
            assert [bytes(data[x:y]).decode() for x, y in zip(cut[:-1], cut[1:], strict=True)] == texts[a : a + 40]


def water(sizes):
    """Targets by repeated resharing."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        share = {s: left * weight[s] / sum(weight[x] for x in names if x not in full) for s in names if s not in full}
        above = {s for s in share if share[s] > 3 * sizes[s]}
        if not above:
            return {s: 3.0 * sizes[s] if s in full else share[s] for s in names}
        full |= above


@pytest.mark.parametrize("skew", [False, True])
def test_mixing(spark, docs, empty, skew):
    df = docs
    if skew:  # small sources with great weights, and many documents of one size
        data = [(i, "w " * (1 if i % 3 else i % 50), f"s{min(i, 4) if i < 40 else 9}") for i in range(600)]
        df = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = mix(df).collect()
    sizes = Counter()
    for r in df.collect():
        sizes[r["source"]] += len(words(r["text"]))
    want = water(sizes)
    taken = Counter()
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        taken[r["source"]] += r["taken"]
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    for s, t in want.items():
        assert taken[s] <= t + 1e-6 and t - taken[s] < max((r["size"] for r in got if r["source"] == s), default=0) + 1
    assert len(got) == df.count() and Counter(map(tuple, got)) == Counter(map(tuple, mix(df).collect()))
    assert mix(empty).count() == 0


def test_fit_budget_is_the_best_sum():
    """Against all sums there are."""
    import numpy as np

    rng = np.random.default_rng(2)
    for case in range(2000):
        lengths = np.unique(rng.integers(0, 30, 6)) * (1 if case % 5 else 40_000)
        counts = rng.integers(1, 4, len(lengths))
        total = int((lengths * counts).sum())
        budget = int(rng.integers(0, max(total, 1) * 1.1 + 5)) if case % 3 else int(rng.integers(0, 30)) * 40_000 + 7
        sums = {0}
        for x, n in zip(lengths.tolist(), counts.tolist(), strict=True):
            sums = {s + k * x for s in sums for k in range(n + 1)}
        take = fit_budget(lengths, counts, budget)
        assert (take >= 0).all() and (take <= counts).all()
        assert (lengths * take).sum() == max(s for s in sums if s <= budget), (lengths, counts, budget)
    for lengths, counts, budget, want in (([240_000, 250_000], [1, 1], 260_000, 250_000), ([250_001, 251_003, 252_007], [1, 1, 1], 260_000, 252_007), ([5, 8, 13, 20, 22], [3, 3, 2, 1, 2], 120, 119)):
        assert (np.array(lengths) * fit_budget(np.array(lengths), np.array(counts), budget)).sum() == want


def test_fit_budget_is_even_and_whole_on_many_documents():
    import numpy as np

    rng = np.random.default_rng(4)
    lengths = np.unique(rng.integers(1, 20_000, 3000))
    counts = rng.integers(1, 400, len(lengths))
    budget = int((lengths * counts).sum() * 0.37)
    take = fit_budget(lengths, counts, budget)
    assert (lengths * take).sum() == budget
    half = len(lengths) // 2
    for part in (slice(0, half), slice(half, None)):
        assert take[part].sum() / counts[part].sum() == pytest.approx(0.37, abs=0.01)


def brute_components(data):
    sets = {}
    for i, t in data:
        w = words((t or "").translate(LOWER))
        sets.setdefault(i, set()).update({tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set())
    ids = sorted(sets)
    comp = {i: i for i in ids}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                comp[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_shingle_sets_tell_the_same_windows_apart(monkeypatch):
    """Hashes are equal just where word windows are, whatever else is hashed at the same time."""
    from driftmesh.llm import jaccard

    rng = random.Random(7)
    texts = [r[1] for r in rows()] + ["ab ba", "ba ab", "a b", "b a", "Ünï ünï", "ÜNÏ", "a\x0bb\x1cc d", " lead and trail "] + [" ".join(rng.choice(["x", "xx", "y", "yx", "xy", "X", "é"]) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    names: dict = {}
    for at_once in (500_000, 40):
        monkeypatch.setattr(jaccard, "AT_ONCE", at_once)
        for t, v in zip(texts, jaccard.shingle_sets(texts), strict=True):
            w = words((t or "").translate(LOWER))
            want = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()
            assert len(v) == len(want) and (v[1:] > v[:-1]).all()
            names.setdefault(frozenset(want), set()).add(v.tobytes())
    assert all(len(x) == 1 for x in names.values()) and len(names) == len({min(x) for x in names.values()})


def test_jaccard_small(docs, empty):
    data = [(r[0], r[1]) for r in rows() if r[0] is not None]
    want = brute_components(data)
    got = jaccard_components(docs).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None) == Counter((i, *want[i]) for i, _ in data)
    assert sum(r["doc_id"] is None for r in got) == 1
    assert jaccard_components(empty).count() == 0


def test_jaccard_long_columns(spark, monkeypatch):
    """Groups far beyond a block: near copies in chains, and texts of common passages that don't link."""
    from driftmesh.llm import jaccard

    rng = random.Random(5)
    word = lambda: f"v{rng.randrange(400)}"
    base = [word() for _ in range(60)]
    data = []
    for i in range(130):
        t = base[:]
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(60)] = word()
        data.append(" ".join(t))
    passages = [" ".join(word() for _ in range(14)) for _ in range(9)]
    data += [" ".join(rng.sample(passages, 3)) for _ in range(130)]
    want = brute_components(list(enumerate(data)))
    df = spark.createDataFrame(list(enumerate(data)), "doc_id long, text string").repartition(4)
    for broadcast in (1_000_000, 0):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(df, broadcast_rows=broadcast, most_common=1 if broadcast else 1000).collect()}
        assert got == want
    assert len({c for _, c in want.values()}) > 5


@pytest.mark.parametrize("kind", ["one kind of word", "mixed scripts", "one word"])
def test_bpe_of_very_long_texts(spark, kind):
    """5 MB in one text, beside a short one."""
    rng = random.Random(1)
    if kind == "mixed scripts":
        text = "".join(chr(rng.choice((rng.randrange(97, 123), 32, rng.randrange(0x1200, 0x1350), rng.randrange(0x4E00, 0x9000), 10))) for _ in range(2_500_000))
    else:
        text = "repeated words " * 333_000 if kind == "one kind of word" else "abc" * 400_000
    path = public_tokenizers.path(Q.VOCABULARY)
    df = spark.createDataFrame([(1, text), (2, "short one")], "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r for r in bpe_encode(df, path, public_tokenizers.PATTERN, decode=True).collect()}
    assert bytes(got[1]["decoded"]) == text.encode() and bytes(got[2]["decoded"]) == b"short one"
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert got[1]["ids"] == enc.encode_ordinary(text)


@pytest.mark.parametrize("name", ["op1_line_dedup", "op4_exact_dedup", "op6_jaccard", "op11_divergence", "op12_urls"])
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(Q.oracle_sql()[name])
    got = Q.queries()[name](spark, sf).select(*want.columns)
    assert Counter(map(tuple, got.collect())) == Counter(want.fetchall())


@pytest.mark.parametrize("tail", [1, 20, 100])
def test_products_of_a_column_over_batches(tail):
    """A long column that ends within a later batch gives what it gives in one batch."""
    import pandas as pd
    from driftmesh.llm.jaccard import _products

    sizes = [3, 1, 100 + tail, 2, 60, 5]
    column = pd.DataFrame({"h": [h for h, k in enumerate(sizes) for _ in range(k)], "sig": [s for k in sizes for s in range(k)]})
    column["n"] = 50 + column["sig"] % 3

    def summed(cuts):
        out, ends = Counter(), [0, *cuts, len(column)]
        for part in _products(75, 100)(column.iloc[a:b].reset_index(drop=True) for a, b in zip(ends, ends[1:])):
            for kind, h, a, b, na, nb, c in part[["kind", "h", "a", "b", "na", "nb", "c"]].itertuples(index=False):
                out[kind, h, a, b, na, nb] += c if kind == 0 else 1
        return out

    want = summed([])
    assert sum(n for k, n in want.items() if k[0] == 2) == 160 + tail
    assert summed([104]) == summed([60, 104]) == summed([30, 80, 104, 104 + tail]) == want


def test_jaccard_null_and_repeated_ids(spark):
    """Texts whose id is a copy's id too link as others do."""
    rng = random.Random(8)
    text = lambda: [f"u{rng.randrange(10**6)}" for _ in range(60)]
    near = lambda ws: " ".join([*ws[:30], "changed", *ws[31:]])
    x, y, z, v, w = (text() for _ in range(5))
    join = " ".join
    data = [(3, join(x)), (7, join(y)), (None, join(x)), (None, near(y)), (5, join(x)), (5, join(z)), (9, near(z)), (None, join(v)), (None, near(v)), (None, join(v)), (12, join(w)), (12, join(w)), (14, near(w)), (None, None), (None, "")]
    comp = [3, 7, 3, 7, 3, 5, 5, None, None, None, 12, 12, 12, None, None]
    want = Counter((i, len({tuple(t.split()[k : k + 5]) for k in range(56)}) if t else 0, c) for (i, t), c in zip(data, comp, strict=True))
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(data)], "k long, doc_id long, text string").repartition(3)
    for broadcast in (1_000_000, 0):
        assert Counter(map(tuple, jaccard_components(df, broadcast_rows=broadcast).collect())) == want
    got = jaccard_components(df, key="k").collect()
    assert Counter(tuple(r)[1:4] for r in got) == want
    assert {r["k"] for r in got if r["first_row"]} == {0, 1, 5, 7, 10, 13, 14}
