"""Language ID by error-correcting output codes over hashed character n-grams."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, small_batches

DIMS = 2048
SLICE = 250_000
_MIX = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))
_LETTER = regex.compile(r"\p{L}")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _slices(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """Rows and pieces of bounded total size; pieces of one text overlap by the two characters that end its last n-grams."""
    rows: list[int] = []
    pieces: list[str] = []
    size = 0
    for i, t in enumerate(texts):
        low = t.lower()
        for a in range(0, max(len(low), 1), SLICE):
            rows.append(i)
            pieces.append((low[a : a + SLICE + 2] + "  ")[: min(SLICE, len(low) - a) + 2])
            size += len(pieces[-1])
            if size >= SLICE:
                yield rows, pieces
                rows, pieces, size = [], [], 0
    if rows:
        yield rows, pieces


def ngram_features(texts: list[str]) -> np.ndarray:
    """Square roots of the shares of hashed 1-, 2- and 3-grams of the lower-cased whole text; a row a text."""
    out = np.zeros((len(texts), DIMS))
    for rows, pieces in _slices(texts):
        c = np.frombuffer("".join(pieces).encode("utf-32-le", "replace"), np.uint32)
        lens = np.array([len(p) for p in pieces])
        ends = np.cumsum(lens)
        use = np.ones(len(c), bool)
        use[ends - 1] = use[ends - 2] = False  # n-grams that would begin in the padding
        row = np.repeat(np.arange(len(rows)), lens)[use] * DIMS
        h, total = np.zeros(len(c), np.uint32), np.zeros(len(rows) * DIMS)
        for n in range(3):
            h = (h ^ np.append(c[n:], c[:n] * 0) * _MIX[0]) * _MIX[1] + _MIX[2]
            total += np.bincount(row + ((h ^ (h >> np.uint32(15)))[use] & np.uint32(DIMS - 1)), minlength=len(total))
        np.add.at(out, rows, total.reshape(len(rows), DIMS))
    return np.sqrt(out / np.maximum(out.sum(axis=1, keepdims=True), 1)).astype(np.float32)


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """A row of +1 and -1 a language: all different splits for up to 6 languages, else random splits of about 10 log2(n) bits."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 6:
        bits = [[1 if k >> i & 1 else -1 for i in range(n)] for k in range(1, 2 ** (n - 1))]
        return np.array(bits, np.int8).T
    rng = np.random.default_rng(seed)
    best = None
    for _ in range(20):
        code = rng.choice(np.array([-1, 1], np.int8), (n, math.ceil(10 * math.log2(n))))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        apart = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
        if best is None or apart > best[0]:
            best = (apart, code)
    return best[1]


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest codeword, its share of exp(-loss), and whether it leads the second by little.

        A codeword's loss is the sum of logistic losses of the bits, weighted by how far each bit's
        classifier can be trusted on that language.
        """
        f = x.astype(float) @ self.weights.astype(float) + self.bias  # in doubles, so that batches don't show in the score
        loss = np.logaddexp(0, -f[:, None, :] * self.code[None])
        d = (loss * self.trust[None]).sum(axis=2) * self.code.shape[1]
        p = np.exp(d.min(axis=1, keepdims=True) - d)
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        top = np.sort(p, axis=1)[:, ::-1]
        lead = top[:, 0] - top[:, 1] if p.shape[1] > 1 else top[:, 0]
        return best, top[:, 0], lead < 0.1


def fit(x: np.ndarray, langs: np.ndarray, steps: int = 300, l2: float = 1e-5) -> Model:
    """One logistic classifier a bit, by accelerated gradient steps; trust is each bit's accuracy on each language, as shares."""
    names = sorted(set(langs.tolist()))
    at = np.searchsorted(names, langs)
    code = codewords(len(names))
    y = code[at].astype(np.float32)
    per = (1.0 / np.bincount(at, minlength=len(names)))[at][:, None] / len(names)
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    vw, vb = w.copy(), b.copy()
    for _ in range(steps):
        f = x @ (w + 0.9 * vw) + b + 0.9 * vb
        g = (-y / (1 + np.exp(np.clip(y * f, -30, 30))) * per).astype(np.float32)
        vw = 0.9 * vw - 4.0 * (x.T @ g + l2 * w)
        vb = 0.9 * vb - 4.0 * g.sum(axis=0)
        w, b = w + vw, b + vb
    right = (np.sign(x @ w + b) == y).astype(float)
    trust = np.stack([right[at == i].mean(axis=0) for i in range(len(names))]) ** 2 + 1e-6
    return Model(names, code, w, b, trust / trust.sum(axis=1, keepdims=True))


def train(docs: DataFrame, per_language: int = 1000) -> Model | None:
    """Learns from text and non-null lang of documents that aren't held out; None without any.

    The fit uses at most ``per_language`` documents of each language: that is the bound of the sample, at
    every size of the input.  Languages are counted; then the documents whose hash of id and text lies in
    the share per_language / count of a language's hash space are chosen, so no text moves before it
    is chosen, and their texts become DIMS numbers on the executors (the driver gets 8 kB a chosen document).
    """
    small_batches(docs.sparkSession)
    usable = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang", F.xxhash64("doc_id", "text", F.lit(3)).alias("h"))
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = ngram_features(b["text"].tolist())
            yield pd.DataFrame({"h": b["h"], "lang": b["lang"], "x": [v.tobytes() for v in x]})
        give_back()

    chosen = F.lit(False)
    for lang, n in sorted(counts.items()):
        chosen = chosen | ((F.col("lang") == lang) & (F.col("h") <= min(-(2**63) + 2**64 * per_language // n, 2**63 - 1)))
    rows = usable.where(chosen).select("h", "lang", "text").mapInPandas(vectors, "h long, lang string, x binary").dropDuplicates(["lang", "h"]).collect()
    rows.sort(key=lambda r: (r["lang"], r["h"]))
    first: dict[str, int] = {}
    rows = [r for r in rows if first.setdefault(r["lang"], 0) < per_language and not first.update({r["lang"]: first[r["lang"]] + 1})]
    if not rows:
        return None
    x, langs = np.stack([np.frombuffer(r["x"], np.float32) for r in rows]), np.array([r["lang"] for r in rows])
    del rows
    model = fit(x, langs)
    del x
    give_back()  # the driver's memory too
    return model


def identify_language(docs: DataFrame, model: Model | None, key: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, lang_pred, score (0 to 1), ambiguous.

    ``key`` may name another long column of docs to stand for doc_id.  Only the text decides.  Null texts and texts without a letter are ``und`` with score 0 and ambiguous,
    and so is everything if nothing was learned.  Texts are worked on whole, long ones slice by slice.
    Repeated rows give repeated results, an empty table none.  Other columns are ignored.  Nothing shuffles.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for whole in batches:
            for a in range(0, len(whole), 500):
                b = whole.iloc[a : a + 500]
                texts = [t or "" for t in b["text"]]
                known = np.array([bool(m and _LETTER.search(t)) for t in texts], bool)
                out = pd.DataFrame({key: b[key].to_numpy(), "lang_pred": "und", "score": 0.0, "ambiguous": True})
                if known.any():
                    best, score, unsure = m.decode(ngram_features([t for t, k in zip(texts, known, strict=True) if k]))
                    out.loc[known, "lang_pred"] = [m.langs[i] for i in best]
                    out.loc[known, "score"] = np.round(score, 6)
                    out.loc[known, "ambiguous"] = unsure
                yield out
        give_back()

    return docs.select(key, "text").mapInPandas(run, f"{key} long, lang_pred string, score double, ambiguous boolean")
