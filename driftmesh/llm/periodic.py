"""Periodic runs of words: repeated k-grams mask what can't be in a run; Main-Lorentz finds the runs of what is left."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import give_back, small_batches

CHARS_A_ROUND = 2_000_000
#: Candidates (split, period) that are compared at once.
AT_ONCE = 1 << 18

RUNS = "array<struct<start:long,length:long,period:long>>"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def segments(ids: np.ndarray, bounds: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Stretches (first, last + 1) of at least ``least`` words that in-document repeated k-grams cover without a gap.

    Grams are known by 64-bit hashes of gram and document: two that share one only keep more words.
    """
    n = len(ids)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    if n < k:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(doc[: n - k + 1] == doc[k - 1 :])
    word = _mixed(ids.astype(np.uint64) + np.uint64(1))
    h = doc[starts].astype(np.uint64)
    for j in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + word[starts + j]
    h = _mixed(h)
    ordered = np.sort(h)
    again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(again):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(again, h), len(again) - 1)
    hit = starts[again[at] == h]
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, hit, 1)
    np.add.at(step, hit + k, -1)
    covered = np.cumsum(step[:n]) > 0
    new = covered.copy()
    new[1:] &= ~covered[:-1] | (doc[1:] != doc[:-1])
    end = covered.copy()
    end[:-1] &= ~covered[1:] | (doc[1:] != doc[:-1])
    lo, hi = np.flatnonzero(new), np.flatnonzero(end) + 1
    long = hi - lo >= least
    return lo[long], hi[long]


def _names(seq: np.ndarray, most: int) -> list[np.ndarray]:
    """names[k][i] stands for the 2^k words from i on, equal where these are equal; windows beyond the end have names of their own."""
    out, k = [np.unique(seq, return_inverse=True)[1].astype(np.int64)], 0
    while 2 << k <= most:
        now, size = -1 - np.arange(len(seq)), len(seq) - (2 << k) + 1
        both = (out[k][:size] << 32) | out[k][1 << k : (1 << k) + size]
        now[:size] = np.unique(both, return_inverse=True)[1]
        out.append(now)
        k += 1
    return out


def _alike(names: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many words from i and j on are the same, and how many before them."""
    fwd, bwd = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
    for k in reversed(range(len(names))):
        fwd += (names[k][i + fwd] == names[k][np.minimum(j + fwd, names.shape[1] - 1)]).astype(np.int64) << k
        a, b = i - bwd - (1 << k), j - bwd - (1 << k)
        bwd += ((a >= 0) & (names[k][np.maximum(a, 0)] == names[k][np.maximum(b, 0)])).astype(np.int64) << k
    return fwd, bwd


def runs_of(seq: np.ndarray, lo: np.ndarray, hi: np.ndarray, least: int) -> np.ndarray:
    """All runs (start, end, period) of at least ``least`` words in the segments [lo, hi) of seq.

    Words between segments must be unlike all others, and there is one after each segment.  Main-Lorentz: a
    split at c stands for the block of words from c - b to c + b, b the greatest power of two that divides c.  A run
    crosses one split whose block holds it; there one full period lies on the right or on the left of c, and
    how far the words around c are the same one period on tells where the run begins and ends.  Splits and periods of all segments
    are worked on together.
    """
    none = np.zeros((0, 3), np.int64)
    if not len(lo):
        return none
    n, sizes = len(seq), hi - lo
    names = np.stack(_names(seq, int(sizes.max())))
    c = np.arange(n)
    seg = np.searchsorted(lo, c, "right") - 1
    c = c[(seg >= 0) & (c > lo[np.maximum(seg, 0)]) & (c < hi[np.maximum(seg, 0)])]
    seg = np.searchsorted(lo, c, "right") - 1
    half, reach = sizes[seg] // 2, c & -c
    found = []
    for right in (True, False):
        most = np.minimum(np.minimum(reach, half), hi[seg] - c if right else c - lo[seg])
        up = np.cumsum(most)
        a = 0
        while a < len(c):
            e = max(a + 1, int(np.searchsorted(up, (up[a - 1] if a else 0) + AT_ONCE)))
            m = most[a:e]
            at = np.repeat(c[a:e], m)
            q = np.arange(len(at)) - np.repeat(np.cumsum(m) - m, m) + 1
            a = e
            i, j = (at, at + q) if right else (at - q, at)
            need = np.maximum(q, least - q)  # a run of q has so many words that are the same one period on
            k = np.minimum(np.log2((need + 1) // 2).astype(np.int64), len(names) - 1)
            w = np.int64(1) << k
            ok = (names[k, i] == names[k, j]) | ((i >= w) & (names[k, np.maximum(i - w, 0)] == names[k, np.maximum(j - w, 0)]))
            i, j, q, need = i[ok], j[ok], q[ok], need[ok]
            fwd, bwd = _alike(names, i, j)
            ok = fwd + bwd >= need
            found.append(np.stack([i - bwd, j + fwd, q], axis=1)[ok])
    found = np.concatenate(found)
    if not len(found):
        return none
    # a multiple of a run's period gives the same stretch: the smallest counts
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    first = np.ones(len(found), bool)
    first[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
    return found[first]


def find_runs(ids: np.ndarray, bounds: np.ndarray, least: int) -> np.ndarray:
    """Runs (start, end, period) of documents that lie one after another; document i has the words from bounds[i] to bounds[i + 1]."""
    lo, hi = segments(ids, bounds, -(-least // 2), least)
    if not len(lo):
        return np.zeros((0, 3), np.int64)
    sizes = hi - lo
    begin = np.cumsum(sizes + 1) - sizes  # one word of its own before each segment and after the last
    seq = int(ids.max()) + 1 + np.arange(int(begin[-1] + sizes[-1]) + 1)
    inner = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    seq[np.repeat(begin, sizes) + inner] = ids[np.repeat(lo, sizes) + inner]
    runs = runs_of(seq, begin, begin + sizes, least)
    shift = (lo - begin)[np.searchsorted(begin, runs[:, 0], "right") - 1]
    return np.column_stack([runs[:, 0] + shift, runs[:, 1] + shift, runs[:, 2]])


def _words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    bounds, flat = lists.offsets.to_numpy().astype(np.int64), lists.flatten()
    bounds = bounds - bounds[0]
    real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    return flat.filter(pa.array(real)).dictionary_encode(), np.append(0, np.cumsum(real))[bounds]


def _slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of bounded text: a slice ends with the row that fills it."""
    up, a = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy().astype(np.int64)), 0
    while a < b.num_rows:
        e = min(int(np.searchsorted(up, (up[a - 1] if a else 0) + CHARS_A_ROUND)) + 1, b.num_rows)
        yield b.slice(a, e - a)
        a = e


def periodic_runs(docs: DataFrame, min_length: int = 12) -> DataFrame:
    r"""One row per document: doc_id, runs (start, length, period, by start and period), text (collapsed).

    Words are runs of characters other than ``[\x20\x09-\x0D]``, numbered from 0.  A run is a stretch of words
    with smallest period q and at least max(``min_length``, 2 q) words that no neighbouring word extends
    keeping period q.  The collapsed text has the words that lie in no run behind its first q words, joined by one space.

    Of a run's words at least k = ceil(min_length / 2) in a row are the same one period on, and so each of its words is in
    a k-gram that the document has twice.  Only stretches of such words, of at least min_length, are searched for runs, by
    Main-Lorentz in n log n steps.

    Whole texts are worked on, short ones together, in rounds of about 2 MB; a very long text costs some 200 bytes a word, and
    8 log2(n) bytes more for each word in a stretch of n words that passes the mask.  Null or empty text has no words, no runs
    and an empty collapsed text.  Repeated rows give repeated results.  An empty table gives no rows.
    Other columns are ignored.  Nothing shuffles.
    """
    small_batches(docs.sparkSession)
    struct = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                words, bounds = _words(part.column("text"))
                ids = words.indices.to_numpy().astype(np.int64)
                runs = find_runs(ids, bounds, min_length)
                runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
                step = np.zeros(len(ids) + 1, np.int64)
                np.add.at(step, runs[:, 0] + runs[:, 2], 1)
                np.add.at(step, runs[:, 1], -1)
                stays = np.cumsum(step[:-1]) == 0
                cut = np.append(0, np.cumsum(stays))[bounds].astype(np.int32)
                text = pc.binary_join(pa.ListArray.from_arrays(cut, words.filter(pa.array(stays)).cast(pa.string())), " ")
                doc = np.searchsorted(bounds, runs[:, 0], "right") - 1
                fields = [pa.array(x) for x in (runs[:, 0] - bounds[doc], runs[:, 1] - runs[:, 0], runs[:, 2])]
                ends = np.searchsorted(doc, np.arange(part.num_rows + 1)).astype(np.int32)
                listed = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(fields, fields=list(struct)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), listed, text], ["doc_id", "runs", "text"])
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, runs {RUNS}, text string")
