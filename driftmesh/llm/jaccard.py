"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence, with size-derived bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, materialize, maybe_broadcast, release, small_batches
from .components import components

_LAST = 2**63 - 1
#: Odd multipliers of a window's words, fixed values.
_MUL = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)
#: A column of the product with up to so many documents is multiplied out at once.
BLOCK = 48
#: Below this hash, documents are counted for every shingle.  Prefixes of documents with under a quarter of common shingles end there.
SURE = np.uint64(35 * 2**64 // 100)
PAIRS = "kind int, h long, a long, b long, na int, nb int, c int"


#: Bytes of text that are hashed at once; a longer text alone.
AT_ONCE = 500_000


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MUL[0]
    return h ^ (h >> np.uint64(29))


#: By byte: A-Z lower-cased, whether it is white space, and a 64-bit value.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_VALUE = _mixed(_mixed(np.arange(1, 257, dtype=np.uint64) * _MUL[3]) + _MUL[1])


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word and where it starts: bytes' values by powers of an odd number, summed up within words."""
    low = _LOWER[np.frombuffer(data, np.uint8)]
    word = ~_SPACE[low]
    edge = np.flatnonzero(np.diff(word.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    start, n = edge[::2], edge[1::2] - edge[::2]
    if not len(n):
        return np.zeros(0, np.uint64), start
    first = np.cumsum(n) - n
    powers = np.full(int(n.max()), _MUL[0], np.uint64)
    powers[0] = 1
    at = np.arange(int(n.sum())) - np.repeat(first, n)
    h = np.add.reduceat(_VALUE[low[word]] * np.multiply.accumulate(powers)[at], first)
    return _mixed(h + n.astype(np.uint64) * _MUL[2]), start


def shingle_sets(texts: list[str | None], size: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its word windows, A-Z lower-cased; a shorter text is one window, none without words."""
    out: list[np.ndarray] = []
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    a = 0
    while a < len(raw):
        e, room = a + 1, AT_ONCE - len(raw[a])
        while e < len(raw) and len(raw[e]) <= room:
            room -= len(raw[e])
            e += 1
        w, start = _word_hashes(b"\n".join(raw[a:e]))
        ends = np.searchsorted(start, np.cumsum([len(x) + 1 for x in raw[a:e]]))
        k = max(len(w) - size + 1, 0)
        windows = _mixed(sum((w[i : i + k] * _MUL[i % 5] + np.uint64(i // 5) for i in range(1, size)), w[:k] * _MUL[0]))
        for x, y in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            if y - x >= size:
                out.append(np.unique(windows[x : y - size + 1]))
            elif y > x:
                out.append(_mixed((w[x:y] * _MUL[: y - x]).sum(dtype=np.uint64, keepdims=True) + np.uint64(y - x)))
            else:
                out.append(np.zeros(0, np.uint64))
        a = e
    return out


def _ints(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of a batch's different texts hold a shingle: all shingles below SURE, one row a text; of the others those that a thousandth hold."""
    for b in batches:
        v = shingle_sets(list(dict.fromkeys(b.column("text").to_pylist())))
        cut = [int(np.searchsorted(x, SURE)) for x in v]
        low = np.concatenate([*[x[:k] for x, k in zip(v, cut, strict=True)], np.zeros(0, np.uint64)])
        yield pa.RecordBatch.from_pydict({"h": _ints(low), "n": pa.array(np.ones(len(low), np.int32))})
        high = np.concatenate([*[x[k:] for x, k in zip(v, cut, strict=True)], np.zeros(0, np.uint64)])
        slot, least = (high & np.uint64(2**22 - 1)).astype(np.int64), max(6, len(v) // 1000)
        h, n = np.unique(high[np.bincount(slot, minlength=2**22)[slot] >= least], return_counts=True)
        yield pa.RecordBatch.from_pydict({"h": _ints(h[n >= least]), "n": pa.array(n[n >= least].astype(np.int32))})
    give_back()


def _common(src: DataFrame, most: int, least: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Shingles in ``least`` or more documents, sorted, and their places by count; in more documents, if these would be over ``most``."""
    counted = materialize(src.select("text").mapInArrow(_counts, "h long, n int").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least))
    levels = {r["k"]: r["count"] for r in counted.groupBy(F.floor(F.log2("n")).alias("k")).count().collect()}
    k = next(k for k in range(64) if sum(c for x, c in levels.items() if x >= k) <= most)
    rows = counted.where(F.floor(F.log2("n")) >= k).toArrow()
    release(counted)
    h, n = rows["h"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    order = np.argsort(h)
    return h[order], np.argsort(np.argsort(n[order], kind="stable"), kind="stable")


def _prefix(v: np.ndarray, common: np.ndarray, rank: np.ndarray, num: int, den: int) -> np.ndarray:
    """The first shingles in the global order (by hash; common ones last, rarer before) that any match must share one of."""
    n = len(v)
    k = n + (-num * n // den) + 1  # n - ceil(t n) + 1
    if len(common):
        at = np.minimum(np.searchsorted(common, v), len(common) - 1)
        hot = common[at] == v
        if hot.any():
            cold = v[~hot]
            return np.concatenate([cold, v[hot][np.argsort(rank[at[hot]], kind="stable")]])[:k]
    return v[:k]


def _nodes(shared, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, rank = shared.value
        for whole in batches:
            for a in range(0, whole.num_rows, 2000):
                b = whole.slice(a, 2000)
                v = shingle_sets(b.column("text").to_pylist())
                p = [_prefix(x, common, rank, num, den) if len(x) else x for x in v]
                cut = np.cumsum([0, *map(len, p)]).astype(np.int32)
                sig = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in v], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_pydict(
                    {
                        **{c: b.column(c) for c in b.schema.names if c != "text"},
                        "sig": pa.array(sig, mask=np.array([not len(x) for x in v], bool)),
                        "n": pa.array([len(x) for x in v], pa.int32()),
                        "prefix": pa.ListArray.from_arrays(pa.array(cut), _ints(np.concatenate([*p, np.zeros(0, np.uint64)]))),
                    }
                )
        give_back()

    return run


def _bins(v: np.ndarray) -> bytes:
    """How many of the shingles have each leading byte, 255 for more."""
    return np.minimum(np.bincount((v >> np.uint64(56)).astype(np.int64), minlength=256), 255).astype(np.uint8).tobytes()


def _able(bins: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether the bins of rows a and b allow a link: shared shingles are at most the sum of the lesser counts.

    A bin that is full on both sides allows any overlap.
    """
    least = np.minimum(bins[a], bins[b])
    return (least == 255).any(axis=1) | (least.sum(axis=1, dtype=np.int64) * (num + den) >= (n[a].astype(np.int64) + n[b]) * num)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for a in range(0, whole.num_rows, 2000):
            v = [x for x in shingle_sets(whole.slice(a, 2000).column("text").to_pylist()) if len(x)]
            cut = np.cumsum([0, *map(len, v)]).astype(np.int32)
            sig = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in v], np.uint64).view(np.int64)
            vec = pa.ListArray.from_arrays(pa.array(cut), _ints(np.concatenate([*v, np.zeros(0, np.uint64)])))
            yield pa.RecordBatch.from_pydict({"sig": pa.array(sig), "vec": vec, "bins": pa.array([_bins(x) for x in v], pa.binary())})
    give_back()


def _emit(kind: int, h=0, a=0, b=0, na=0, nb=0, c=0) -> pd.DataFrame:
    return pd.DataFrame({"kind": kind, "h": h, "a": a, "b": b, "na": na, "nb": nb, "c": c})


def _near(na: np.ndarray, nb: np.ndarray, num: int, den: int) -> np.ndarray:
    return np.minimum(na, nb) * den >= np.maximum(na, nb) * num


def _products(num: int, den: int):
    """Multiplies out the columns that come sorted by (h, sig).

    kind 0: documents a < b share c of the columns with up to BLOCK documents; kind 1: a longer column's
    first document with another; kind 2: a longer column's documents.  A column that goes on over batches
    is held back up to BLOCK documents; beyond, only its first two stay in memory.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [np.zeros(0, np.int64)] * 3
        big: tuple | None = None  # the long column that is passing: its h and its first two documents

        def long_rows(h, sig, n, lead):
            yield _emit(2, h=h, a=sig, na=n)
            for s, m in lead:
                ok = (sig != s) & _near(n, m, num, den)
                yield _emit(1, a=s, b=sig[ok], na=m, nb=n[ok]) if ok.any() else _emit(1, a=sig[:0])

        def flush(h, sig, n):
            start = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
            size = np.diff(np.append(start, len(h)))
            out = []
            for k in np.unique(size[(size > 1) & (size <= BLOCK)]):
                i, j = np.triu_indices(k, 1)
                at = start[size == k]
                a, b = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
                ok = _near(n[a], n[b], num, den)
                out.append(np.stack([sig[a[ok]], sig[b[ok]], n[a[ok]], n[b[ok]]], axis=1))
            if out:
                rows, c = np.unique(np.concatenate(out), axis=0, return_counts=True) if sum(map(len, out)) else (np.zeros((0, 4), np.int64), np.zeros(0, np.int64))
                yield _emit(0, a=rows[:, 0], b=rows[:, 1], na=rows[:, 2], nb=rows[:, 3], c=c)
            for s, k in zip(start[size > BLOCK], size[size > BLOCK], strict=True):
                yield from long_rows(h[s : s + k], sig[s : s + k], n[s : s + k], [(sig[s], n[s]), (sig[s + 1], n[s + 1])])

        for batch in batches:
            h, sig, n = (np.concatenate([x, batch[c].to_numpy(np.int64)]) for x, c in zip(held, ("h", "sig", "n"), strict=True))
            if len(h) == 0:
                continue
            new = np.append(True, (h[1:] != h[:-1]) | (sig[1:] != sig[:-1]))
            h, sig, n = h[new], sig[new], n[new]
            if big:
                k = int((h == big[0]).sum())  # its rows lead
                if k:
                    yield from long_rows(h[:k], sig[:k], n[:k], big[1])
                if k == len(h):
                    held = [x[:0] for x in (h, sig, n)]
                    continue
                big, h, sig, n = None, h[k:], sig[k:], n[k:]
            last = int(np.flatnonzero(np.append(True, h[1:] != h[:-1]))[-1])
            if len(h) - last > BLOCK:
                big = (h[-1], [(sig[last], n[last]), (sig[last + 1], n[last + 1])])
                yield from flush(h, sig, n)
                held = [x[:0] for x in (h, sig, n)]
            else:
                yield from flush(h[:last], sig[:last], n[:last])
                held = [h[last:], sig[last:], n[last:]]
        yield from flush(*held)
        give_back()

    return run


def _cross(num: int, den: int, best: bool):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """One block of a long column's product: pairs of different components that share enough long columns.

        Rows carry all their long columns, so a pair's count is whole here; only its first shared column gives it.
        Of what the count leaves, the bins of whole sets drop most pairs that can't link before they are given.
        """
        sig, n, comp, odd = (rows[c].to_numpy() for c in ("sig", "n", "comp", "odd"))
        cols, at = np.unique(np.concatenate(rows["cols"].tolist()), return_inverse=True)
        holds = np.zeros((len(rows), len(cols)), np.float32)
        holds[np.repeat(np.arange(len(rows)), [len(c) for c in rows["cols"]]), at] = 1
        left = np.flatnonzero(odd)
        right = np.flatnonzero(~odd) if key[1] == "main" else left
        shared = holds[left] @ holds[right].T
        na, nb = n[left][:, None], n[right][None]
        need = -(-(na + nb) * num // (num + den)) + (-num * np.maximum(na, nb) // den) + 1
        ok = (comp[left][:, None] != comp[right][None]) & (np.minimum(na, nb) * den >= np.maximum(na, nb) * num) & (shared >= np.maximum(need, 1))
        # shares none of the columns before this one
        before = holds[:, cols < key[0]]
        ok &= before[left] @ before[right].T == 0
        bins = np.stack([np.frombuffer(x, np.uint8) for x in rows["bins"]])
        i, j = np.nonzero(ok)
        for k in range(0, len(i), 20_000):
            x, y = i[k : k + 20_000], j[k : k + 20_000]
            ok[x, y] = _able(bins, left[x], right[y], n, num, den)
        if best:  # just each odd document's partner with the highest count
            ok &= shared == np.where(ok, shared, -1).max(axis=1, initial=-1, keepdims=True)
            ok &= np.cumsum(ok, axis=1) == 1
        i, j = np.nonzero(ok)
        a, b = sig[left[i]], sig[right[j]]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()

    return run


def jaccard_components(docs: DataFrame, num: int = 75, den: int = 100, broadcast_rows: int = 1_000_000, most_common: int = 500_000, key: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    ``key`` may name a column of docs with a different long in each row.  It is then the first column, and the
    last is first_row: whether the row comes first in its component, by doc_id (null last), then by key.

    Two documents link when the Jaccard similarity of their sets of 5-word shingles is num / den or more;
    component_id is the smallest doc_id that links lead to, the document's own included.

    The product of the incidence matrix with itself is never formed whole:

    * Documents with equal sets are one row of it (their hash is the row's name).
    * Columns are put in one order: by hash, shingles that 8 or more documents hold last, the commonest at the end.  A pair that shares
      none of the first n - ceil(t n) + 1 of either document's columns can't reach the bound, so only these
      entries shuffle.
    * Columns are multiplied out block by block.  Overlap counts of a pair add up over blocks; pairs whose
      sizes differ too much, or whose count is below what the sizes ask for, are discarded.
    * A column with over BLOCK documents gives each document with the column's first two.  After the links
      found so far are joined to components, what such a column still holds of different components is
      multiplied in blocks of bounded size; so no link between components is lost, and a large group of
      near copies never gives all its pairs.
    * What remains is verified exactly on the whole shingle sets, first each document's best partner, then
      all pairs that aren't yet in one component.

    Common shingles only order columns: at most ``most_common`` are broadcast, those counted most often.  Prefixes lie
    in the first part of hash space, so only there all shingles are counted, by one shuffle of hashes.
    Before the whole sets, 16 bits of each shingle give
    an upper bound of the overlap.  Lists of documents are broadcast up to ``broadcast_rows`` rows, else joined by shuffle.  Shingles are
    64-bit hashes.

    A text without words has n_shingles 0 and is its own component.  A null doc_id counts in its component
    only if no other is there.  Rows that share a doc_id share its component where texts agree, and each
    row has its own result; of rows with equal sets, whatever their ids, one row enters the product.  An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    src = docs.select(F.coalesce("doc_id", F.lit(_LAST)).alias("rid"), "text", *([F.col(key).alias("row")] if key else []))
    shared = spark.sparkContext.broadcast(_common(src, most_common))
    entries = src.mapInArrow(_nodes(shared, num, den), "rid long, " + "row long, " * bool(key) + "sig long, n int, prefix array<long>")
    if not key:
        entries = entries.withColumn("row", F.monotonically_increasing_id())
    entries = materialize(entries)  # rows keep their numbers from here on
    nodes = materialize(entries.select("rid", "row", "sig", "n"))
    firsts = nodes.where("sig IS NOT NULL").groupBy("sig").agg(F.min(F.struct("rid", "row")).alias("m"), F.first("n").alias("n"))
    classes = materialize(firsts.select("sig", F.col("m.rid").alias("rep"), F.col("m.row").alias("own"), "n"))
    # by row: ids may be null or shared by other texts
    copies = nodes.select("row", "sig").join(classes.select("sig", "own"), "sig").where("row <> own").select("row")
    copies = materialize(copies)
    rows = entries.join(maybe_broadcast(copies, copies.count(), broadcast_rows), "row", "left_anti").select(F.explode("prefix").alias("h"), "sig", "n")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = materialize(rows.repartition(parts, "h").sortWithinPartitions("h", "sig").mapInPandas(_products(num, den), PAIRS))
    del rows
    release(entries)

    ceil_t = lambda n: F.ceil(n * num / F.lit(den)).cast("long")
    alpha = F.ceil((F.col("na") + F.col("nb")) * num / F.lit(num + den)).cast("long")
    need = alpha - F.greatest(ceil_t(F.col("na")), ceil_t(F.col("nb"))) + 1
    small = found.where("kind = 0").groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.sum("c").alias("c"))
    long_cols = found.where("kind = 2").select("h", F.col("a").alias("sig"), F.col("na").alias("n"))
    more = long_cols.groupBy("sig").agg(F.count("*").alias("more"))
    some_long = bool(long_cols.take(1))
    if some_long:  # columns that weren't multiplied out may add to a pair's count
        small = small.join(more.select(F.col("sig").alias("a"), F.col("more").alias("ma")), "a", "left").join(more.select(F.col("sig").alias("b"), F.col("more").alias("mb")), "b", "left")
        small = small.withColumn("may", F.col("c") + F.least(F.coalesce("ma", F.lit(0)), F.coalesce("mb", F.lit(0))))
    else:
        small = small.withColumn("may", F.col("c"))
    first = found.where("kind = 1").groupBy("a", "b").agg(F.count("*").alias("c"))
    cand = materialize(small.where(F.col("may") >= need).select("a", "b", "c").unionByName(first))

    ends = cand.select(F.explode(F.array("a", "b")).alias("sig")).unionByName(long_cols.select("sig")).distinct()
    ends = materialize(classes.join(ends, "sig", "left_semi").select("sig", "rep"))
    reps = materialize(ends.select("rep").distinct())
    n_reps, n_ends = reps.count(), ends.count()
    wanted = src.join(maybe_broadcast(reps, n_reps, broadcast_rows), F.col("rid") == F.col("rep"), "left_semi").select("text")
    vectors = materialize(wanted.mapInArrow(_vectors, "sig long, vec array<long>, bins binary"))
    if vectors.count() > n_ends:  # rows that share an id: each wanted set once
        several = vectors
        vectors = several.join(maybe_broadcast(ends.select("sig"), n_ends, broadcast_rows), "sig", "left_semi").groupBy("sig").agg(F.first("vec").alias("vec"), F.first("bins").alias("bins"))
        vectors = materialize(vectors)
        release(several)
    # 16 bits of each shingle: an upper bound of the overlap at a quarter of the size
    sketches = materialize(vectors.select("sig", F.array_distinct(F.transform("vec", lambda x: F.shiftright(x, 48).cast("smallint"))).alias("vec"), F.size("vec").alias("n")))

    def met(pairs: DataFrame, table: DataFrame) -> DataFrame:
        """The pairs with both sides' rows of the table."""
        used = materialize(pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct())
        v = table.join(maybe_broadcast(used, used.count(), broadcast_rows), "sig", "left_semi")
        side = lambda x: v.select(*[F.col(c).alias(x if c == "sig" else c + x) for c in v.columns])
        return pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a")

    def exact(pairs: DataFrame) -> DataFrame:
        inter = F.size(F.array_intersect("veca", "vecb")).cast("long")
        counted = met(pairs, vectors.select("sig", "vec")).select("a", "b", inter.alias("inter"), (F.size("veca") + F.size("vecb")).alias("sum"))
        return materialize(counted.where(F.col("inter") * den >= (F.col("sum") - F.col("inter")) * num).select("a", "b"))

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs that link: those whose sketches allow it, by their whole sets."""
        lost = F.least(F.col("na") - F.size("veca"), F.col("nb") - F.size("vecb"))
        most = (F.size(F.array_intersect("veca", "vecb")) + lost).cast("long")
        able = met(pairs, sketches).select("a", "b", most.alias("most"), (F.col("na") + F.col("nb")).alias("sum"))
        out = exact(materialize(able.where(F.col("most") * (den + num) >= F.col("sum") * num).select("a", "b")))
        release(pairs)
        return out

    def apart(pairs: DataFrame, comp: DataFrame) -> DataFrame:
        for x in ("a", "b"):
            pairs = pairs.join(comp.select(F.col("node").alias(x), F.col("comp").alias(f"c{x}")), x, "left")
        return pairs.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).drop("ca", "cb")

    def joined(comp: DataFrame, links: DataFrame) -> DataFrame:
        """Components after more links; links between the same two components count once."""
        edges = links
        for x in ("a", "b"):
            edges = edges.join(comp.select(F.col("node").alias(x), F.col("comp").alias(f"c{x}")), x, "left").withColumn(f"c{x}", F.coalesce(f"c{x}", x))
        tops = components(edges.select("ca", "cb").distinct(), "ca", "cb")
        moved = comp.join(tops.select(F.col("node").alias("comp"), F.col("comp").alias("top")), "comp", "left").select("node", F.coalesce("top", "comp").alias("comp"))
        return materialize(moved.unionByName(tops))

    def best_of(pairs: DataFrame) -> DataFrame:
        """Each document's pair with the highest count."""
        sym = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "c"))
        best = sym.groupBy("a").agg(F.max(F.struct("c", F.col("b").alias("other"))).alias("m"))
        return materialize(best.select(F.least("a", "m.other").alias("a"), F.greatest("a", "m.other").alias("b")).distinct())

    pairs = cand.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("c").alias("c"))
    tried = best_of(pairs)
    comp = components(exact(tried), "a", "b")
    pairs = materialize(apart(pairs.join(tried, ["a", "b"], "left_anti"), comp))
    tried = best_of(pairs)  # once more over what is still apart: large groups are mostly one component then
    links = exact(tried)
    if links.take(1):
        comp = joined(comp, links)
    rest = materialize(apart(pairs.join(tried, ["a", "b"], "left_anti"), comp).select("a", "b"))
    links = verified(rest)
    if links.take(1):
        comp = joined(comp, links)
    if some_long:
        for best in (True, False):  # best partners first, so that few pairs of a large group are left for the whole product
            links = verified(materialize(_long_pairs(long_cols, vectors, comp, num, den, best)))
            if links.take(1):
                comp = joined(comp, links)
    named = classes.join(comp.withColumnRenamed("node", "sig"), "sig", "left").select("sig", "rep", "own", F.coalesce("comp", "sig").alias("comp"))
    least = named.groupBy("comp").agg(F.min(F.struct("rep", "own")).alias("least"))
    ids = named.join(least, "comp").select("sig", F.col("least.rep").alias("component_id"), F.col("least.own").alias("own"))
    linked = nodes.where("sig IS NOT NULL").join(ids, "sig", "left").select("rid", "row", "n", "component_id", (F.col("row") == F.col("own")).alias("first_row"))
    alone = nodes.where("sig IS NULL").select("rid", "row", "n", F.col("rid").alias("component_id"), F.lit(True).alias("first_row"))
    null_id = lambda c: F.when(F.col(c) != _LAST, F.col(c))
    out = (null_id("rid").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), null_id("component_id").alias("component_id"))
    return linked.unionByName(alone).select(*([F.col("row").alias(key), *out, "first_row"] if key else out))


def _long_pairs(long_cols: DataFrame, vectors: DataFrame, comp: DataFrame, num: int, den: int, best: bool, block: int = 512) -> DataFrame:
    """Pairs of different components that share as many long columns as their sizes ask for, by blocks of about ``block`` documents a side.

    Pairs that share a shorter column too have been candidates before.  Documents of the column's largest
    component meet only the others.  With ``best`` each of the others gives its best pair of a block only.
    """
    lists = long_cols.groupBy("sig").agg(F.collect_set("h").alias("cols")).join(vectors.select("sig", "bins").dropDuplicates(["sig"]), "sig")
    rows = long_cols.join(comp.withColumnRenamed("node", "sig"), "sig", "left").select("h", "sig", "n", F.coalesce("comp", "sig").alias("comp"))
    rows = materialize(rows)
    per = rows.groupBy("h", "comp").agg(F.count("*").alias("k"))
    main = per.groupBy("h").agg(F.max(F.struct("k", "comp")).alias("m"), F.sum("k").alias("all")).where("m.k < all")
    cut = lambda k: F.ceil(k / F.lit(block)).cast("int")
    main = main.select("h", F.col("m.comp").alias("main"), cut(F.col("m.k")).alias("mains"), cut(F.col("all") - F.col("m.k")).alias("odds"))
    rows = rows.join(main, "h").join(lists, "sig").withColumn("odd", F.col("comp") != F.col("main"))
    own = F.pmod(F.xxhash64("sig"), F.when(F.col("odd"), F.col("odds")).otherwise(F.col("mains"))).cast("int")
    rows = rows.withColumn("own", own)

    def unit(kind: str, i: Column, j: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"))

    with_main = F.when(F.col("odd"), F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda j: unit("main", F.col("own"), j))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("odds") - 1), lambda i: unit("main", i, F.col("own")))
    )
    with_odd = F.when(F.col("odd"), F.transform(F.sequence(F.lit(0), F.col("odds") - 1), lambda i: unit("odd", F.least(i, F.col("own")), F.greatest(i, F.col("own"))))).otherwise(F.array().cast("array<struct<kind:string,i:int,j:int>>"))
    units = rows.select("h", "sig", "n", "comp", "odd", "cols", "bins", F.explode(F.concat(with_main, with_odd)).alias("u")).select("h", "u.kind", "u.i", "u.j", "sig", "n", "comp", "odd", "cols", "bins")
    return units.groupBy("h", "kind", "i", "j").applyInPandas(_cross(num, den, best), "a long, b long").distinct()
