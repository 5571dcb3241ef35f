"""Line dedup: two Bloom filters find suspected repeats; only those shuffle for exact confirmation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, give_back, materialize, small_batches, strip_ws

#: Bits of one filter segment; a key has two bits in the segment that its hash's top bits name.
SEGMENT_LOG2 = 20
_LAST = 2**63 - 1


def _lines() -> Column:
    return F.split(F.coalesce(F.col("text"), F.lit("")), "\n")


def _two_bits(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << SEGMENT_LOG2) - 1)
    return (h & mask).astype(np.int64), ((h >> np.uint64(SEGMENT_LOG2)) & mask).astype(np.int64)


def _segment(h: np.ndarray, log2: int) -> np.ndarray:
    return (h >> np.uint64(64 - log2)).astype(np.int64) if log2 else np.zeros(len(h), np.int64)


def _summaries(log2: int):
    """Packs each batch's hashes by segment: every hash once, and whether the batch has it in two documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            lists = [x for x in b["hs"] if len(x)]
            if not lists:
                continue
            h, n = np.unique(np.concatenate(lists).astype(np.int64).view(np.uint64), return_counts=True)
            seg = _segment(h, log2)  # h is sorted, so each segment is a slice
            cut = np.flatnonzero(np.diff(seg)) + 1
            yield pd.DataFrame(
                [(int(s[0]), k.tobytes(), (c > 1).tobytes()) for s, k, c in zip(np.split(seg, cut), np.split(h, cut), np.split(n, cut), strict=True)],
                columns=["seg", "hashes", "twice"],
            )
        give_back()

    return run


def _filters(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Builds a segment's once- and twice-seen filters from rows that are sorted by segment; gives the latter.

    A bit is set in the second filter when a hash that sets it in the first comes again, so it doesn't
    matter in which order the rows come.
    """
    now, once, twice = None, None, None
    for b in batches:
        for seg, hashes, again in zip(b["seg"], b["hashes"], b["twice"], strict=True):
            if seg != now:
                if now is not None:
                    yield pd.DataFrame({"seg": [now], "bits": [np.packbits(twice).tobytes()]})
                now, once, twice = seg, np.zeros(1 << SEGMENT_LOG2, bool), np.zeros(1 << SEGMENT_LOG2, bool)
            h, again = np.frombuffer(hashes, np.uint64), np.frombuffer(again, bool)
            for bits in _two_bits(h):
                seen, n = np.unique(bits, return_counts=True)
                twice[seen[once[seen] | (n > 1)]] = True
                twice[bits[again]] = True
                once[seen] = True
    if now is not None:
        yield pd.DataFrame({"seg": [now], "bits": [np.packbits(twice).tobytes()]})
    give_back()


def _suspected(shared, log2: int):
    """Which of a document's hashes the filter lets through, by their places in the array."""

    @F.pandas_udf("array<int>")
    def run(hs: pd.Series) -> pd.Series:
        bits = np.frombuffer(shared.value, np.uint8)
        cut = np.cumsum([0, *map(len, hs)])
        h = np.concatenate([np.zeros(0, np.int64), *hs]).astype(np.int64).view(np.uint64)
        base, hit = _segment(h, log2) << SEGMENT_LOG2, np.ones(len(h), bool)
        for k in _two_bits(h):
            at = base + k
            hit &= (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
        places = np.flatnonzero(hit)
        ends = np.searchsorted(places, cut)
        return pd.Series([places[x:y] - c for x, y, c in zip(ends[:-1], ends[1:], cut[:-1], strict=True)])

    return run


def line_dedup(docs: DataFrame, min_chars: int = 10, bits_per_line: int = 8, max_log2_bits: int = 29, keep: tuple[str, ...] = ()) -> DataFrame:
    r"""One row per document: doc_id, text (kept lines), n_lines, n_dropped, and the row's columns that ``keep`` names.

    A line's key is the line without white space at both ends and with A-Z lower-cased.  Keys of at least
    ``min_chars`` code points found in two documents or more lose all their lines except in the document
    with the smallest doc_id.

    Steps: each task hashes its documents' distinct keys; segments of the hash space build a once-seen and
    a twice-seen Bloom filter; the twice-seen one is broadcast and keeps the suspected lines; those alone
    are digested and shuffle, by SHA-256 of the key, for the exact count of documents and the first of them; the positions
    to drop go back to the documents.

    The filter has ``bits_per_line`` bits a line, at most 2^``max_log2_bits`` (64 MB by default): that is
    the proven size of the broadcast.  Beyond that many lines the filter lets more lines through; then
    more 58-byte records shuffle and results stay exact.  Common lines are combined before they shuffle,
    and the join that finds their documents has no aggregate on the same key, so that Spark splits it.

    Null or empty text is one empty line.  A null doc_id comes after all others.  Rows that share a
    doc_id count as one document.  An empty table gives no rows.  Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rid = F.coalesce(F.col("doc_id"), F.lit(_LAST))
    t = F.xxhash64("text").alias("t")  # rows that share an id may have other texts; each has its own places
    keyed = docs.select(rid.alias("rid"), t, F.transform(_lines(), lambda x: ascii_lower(strip_ws(x))).alias("keys"))
    hashes = keyed.select(F.array_distinct(F.transform(F.filter("keys", lambda k: F.length(k) >= min_chars), lambda k: F.xxhash64(k))).alias("hs"))
    n = hashes.agg(F.sum(F.size("hs").cast("long"))).first()[0] or 0
    log2 = min(max_log2_bits, max(SEGMENT_LOG2, int(max(n * bits_per_line, 1) - 1).bit_length())) - SEGMENT_LOG2
    parts = max(1, min(1 << log2, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    filters = hashes.mapInPandas(_summaries(log2), "seg long, hashes binary, twice binary").repartition(parts, "seg").sortWithinPartitions("seg").mapInPandas(_filters, "seg long, bits binary")
    size = 1 << (SEGMENT_LOG2 - 3)
    bits = bytearray(size << log2)  # at most 2^(max_log2_bits - 3) bytes
    for row in filters.toLocalIterator():
        bits[row["seg"] * size : (row["seg"] + 1) * size] = row["bits"]
    shared = spark.sparkContext.broadcast(bytes(bits))
    # a document's hashes are tested together; only suspected lines become rows and are digested
    hashed = F.transform("keys", lambda k, i: F.struct(i.alias("pos"), F.when(F.length(k) >= min_chars, F.xxhash64(k)).alias("h")))
    each = keyed.withColumn("long", F.filter(hashed, lambda x: x["h"].isNotNull()))
    hits = each.withColumn("at", _suspected(shared, log2)(F.transform("long", lambda x: x["h"]))).where(F.size("at") > 0)
    rows = hits.select("rid", "t", F.explode(F.transform("at", lambda i: F.struct(F.get("long", i)["pos"].alias("pos"), F.get("keys", F.get("long", i)["pos"]).alias("key")))).alias("x"))
    suspects = materialize(rows.select("rid", "t", "x.pos", F.unhex(F.sha2("x.key", 256)).alias("digest")))
    # written, so that the join below is plain and Spark can split a common line's rows
    repeated = materialize(suspects.groupBy("digest").agg(F.min("rid").alias("lo"), F.max("rid").alias("hi")).where("lo <> hi").select("digest", "lo"))
    drops = suspects.join(repeated, "digest").where("rid > lo").groupBy("rid", "t").agg(F.collect_set("pos").alias("drop"))
    joined = docs.select("doc_id", rid.alias("rid"), t, "text", *keep).join(drops, ["rid", "t"], "left").select("doc_id", *keep, _lines().alias("lines"), F.coalesce("drop", F.array().cast("array<int>")).alias("drop"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drop"))
    text = F.transform(F.array(F.col("lines")), lambda ls: F.array_join(F.transform(kept, lambda i: F.get(ls, i)), "\n"))[0]
    return joined.select(
        "doc_id",
        F.when(F.size("drop") == 0, F.array_join("lines", "\n")).otherwise(text).alias("text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size("drop").cast("long").alias("n_dropped"),
        *keep,
    )
