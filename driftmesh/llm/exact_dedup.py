"""Exact dedup by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, maybe_broadcast, without_ws


def exact_dedup(docs: DataFrame, prefix_chars: int = 64, broadcast_rows: int = 1_000_000, digest_all: bool = False) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are identical without white space.  Of equal texts the row with the most
    code points stays, then the smallest doc_id.

    Rounds: (1) rows are counted by normalised length; (2) lengths that occur twice are counted by
    length and prefix hash; (3) only rows whose length and prefix occur twice have their full text
    hashed with SHA-256 and grouped.  text_sha256 is null for the others unless ``digest_all``.

    Counts are combined before each shuffle, so that a group with a third of all rows is one row a task.
    Surviving (length, prefix) keys are broadcast up to ``broadcast_rows`` keys, else joined by shuffle.

    Null text counts as empty.  A null doc_id is a document that others of equal length go before.
    Rows that share doc_id and text are one document: all are kept or none.  An empty table gives no
    rows.  Other columns are ignored.
    """
    norm = without_ws(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.select("doc_id", F.length(F.coalesce(F.col("text"), F.lit(""))).alias("chars"), norm.alias("norm")).select(
        "doc_id", "chars", "norm", F.length("norm").alias("len"), F.xxhash64(F.length("norm"), F.substring("norm", 1, prefix_chars)).alias("pre")
    )
    keys = materialize(rows.select("len", "pre"))
    lens = keys.groupBy("len").agg(F.count("*").alias("n")).where("n > 1").select("len")
    alike = keys.join(lens, "len", "left_semi").groupBy("pre").agg(F.count("*").alias("n")).where("n > 1")
    alike = materialize(alike.select(F.col("pre").alias("alike")))
    alike = maybe_broadcast(alike, alike.count(), broadcast_rows)
    sha = F.sha2(F.col("norm"), 256)
    hashed = materialize(
        rows.join(alike, F.col("pre") == F.col("alike"), "left").select(
            "doc_id", "chars", F.col("alike").isNotNull().alias("suspect"), (sha if digest_all else F.when(F.col("alike").isNotNull(), sha)).alias("text_sha256")
        )
    )
    first = F.struct("chars", F.col("doc_id").isNotNull().alias("has"), F.bitwise_not(F.col("doc_id")).alias("low"))
    # written, so that the join below is plain and Spark can split a hot text's rows
    groups = materialize(hashed.where("suspect").groupBy("text_sha256").agg(F.max_by("doc_id", first).alias("keep_id"), F.count("*").alias("group_size")))
    out = ("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    several = hashed.where("suspect").join(groups, "text_sha256").select(*out)
    single = hashed.where("not suspect").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    return several.unionByName(single)
