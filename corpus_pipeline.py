"""A corpus pipeline of five stages; each calls one training-data operator and gives rows with the columns of documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmesh.llm.bpe import bpe_encode
from driftmesh.llm.common import materialize
from driftmesh.llm.jaccard import jaccard_components
from driftmesh.llm.langid import identify_language, train
from driftmesh.llm.line_dedup import line_dedup
from driftmesh.llm.mixing import mix

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _numbered(docs: DataFrame) -> DataFrame:
    """Documents with a number of their own for each row, written so that it stays: ids may be null or repeated."""
    return materialize(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go: no letters, or two languages about as near.

    Each row stays or goes by its own text; a null or repeated doc_id doesn't matter.
    """
    docs = _numbered(docs)
    known = identify_language(docs, train(docs), key="row").where("NOT ambiguous").select("row")
    return docs.join(known, "row", "left_semi").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the lines that an earlier document has.

    Each row gives one row.  Rows that share a doc_id count as one document; rows without one count as one
    document that comes last, as in ``line_dedup``.
    """
    kept = line_dedup(docs, keep=("lang", "source"))
    return kept.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays.

    Rows of the group that share that id are one document: all of them stay, each once.  In a group without any id one
    row stays.  Rows that share an id but are in different groups stay or go each by its own group.
    """
    docs = _numbered(docs)
    stays = jaccard_components(docs, key="row").where("first_row OR doc_id = component_id").select("row")
    return docs.join(stays, "row", "left_semi").select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix takes them, up to 3 times; those that it doesn't take go.

    Each row is a document and comes as often as its own repeats, whether its doc_id is null or repeated.
    """
    docs = _numbered(docs)
    taken = mix(docs, keep=("row",)).where("repeats > 0").select("row", "repeats")
    return docs.join(taken, "row").withColumn("copy", F.explode(F.sequence(F.lit(1), "repeats"))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids, and whether they decode to its text; each row gives one row."""
    rows = bpe_encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, decode=True)
    return rows.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language ID", language), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("mixing sources", mixing), ("byte-level BPE", tokens)]

#: A learned classifier, a fitted budget and the tokenizer are beyond SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
