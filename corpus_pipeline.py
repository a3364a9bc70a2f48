"""From raw documents to token ids: filter, dedup, decontaminate, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from privlink.llm import bpe, decontaminate, exact, minhash, queries, toxicity
from privlink.llm.common import remove, shared_dir, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under one half.

    Null and empty texts get the score of a text without matches; repeated rows are judged row by row; without labels of
    both classes all texts get the share of toxic labels; an empty table gives an empty table; further columns pass through.
    """
    model = toxicity.fit(docs, queries.training_labels(table(spark, sf_dir, "labels")))
    return toxicity.keep_clean(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for white space: the longest, then the smallest id.

    Null counts as empty, and empty texts equal each other; null ids come last; repeated rows stay once; an empty table gives an
    empty table; further columns pass through.
    """
    return exact.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of near-duplicates, linked at a similarity of 0.80 of five-word shingles.

    Texts without words, and rows without an id, stay; rows that repeat an id stay or go together; an empty table gives an empty
    table; further columns pass through.
    """
    return minhash.keep_one(docs, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark passage (ten words in a row, or a whole shorter item).

    Texts without words, and all texts where the benchmark is empty, stay; repeated rows are judged row by row; an empty table
    gives an empty table; further columns pass through.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids and a digest of the bytes that they decode to.

    A null or empty text has no ids; repeated rows are answered row by row; an empty table gives an empty table; other columns
    are not looked at.
    """
    ranks = queries.vocabulary("byte_bpe_50k.tiktoken")
    return bpe.encode_decode(docs, ranks, queries.split_pattern(), keep=("doc_id", "lang", "source"), outputs=("n_tokens", "ids", "decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("minhash", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("byte_bpe", tokenize),
]

#: The classifier of the first stage is not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's table; those of the stages before it are deleted once the next one is written."""
    docs = table(spark, sf_dir, "documents")
    base, before = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        path = f"{base}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
