"""Exact dedup by content sort, with DataFrame operations only.

Normalised texts are range-partitioned by sampled splitters and sorted externally, so that equal texts lie next to each
other; the window operator then compares neighbours in full and keeps one row per run.  The splitter key is
``(first characters, 64-bit hash, salt)``: it is short whatever the text's length, so the sample that Spark draws for
the splitters stays small, and a run of equal texts stays within one key.

Hot groups: a first light pass counts rows by hash.  A hash with more than ``rows / (4 x shuffle partitions)`` rows is
*heavy*; there are fewer than ``4 x shuffle partitions`` of them whatever the input, so their list is broadcast.  Rows of
heavy texts are dealt over ``SALTS`` runs, each run keeps its best row, and the few best rows (at most SALTS for each
heavy text) are compared again in full and merged.

Defined results: a null text counts as empty and empty texts equal each other; null ids come after all others; of
repeated rows with the same id and text one is kept; an empty table gives an empty table; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh_names, shuffle_partitions, without_space

#: Runs that a heavy text is dealt over.
SALTS = 64
#: Characters of the normalised text in the splitter key.
HEAD = 24


def normalised(text: Column) -> Column:
    return without_space(F.coalesce(text, F.lit("")))


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col``, keep_id, group_size, kept, text_sha256.

    Of equal texts, the row with the most code points in the original text stays, then the smallest id.
    """
    spark = df.sparkSession
    rows = df.select(df[id_col].alias("_id"), normalised(df[text_col]).alias("_text"), F.length(F.coalesce(df[text_col], F.lit(""))).alias("_len"))
    rows = rows.withColumn("_hash", F.xxhash64("_text"))

    limit = max(SALTS, df.count() // (4 * shuffle_partitions(spark)))
    heavy = rows.groupBy("_hash").agg(F.count("*").alias("_n")).where(F.col("_n") > limit).select("_hash", F.lit(True).alias("_heavy"))
    keyed = (
        rows.join(F.broadcast(heavy), "_hash", "left")
        .withColumn("_heavy", F.coalesce("_heavy", F.lit(False)))
        .withColumn("_head", F.substring("_text", 1, HEAD))
        .withColumn("_salt", F.when(F.col("_heavy"), F.pmod(F.xxhash64("_id"), F.lit(SALTS))).otherwise(0))
    )
    placed = keyed.repartitionByRange("_head", "_hash", "_salt")
    run = Window.partitionBy("_head", "_hash", "_salt", "_text").orderBy(F.desc("_len"), F.asc_nulls_last("_id"))
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = placed.select(
        "_id", "_hash", "_heavy",
        F.sha2("_text", 256).alias("_sha"),
        F.first("_id").over(whole).alias("_keep"),
        F.first("_len").over(whole).alias("_keep_len"),
        F.count("*").over(whole).alias("_size"),
        F.row_number().over(run).alias("_rank"),
        F.when(F.col("_heavy"), F.col("_text")).alias("_again"),
    ).withColumn("_again", F.when(F.col("_rank") == 1, F.col("_again")))
    runs = cut(runs)

    best = F.min(F.struct((-F.col("_keep_len")).alias("a"), F.col("_keep").isNull().alias("b"), F.col("_keep").alias("c")))
    merged = (
        runs.where(F.col("_heavy") & (F.col("_rank") == 1))
        .groupBy("_hash", "_again")
        .agg(best.alias("_b"), F.sum("_size").alias("_all"), F.first("_sha").alias("_sha"))
        .select("_hash", "_sha", F.col("_b.c").alias("_best"), "_all", F.lit(True).alias("_found"))
    )
    out = runs.join(F.broadcast(merged), ["_hash", "_sha"], "left")
    keep = F.when(F.col("_found"), F.col("_best")).otherwise(F.col("_keep"))
    return out.select(
        F.col("_id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("_all", "_size").alias("group_size"),
        ((F.col("_rank") == 1) & F.col("_keep").eqNullSafe(keep)).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns; equal rows with one id stay once."""
    sid, ssha, sha, rank = fresh_names(df, "sid", "ssha", "sha", "rank")
    stay = groups(df, id_col, text_col).where("kept").select(F.col(id_col).alias(sid), F.col("text_sha256").alias(ssha))
    marked = df.withColumn(sha, F.sha2(normalised(df[text_col]), 256))
    both = marked.join(stay, marked[id_col].eqNullSafe(stay[sid]) & (marked[sha] == stay[ssha]), "left_semi")
    # a repeated id may carry the same normalised text in several rows; one of them is the row that stays
    order = Window.partitionBy(id_col, sha).orderBy(F.desc(F.length(text_col)), *[F.col(c) for c, t in df.dtypes if c not in (id_col, text_col) and "map<" not in t and t != "variant"])
    return both.withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1).select(*df.columns)
