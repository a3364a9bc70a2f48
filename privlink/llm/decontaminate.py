"""Benchmark decontamination by winnowing, with DataFrame operations only.

Words are hashed, each run of ``K`` words gets a hash of the word hashes, and of every ``W`` consecutive
grams the least hash is kept.  W + K - 1 = ``WINDOW``: a span of WINDOW words that a document shares with an item has the
same kept hash on either side, so no such span is missed.  Items shorter than WINDOW words are one window each; for each
such length present, documents contribute all their grams of that length.

1. One pass over the documents writes their ids, lengths and kept hashes to the shared folder.
2. The kept hashes of documents and items are joined; few documents meet any.
3. Only for those, hits are extended: every window start that could hold the hit is compared, word by word, with the
   windows of the benchmark (a join on the window's words themselves), and overlapping windows are merged into spans.

Every step is linear in the words; no pair of documents and no pair of document and item is formed without a common
window.  A passage that a third of all documents share costs each of them one row for each of its windows.

Defined results: null text has no words; a document without words, or without a common window, has no hits; items without
words are no windows; items with equal windows all count; repeated rows are answered row by row; an empty benchmark hits
nothing; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, bind, cut, fresh_names

#: Words of a window, of a gram, and grams in a winnowing window.
WINDOW, K = 10, 5
W = WINDOW - K + 1
#: Runs of what separates words (a fixed value): ASCII but letters and digits.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-cased words (A-Z only); null text has none."""
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS)
    return F.filter(parts, lambda w: w != "")


def grams(hashes: Column, k: int) -> Column:
    """Hash of each run of k words, by position."""
    return F.transform(
        F.when(F.size(hashes) >= k, F.sequence(F.lit(0), F.size(hashes) - k)).otherwise(F.array().cast("array<int>")),
        lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(k)]),
    )


def kept(gram_hashes: Column, w: int) -> Column:
    """Winnowing: the distinct least hashes of all runs of w grams (of the whole if there are fewer)."""
    least = F.transform(F.sequence(F.lit(0), F.size(gram_hashes) - w), lambda i: F.least(*[F.get(gram_hashes, i + j) for j in range(w)]))
    return F.array_distinct(F.when(F.size(gram_hashes) >= w, least).otherwise(F.array().cast("array<bigint>")))


def _windows(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(len, window, item): each distinct window of each item, as the words joined by a space."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(WINDOW))
    starts = F.sequence(F.lit(1), F.size("w") - size + 1)
    each = items.select("item", "w", size.alias("len"), F.explode(starts).alias("at"))
    return each.select("len", F.concat_ws(" ", F.slice("w", F.col("at"), F.col("len"))).alias("window"), "item").distinct()


def _around(h: Column, n: int, k: int, back: int) -> Column:
    """Starts of the windows of n words that hold a matched gram: i - back .. i for a gram at i."""

    def matched(x):
        return F.exists("_met", lambda m: (m["_print"] == x["g"]) & (m["_len"] == n))

    def starts(x):
        return F.transform(F.sequence(F.greatest(x["i"] - back, F.lit(0)), x["i"]), lambda s: F.struct(s.alias("at"), F.lit(n).alias("len")))

    placed = F.transform(grams(h, k), lambda g, i: F.struct(g.alias("g"), i.alias("i")))
    return F.flatten(F.transform(F.filter(placed, matched), starts))


def contamination(
    df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """Per row: id_col, n_words, n_hit, spans (first and last word of each merged hit), items (sorted strings)."""
    windows = cut(_windows(benchmark, item_col, item_text_col))
    short = sorted(r["len"] for r in windows.where(F.col("len") < WINDOW).select("len").distinct().collect())  # at most WINDOW - 1 numbers
    kinds = [(WINDOW, K, W - 1), *[(n, n, 0) for n in short]]  # window length, gram length, how far a start lies before a gram

    # A row is known by its id and a hash of its text; rows that agree in both have the same result.
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("_id"), text.alias("_text"), F.xxhash64(text).alias("_key"))
    split = rows.select("_id", "_key", words(F.col("_text")).alias("_w"))
    hashed = split.select("_id", "_key", F.size("_w").cast("bigint").alias("n_words"), F.transform("_w", lambda x: F.xxhash64(x)).alias("_h"))

    def prints(h: Column) -> Column:
        parts = [bind(grams(h, K), lambda g: kept(g, W))] + [F.array_distinct(grams(h, n)) for n in short]
        return F.concat(*parts) if short else parts[0]

    first = cut(hashed.select("_id", "_key", "n_words", prints(F.col("_h")).alias("_prints")))

    parts = windows.select("len", F.transform(F.split("window", " "), lambda x: F.xxhash64(x)).alias("_h"))
    of_items = [parts.where(F.col("len") == WINDOW).select(F.explode(bind(grams(F.col("_h"), K), lambda g: kept(g, W))).alias("_print"), F.lit(WINDOW).alias("_len"))]
    of_items += [parts.where(F.col("len") == n).select(F.explode(grams(F.col("_h"), n)).alias("_print"), F.lit(n).alias("_len")) for n in short]
    of_items = functools.reduce(DataFrame.unionByName, of_items).distinct()

    met = first.select("_id", "_key", F.explode("_prints").alias("_print")).join(of_items, "_print")
    met = met.groupBy("_id", "_key").agg(F.collect_set(F.struct("_print", "_len")).alias("_met"))  # at most the prints of one text
    met = cut(met.select(F.col("_id").alias("_mid"), F.col("_key").alias("_mkey"), "_met"))

    again = rows.join(met, F.col("_id").eqNullSafe(F.col("_mid")) & (F.col("_key") == F.col("_mkey"))).dropDuplicates(["_id", "_key"])
    again = again.select("_id", "_key", "_met", words(F.col("_text")).alias("_w"))
    again = again.select("_id", "_key", "_met", "_w", F.transform("_w", lambda x: F.xxhash64(x)).alias("_h"))
    starts = [_around(F.col("_h"), n, k, back) for n, k, back in kinds]
    near = again.select("_id", "_key", "_w", F.explode(F.array_distinct(F.concat(*starts) if short else starts[0])).alias("_s"))
    near = near.where(F.col("_s.at") + F.col("_s.len") <= F.size("_w"))
    near = near.select("_id", "_key", F.col("_s.at").alias("_at"), F.col("_s.len").alias("len"), F.concat_ws(" ", F.slice("_w", F.col("_s.at") + 1, F.col("_s.len"))).alias("window"))
    hits = near.join(windows, ["len", "window"])

    found = hits.groupBy("_id", "_key").agg(F.collect_set(F.struct("_at", "len")).alias("_places"), F.array_sort(F.collect_set("item")).alias("items"))
    found = found.select("_id", "_key", "items", F.array_sort(F.array_distinct(F.flatten(F.transform("_places", lambda p: F.sequence(p["_at"], p["_at"] + p["len"] - 1))))).alias("_hit"))
    begins = F.filter("_hit", lambda x, i: (i == 0) | (F.get(F.col("_hit"), i - 1) != x - 1))
    ends = F.filter("_hit", lambda x, i: (i == F.size("_hit") - 1) | (F.get(F.col("_hit"), i + 1) != x + 1))
    found = found.select(F.col("_id").alias("_fid"), F.col("_key").alias("_fkey"), "items", F.size("_hit").cast("bigint").alias("n_hit"), F.arrays_zip(begins.alias("first"), ends.alias("last")).alias("spans"))

    out = first.select("_id", "_key", "n_words").join(found, F.col("_id").eqNullSafe(F.col("_fid")) & (F.col("_key") == F.col("_fkey")), "left")
    return out.select(
        F.col("_id").alias(id_col),
        F.col("_key").alias("text_key"),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        "spans",
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Hits per document as numbers and a digest of the item ids."""
    return found.select(
        id_col,
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **columns) -> DataFrame:
    """The rows of ``df`` without any hit, with all their columns."""
    hid, hkey = fresh_names(df, "hid", "hkey")
    hit = contamination(df, benchmark, id_col, text_col, **columns).where("n_hit > 0").select(F.col(id_col).alias(hid), F.col("text_key").alias(hkey))
    key = F.xxhash64(F.coalesce(df[text_col], F.lit("")))
    return df.join(hit, df[id_col].eqNullSafe(hit[hid]) & (key == hit[hkey]), "left_anti")
