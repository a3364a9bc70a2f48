"""Toxicity by lexicon: a trie of terms and stems learned from labels, met by Levenshtein automata, scored in context.

*Lexicon.*  From a bounded sample of labelled rows (``SAMPLE`` rows with the smallest id hashes) built-in aggregations
count, for each word and each word beginning of ``STEMS`` letters, the toxic and the clean texts that hold it; those with
a high smoothed log odds become terms.  Words are whole terms; a beginning that STEM_TERMS of them share is a stem, which any
ending may follow.

*Matching.*  Each distinct word of a text is run through the trie: exactly, by stem, or - for terms of ``FUZZY_FROM``
letters and more - by the deterministic automaton of edit distance one, simulated on the trie as (node, offset, errors)
states so that only shared prefixes are visited.  Workers remember the answers of the words seen last.

*Context.*  A match within quotation marks, or within ``WINDOW`` words of a word that reports speech, counts as quoted.
A logistic regression over the match counts of the sample (plain, stem, misspelled, quoted, and their density) gives the
score, so how much a quotation or a misspelling counts is learned.

Inputs of a score are the text alone.  Defined results: null and empty texts have no matches and get the score of a text
without matches; repeated rows are scored row by row; without labels of both classes the lexicon is empty and every score
is the share of toxic labels (0 if none); an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, ship

#: Bound on labelled rows that the lexicon and the weights are fitted on.
SAMPLE = 12_000
STEMS = (4, 5, 6)
#: The least log odds and number of toxic texts of a term.  They bound the lexicon with the sample: a text of the sample holds so
#: many different words at most, and MIN_TEXTS texts are needed for each term.
MIN_ODDS, MIN_TEXTS = 3.5, 4
STEM_TERMS = 4
FUZZY_FROM = 5
WINDOW = 6
REMEMBER = 300_000
# Words that report speech, and quotation marks.
REPORTING = frozenset("said says quote quoted quotes called calls term word slur wrote disse dit dijo sagte schrieb nannte".split())
QUOTES = "\"'“”‘’«»„"
#: A word of the lexicon: letters only, of any number.
LETTERS = r"\p{L}+"
WORD = re.compile(r"[^\W\d_]+(?:[\d@$!]+[^\W\d_]+)*")


def build_trie(words: list[str], stems: list[str]) -> dict:
    """Nested dicts by letter; "" marks the end of a word, "*" the end of a stem."""
    root: dict = {}
    for kind, terms in (("", words), ("*", stems)):
        for t in terms:
            node = root
            for ch in t:
                node = node.setdefault(ch, {})
            node[kind] = True
    return root


def match(trie: dict, word: str, fuzzy_from: int = FUZZY_FROM) -> str:
    """"exact", "stem", "fuzzy" or "": how the word meets the lexicon."""
    node, depth = trie, 0
    while True:
        if "*" in node:
            return "stem"
        if depth == len(word) or word[depth] not in node:
            break
        node = node[word[depth]]
        depth += 1
    if depth == len(word) and "" in node:
        return "exact"
    # Automaton of edit distance one: follow the word without error, branch once at each node on the way.
    n, node, i = len(word), trie, 0
    if n < fuzzy_from - 1:
        return ""
    while node is not None:
        if i < n and _rest(node, word, i + 1, i, fuzzy_from):  # a letter too many
            return "fuzzy"
        for ch, child in node.items():
            if len(ch) != 1 or ch == "*":
                continue
            if i < n and ch != word[i] and _rest(child, word, i + 1, i + 1, fuzzy_from):  # another letter
                return "fuzzy"
            if _rest(child, word, i, i + 1, fuzzy_from):  # a letter too few
                return "fuzzy"
            if i + 1 < n and ch == word[i + 1] and word[i] in child and _rest(child[word[i]], word, i + 2, i + 2, fuzzy_from):  # two swapped
                return "fuzzy"
        node = node.get(word[i]) if i < n else None
        i += 1
    return ""


def _rest(node: dict, word: str, i: int, depth: int, fuzzy_from: int) -> bool:
    """The rest of the word leads, without error, to the end of a whole term that is long enough."""
    for ch in word[i:]:
        node = node.get(ch)
        if node is None:
            return False
        depth += 1
    return "" in node and depth >= fuzzy_from


def features(trie: dict, text: str, known: dict[str, str]) -> tuple[float, ...]:
    """log counts of plain, stem and misspelled matches, of quoted ones, whether any is plain, and their density."""
    lowered = text.lower()
    words = WORD.findall(lowered)
    hits = {}
    for w in set(words):
        kind = known.get(w)
        if kind is None:
            kind = known[w] = match(trie, w)
        if kind:
            hits[w] = kind
    if not hits:
        return (0.0,) * 6
    spans = [(m.start(), m.end()) for m in WORD.finditer(lowered)]
    count = {"exact": 0, "stem": 0, "fuzzy": 0, "quoted": 0}
    for k, w in enumerate(words):
        kind = hits.get(w)
        if kind:
            a, b = spans[k]
            marks = lowered[max(0, a - 1) : a].strip() in QUOTES and lowered[max(0, a - 1) : a] and lowered[b : b + 1] and lowered[b : b + 1] in QUOTES
            told = REPORTING.intersection(words[max(0, k - WINDOW) : k + WINDOW + 1])
            count["quoted" if (marks and lowered[a - 1] in QUOTES) or told else kind] += 1
    plain = count["exact"] + count["stem"] + count["fuzzy"]
    return (*(math.log1p(count[k]) for k in ("exact", "stem", "fuzzy", "quoted")), float(plain > 0), math.log1p(100 * plain / len(words)))


class Model:
    """Lexicon and weights; bounded by the sample that they were learned from, shipped with the scoring function."""

    def __init__(self, words: list[str], stems: list[str], weights: list[float]):
        self.words, self.stems, self.weights = words, stems, weights
        self.trie = build_trie(words, stems)


def _map(df: DataFrame, keep: tuple[str, ...], text_col: str, trie: dict, made: T.StructType, of) -> DataFrame:
    picked = df.select(*keep, df[text_col].alias("__text"))
    schema = T.StructType([f for f in picked.schema if f.name != "__text"] + list(made))
    ship(df.sparkSession)

    def run(batches):
        known: dict[str, str] = {}
        for batch in batches:
            rows = []
            for text in batch.column(batch.num_columns - 1):
                rows.append(of(features(trie, text.as_py() or "", known)))
                if len(known) > REMEMBER:
                    known.clear()
            cols = [pa.array([r[i] for r in rows], type=pa.float64() if isinstance(f.dataType, T.DoubleType) else pa.int32()) for i, f in enumerate(made)]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(batch.num_columns - 1)] + cols, names=[f.name for f in schema])

    return picked.mapInArrow(run, schema)


def _terms(texts: DataFrame, pos: int, neg: int) -> tuple[list[str], list[str]]:
    """Words and stems with high log odds; their counts are aggregated before anything is shuffled or collected."""
    each = texts.groupBy("text").agg(F.max("toxic").alias("toxic"))  # a copy is no further evidence
    each = each.select("toxic", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(LETTERS), F.lit(0))).alias("w"))

    def starts(k: int):
        return F.transform("w", lambda x: F.when(F.length(x) > k, F.struct(F.lit(k).alias("k"), F.substring(x, 1, k).alias("t"))))

    stems = [starts(k) for k in STEMS]
    whole = F.transform("w", lambda x: F.struct(F.lit(0).alias("k"), x.alias("t")))
    rows = each.select("toxic", F.explode(F.concat(whole, F.array_distinct(F.flatten(F.array(*stems))))).alias("e")).where("e is not null")
    found = rows.groupBy("e.k", "e.t").agg(F.sum("toxic").alias("p"), F.count("*").alias("n"))
    odds = F.log((F.col("p") + 0.5) / (pos + 1)) - F.log((F.col("n") - F.col("p") + 0.5) / (neg + 1))
    good = found.withColumn("o", odds).where((F.col("o") >= MIN_ODDS) & (F.col("p") >= max(MIN_TEXTS, pos // 100)) & (F.col("n") - F.col("p") <= 0.05 * F.col("n")))
    good = cut(good.select("k", "t", "p"))
    # A real term stands behind many different words; a word of one passage that was copied always follows the same one.
    order = F.regexp_extract_all(F.lower("text"), F.lit(LETTERS), F.lit(0))
    after = F.transform("w", lambda x, i: F.struct(x.alias("t"), F.when(i > 0, F.get(F.col("w"), i - 1)).otherwise("").alias("before")))
    places = texts.where("toxic = 1").select(order.alias("w")).select(F.explode(after).alias("e")).select("e.*")
    every = [places.select(F.lit(0).alias("k"), "t", "before")] + [places.where(F.length("t") > k).select(F.lit(k).alias("k"), F.substring("t", 1, k).alias("t"), "before") for k in STEMS]
    spread = functools.reduce(DataFrame.unionByName, every).join(good, ["k", "t"]).groupBy("k", "t", "p").agg(F.countDistinct("before").alias("c"))
    top = spread.where(F.col("c") >= F.greatest(F.lit(MIN_TEXTS), F.col("p") / 3)).orderBy(F.desc("p"), "k", "t").collect()  # bounded by the sample
    whole_words = [r.t for r in top if r.k == 0]
    # A stem stands for several whole terms; the shortest that is good enough is taken.
    picked: list[str] = []
    for r in sorted((r for r in top if r.k), key=lambda r: (len(r.t), r.t)):
        if not any(r.t.startswith(s) for s in picked) and sum(w.startswith(r.t) for w in whole_words) >= STEM_TERMS:
            picked.append(r.t)
    return whole_words, picked  # terms that a stem covers stay beside it, so that a misspelling within the stem is met


def _weights(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Logistic regression by Newton steps with a small ridge; the bias comes last."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), 0.05)
    ridge[-1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return [float(v) for v in w]


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """``labels``: the rows that may be learned from (id_col, label_col)."""
    ids = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(SAMPLE)
    )
    texts = cut(df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(ids), "_id").repartition("_id"))
    n = {r.toxic: r.n for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    pos, neg = n.get(1, 0), n.get(0, 0)
    if not pos or not neg:
        return Model([], [], [0.0] * 6 + [30.0 if pos else -30.0])
    words, stems = _terms(texts, pos, neg)
    made = T.StructType([T.StructField(f"f{i}", T.DoubleType()) for i in range(6)])
    rows = _map(texts, ("toxic",), "text", build_trie(words, stems), made, lambda f: f).collect()  # at most SAMPLE rows of numbers
    data = np.array([tuple(r) for r in rows], dtype=float)
    return Model(words, stems, _weights(data[:, 1:], data[:, 0]))


def score(df: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` with score (0 to 1) and predicted (score >= 0.5).  A narrow map."""
    weights = tuple(model.weights)

    def of(f):
        z = sum(a * b for a, b in zip(f, weights, strict=False)) + weights[-1]
        s = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
        return s, int(s >= 0.5)

    made = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return _map(df, keep, text_col, model.trie, made, of)


def keep_clean(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of df that are predicted clean, with all their columns."""
    names = [f"c{i}" for i in range(len(df.columns))]
    scored = score(df.toDF(*names), model, text_col=names[df.columns.index(text_col)], keep=tuple(names))
    return scored.where("predicted = 0").select(*names).toDF(*df.columns)
