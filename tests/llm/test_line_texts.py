"""Line dedup keeps each text once, and a second time only for lines that share a block with another."""

import random

from privlink.llm import common, lines
from pyspark.sql import functions as F


def test_only_sharing_lines_have_their_texts_stored_again(spark, monkeypatch):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghijklmnoprstu") for _ in range(7))
    alone = [" ".join(word() for _ in range(20)) for _ in range(300)]
    near = [alone[0].replace(w, w + "x", 1) for w in alone[0].split(" ")[:3]]
    held, put = [], common.Store.put

    def counted(self, df):
        out = put(self, df)
        if "norm" in out.columns:
            held.append(out.count())
        return out

    monkeypatch.setattr(common.Store, "put", counted)
    rows = list(enumerate(alone + near + near))
    found = lines.line_groups(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert len(found) == len(rows) and [r.doc_id for r in found if not r.kept] == list(range(300, 306))
    assert held[0] == len(rows) and max(held[1:]) < 20


def test_distance_of_rests_short_and_long(spark):
    """Heads that differ before a common passage: the whole lines' edit distance decides, whatever the length of the rest."""
    rnd = random.Random(6)
    draw = lambda n: " ".join("".join(rnd.choice("abcde") for _ in range(rnd.randint(1, 6))) for _ in range(n))
    pairs = [("a b c", "a b c"), ("a b c d", "b c d"), ("a b", "a b c"), ("a b a b", "a b")]
    for n in (2, 5, 9, 40):
        for _ in range(12):
            passage, head = draw(8 * n), draw(n)
            other = " ".join(w if rnd.random() < 0.6 else draw(1) for w in head.split(" "))
            pairs += [(f"{head} {passage}", f"{other} {passage}"), (f"{passage} {head}", f"{passage} {other}"), (f"{head} {passage} {head}", f"{other} {passage} {other}")]
    df = spark.createDataFrame(pairs, "a string, b string").withColumn("most", lines._most(F.char_length("a"), F.char_length("b")))
    got = df.select(lines.close("a", "b", F.col("most")).alias("x"), (F.levenshtein("a", "b") <= F.col("most")).alias("y")).collect()
    assert all(r.x == r.y for r in got) and {r.y for r in got} == {True, False}


def test_rests_whose_bytes_multiply_beyond_an_int(spark):
    """Two rests of 60,000 bytes each: the product of their bytes is over 2^31."""
    words = [f"word{i:05d}" for i in range(6000)]
    a = " ".join(words)
    b = " ".join(["other", *words[1:3000], "inserted", *words[3000:-1], "last"])
    c = " ".join(["inserted", *("zzzz" if i % 6 < 3 else w for i, w in enumerate(words)), "last"])
    frame = spark.createDataFrame([(0, a, b), (1, a, c)], "i int, a string, b string")
    most = F.floor(F.greatest(F.length("a"), F.length("b")) * 0.1 + 1e-9).cast("int")
    assert [r.near for r in frame.select("i", lines.close("a", "b", most).alias("near")).orderBy("i").collect()] == [True, False]
    found = lines.line_groups(spark.createDataFrame([(1, a), (2, b), (3, a + "\n" + c)], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.line_no): r.keep_id for r in found} == {(1, 0): 1, (2, 0): 1, (3, 0): 1, (3, 1): 3}
