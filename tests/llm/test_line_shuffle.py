"""What the lines' buckets shuffle."""

import random

from privlink.llm import lines


def _written(spark) -> int:
    return sum(e.totalShuffleWrite() for e in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().statusStore().executorList(False)))


def test_blocks_of_one_line_shuffle_little(spark):
    """Lines that share no block: their hashes and SimHashes go through one shuffle, a block's key and number through the next."""
    draw = random.Random(5)
    word = lambda: "".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=6))
    rows = [(i, "\n".join(" ".join(word() for _ in range(14)) for _ in range(20))) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache()
    df.count()
    before = _written(spark)
    assert lines.line_groups(df).where("kept").count() == 20_000
    assert (_written(spark) - before) / 20_000 < 210  # 239 with the ends in the large aggregate
