"""Work that is done once, many pairs at a time, or before pairs are dealt out."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from privlink.functions import similarity
from privlink.operators import blocking, encode, linkage
from privlink.plans.spec import EncodingSpec, blocking_groups


@pytest.mark.parametrize("letters", ["ab", "abcdefgh", "0123456789#Sé😀"])
def test_jaro_winkler_of_many(spark, letters):
    draw = random.Random(7)
    text = lambda: "".join(draw.choices(letters, k=draw.randrange(0, 20)))
    pairs = [(text(), text()) for _ in range(2000)] + [("ab" * 40, "ba" * 40), (text() * 9, text()), ("", ""), ("x", "x")]
    want = [similarity.jaro_winkler(a, b) for a, b in pairs]
    short = [i for i, p in enumerate(pairs) if max(map(len, p)) <= similarity.LETTERS]
    assert similarity.jaro_winkler_many(*map(list, zip(*[pairs[i] for i in short], strict=True))).tolist() == [want[i] for i in short]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate([*pairs, (None, "a"), ("a", None)])], "i int, a string, b string")
    got = [r.s for r in df.select("i", similarity.score("jaro_winkler", F.col("a"), F.col("b")).alias("s")).orderBy("i").collect()]
    assert got[:-2] == want and all(x is None or x != x for x in got[-2:])


def test_vectors_are_computed_once(spark):
    df = spark.createDataFrame([(i, f"name{i % 3}", f"{i % 5}") for i in range(60)], "id int, name string, size string")
    plan = linkage.pair_histogram(df, "id", ["name", "size"], blocks=2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def filters(bits, seed):
    """Ids with filters: copies, neighbours, a repeated id, nulls."""
    draw = random.Random(seed)
    some = [random.Random(1).getrandbits(bits) for _ in range(4)]
    rows = [(i, some[i % 4] ^ sum(1 << draw.randrange(bits) for _ in range(draw.randrange(30))) % (1 << bits)) for i in range(40)]
    return [*rows, (3, some[0]), (50, some[1]), (51, some[1]), (52, None), (None, some[2])]


@pytest.mark.parametrize("bits", [100, 1500])
@pytest.mark.parametrize("strategy", [*blocking.STRATEGIES, "many"])
def test_far_pairs_go_where_they_are_met(spark, monkeypatch, strategy, bits):
    if strategy == "many":  # too many records to hold
        monkeypatch.setattr(blocking, "BROADCAST_RECORDS", 1)
        strategy = "broadcast"
    spec = EncodingSpec.make("CLK", ["n"], 1, 2, bits=bits)
    groups, least, far = blocking_groups(bits, 12, 8, 3), 2, 12
    rows = [filters(bits, seed) for seed in (1, 2)]
    side = lambda r: spark.createDataFrame([(i, None if v is None else v.to_bytes(-(-bits // 8), "little")) for i, v in r], "id int, enc binary")
    a, b = (side(r).select("id", F.col("enc").alias("enc", metadata={"encoding": spec.to_json()})) for r in rows)
    there = [[(i, v) for i, v in r if i is not None and v is not None] for r in rows]
    shared = lambda x, y: sum(all(x >> p & 1 == y >> p & 1 for p in g) for g in groups)
    hits: dict = {}
    for (i, x), (j, y) in itertools.product(*there):
        hits[i, j] = hits.get((i, j), 0) + shared(x, y)
    want = sorted((i, j) for (i, x), (j, y) in itertools.product(*there) if hits[i, j] >= least and (x ^ y).bit_count() <= far)
    assert len(want) > 20 and sorted(map(tuple, blocking.block(a, b, groups, least, far, strategy=strategy).collect())) == want
    heads = [blocking._classes(x, "enc", "id")[0] for x in (a, b)]
    met = blocking.near(*heads, groups, far, bits, "enc", "enc", strategy).count()
    every = blocking.candidates(*(blocking.lsh_keys(x.drop("_rows"), groups, "enc") for x in heads), "shuffle").count()
    assert met == every if blocking.BROADCAST_RECORDS == 1 else met < every


def test_fields_are_encoded_once(spark):
    spec = EncodingSpec.make("CLK", ["name", "size"], 3, 2, bits=200)
    rows = [(i, n, s) for i, (n, s) in enumerate([("ann", 1), ("ann", 1), ("bob", 1), (None, 1), (None, 1), (None, None), ("", None)])]
    df = spark.createDataFrame([*rows, (0, "bob", 1), (None, "ann", 1)], "id int, name string, size int")
    once = encode.encode_distinct(df, spec, b"key", ["id", "name"], name="enc")
    each = encode.encode(df, spec, b"key", ["id", "name"], name="enc")
    assert sorted(map(str, once.collect())) == sorted(map(str, each.collect())) and once.columns == each.columns
    assert EncodingSpec.of(once.schema) == EncodingSpec.of(each.schema)
    assert encode.encode_distinct(df.limit(0), spec, b"key", ["id"]).count() == 0
