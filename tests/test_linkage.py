"""Goldens, cross-checks and edge cases of the linkage operators."""

import hashlib
import hmac
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from privlink.functions import bits, hashing, qgram, similarity
from privlink.operators import blocking, datasets, encode, linkage
from privlink.plans import javarand
from privlink.plans.spec import EncodingSpec, blocking_groups, dynamic_size, groups_from_text, groups_to_text, optimal_blocking, plan_sizes
from privlink.sources import files

COMPAT_KEY = b"ZIKRETQI"  # the published key, for golden values only


def test_java_random():
    assert javarand.draws(5, 10, 42) == [0, 3, 8, 4, 0]
    assert javarand.permutation(4096, 420)[:5] == [355, 927, 2828, 871, 1173]
    assert sorted(javarand.permutation(100, 1)) == list(range(100))


def test_positions(spark):
    df = spark.createDataFrame([("_a",), ("é_",)], "g string")
    rows = df.select("g", hashing.hmac_hex(F.col("g"), COMPAT_KEY, "md5").alias("m"), hashing.hmac_hex(F.col("g"), COMPAT_KEY, "sha1").alias("s"), hashing.positions(F.col("g"), 1024, 5, COMPAT_KEY).alias("p")).collect()
    assert rows[0].m == "7a9366630692224b3a252ab19a3ec1e7" and rows[0].s == "9e1c8ca6868c7d2e67b2be59546c815499ada36d"
    assert rows[0].p == [340, 197, 290, 777, 784]
    for r in rows:
        assert r.m == hmac.new(COMPAT_KEY, r.g.encode(), hashlib.md5).hexdigest()
        assert r.p == hashing.positions_of(r.g, 1024, 5, COMPAT_KEY)


@pytest.mark.parametrize("q", [2, 3, 4])
def test_qgrams(spark, q):
    values = ["", "a", "ab", "_a", "a_", "_", " x  y ", "don't", "ß é", None]
    df = spark.createDataFrame([(v,) for v in values], "s string")
    got = df.select("s", qgram.qgrams(F.col("s"), q).alias("g"), qgram.qgram_count(F.col("s"), q).alias("n"), qgram.unique_qgram_count(F.col("s"), q).alias("u")).collect()
    for r in got:
        if not r.s:
            assert r.g == [] and r.n == 0
            continue
        p = "_".join(__import__("re").split(r"[ \t]+", r.s))
        p = p if p.startswith("_") else "_" + p
        p = p if p.endswith("_") else p + "_"
        assert r.g == [p[i : i + q] for i in range(len(p) - q + 1)]
        assert r.n == len(r.g) and r.u == len(set(r.g))


def test_qgrams_of_other_types(spark):
    df = spark.createDataFrame([(-5, 1e20, True), (None, None, None)], "i int, d double, b boolean")
    r = df.select(qgram.qgrams(F.col("i"), 2, "number").alias("i"), qgram.qgrams(F.col("d"), 4, "number").alias("d"), qgram.qgrams(F.col("b"), 2, "boolean").alias("b"), qgram.qgrams(F.col("b"), 4, "boolean").alias("b4")).collect()
    assert r[0].i == ["_-", "-5", "5_"] and r[0].d[0] == "_1.0" and r[0].b == ["_T", "T_"] and r[0].b4 == ["_T_"]
    assert r[1] == ([], [], [], [])
    compat = spark.createDataFrame([(None,)], "s string").select(qgram.qgrams(F.col("s"), 2, compat=True).alias("g")).first()
    assert compat.g == ["_n", "nu", "ul", "ll", "l_"]


def test_clk_golden(spark):
    df = spark.createDataFrame([(1, "conner", "draiden", "irving")], "id int, a string, b string, c string")
    spec = EncodingSpec.make("CLK", ["a", "b", "c"], 10, 2, bits=1024)
    raw = bytes(encode.encode(df, spec, COMPAT_KEY, ["id"], name="e").first().e)
    assert int(np.bitwise_count(np.frombuffer(raw, np.uint8)).sum()) == 199
    assert hashlib.md5(raw).hexdigest() == "33d4e6433416f2eca71589103bcc57cb"


@pytest.mark.parametrize(
    "spec",
    [
        EncodingSpec.make("CLK", ["a", "b"], 5, 2, bits=100),
        EncodingSpec.make("FBF", ["a", "b"], 5, 2, field_bits=50),
        EncodingSpec.make("FBF", ["a", "b"], 5, 2, grams=[3.5, 7.0]),
        EncodingSpec.make("RBF", ["a", "b"], 5, 2, bits=75, field_bits=50),
        EncodingSpec.make("RBF", ["a", "b"], 5, 2, bits=75, grams=[3.5, 7.0]),
        EncodingSpec.make("RBF", ["a", "b"], 5, 2, field_bits=50, weights=[0.3, 0.7]),
        EncodingSpec.make("RBF", ["a", "b"], 5, 2, grams=[3.5, 7.0], weights=[0.3, 0.7]),
    ],
)
def test_schemes(spark, spec):
    """Workers, built-in expressions and the bitmap aggregate agree; the spec survives in the metadata."""
    df = spark.createDataFrame([(1, "ann", "lee"), (2, "", ""), (3, None, "x y"), (4, "ann", "lee")], "id int, a string, b string")
    made = encode.encode(df, spec, b"k", ["id"])
    assert EncodingSpec.of(made.schema) == spec and made.columns == ["id", spec.column]
    raw = {r[0]: bytes(r[1]) for r in made.collect()}
    native = encode.bit_positions(df, spec, b"k", ["id"])
    aggregated = {r.id: bytes(r.filter) for r in bits.from_positions(native, "id", "positions", spec.bits).collect()}
    for r in native.collect():
        mine = [i for i in range(8 * len(raw[r.id])) if raw[r.id][i // 8] >> (i % 8) & 1]
        assert mine == r.positions and len(raw[r.id]) == math.ceil(spec.bits / 8)
    assert aggregated == raw and raw[1] == raw[4] and not any(raw[2])


def test_spec_checks(spark):
    for bad in (
        lambda: EncodingSpec.make("CLK", ["a"]),
        lambda: EncodingSpec.make("RBF", ["a"], bits=10, field_bits=10),
        lambda: EncodingSpec.make("RBF", ["a", "b"], field_bits=10, weights=[0.5, 0.6]),
        lambda: EncodingSpec.make("FBF", ["a"], grams=[float("nan")]),
        lambda: EncodingSpec.make("XXX", ["a"], bits=1),
    ):
        with pytest.raises(ValueError):
            bad()
    spec = EncodingSpec.make("CLK", ["a"], bits=64)
    with pytest.raises(ValueError):
        spec.check(spark.createDataFrame([], "b string").schema)
    assert spec.with_fields({"a": "z"}).fields == ("z",)
    assert dynamic_size(7.0333333, 15) == 153 and dynamic_size(7.5166667, 15) == 164
    assert plan_sizes(["a", "b"], [3.0, 4.0], [0.4, 0.6], 100, 10)[0]["candidate_static"] == 250


def test_filter_similarities(spark):
    rng = np.random.default_rng(1)
    rows = [(i, bytearray(rng.integers(0, 256, 13, dtype=np.uint8).tobytes()), bytearray(rng.integers(0, 256, 13, dtype=np.uint8).tobytes())) for i in range(50)]
    rows.append((50, bytearray(13), bytearray(13)))
    df = spark.createDataFrame(rows, "i int, a binary, b binary")
    a, b = F.col("a"), F.col("b")
    got = df.select("i", bits.hamming(a, b).alias("h"), bits.jaccard(a, b).alias("j"), bits.dice(a, b).alias("d"), bits.similar("jaccard", a, b, 0.0).alias("s"), bits.hamming_words(bits.words(a, 104), bits.words(b, 104)).alias("w")).collect()
    for r, (_, x, y) in zip(sorted(got), rows, strict=True):
        m, n = (int.from_bytes(v, "little") for v in (x, y))
        assert r.h == r.w == (m ^ n).bit_count()
        if m | n:
            assert math.isclose(r.j, (m & n).bit_count() / (m | n).bit_count()) and math.isclose(r.d, 2 * (m & n).bit_count() / (m.bit_count() + n.bit_count()))
        else:
            assert r.j is None and r.d is None and not r.s
    with pytest.raises(ValueError):
        bits.similar("cosine", a, b, 1)


def test_optimal_blocking():
    got = {d: (p.collisions, p.groups) for d in (1e-3, 1e-4, 1e-5, 1e-6) for p in [optimal_blocking(180, 4096, d, 30)]}
    assert got == {1e-3: (4, 52), 1e-4: (6, 74), 1e-5: (7, 91), 1e-6: (9, 114)}
    groups = blocking_groups(100, 5, 3, 7)
    assert groups_from_text(groups_to_text(groups)) == groups and all(len(set(g)) == 5 for g in groups)


@pytest.mark.parametrize("k", [1, 15, 70])
def test_blocking_against_brute_force(spark, k):
    names = ["anna lee", "anna leh", "bob stone", "bob stones", "carl", "", "dora", "dora"]
    a = spark.createDataFrame([(f"a{i}", n) for i, n in enumerate(names)], "id string, n string")
    b = spark.createDataFrame([(f"b{i}", n) for i, n in enumerate(reversed(names))], "id string, n string")
    spec = EncodingSpec.make("CLK", ["n"], 10, 2, bits=256)
    ea, eb = (encode.encode(x, spec, b"k", ["id"]) for x in (a, b))
    groups = blocking_groups(256, k, 6, 3)
    ra, rb = ({r[0]: int.from_bytes(r[1], "little") for r in x.collect()} for x in (ea, eb))
    key = lambda v, g: tuple(v >> p & 1 for p in g)
    want = {(i, j) for i, x in ra.items() for j, y in rb.items() if sum(key(x, g) == key(y, g) for g in groups) >= 2 and (x ^ y).bit_count() <= 40}
    for s in blocking.STRATEGIES:
        assert {tuple(r) for r in blocking.block(ea, eb, groups, 2, 40, strategy=s).collect()} == want
    assert blocking.block(ea.limit(0), eb, groups, 2, 40).count() == 0
    with pytest.raises(ValueError):
        blocking.block(ea, eb, groups, 7, 40)


def test_clear_text_similarities(spark):
    assert math.isclose(similarity.jaro("martha", "marhta"), 17 / 18) and similarity.jaro("", "a") == 0.0
    assert math.isclose(similarity.jaro_winkler("martha", "marhta"), 17 / 18 + 0.1 * 3 / 18)
    df = spark.createDataFrame([("night", "nacht"), ("abcd", "abcd"), ("", ""), (None, "x")], "a string, b string")
    for m in similarity.METHODS:
        assert [r.s for r in df.select(similarity.similar(m, F.col("a"), F.col("b"), 0.9).alias("s")).collect()][:2] == [False, True]
    r = df.select(similarity.score("jaccard_bigrams", F.col("a"), F.col("b")).alias("s")).first()
    assert math.isclose(r.s, 3 / 9)


def test_em():
    est = linkage.expectation_maximisation([6858, 145, 107, 30], 0.9, 0.1, 0.01)
    assert est.iterations == 7
    assert np.allclose([*est.m, *est.u, est.p], [0.946631, 0.934023, 0.020431, 0.015141, 0.004404], atol=2e-6)
    w = linkage.field_weights([0.9, 0.5], [0.1, 0.5])
    assert math.isclose(w[0]["agree"], math.log(9)) and w[1]["share"] == 0 and math.isclose(w[0]["share"], 1)
    assert linkage.field_weights([1.0], [0.0])[0]["agree"] > 700


def test_pairs_and_ranks(spark):
    df = spark.range(9).withColumnRenamed("id", "uid")
    one = {tuple(r) for r in linkage.self_pairs(df, "uid", []).collect()}
    assert one == {tuple(r) for r in linkage.self_pairs(df, "uid", [], blocks=3).collect()} == set(itertools.combinations(range(9), 2))
    ranked = linkage.self_pairs(df, "uid", []).select("uid_a", "uid_b", linkage.pair_rank(F.col("uid_a"), F.col("uid_b")).alias("r")).collect()
    assert sorted(r.r for r in ranked) == list(range(36)) and all(r.r == linkage.rank_combination([r.uid_a, r.uid_b]) for r in ranked)
    assert linkage.ranks_with(4, 9) == sorted(r.r for r in ranked if 4 in (r.uid_a, r.uid_b))
    truth = spark.createDataFrame([("a12", "b12_3"), ("a1", "b2"), ("x", "x")], "a string, b string").select(linkage.truth_by_digits(F.col("a"), F.col("b")).alias("t")).collect()
    assert [r.t for r in truth] == [True, False, False]


def test_uid_sort_sample(spark):
    df = spark.createDataFrame([(i % 7, f"n{i % 5}", i) for i in range(500)] + [(1, "n1", 1)] * 3, "a int, b string, c int").repartition(5)
    rows = datasets.with_uid(df, ["b", "a"], start=10).orderBy("uid").collect()
    assert [r.uid for r in rows] == list(range(10, 513)) and [(r.b, r.a, r.c) for r in rows] == sorted((r.b, r.a, r.c) for r in rows)
    assert datasets.with_uid(df.limit(0), ["a"]).count() == 0
    assert datasets.sort_rows(df, ["b"], ("b",)).columns == ["b", "a", "c"]
    assert datasets.sample(df, 20, 1).collect() == datasets.sample(df, 20, 1).collect() and datasets.sample(df, 9999, 1).count() == 503
    with pytest.raises(ValueError):
        datasets.check_fields(df, ["zz"])


def test_files(spark, tmp_path):
    xml = tmp_path / "d.xml"
    xml.write_text(
        '<dblp><article key="k1"><author>A &amp;uuml;ber</author><author>B</author><title>T</title><year>1999</year></article>'
        '<book key="k2"><title>Only</title></book><note key="k3"><title>x</title></note></dblp>'
    )
    got = {r.key: (r.author, r.title, r.year) for r in files.read_bibliography(spark, str(xml)).collect()}
    assert got == {"k1": ("A über", "T", "1999"), "k2": ("-missing-", "Only", "-missing-")}
    csv = tmp_path / "c.csv"
    csv.write_text("1,x,,a,b\n,,2.5,\n")
    rows = files.read_csv(spark, str(csv), "i int, s string, d double, rest string").collect()
    assert rows[0].i == 1 and math.isnan(rows[0].d) and rows[0].rest == "a,b" and rows[1].i == 0 and rows[1].s == "-NA-" and rows[1].d == 2.5
    stats = {"record_count": 3, "fields": {"a": {"length": 1.5}}, "em": {"p": 0.25}}
    assert files.stats_from_properties(files.stats_to_properties(stats)) == stats
    assert files.frequencies_from_json(files.frequencies_to_json([1, 2], ["a"])) == ([1, 2], ["a"])
    assert len(files.report_pairs([(str(i), "b") for i in range(200)]).splitlines()) == 52


def test_streamed_linkage(spark, tmp_path):
    from privlink.streaming.link import link_stream

    df = spark.createDataFrame([("1", "anna"), ("2", "bob")], "id string, n string")
    spec = EncodingSpec.make("CLK", ["n"], 10, 2, bits=256)
    base = encode.encode(df, spec, b"k", ["id"], name="e")
    base.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(base.schema).parquet(str(tmp_path / "in"))
    out = []
    q = link_stream(stream, base, blocking_groups(256, 5, 4, 1), 1, 0, lambda m, n: out.extend(map(tuple, m.collect())), str(tmp_path / "cp"))
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert set(out) == {("1", "1"), ("2", "2")}


def test_null_filters_and_bits(spark):
    rows = [(1, bytes([0b101, 0]), bytes([0b100, 0b1])), (2, None, bytes(2)), (3, bytes(2), bytes(2)), (4, None, None)]
    df = spark.createDataFrame(rows, "id int, a binary, b binary")
    got = {r.id: r for r in df.select("id", bits.hamming(F.col("a"), F.col("b")).alias("h"), bits.common_ones(F.col("a"), F.col("b")).alias("c"), bits.jaccard(F.col("a"), F.col("b")).alias("j"), bits.dice(F.col("a"), F.col("b")).alias("d"), bits.similar("hamming", F.col("a"), F.col("b"), 3).alias("s")).collect()}
    assert (got[1].h, got[1].c, got[1].s) == (2, 1, True) and abs(got[1].j - 1 / 3) < 1e-9 and got[1].d == 0.5
    assert all((got[i].h, got[i].c, got[i].j, got[i].d, got[i].s) == (None, None, None, None, False) for i in (2, 4)) and got[3].j is None
    one = df.where("id = 1").select(bits.count_ones(F.col("a"), 16).alias("n"), bits.set_positions(F.col("b"), 16).alias("on"), bits.set_positions(F.col("a"), 10, ones=False).alias("off"), bits.test_bit(F.col("b"), 8).alias("t"), bits.show_bits(F.col("b")).alias("x")).first()
    assert tuple(one) == (2, [2, 8], [1, 3, 4, 5, 6, 7, 8, 9], True, "0104")
    keys = blocking.lsh_keys(df, [[0, 2], [8, 9]], "a")
    assert sorted((r.id, r.grp, r.key) for r in keys.collect()) == [(1, 0, 3), (1, 1, 0), (3, 0, 0), (3, 1, 0)]


def test_estimates_of_edge_histograms():
    assert linkage.expectation_maximisation([0, 0, 0, 0]).iterations == 0
    one_sided = linkage.expectation_maximisation([0, 0, 0, 10])
    assert all(0 <= x <= 1 for x in (*one_sided.m, *one_sided.u, one_sided.p))
    assert [r["share"] for r in linkage.field_weights([0.5, 0.5], [0.5, 0.5])] == [0.5, 0.5]


def test_files_of_a_plan(spark, tmp_path):
    people = spark.createDataFrame([(i, n, s) for i, (n, s) in enumerate([("ann", "smith"), ("anne", "smith"), ("bob", "jones"), ("bobby", "jones"), ("carl", "brown")])], "uid int, name string, surname string")
    plan = linkage.field_plan(people, "uid", ["name", "surname"], 512, 10)
    files.save_statistics(spark, f"file://{tmp_path}/stats.properties", plan)
    back = files.load_statistics(spark, f"file://{tmp_path}/stats.properties")
    assert back["record_count"] == 5 and back["fields"] == plan["fields"] and back["em"] == plan["em"]
    assert [r["field"] for r in plan["sizes"]] == ["name", "surname"] and abs(sum(r["weight"] for r in plan["sizes"]) - 1) < 1e-9
    spec = EncodingSpec.make("CLK", ["name", "surname"], 10, 2, bits=512)
    made = encode.encode(people, spec, b"key", ["uid"], name="enc")
    files.save_schema(made, f"file://{tmp_path}/schema.json")
    assert EncodingSpec.of(files.load_schema(spark, f"file://{tmp_path}/schema.json")) == spec == EncodingSpec.from_column(spec.column)
    with pytest.raises(ValueError):
        EncodingSpec.from_column("name")
    assert [(r.name, r.encoding is None) for r in files.describe(made).orderBy("position").collect()] == [("uid", True), ("enc", False)]
    files.write_dataset(made, f"file://{tmp_path}/d", parts=2)
    assert files.read_dataset(spark, f"file://{tmp_path}/d").count() == 5 and files.read_dataset(spark, f"file://{tmp_path}/d", limit=2, order_by=["uid"]).count() == 2


def test_timed_runs(spark, tmp_path):
    spec = EncodingSpec.make("CLK", ["name"], 10, 2, bits=256)
    people = encode.encode(spark.createDataFrame([(i, f"person {i % 7}") for i in range(20)], "id int, name string"), spec, b"key", ["id"], name="enc")
    groups = blocking_groups(256, 8, 4, 1)
    runs = {s: (people, people, groups, 2, 5, F.col("aid") == F.col("bid"), "hamming", s) for s in ("shuffle", "records")}
    a, b = blocking.timed_runs(runs, f"{tmp_path}/runs.csv")
    assert {k: v for k, v in a.items() if k not in ("run", "strategy", "seconds")} == {k: v for k, v in b.items() if k not in ("run", "strategy", "seconds")} and a["n_true"] == 20
    assert open(f"{tmp_path}/runs.csv").read().count("\n") == 3


def test_seldom_called_functions(spark):
    datasets.check_name("people_1")
    with pytest.raises(ValueError):
        datasets.check_name("no name")
    assert 0 < datasets.quick_sample(spark.range(100), 10, 1).count() <= 10
    assert abs(bits.false_positive_rate(1024, 10, 50) - (1 - math.exp(-500 / 1024)) ** 10) < 1e-12
    places = hashing.linear_positions("_a", 1024, 5, b"key")
    assert len(places) == 5 and all(0 <= p < 1024 for p in places) and (places[2] - places[1]) % 1024 == (places[1] - places[0]) % 1024
