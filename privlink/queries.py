"""Queries of the linkage operators over the star-schema tables, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import bits, hashing, qgram, similarity
from .operators import blocking, datasets, encode, linkage, meeting, tables
from .plans.spec import EncodingSpec, blocking_groups, optimal_blocking
from .sources import files

#: Key of the example queries; real parties agree on a secret one.
KEY = b"example-key"
BITS, HASHES, Q = 1024, 15, 2
FIELDS = ["p_name", "p_brand", "p_type", "p_size"]
GROUPS, GROUP_BITS, COLLISIONS, DISTANCE, SEED = 12, 15, 2, 38, 42
THRESHOLDS = [0.5, 0.6, 0.7, 0.8, 0.9]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clk_spec() -> EncodingSpec:
    return EncodingSpec.make("CLK", FIELDS, HASHES, Q, bits=BITS)


def fbf_spec() -> EncodingSpec:
    return EncodingSpec.make("FBF", ["p_name", "p_brand"], HASHES, Q, field_bits=500)


def rbf_spec() -> EncodingSpec:
    return EncodingSpec.make("RBF", ["p_name", "p_brand"], HASHES, Q, bits=600, field_bits=500, seeds=[11, 12], permutation_seed=13)


def _part(spark: SparkSession, sf_dir: str, typo: bool = False) -> DataFrame:
    part = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), *FIELDS)
    return part.withColumn("p_name", F.expr("concat(substr(p_name, 1, 1), substr(p_name, 3))")) if typo else part


def _clk(spark: SparkSession, sf_dir: str, typo: bool = False) -> DataFrame:
    return encode.encode_distinct(_part(spark, sf_dir, typo), clk_spec(), KEY, ["id"], name="enc")


def _keys(df: DataFrame) -> DataFrame:
    return blocking.lsh_keys(df, blocking_groups(BITS, GROUP_BITS, GROUPS, SEED), "enc")


def _set_bits(n: int) -> str:
    return f"array_join(filter(sequence(0, {n - 1}), i -> (cast(conv(hex(substring(enc, i div 8 + 1, 1)), 16, 10) as bigint) & shiftleft(1L, i % 8)) <> 0), ' ')"


def _encoded(spec: EncodingSpec):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = encode.encode(_part(spark, sf_dir), spec, KEY, ["id"], name="enc")
        return made.select("id", F.expr(_set_bits(spec.bits)).alias("set_bits"))

    return run


def qgram_bag(spark, sf_dir):
    part = _read(spark, sf_dir, "part")
    return part.select("p_partkey", *[F.array_join(qgram.qgrams(F.col("p_name"), q), "|").alias(f"q{q}") for q in (2, 3, 4)])


def qgram_unique(spark, sf_dir):
    part = _read(spark, sf_dir, "part")
    return part.select(
        "p_partkey",
        F.array_join(F.array_sort(qgram.unique_qgrams(F.col("p_type"), 2)), "|").alias("grams"),
        qgram.qgram_count(F.col("p_type"), 2).cast("bigint").alias("n"),
        qgram.unique_qgram_count(F.col("p_type"), 2).cast("bigint").alias("n_unique"),
    )


def qgram_number(spark, sf_dir):
    return _read(spark, sf_dir, "orders").select("o_orderkey", F.array_join(qgram.qgrams(F.col("o_orderkey"), 3, "number"), "|").alias("grams"))


def qgram_boolean(spark, sf_dir):
    flag = F.col("o_orderkey") % 2 == 0
    return _read(spark, sf_dir, "orders").select("o_orderkey", *[F.array_join(qgram.qgrams(flag, q, "boolean"), "|").alias(f"q{q}") for q in (2, 3)])


def profile_fields(spark, sf_dir):
    made = datasets.profile(_read(spark, sf_dir, "customer"), ["c_name", "c_mktsegment", "c_custkey"])
    return made.select("field", "n", *[F.round(c, 6).alias(c) for c in made.columns if c.startswith("avg")])


def hmac_positions(spark, sf_dir):
    grams = _read(spark, sf_dir, "part").select(F.explode(qgram.qgrams(F.col("p_brand"), 2)).alias("gram")).distinct()
    return grams.select("gram", hashing.hmac_hex(F.col("gram"), KEY, "md5").alias("md5"), F.array_join(hashing.positions(F.col("gram"), BITS, HASHES, KEY), " ").alias("positions"))


def clk_native(spark, sf_dir):
    made = encode.bit_positions(_part(spark, sf_dir), clk_spec(), KEY, ["id"])
    return made.select("id", F.array_join("positions", " ").alias("set_bits"))


def private_similarity(spark, sf_dir):
    spec = EncodingSpec.make("CLK", ["s_name", "s_nationkey"], HASHES, Q, bits=512)
    made = encode.encode(_read(spark, sf_dir, "supplier"), spec, KEY, ["s_suppkey"], name="enc")
    pairs = tables.filter_pairs(made, "s_suppkey", "enc")
    # what follows from both counts is looked up, as rounding is slow
    kinds = spark.range((spec.bits + 1) * (2 * spec.bits + 1)).select(F.expr(f"id div {2 * spec.bits + 1}").cast("int").alias("common"), (F.col("id") % (2 * spec.bits + 1)).cast("int").alias("total"))
    both, total = F.col("common"), F.col("total")
    known = kinds.select("common", "total", F.round(F.try_divide(both, total - both), 6).alias("jaccard"), F.round(F.try_divide(2 * both, total), 6).alias("dice"))
    found = pairs.join(F.broadcast(known.where("total >= 2 * common")), ["common", "total"])
    return found.select("s_suppkey_a", "s_suppkey_b", (total - 2 * both).cast("bigint").alias("hamming"), both.cast("bigint").alias("common"), "jaccard", "dice")


def hamming_native(spark, sf_dir):
    """The same distance by built-in expressions on 64-bit words."""
    spec = EncodingSpec.make("CLK", ["s_name", "s_nationkey"], HASHES, Q, bits=512)
    made = encode.encode(_read(spark, sf_dir, "supplier"), spec, KEY, ["s_suppkey"], name="enc").select("s_suppkey", bits.words(F.col("enc"), 512).alias("w"))
    pairs, members = linkage.class_pairs(made, "s_suppkey", ["w"])
    return linkage.member_pairs(pairs.select("cls_a", "cls_b", bits.hamming_words(F.col("w_a"), F.col("w_b")).cast("bigint").alias("hamming")), members, "s_suppkey")


def lsh_keys(spark, sf_dir):
    return _keys(_clk(spark, sf_dir)).select("id", F.col("grp").cast("bigint").alias("grp"), "key")


def lsh_key_statistics(spark, sf_dir):
    made = blocking.key_statistics(_keys(_clk(spark, sf_dir)))
    return made.withColumn("avg_keys", F.round("avg_keys", 6))


def lsh_buckets(spark, sf_dir):
    made = blocking.buckets(_keys(_clk(spark, sf_dir)))
    return made.select(F.col("grp").cast("bigint").alias("grp"), "key", F.array_join("ids", " ").alias("ids"))


def _met(spark, sf_dir, least: int) -> DataFrame:
    return meeting.met_pairs(_clk(spark, sf_dir), _clk(spark, sf_dir, True), blocking_groups(BITS, GROUP_BITS, GROUPS, SEED), least)


def lsh_candidates(spark, sf_dir):
    return _met(spark, sf_dir, 1).select("aid", "bid")


def fps_frequent(spark, sf_dir):
    return _met(spark, sf_dir, COLLISIONS)


def _matched(strategy: str):
    def run(spark, sf_dir):
        groups = blocking_groups(BITS, GROUP_BITS, GROUPS, SEED)
        return blocking.block(_clk(spark, sf_dir), _clk(spark, sf_dir, True), groups, COLLISIONS, DISTANCE, strategy=strategy)

    return run


def blocking_summary(spark, sf_dir):
    groups = blocking_groups(BITS, GROUP_BITS, GROUPS, SEED)
    return blocking.blocked_summary(_clk(spark, sf_dir), _clk(spark, sf_dir, True), groups, COLLISIONS, DISTANCE)


def optimal_parameters(spark, sf_dir):
    rows = [(d, *(lambda p: (p.collisions, p.groups, p.least_groups, p.most_groups))(optimal_blocking(180, 4096, d, 30))) for d in (1e-2, 1e-3, 1e-4, 1e-5, 1e-6)]
    return spark.createDataFrame(rows, "delta double, collisions bigint, n_groups bigint, least bigint, most bigint")


def _names(spark, sf_dir):
    return linkage.self_pairs(_read(spark, sf_dir, "nation"), "n_nationkey", ["n_name"])


def clear_similarity(spark, sf_dir):
    a, b = F.col("n_name_a"), F.col("n_name_b")
    scores = [F.round(similarity.score(f"{m}_{s}", a, b), 6).alias(f"{m}_{s}") for m in ("jaccard", "dice", "cosine") for s in similarity.SIZES]
    return _names(spark, sf_dir).select("n_nationkey_a", "n_nationkey_b", similarity.score("exact", a, b).alias("exact"), *scores)


def jaro_matches(spark, sf_dir):
    pairs = _names(spark, sf_dir)
    return pairs.where(similarity.similar("jaro_winkler", F.col("n_name_a"), F.col("n_name_b"), 0.6)).select("n_nationkey_a", "n_nationkey_b")


def jaro_winkler_scores(spark, sf_dir):
    """Names with long common beginnings, most of them above the 0.7 from which on these count."""
    names = _read(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    score = similarity.score("jaro_winkler", F.col("s_name_a"), F.col("s_name_b"))
    pairs, members = linkage.class_pairs(names, "s_suppkey", ["s_name"])
    return linkage.member_pairs(pairs.select("cls_a", "cls_b", F.round(score, 6).alias("score")), members, "s_suppkey")


def blocking_metrics(spark, sf_dir):
    groups = blocking_groups(BITS, GROUP_BITS, GROUPS, SEED)
    made = blocking.metrics(_clk(spark, sf_dir), _clk(spark, sf_dir, True), groups, COLLISIONS, DISTANCE, F.col("aid") == F.col("bid"))
    return made.select(*[F.col(c).cast("bigint").alias(c) if c != "strategy" else F.col(c) for c in made.columns])


def cross_similarity(spark, sf_dir):
    nation, region = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name"), _read(spark, sf_dir, "region").select("r_regionkey", "r_name")
    dice = similarity.score("dice_bigrams", F.col("n_name"), F.col("r_name"))
    return linkage.cross_pairs(nation, region).select("n_nationkey", "r_regionkey", F.round(dice, 6).alias("dice"))


def _balances(spark, sf_dir):
    return _read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.col("s_acctbal").cast("decimal(12,2)").cast("string").alias("balance"))


def vector_histogram(spark, sf_dir):
    return tables.vector_counts(_balances(spark, sf_dir), "s_suppkey", ["s_name", "balance"]).select(F.col("vec").cast("bigint").alias("vec"), "n")


M, U, P = [0.95, 0.9], [0.02, 0.1], 0.01


def linkage_scores(spark, sf_dir):
    pairs = tables.vector_pairs(_balances(spark, sf_dir), "s_suppkey", ["s_name", "balance"])
    vec = F.col("vec")
    each = lambda value: F.coalesce(*[F.when(vec == v, value(F.lit(v))) for v in range(4)])  # noqa: E731 - constants, one for each vector
    score, link = each(lambda v: F.round(similarity.linkage_score(v, M, U), 6)), each(lambda v: similarity.is_link(v, M, U, P))
    return pairs.select("s_suppkey_a", "s_suppkey_b", vec.cast("bigint").alias("vec"), score.alias("score"), link.alias("link"))


def em_estimate(spark, sf_dir):
    counts = {r.vec: r.n for r in vector_histogram(spark, sf_dir).collect()}  # 2^2 rows
    est = linkage.expectation_maximisation([counts[v] for v in range(4)])
    rows = [(j, round(est.m[j], 6), round(est.u[j], 6), round(est.p, 6), est.iterations) for j in range(2)]
    return spark.createDataFrame(rows, "field bigint, m double, u double, p double, iterations bigint")


def field_weights(spark, sf_dir):
    rows = [(j, round(w["agree"], 9), round(w["disagree"], 9), round(w["share"], 9)) for j, w in enumerate(linkage.field_weights(M, U))]
    return spark.createDataFrame(rows, "field bigint, agree double, disagree double, share double")


def pair_ranks(spark, sf_dir):
    return _names(spark, sf_dir).select("n_nationkey_a", "n_nationkey_b", linkage.pair_rank(F.col("n_nationkey_a"), F.col("n_nationkey_b")).alias("pair_rank"))


def sort_with_uid(spark, sf_dir):
    rows = _read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return datasets.with_uid(rows, ["c_mktsegment", "c_name"])


def csv_import(spark, sf_dir):
    lines = [("1,ann,3.5,true,a,b",), ("2,,,,",), ("3,bob,7,false,x",)]
    made = files.parse_csv(spark.createDataFrame(lines, "value string"), "id bigint, name string, size double, flag boolean, rest string")
    return made.withColumn("size", F.coalesce(F.nanvl("size", F.lit(-1.0)), F.lit(-1.0)))


def csv_import_customers(spark, sf_dir):
    """Lines of a whole table, with cells that are empty and a last one that keeps its commas."""
    k = F.col("c_custkey")
    some = lambda n, c: F.when(k % n != 0, c.cast("string")).otherwise("")
    cells = [k.cast("string"), some(3, F.col("c_name")), some(5, F.col("c_nationkey")), some(7, k / 4), some(2, F.lit("True")), some(11, F.concat_ws(",", "c_mktsegment", "c_name", F.lit("")))]
    made = files.parse_csv(_read(spark, sf_dir, "customer").select(F.concat_ws(",", *cells).alias("value")), "id bigint, name string, nation int, size double, flag boolean, rest string")
    return made.withColumn("size", F.coalesce(F.nanvl("size", F.lit(-1.0)), F.lit(-1.0)))


def linkage_quality(spark, sf_dir):
    """Pairs that meet are counted by the ones of their filters; those of one id, which are few, are looked at once more."""
    groups = blocking_groups(BITS, GROUP_BITS, GROUPS, SEED)
    a, b = _clk(spark, sf_dir), _clk(spark, sf_dir, True)
    met = meeting.met_scores(a, b, groups, COLLISIONS, BITS)
    own = meeting.own_scores(a, b, groups, COLLISIONS)
    parts = own.withColumn("truth", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("n", F.when(F.col("truth"), F.col("n")).otherwise(-F.col("n")))
    scored = met.withColumn("truth", F.lit(False)).unionByName(parts).withColumn("score", F.round(F.try_divide("both", "either"), 9))
    made = linkage.quality(scored, F.col("score"), F.col("truth"), THRESHOLDS, F.col("n"))
    return made.select("threshold", "tm", "fm", "tn", "fn", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "f1")])


def distance_statistics(spark, sf_dir):
    a, b = _clk(spark, sf_dir), _clk(spark, sf_dir, True)
    pairs = a.toDF("id", "x").join(b.toDF("id", "y"), "id").select(bits.hamming(F.col("x"), F.col("y")).alias("d"))
    made = linkage.distance_statistics(pairs, F.col("d"))
    return made.select("min_d", F.round("mean_d", 6).alias("mean_d"), "max_d", F.round("std_d", 6).alias("std_d"))


def stable_sample(spark, sf_dir):
    """A sampling operator: the number of rows is its feature."""
    return datasets.sample(_read(spark, sf_dir, "customer"), 100, 7)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode, block, verify: parts against parts with a letter missing."""
    return _matched("auto")(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plain = (
        qgram_bag, qgram_unique, qgram_number, qgram_boolean, profile_fields, hmac_positions, clk_native, private_similarity, hamming_native, lsh_keys, lsh_key_statistics, lsh_buckets,
        lsh_candidates, fps_frequent, blocking_summary, optimal_parameters, clear_similarity, jaro_matches, vector_histogram, linkage_scores, em_estimate, field_weights, pair_ranks, sort_with_uid,
        jaro_winkler_scores, blocking_metrics, cross_similarity, csv_import, csv_import_customers, linkage_quality, distance_statistics, stable_sample,
    )
    out = {f.__name__: f for f in plain}
    out |= {f"{n}_encode": _encoded(s) for n, s in (("clk", clk_spec()), ("fbf", fbf_spec()), ("rbf", rbf_spec()))}
    out |= {f"fps_matched_{s}": _matched(s) for s in blocking.STRATEGIES}
    return out


# ---- the same in SQL ----


def _pad(x: str) -> str:
    s = rf"regexp_replace({x}, '\s+', '_', 'g')"
    s = f"(CASE WHEN starts_with({s}, '_') THEN {s} ELSE '_' || {s} END)"
    return f"(CASE WHEN ends_with({s}, '_') THEN {s} ELSE {s} || '_' END)"


def _cut(p: str, q: int) -> str:
    return f"list_transform(range(1, length({p}) - {q - 2}), lambda i: substr({p}, i, {q}))"


def _bag(x: str, q: int) -> str:
    return f"(CASE WHEN {x} = '' THEN [] ELSE {_cut(_pad(x), q)} END)"


def _number(x: str, q: int) -> str:
    return _cut(f"('_' || CAST({x} AS VARCHAR) || '_')", q)


def _hmac_sql(x: str, digest: str) -> str:
    inner, outer = (f"unhex('{p.hex()}')" for p in hashing._pads(KEY))
    return f"{digest}({outer} || unhex({digest}({inner} || encode({x}))))"


def _int_sql(h: str) -> str:
    x = f"CAST('0x' || right({h}, 8) AS BIGINT)"
    return f"(CASE WHEN {x} >= 2147483648 THEN {x} - 4294967296 ELSE {x} END)"


def _positions_sql(x: str, n: int) -> str:
    a, b = _int_sql(_hmac_sql(x, "sha1")), _int_sql(_hmac_sql(x, "md5"))
    return f"list_transform(range(1, {HASHES + 1}), lambda i: abs((((({a}) + i * ({b}) + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648) % {n}))"


def _clk_sql(name: str, source: str, key: str, bags: list[str], n: int) -> str:
    """CTEs: {name} has (id, p) for each set bit."""
    return f"""{name}_g AS (SELECT {key} AS id, unnest(list_distinct(flatten([{", ".join(bags)}]))) AS g FROM {source}),
        {name}_d AS (SELECT g, unnest(list_distinct({_positions_sql("g", n)})) AS p FROM (SELECT DISTINCT g FROM {name}_g)),
        {name} AS (SELECT DISTINCT id, p FROM {name}_g JOIN {name}_d USING (g))"""


PART_BAGS = [_bag("p_name", Q), _bag("p_brand", Q), _bag("p_type", Q), _number("p_size", Q)]
TYPO = "(SELECT p_partkey, substr(p_name, 1, 1) || substr(p_name, 3) AS p_name, p_brand, p_type, p_size FROM part)"


def _keys_sql(name: str, clk: str) -> str:
    groups = blocking_groups(BITS, GROUP_BITS, GROUPS, SEED)
    values = ", ".join(f"({g}, {p}, {1 << i})" for g, ps in enumerate(groups) for i, p in enumerate(ps))
    return f"""{name}_v(grp, p, w) AS (VALUES {values}),
        {name}_s AS (SELECT id, grp, sum(w) AS key FROM {clk} JOIN {name}_v USING (p) GROUP BY id, grp),
        {name} AS (SELECT id, CAST(r.grp AS BIGINT) AS grp, CAST(coalesce(s.key, 0) AS BIGINT) AS key FROM (SELECT DISTINCT id FROM {clk}) i CROSS JOIN range({GROUPS}) r(grp) LEFT JOIN {name}_s s USING (id, grp))"""


def _blocked_sql() -> str:
    return f"""WITH {_clk_sql("a", "part", "p_partkey", PART_BAGS, BITS)}, {_clk_sql("b", TYPO, "p_partkey", PART_BAGS, BITS)},
        {_keys_sql("ka", "a")}, {_keys_sql("kb", "b")},
        pairs AS (SELECT ka.id AS aid, kb.id AS bid FROM ka JOIN kb USING (grp, key)),
        freq AS (SELECT aid, bid, count(*) AS hits FROM pairs GROUP BY aid, bid HAVING count(*) >= {COLLISIONS}),
        na AS (SELECT id, count(*) AS n FROM a GROUP BY id), nb AS (SELECT id, count(*) AS n FROM b GROUP BY id),
        common AS (SELECT aid, bid, count(*) AS c FROM freq JOIN a ON a.id = aid JOIN b ON b.id = bid AND b.p = a.p GROUP BY aid, bid),
        judged AS (SELECT f.aid, f.bid, na.n + nb.n - 2 * coalesce(c, 0) AS d, coalesce(c, 0) / (na.n + nb.n - coalesce(c, 0)) AS j
                   FROM freq f JOIN na ON na.id = f.aid JOIN nb ON nb.id = f.bid LEFT JOIN common c ON c.aid = f.aid AND c.bid = f.bid),
        matched AS (SELECT aid, bid FROM judged WHERE d <= {DISTANCE})"""


def _set_bits_sql(cte: str, body: str = "") -> str:
    return f"WITH {cte}{body} SELECT id, string_agg(CAST(p AS VARCHAR), ' ' ORDER BY p) AS set_bits FROM {{}} GROUP BY id"


def _fields_sql(spec: EncodingSpec, table: bool) -> str:
    """Bits of an FBF (or, through the target table, RBF) encoding."""
    ctes, unions = [], []
    for j, f in enumerate(spec.fields):
        n = spec.sizes[j]
        ctes.append(_clk_sql(f"f{j}", "part", "p_partkey", [_bag(f, Q)], n))
        if table:
            values = ", ".join(f"({p}, {bit})" for p, bits_of in enumerate(spec.targets(j)) for bit in bits_of)
            ctes.append(f"t{j}(p, bit) AS (VALUES {values})")
            unions.append(f"SELECT id, bit AS p FROM f{j} JOIN t{j} USING (p)")
        else:
            unions.append(f"SELECT id, p + {sum(spec.sizes[:j])} AS p FROM f{j}")
    return f"WITH {', '.join(ctes)}, u AS ({' UNION '.join(unions)}) SELECT id, string_agg(CAST(p AS VARCHAR), ' ' ORDER BY p) AS set_bits FROM u GROUP BY id"


def _score_sql(method: str, q: int) -> str:
    x, y = _bag("a.n_name", q), _bag("b.n_name", q)
    u, v = f"list_distinct({x})", f"list_distinct({y})"
    both = f"len(list_intersect({u}, {v}))"
    if method == "jaccard":
        return f"round({both} / (len({u}) + len({v}) - {both}), 6)"
    if method == "dice":
        return f"round(2 * {both} / (len({u}) + len({v})), 6)"
    count = lambda l, m: f"list_sum(list_transform({l}, lambda g: len(list_filter({m}, lambda h: h = g))))"  # noqa: E731, E741
    return f"round(coalesce({count(x, y)}, 0) / (sqrt({count(x, x)}) * sqrt({count(y, y)})), 6)"


def _dice_sql(a: str, b: str) -> str:
    u, v = f"list_distinct({_bag(a, 2)})", f"list_distinct({_bag(b, 2)})"
    return f"round(2 * len(list_intersect({u}, {v})) / (len({u}) + len({v})), 6)"


def _em_sql(vec: str) -> str:
    """Two fields, four frequencies: the state is one row, a round is one step of the recursion."""
    cell = lambda v, m, p: f"{p} * {' * '.join(f'{m}{j}' if v >> j & 1 else f'(1 - {m}{j})' for j in range(2))}"
    share = ", ".join(f"coalesce(n{v} * ({cell(v, 'm', 'p')}) / nullif(({cell(v, 'm', 'p')}) + ({cell(v, 'u', '(1 - p)')}), 0), 0) AS g{v}" for v in range(4))
    new_m = [f"coalesce((g{1 << j} + g3) / nullif(g0 + g1 + g2 + g3, 0), m{j})" for j in range(2)]
    others = lambda v: f"(n{v} - g{v})"
    new_u = [f"coalesce(({others(1 << j)} + {others(3)}) / nullif({' + '.join(map(others, range(4)))}, 0), u{j})" for j in range(2)]
    news = dict(zip(("m0", "m1", "u0", "u1", "p"), [*new_m, *new_u, "(g0 + g1 + g2 + g3) / (n0 + n1 + n2 + n3)"], strict=True))
    moved = ", ".join(f"abs({x} - {n})" for n, x in news.items())
    step = f"SELECT i + 1, {', '.join(news.values())}, greatest({moved}) FROM (SELECT *, {share} FROM s, h WHERE i < {linkage.ITERATIONS} AND moved > {linkage.TOLERANCE})"
    count = ", ".join(f"(SELECT count(*) FROM v WHERE vec = {v})::DOUBLE AS n{v}" for v in range(4))
    start = "SELECT 0 AS i, 0.9::DOUBLE AS m0, 0.9::DOUBLE AS m1, 0.001::DOUBLE AS u0, 0.001::DOUBLE AS u1, 0.1::DOUBLE AS p, 1::DOUBLE AS moved"
    last = "SELECT * FROM s ORDER BY i DESC LIMIT 1"
    return f"""WITH RECURSIVE {vec.removeprefix("WITH ")}, h AS MATERIALIZED (SELECT {count}), s(i, m0, m1, u0, u1, p, moved) AS ({start} UNION ALL {step}), e AS ({last})
        SELECT j AS field, round(CASE j WHEN 0 THEN m0 ELSE m1 END, 6) AS m, round(CASE j WHEN 0 THEN u0 ELSE u1 END, 6) AS u, round(p, 6) AS p, CAST(i AS BIGINT) AS iterations FROM e, range(2) r(j)"""


def _winkler_sql(a: str, b: str) -> str:
    j = f"jaro_similarity({a}, {b})"
    same = f"list_transform(range(1, least(length({a}), length({b})) + 1), lambda i: substr({a}, i, 1) = substr({b}, i, 1))"
    prefix = f"coalesce(nullif(list_position({same}, false), 0) - 1, least(length({a}), length({b})))"
    return f"(CASE WHEN {j} <= 0.7 THEN {j} ELSE {j} + least(0.1::DOUBLE, 1.0::DOUBLE / greatest(length({a}), length({b}))) * {prefix} * (1 - {j}) END)"


def _avg_sql(f: str, number: bool) -> str:
    cols = [f"round(avg(length(CAST({f} AS VARCHAR))), 6) AS avg_length"]
    for q in (2, 3, 4):
        bag = _number(f, q) if number else _bag(f, q)
        cols += [f"round(avg(len({bag})), 6) AS avg_{q}grams", f"round(avg(len(list_distinct({bag}))), 6) AS avg_unique_{q}grams"]
    return f"SELECT '{f}' AS field, count(*) AS n, {', '.join(cols)} FROM customer"


def oracle_sql() -> dict[str, str]:
    supplier_bags = [_bag("s_name", Q), _number("s_nationkey", Q)]
    sup = _clk_sql("s", "supplier", "s_suppkey", supplier_bags, 512)
    sup_pairs = f"""WITH {sup}, n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
        c AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM s x JOIN s y ON x.p = y.p AND x.id < y.id GROUP BY x.id, y.id),
        j AS (SELECT x.id AS s_suppkey_a, y.id AS s_suppkey_b, x.n AS na, y.n AS nb, coalesce(c.c, 0) AS c FROM n x JOIN n y ON x.id < y.id LEFT JOIN c ON c.a = x.id AND c.b = y.id)"""
    clk = _clk_sql("a", "part", "p_partkey", PART_BAGS, BITS)
    keys = f"WITH {clk}, {_keys_sql('k', 'a')}"
    vec = """WITH v AS (SELECT a.s_suppkey AS s_suppkey_a, b.s_suppkey AS s_suppkey_b,
        CAST(jaro_similarity(a.s_name, b.s_name) >= 0.7 - 1e-9 AS BIGINT) + 2 * CAST(jaro_similarity(CAST(CAST(a.s_acctbal AS DECIMAL(12,2)) AS VARCHAR), CAST(CAST(b.s_acctbal AS DECIMAL(12,2)) AS VARCHAR)) >= 0.7 - 1e-9 AS BIGINT) AS vec
        FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey)"""
    score = " + ".join(f"CASE WHEN (vec >> {j}) & 1 = 1 THEN ln({m}::DOUBLE / {u}) ELSE ln((1 - {m}::DOUBLE) / (1 - {u}::DOUBLE)) END" for j, (m, u) in enumerate(zip(M, U, strict=True)))
    clk_out = _set_bits_sql(clk).format("a")
    pairs = "nation a JOIN nation b ON a.n_nationkey < b.n_nationkey"
    weights = ", ".join(f"({j}, {m}, {u})" for j, (m, u) in enumerate(zip(M, U, strict=True)))
    blocked = _blocked_sql()
    return {
        "qgram_bag": f"SELECT p_partkey, {', '.join(f'array_to_string({_bag("p_name", q)}, {chr(39)}|{chr(39)}) AS q{q}' for q in (2, 3, 4))} FROM part",
        "qgram_unique": f"SELECT p_partkey, array_to_string(list_sort(list_distinct({_bag('p_type', 2)})), '|') AS grams, len({_bag('p_type', 2)}) AS n, len(list_distinct({_bag('p_type', 2)})) AS n_unique FROM part",
        "qgram_number": f"SELECT o_orderkey, array_to_string({_number('o_orderkey', 3)}, '|') AS grams FROM orders",
        "qgram_boolean": "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '_T|T_' ELSE '_F|F_' END AS q2, CASE WHEN o_orderkey % 2 = 0 THEN '_T_' ELSE '_F_' END AS q3 FROM orders",
        "profile_fields": " UNION ALL ".join((_avg_sql("c_name", False), _avg_sql("c_mktsegment", False), _avg_sql("c_custkey", True))),
        "hmac_positions": f"SELECT gram, {_hmac_sql('gram', 'md5')} AS md5, array_to_string({_positions_sql('gram', BITS)}, ' ') AS positions FROM (SELECT DISTINCT unnest({_bag('p_brand', 2)}) AS gram FROM part)",
        "clk_encode": clk_out,
        "clk_native": clk_out,
        "fbf_encode": _fields_sql(fbf_spec(), False),
        "rbf_encode": _fields_sql(rbf_spec(), True),
        "private_similarity": f"{sup_pairs} SELECT s_suppkey_a, s_suppkey_b, na + nb - 2 * c AS hamming, c AS common, round(c / (na + nb - c), 6) AS jaccard, round(2 * c / (na + nb), 6) AS dice FROM j",
        "hamming_native": f"{sup_pairs} SELECT s_suppkey_a, s_suppkey_b, na + nb - 2 * c AS hamming FROM j",
        "lsh_keys": f"{keys} SELECT id, grp, key FROM k",
        "lsh_key_statistics": f"{keys}, e AS (SELECT grp, count(DISTINCT key) AS n FROM k GROUP BY grp) SELECT count(*) AS n_groups, min(n) AS min_keys, max(n) AS max_keys, round(avg(n), 6) AS avg_keys FROM e",
        "lsh_buckets": f"{keys} SELECT grp, key, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY id) AS ids FROM k GROUP BY grp, key",
        "lsh_candidates": f"{blocked} SELECT DISTINCT aid, bid FROM pairs",
        "fps_frequent": f"{blocked} SELECT * FROM freq",
        **{f"fps_matched_{s}": f"{blocked} SELECT * FROM matched" for s in blocking.STRATEGIES},
        "blocking_summary": f"{blocked} SELECT n AS n_a, n AS n_b, (SELECT count(*) FROM freq) AS n_frequent, (SELECT count(*) FROM matched) AS n_matched, n * n AS n_pairs FROM (SELECT count(*) AS n FROM part)",
        "optimal_parameters": "SELECT * FROM (VALUES (1e-2, 2, 29, 16, 43), (1e-3, 4, 52, 23, 75), (1e-4, 6, 74, 31, 106), (1e-5, 7, 91, 39, 131), (1e-6, 9, 114, 46, 162)) t(delta, collisions, n_groups, least, most)",
        "clear_similarity": f"SELECT a.n_nationkey AS n_nationkey_a, b.n_nationkey AS n_nationkey_b, CAST(a.n_name = b.n_name AS DOUBLE) AS exact, {', '.join(f'{_score_sql(m, q)} AS {m}_{s}' for m in ('jaccard', 'dice', 'cosine') for s, q in similarity.SIZES.items())} FROM {pairs}",
        "em_estimate": _em_sql(vec),
        "jaro_winkler_scores": f"SELECT a.s_suppkey AS s_suppkey_a, b.s_suppkey AS s_suppkey_b, round({_winkler_sql('a.s_name', 'b.s_name')}, 6) AS score FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey",
        "blocking_metrics": f"""{blocked} SELECT {COLLISIONS}::BIGINT AS collisions, {GROUPS}::BIGINT AS n_groups, {GROUP_BITS}::BIGINT AS k, 'shuffle' AS strategy, (SELECT count(*) FROM (SELECT DISTINCT aid, bid FROM pairs)) AS n_candidates,
            (SELECT count(*) FROM freq) AS n_frequent, (SELECT count(*) FROM matched) AS n_matched, (SELECT count(*) FROM matched WHERE aid = bid) AS n_true""",
        "cross_similarity": f"SELECT n_nationkey, r_regionkey, {_dice_sql('n_name', 'r_name')} AS dice FROM nation CROSS JOIN region",
        "jaro_matches": f"SELECT a.n_nationkey AS n_nationkey_a, b.n_nationkey AS n_nationkey_b FROM {pairs} WHERE jaro_similarity(a.n_name, b.n_name) >= 0.6",
        "vector_histogram": f"{vec} SELECT r.vec, count(v.vec) AS n FROM range(4) r(vec) LEFT JOIN v USING (vec) GROUP BY r.vec",
        "linkage_scores": f"{vec} SELECT s_suppkey_a, s_suppkey_b, vec, round({score}, 6) AS score, {score} + ln({P} / (1 - {P})) >= 0 AS link FROM v",
        "field_weights": f"WITH w(field, m, u) AS (VALUES {weights}), x AS (SELECT field, ln(m::DOUBLE) - ln(u::DOUBLE) AS a, ln(1 - m::DOUBLE) - ln(1 - u::DOUBLE) AS d FROM w) SELECT field, round(a, 9) AS agree, round(d, 9) AS disagree, round(abs(a - d) / sum(abs(a - d)) OVER (), 9) AS share FROM x",
        "pair_ranks": f"SELECT a.n_nationkey AS n_nationkey_a, b.n_nationkey AS n_nationkey_b, CAST(b.n_nationkey * (b.n_nationkey - 1) // 2 + a.n_nationkey AS BIGINT) AS pair_rank FROM {pairs}",
        "sort_with_uid": "SELECT row_number() OVER (ORDER BY c_mktsegment, c_name, c_custkey) - 1 AS uid, c_custkey, c_name, c_mktsegment FROM customer",
        "csv_import": "SELECT * FROM (VALUES (1, 'ann', 3.5::DOUBLE, true, 'a,b'), (2, '-NA-', -1, false, '-NA-'), (3, 'bob', 7, false, 'x')) t(id, name, size, flag, rest)",
        "csv_import_customers": """SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN '-NA-' ELSE c_name END AS name, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE c_nationkey END AS nation,
            CASE WHEN c_custkey % 7 = 0 THEN -1 ELSE c_custkey / 4.0::DOUBLE END AS size, c_custkey % 2 <> 0 AS flag,
            CASE WHEN c_custkey % 11 = 0 THEN '-NA-' ELSE c_mktsegment || ',' || c_name || ',' END AS rest FROM customer""",
        "linkage_quality": f"""{blocked}, t(threshold) AS (VALUES {", ".join(f"({x}::DOUBLE)" for x in THRESHOLDS)}),
            q AS (SELECT threshold, count(*) FILTER (round(j, 9) >= threshold AND aid = bid) AS tm, count(*) FILTER (round(j, 9) >= threshold AND aid <> bid) AS fm,
                         count(*) FILTER (round(j, 9) < threshold AND aid <> bid) AS tn, count(*) FILTER (round(j, 9) < threshold AND aid = bid) AS fn FROM judged CROSS JOIN t GROUP BY threshold)
            SELECT threshold, tm, fm, tn, fn, round(tm / (tm + fn), 6) AS recall, round(tm / (tm + fm), 6) AS precision,
                   round(CASE WHEN tm = 0 THEN 0 ELSE 2 * (tm / (tm + fn)) * (tm / (tm + fm)) / (tm / (tm + fn) + tm / (tm + fm)) END, 6) AS f1 FROM q WHERE tm + fn > 0 AND tm + fm > 0""",
        "distance_statistics": f"""WITH {clk}, {_clk_sql("b", TYPO, "p_partkey", PART_BAGS, BITS)}, na AS (SELECT id, count(*) AS n FROM a GROUP BY id), nb AS (SELECT id, count(*) AS n FROM b GROUP BY id),
            c AS (SELECT id, count(*) AS c FROM a JOIN b USING (id, p) GROUP BY id), d AS (SELECT na.n + nb.n - 2 * coalesce(c, 0) AS d FROM na JOIN nb USING (id) LEFT JOIN c USING (id))
            SELECT min(d) AS min_d, round(avg(d), 6) AS mean_d, max(d) AS max_d, round(stddev_samp(d), 6) AS std_d FROM d""",
    }
