"""Fuzzy line dedup by SimHash, pigeonhole blocks and edit similarity, with DataFrame operations only.

*Normalised lines.*  Texts are split at ``\\n``; a line is its lower-cased words, bounded by ASCII other than letters and
digits, with one space between them.  Equal lines are one node, known by two 64-bit hashes.

*SimHash.*  A line's features are its pairs of neighbouring words, and for lines of under ``FEW`` words its runs of ``GRAM``
characters.  The SimHash has ``BLOCKS`` blocks of 64 bits, each the bitwise majority of ``SHARE`` features: those that
follow the block's point on the circle of feature hashes.  A SimHash of all
features in every bit loses most bits that a join could use when one word in twenty changes (measured: 3 of 64 bits hold a
third of the lines of edit similarity 0.9); here a changed word spoils only the blocks that drew on it.

*Candidates.*  Pigeonhole: changes that spoil fewer than BLOCKS blocks leave one equal, so lines are joined on equal
blocks.  Pairs whose SimHashes differ in more than ``DISTANCE`` of the BLOCKS x 64 bits are passed over (lines that have
nothing to do with each other differ in half of them); the others are links if their edit similarity (1 - Levenshtein
distance / longer length) is at least ``SIMILARITY``.

*Links*, without forming the pairs of a bucket:
1. each line is held against the least line of its largest bucket, and components are formed;
2. in buckets that hold several components, each line is held against the bucket's least and greatest one, unless it is in
   their component; buckets of up to three lines are decided by that;
3. in larger ones whose lines are not in one component then, lines of different components meet in parts of about ``PART``, and
   only pairs with near SimHashes leave the join.
Nothing is capped or dropped; a bucket with any share of the rows is dealt over many parts.

Of each connected group the smallest occurrence (id, line number) is kept.

Defined results: null text has one empty line; lines without words are in no row and are never dropped; lines of under ten
characters are in a group with equal ones alone (an edit would be too much); rows that repeat an id and its text are
answered row by row (all or none of them are kept); null ids come after all others; an empty table gives an empty table;
other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Store, bind, fresh_names
from .graph import components

SIMILARITY = 0.9
#: Blocks of a SimHash, features of a block, and bits of BLOCKS x 64 in which linked lines may differ.
BLOCKS, SHARE, DISTANCE = 8, 3, 160
#: Lines of under FEW words have runs of GRAM characters as features, others pairs of words.
FEW, GRAM = 12, 4
#: Lines of a bucket that meet another such part at once.
PART = 1024
#: Rows of a few longs, and bytes of texts, up to which a side is broadcast; beyond it the join is shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 16 << 20
#: Words of the runs that hold two lines together when their distance is bounded, and the first band of long ones.
ANCHOR, FAR, STEP = 3, 1.5, 1024
#: Product of the bytes of two rests up to which their distance is formed at once.
SHORT = 16_384
#: What separates words, but the line's end (a fixed value): ASCII other than letters and digits, once lower-cased.
SEPARATORS = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"
# Fixed value: an odd multiplier that tells blocks of different places apart.
MIX = 0x1E3779B97F4A7C15 >> 4


def normal_lines(text: Column) -> Column:
    """The normalised lines of a text; lines without words are empty."""
    folded = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS, " ")
    return F.split(folded, "\n", -1)


def _features(norm: Column) -> Column:
    """64-bit hashes of what stands for a line."""
    words, gap = F.split(norm, " "), F.array(F.lit(""))
    pairs = bind(words, lambda w: F.zip_with(F.concat(gap, w), F.concat(w, gap), lambda a, b: F.xxhash64(a, b)))
    runs = F.transform(F.sequence(F.lit(1), F.char_length(norm) - GRAM + 1), lambda at: F.xxhash64(F.substring(norm, at, F.lit(GRAM))))
    spaces = F.char_length(norm) - F.char_length(F.replace(norm, F.lit(" "), F.lit("")))
    return F.when(spaces + 1 < FEW, runs).otherwise(pairs)


def simhash(norm: Column) -> Column:
    """The SimHash blocks of a normalised line; null where an edit would be too much."""

    def starts(arcs: Column) -> Column:
        """For each block the place (from 0) of the first hash on its arc of the circle, or on the next arc that holds any."""
        first = [F.nullif(F.array_position(arcs, F.lit(t - BLOCKS // 2).cast("bigint")), F.lit(0).cast("bigint")) for t in range(BLOCKS)]
        return F.array(*[(F.coalesce(*first[t:], F.lit(1).cast("bigint")) - 1).cast("int") for t in range(BLOCKS)])

    def block(s: Column, at: Column, t: Column) -> Column:
        x, y, z = (F.get(s, F.pmod(at + k, F.size(s))) for k in range(SHARE))
        return x.bitwiseAND(y).bitwiseOR(x.bitwiseAND(z)).bitwiseOR(y.bitwiseAND(z)).bitwiseXOR((t + 1).cast("bigint") * F.lit(MIX))

    def blocks(s: Column) -> Column:
        arcs = F.transform(s, lambda x: F.shiftright(x, 64 - (BLOCKS - 1).bit_length()))
        return F.transform(bind(arcs, starts), lambda at, t: block(s, at, t))

    made = bind(F.sort_array(F.array_distinct(_features(norm))), blocks)
    return F.when(F.char_length(norm) * (1 - SIMILARITY) + 1e-9 >= 1, made)


def _apart(a: str, b: str) -> Column:
    """Bits in which two SimHashes differ."""
    return functools.reduce(operator.add, [F.bit_count(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))) for k in range(BLOCKS)])


def _most(a: str, b: str) -> Column:
    """The edit distance that the similarity allows to texts of so many characters."""
    return F.floor(F.greatest(a, b) * (1 - SIMILARITY) + 1e-9).cast("int")


def _fits(a: str, b: str) -> Column:
    return F.abs(F.col(a) - F.col(b)) <= _most(a, b)


def close(a: str, b: str, most: Column) -> Column:
    """Whether the edit distance of two normalised lines is at most ``most``.

    The words that differ in place settle most links.  For all others, what the lines have in common at their ends goes.  Where
    the rest is short (SHORT), its distance is formed at once; else where the runs of ANCHOR words that either rest has once stand in one order,
    the distances of what lies between the first words of those runs are summed.  That sum is a bound from above, and one of
    over FAR times ``most`` settles it the other way: a better way past the runs would have to save a third of all edits.  What
    is open then has its distance formed within a band.
    """

    def distance(x: Column, y: Column, most: Column) -> Column:
        """Their distance if it is at most ``most``, else a number over it."""
        found = F.call_function("levenshtein", x, y, most)
        return bind(found, lambda d: F.when(d < 0, most + 1).otherwise(d))

    def total(costs: Column) -> Column:
        return F.aggregate(costs, F.lit(0), lambda n, c: n + c)

    def in_place(r: Column) -> Column:
        cost = F.zip_with(r.x, r.y, lambda p, q: F.when(p == q, 0).otherwise(F.greatest(F.char_length(p), F.char_length(q))))
        return (F.size(r.x) == F.size(r.y)) & (total(cost) <= r.most)

    def runs(w: Column) -> Column:
        return F.transform(w, lambda v, i: F.xxhash64(*[F.get(w, i + k) for k in range(ANCHOR)]))

    def once(hashes: Column) -> Column:
        alone = lambda s, i, x: F.coalesce(F.get(s, i - 1) != x, F.lit(True)) & F.coalesce(F.get(s, i + 1) != x, F.lit(True))
        return bind(F.sort_array(hashes), lambda s: F.filter(s, lambda x, i: alone(s, i, x)))

    def anchored(r: Column) -> Column:
        """Gaps and anchors of either line, then the summed distances; null where the anchors tell nothing."""

        def marked(w: Column, hashes: Column, both: Column) -> Column:
            return F.zip_with(w, hashes, lambda v, h: F.struct(v.alias("w"), F.array_contains(both, h).alias("held")))

        def parts(m: Column) -> Column:
            text = F.array_join(F.transform(m, lambda e: F.when(e.held, F.lit("\n")).otherwise(e.w)), " ")
            return F.struct(F.split(text, "\n").alias("gaps"), F.transform(F.filter(m, lambda e: e.held), lambda e: e.w).alias("anchors"))

        def sides(h: Column) -> Column:
            return bind(F.array_intersect(once(h.x), once(h.y)), lambda both: F.struct(*[parts(marked(w, g, both)).alias(n) for n, w, g in (("x", r.x, h.x), ("y", r.y, h.y))]))

        def bound(s: Column) -> Column:
            costs = F.zip_with(s.x.gaps, s.y.gaps, lambda p, q: F.when(p == q, 0).otherwise(distance(p, q, (r.most * FAR).cast("int"))))
            return F.when((s.x.anchors == s.y.anchors) & (F.size(s.x.anchors) > 0), total(costs))

        return bind(bind(F.struct(runs(r.x).alias("x"), runs(r.y).alias("y")), sides), bound)

    def common(x: Column, y: Column) -> Column:
        """Words at which two lists begin alike."""
        return F.array_position(F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False))), F.lit(False)).cast("int") - 1

    def exact(r: Column) -> Column:
        return F.when(r.most > STEP, distance(r.a, r.b, F.lit(STEP)) <= STEP).otherwise(False) | (distance(r.a, r.b, r.most) <= r.most)

    def decided(r: Column) -> Column:
        # where nothing is left of one line, the distance is the difference of the lengths
        by_anchors = bind(anchored(r), lambda d: F.when(d <= r.most, True).when(d > r.most * FAR, False).otherwise(exact(r)))
        short = F.octet_length(r.a).cast("bigint") * F.octet_length(r.b) <= SHORT
        return F.when((r.a == "") | (r.b == ""), True).when(short, exact(r)).otherwise(by_anchors)

    def trimmed(r: Column) -> Column:
        head = common(r.x, r.y)
        tail = F.least(common(F.reverse(r.x), F.reverse(r.y)), F.least(F.size(r.x), F.size(r.y)) - head)
        left = lambda w, e: F.slice(w, e.h + 1, F.size(w) - e.h - e.t)
        rest = bind(F.struct(head.alias("h"), tail.alias("t")), lambda e: F.struct(left(r.x, e).alias("x"), left(r.y, e).alias("y")))
        return bind(bind(rest, lambda e: F.struct(e.x.alias("x"), e.y.alias("y"), F.array_join(e.x, " ").alias("a"), F.array_join(e.y, " ").alias("b"), r.most.alias("most"))), decided)

    def settled(r: Column) -> Column:
        return F.when(in_place(r), True).otherwise(trimmed(r))

    words = F.struct(F.split(a, " ").alias("x"), F.split(b, " ").alias("y"), most.alias("most"))
    fits = F.abs(F.char_length(a) - F.char_length(b)) <= most
    return (F.col(a) == F.col(b)) | (fits & bind(words, settled))


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _near(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """The pairs (a, b) whose lengths and SimHashes allow a link."""
    sides = [lines.select(F.col("lid").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("chars", "sim")]) for s in ("a", "b")]
    both = pairs.distinct().join(sides[1], "b").join(sides[0], "a")
    return both.where(_fits("chars_a", "chars_b") & (_apart("sim_a", "sim_b") <= DISTANCE)).select("a", "b")


def _verified(pairs: DataFrame, texts: DataFrame, store: Store) -> DataFrame:
    """Of pairs (a, b) that are near, those that are links."""
    pairs = store.put(pairs.distinct())
    ends = pairs.select(F.col("a").alias("lid")).union(pairs.select(F.col("b").alias("lid"))).distinct()
    texts = store.put(texts.join(_few(store.put(ends)), "lid", "left_semi"))
    sides = [texts.select(F.col("lid").alias(s), F.col("norm").alias(f"norm_{s}")) for s in ("a", "b")]
    # a bucket's ends meet all its lines: they are few
    firsts = sides[0].join(_few(store.put(pairs.select("a").distinct())), "a", "left_semi")
    size = firsts.agg(F.sum(F.octet_length("norm_a") + 200)).first()[0] or 0
    both = pairs.join(sides[1], "b").join(F.broadcast(firsts) if size <= BROADCAST_BYTES else firsts, "a")
    return store.put(both.where(close("norm_a", "norm_b", _most(F.char_length("norm_a"), F.char_length("norm_b")))).select("a", "b"))


def _ordered(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.where(F.col(x) != F.col(y)).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))


def _across(members: DataFrame, lines: DataFrame, found: DataFrame, store: Store) -> DataFrame:
    """Pairs (a, b) with near SimHashes among the lines of different components of a bucket.

    The bucket's ends are left out: they have met all others.
    """
    named = members.join(found.select(F.col("node").alias("lid"), "component"), "lid", "left").withColumn("component", F.coalesce("component", "lid"))
    named = store.put(named)
    mixed = store.put(named.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key"))
    parts = F.ceil(F.col("n") / PART).cast("int")
    open_ = named.join(_few(mixed), "key", "left_semi").where("lid <> low and lid <> high")
    dealt = open_.join(lines.select("lid", "chars", "sim"), "lid").withColumn("part", F.pmod(F.xxhash64("lid"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    dealt = dealt.select("key", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "lid", "chars", "component", "sim")
    dealt = store.put(dealt)
    left, right = (dealt.select("key", "p", "q", *[F.col(c).alias(f"{c}_{s}") for c in ("part", "lid", "chars", "component", "sim")]) for s in ("a", "b"))
    met = (
        (F.col("lid_a") < F.col("lid_b"))
        & (F.col("component_a") != F.col("component_b"))
        & ((F.col("p") == F.col("q")) | (F.col("part_a") != F.col("part_b")))
        & _fits("chars_a", "chars_b")
        & (_apart("sim_a", "sim_b") <= DISTANCE)
    )
    return left.join(right, ["key", "p", "q"]).where(met).select(F.col("lid_a").alias("a"), F.col("lid_b").alias("b"))


def _joined(groups: DataFrame, links: DataFrame, store: Store) -> DataFrame:
    """The components once further links hold: only components that a link ties to another take part."""
    if not links.take(1):
        return groups
    ties = links
    for s in ("a", "b"):
        name = groups.select(F.col("node").alias(s), F.col("component").alias("c"))
        ties = ties.join(name, s, "left").withColumn(s, F.coalesce("c", s)).drop("c")
    new = store.put(components(ties).toDF("old", "new"))
    kept = groups.join(_few(new), F.col("component") == F.col("old"), "left").select("node", F.coalesce("new", "component").alias("component"))
    alone = new.join(groups.select(F.col("node").alias("old")), "old", "left_anti").toDF("node", "component")
    return store.put(kept.unionByName(alone))


def line_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line with words: id_col, line_no (from 0), keep_id and keep_line (the occurrence that its group keeps),
    group_size (occurrences), kept."""
    store = Store(df.sparkSession)
    each = df.select(df[id_col].alias("id"), F.posexplode(normal_lines(df[text_col])).alias("line_no", "norm"))
    each = each.select("id", F.col("line_no").cast("bigint").alias("line_no"), F.trim("norm").alias("norm")).where("norm <> ''")
    each = each.select("id", "line_no", F.xxhash64("norm").alias("h"), F.xxhash64(F.lit(1), "norm").alias("k"), "norm")
    found = store.put(each)

    # different lines by their hashes alone, with a number of their own once they are written
    lines = found.select("h", "k", F.char_length("norm").alias("chars"), simhash(F.col("norm")).alias("sim")).groupBy("h", "k", "chars", "sim").agg(F.count("*").alias("times"))
    lines = store.put(lines.select(F.monotonically_increasing_id().alias("lid"), "h", "k", "chars", "times", "sim"))
    entered = lines.select("lid", F.explode("sim").alias("key"))
    # most blocks are of one line: only their number goes into the large aggregate, and the ends of the others are found among their members
    shared = store.put(entered.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    met = store.put(entered.join(_few(shared), "key").select("key", "n", "lid"))
    ends = store.put(met.groupBy("key").agg(F.min("lid").alias("low"), F.max("lid").alias("high")))
    members = store.put(met.join(_few(ends), "key").select("key", "low", "high", "n", "lid"))
    # the texts of lines that share a block with another; all others are needed no more
    sharing = store.put(lines.join(_few(store.put(members.select("lid").distinct())), "lid", "left_semi").select("lid", "h", "k", "chars", "sim"))
    texts = store.put(found.select("h", "k", "norm").join(_few(sharing.select("lid", "h", "k")), ["h", "k"]).select("lid", "norm").distinct())

    # each line against the least line of its largest bucket, then against both ends of buckets that hold several components
    best = members.groupBy("lid").agg(F.max(F.struct("n", F.col("low").alias("end"))).alias("top")).select("lid", F.col("top.end").alias("end"))
    groups = store.put(components(_verified(_near(_ordered(best, "lid", "end"), sharing), texts, store)))
    label = _few(groups)
    named = members
    for c, name in (("lid", "component"), ("low", "x"), ("high", "y")):
        named = named.join(label.toDF("node", name), F.col(c) == F.col("node"), "left").withColumn(name, F.coalesce(name, c)).drop("node")
    named = store.put(named)
    pairs = _ordered(named.where("component <> x"), "lid", "low").unionByName(_ordered(named.where("component <> y"), "lid", "high"))
    groups = _joined(groups, _verified(_near(pairs, sharing), texts, store), store)
    groups = _joined(groups, _verified(_across(members.where("n > 3"), sharing, groups, store), texts, store), store)

    # a group of more than one line is known by its component's number, of one by the line itself; lines that occur once are left out
    roots = lines.select("lid", "h", "k", "times").join(_few(groups.select(F.col("node").alias("lid"), "component")), "lid", "left").where("component is not null or times > 1")
    roots = store.put(roots.select("h", "k", F.coalesce("component", "h").alias("g"), F.when(F.col("component").isNull(), F.col("k")).alias("own")))
    found = found.select("id", "line_no", "h", "k")
    grouped = store.put(found.join(_few(roots), ["h", "k"], "left").select("id", "line_no", "g", "own"))
    first = F.struct(F.col("id").isNull().alias("a"), F.col("id").alias("id"), F.col("line_no").alias("line_no"))
    best = grouped.where("g is not null").groupBy("g", "own").agg(F.min(first).alias("best"), F.count("*").alias("group_size"))
    best = store.put(best.withColumnsRenamed({"g": "g_b", "own": "own_b"}))
    out = grouped.join(best, (F.col("g") == F.col("g_b")) & F.col("own").eqNullSafe(F.col("own_b")), "left")
    mine = F.col("best").isNull() | (F.col("id").eqNullSafe(F.col("best.id")) & (F.col("line_no") == F.col("best.line_no")))
    return out.select(
        F.col("id").alias(id_col),
        "line_no",
        F.when(F.col("best").isNull(), F.col("id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.when(F.col("best").isNull(), F.col("line_no")).otherwise(F.col("best.line_no")).alias("keep_line"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        mine.alias("kept"),
    )


def drop_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with the lines that are not kept taken out of its texts; null texts stay null."""
    gid, gone = fresh_names(df, "gid", "gone")
    dropped = line_groups(df, id_col, text_col).where("not kept").groupBy(F.col(id_col).alias(gid)).agg(F.collect_set("line_no").alias(gone))
    joined = df.join(dropped, df[id_col].eqNullSafe(F.col(gid)), "left")
    left = F.filter(F.split(text_col, "\n", -1), lambda x, i: ~F.coalesce(F.array_contains(gone, i.cast("bigint")), F.lit(False)))
    return joined.withColumn(text_col, F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(F.array_join(left, "\n"))).select(*df.columns)
