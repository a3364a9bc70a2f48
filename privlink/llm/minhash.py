"""Near-duplicates by HyperMinHash: compressed registers, banding, corrected estimates, verification on full sets.

*Sketch.*  A text's set of distinct five-word shingles is hashed to 64 bits.  The high bits choose one of ``REGISTERS``
buckets; each bucket keeps its least remaining value as the count of leading zeros and ``MANTISSA`` bits after the first
one (two bytes in all).  An empty bucket borrows from the first filled bucket of a fixed random order of its own, so short
texts have full sketches as well.

*Candidates.*  Equal sets are one class, known by its smallest id.  Bands of registers are hashed, of as many rows (at most
``ROWS``) as leave two sets at the threshold without a shared band with probability ``MISS`` at most: 48 bands of 8 at 0.85,
(1 - 0.85^8)^48 = 2.4e-7; 51 bands of 6 at 0.80, (1 - 0.8^6)^51 = 1.9e-7.

*Links*, without forming the pairs of a bucket:
1. each member of a bucket is held against the bucket's smallest member (a star): estimate from the registers, corrected
   for accidental register matches, then the full sets;
2. components of these links; a bucket whose members already lie in one component is done, and so is one of two members;
3. in the other buckets, members of different components are compared in blocks of about ``BLOCK`` x ``BLOCK``: each
   pair once, in the first band that it shares, by the estimate first and then by full sets.  Only links leave the block,
   and parts of a bucket's largest component do not meet each other;
4. components of all links.
So every candidate pair that could join two components is decided on full sets; nothing is capped or dropped.  A bucket
with any share of the rows is dealt over many blocks.

Defined results: null and empty texts have an empty set and are linked with nothing; fewer than five words are one shingle;
rows that share an id are one node (linked); null ids are linked with nothing and kept; an empty table gives an empty
table; other columns are not looked at, whatever their names.  Ids are integers (or strings of digits): others are refused
by the cast to bigint.  A pair whose estimate lies ``SLACK`` standard errors under the threshold is passed over before its
full sets are compared; at the threshold itself that happens with probability 4e-6.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh_names, ship
from .graph import components

WORDS = 5
#: Links are pairs with percent * union <= 100 * intersection; this is the percent unless the caller gives another.
PERCENT = 85
REGISTERS, ROWS, MISS, MANTISSA = 384, 8, 2.5e-7, 10
#: Members of a bucket that meet the members of another such part in one call.
BLOCK = 256
#: Parts that the copies of a class are dealt over when they learn their representative.
SALTS = 32
#: Standard errors by which an estimate may miss the threshold and still be verified.
SLACK = 4.5
#: Ids that are broadcast to filter the texts (8 bytes each); beyond it the filter is a shuffled semi join.
BROADCAST_IDS = 1_000_000
REMEMBER = 500_000
# Odd multipliers for mixing.
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)

PARTS = [("id", pa.int64()), ("n", pa.int64()), ("filled", pa.binary()), ("registers", pa.binary()), ("hashes", pa.binary())]


@functools.cache
def _orders() -> np.ndarray:
    """For each register, the rank of each other register as a lender."""
    draw = np.random.RandomState(20240501).rand(REGISTERS, REGISTERS)
    return draw.argsort(axis=1).argsort(axis=1).astype(np.uint16)


def shingles(text: str, known: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles."""
    found = text.encode().lower().split()
    if not found:
        return np.empty(0, np.uint64)
    if len(found) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(found), seed=len(found))], np.uint64)
    ids = []
    for w in found:
        h = known.get(w)
        if h is None:
            h = known[w] = xxhash.xxh3_64_intdigest(w)
        ids.append(h)
    if len(known) > REMEMBER:
        known.clear()
    a = np.array(ids, dtype=np.uint64)
    n = len(a) - WORDS + 1
    s = a[:n].copy()
    for k in range(1, WORDS):
        s *= M1
        s += a[k : k + n]
    s ^= s >> np.uint64(31)
    s *= M2
    s ^= s >> np.uint64(29)
    return np.unique(s)


def sketch(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(registers, filled) of a sorted non-empty set of hashes."""
    wide = (hashes >> np.uint64(32)) * np.uint64(REGISTERS)
    bucket = (wide >> np.uint64(32)).astype(np.int64)
    at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])  # sorted: the first of a bucket is its least
    rest = ((wide[at] & np.uint64(0xFFFFFFFF)) << np.uint64(32)) | (hashes[at] & np.uint64(0xFFFFFFFF))
    fraction, exponent = np.frexp((rest >> np.uint64(11)).astype(np.float64))
    zeros = np.minimum(53 - exponent, 63)
    bits = np.where(fraction > 0, (2 * fraction - 1) * (1 << MANTISSA), 0).astype(np.int64)
    registers, filled = np.zeros(REGISTERS, np.uint16), np.zeros(REGISTERS, bool)
    registers[bucket[at]] = (zeros << MANTISSA) | bits
    filled[bucket[at]] = True
    if len(at) < REGISTERS:
        full, empty = bucket[at], np.flatnonzero(~filled)
        lender = full[_orders()[np.ix_(empty, full)].argmin(axis=1)]
        registers[empty] = registers[lender]
    return registers, filled


@functools.cache
def banding(percent: int) -> tuple[int, int]:
    """(bands, rows) for a threshold: the most rows whose bands the registers hold."""
    for rows in range(ROWS, 0, -1):
        bands = math.ceil(math.log(MISS) / math.log1p(-((percent / 100) ** rows))) if percent < 100 else 1
        if bands * rows <= REGISTERS:
            return bands, rows
    raise ValueError(f"{REGISTERS} registers are too few for a threshold of {percent} percent")


@functools.cache
def _band_seeds(bands: int) -> np.ndarray:
    return np.random.RandomState(20240502).randint(0, 2**63, bands, dtype=np.int64).astype(np.uint64)


def band_keys(registers: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """A 64-bit key for each band."""
    bands, rows = banding(percent)
    x = np.zeros((bands, -(-rows // 4) * 4), np.uint16)
    x[:, :rows] = registers[: bands * rows].reshape(bands, rows)
    x = x.view(np.uint64)
    k = _band_seeds(bands).copy()
    for i in range(x.shape[1]):
        k = (k ^ x[:, i]) * M1
        k ^= k >> np.uint64(29)
    k *= M2
    return (k ^ (k >> np.uint64(32))).view(np.int64)


def passes(equal: np.ndarray, either: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Whether an estimate leaves the threshold possible.

    equal: registers filled in either sketch that agree; either: registers filled in either.  Registers of different
    minima agree by accident with probability c; (matches - c) / (1 - c) undoes that.
    """
    ratio = n_a / np.maximum(n_b, 1)
    c = 0.169919487159739 * 4 * ratio / (1 + ratio) ** 2 / (1 << MANTISSA)
    j = (equal / np.maximum(either, 1) - c) / (1 - c)
    t = percent / 100
    sizes = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    return sizes & (j >= t - SLACK * np.sqrt(t * (1 - t) / np.maximum(either, 1)))


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _signatures(df: DataFrame, percent: int) -> DataFrame:
    """(id, n, class, bands) of rows (id, text)."""

    def run(batches):
        known: dict[bytes, int] = {}
        for batch in batches:
            ns, digests, bands = [], [], []
            for text in batch.column(1):
                h = shingles(text.as_py() or "", known)
                ns.append(len(h))
                digests.append(xxhash.xxh3_128_digest(h.tobytes()))
                bands.append(band_keys(sketch(h)[0], percent) if len(h) else np.empty(0, np.int64))
            at = np.r_[0, np.cumsum([len(x) for x in bands])].astype(np.int32)
            flat = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(bands) if bands else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, type=pa.int64()), pa.array(digests, type=pa.binary()), flat], names=["id", "n", "class", "bands"])

    return df.mapInArrow(run, "id bigint, n bigint, class binary, bands array<bigint>")


def _sets(df: DataFrame) -> DataFrame:
    """(id, n, filled, registers, hashes) of rows (id, text)."""

    def run(batches):
        known: dict[bytes, int] = {}
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h = shingles(text.as_py() or "", known)
                if len(h):
                    registers, filled = sketch(h)
                    rows.append((i, len(h), np.packbits(filled).tobytes(), registers.tobytes(), h.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=t) for k, (_, t) in enumerate(PARTS)], names=[n for n, _ in PARTS])

    return df.mapInArrow(run, "id bigint, n bigint, filled binary, registers binary, hashes binary")


def _stars(pairs: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among pairs that carry both sketches and sets."""

    def run(batches):
        for batch in batches:
            c = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for lo in range(0, batch.num_rows, 1024):
                part = {n: x.slice(lo, 1024) for n, x in c.items()}
                n_a, n_b = (part[x].to_numpy(zero_copy_only=False) for x in ("n_a", "n_b"))
                r_a, r_b = (_matrix(part[x].to_pylist(), np.uint16, REGISTERS) for x in ("registers_a", "registers_b"))
                f_a, f_b = (np.unpackbits(_matrix(part[x].to_pylist(), np.uint8, REGISTERS // 8), axis=1).astype(bool) for x in ("filled_a", "filled_b"))
                either = f_a | f_b
                good = passes(((r_a == r_b) & either).sum(1), either.sum(1), n_a, n_b, percent)
                out = [i for i in np.flatnonzero(good) if linked(*(np.frombuffer(part[x][int(i)].as_py(), np.uint64) for x in ("hashes_a", "hashes_b")), percent)]
                yield pa.RecordBatch.from_arrays([part[x].take(pa.array(out, type=pa.int64())) for x in ("a", "b")], names=["a", "b"])

    return pairs.mapInArrow(run, "a bigint, b bigint")


def _matrix(rows: list[bytes], kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), width)


def _block_links(block: list[tuple], first: int, second: int, percent: int) -> Iterator[tuple[int, int]]:
    """Links between members of different components of a bucket's parts ``first`` and ``second``."""
    # a row: band, part, id, component, lead, n, filled, registers, hashes
    band = block[0][0]
    bands, rows = banding(percent)
    left, right = [r for r in block if r[1] == first], [r for r in block if r[1] == second]
    if not left or not right:
        return
    ids, comps, leads, ns = (np.array([r[k] for r in right]) for k in (2, 3, 4, 5))
    filled = np.unpackbits(_matrix([r[6] for r in right], np.uint8, REGISTERS // 8), axis=1).astype(bool)
    registers = _matrix([r[7] for r in right], np.uint16, REGISTERS)
    for r in left:
        other = (comps != r[3]) & (ids != leads) & (r[2] != r[4])
        if first == second:
            other &= ids > r[2]
        k = np.flatnonzero(other)
        if not len(k):
            continue
        own = np.frombuffer(r[7], np.uint16)
        same, either = registers[k] == own, filled[k] | np.unpackbits(np.frombuffer(r[6], np.uint8)).astype(bool)
        good = passes((same & either).sum(1), either.sum(1), np.full(len(k), r[5]), ns[k], percent)
        shared = same[:, : bands * rows].reshape(len(k), bands, rows).all(2).argmax(1)  # the first band that the pair shares
        for i in k[good & (shared == band)]:
            if linked(np.frombuffer(r[8], np.uint64), np.frombuffer(right[i][8], np.uint64), percent):
                yield r[2], int(ids[i])


def _blocks(rows: DataFrame, percent: int) -> DataFrame:
    """Links within blocks; rows of one block are adjacent: key, p, q, band, part, id, component, lead, n, ..."""

    def run(batches):
        at, block, out = None, [], []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
                if row[:3] != at:
                    if block:
                        out += _block_links(block, at[1], at[2], percent)
                    at, block = row[:3], []
                block.append(row[3:])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], type=pa.int64()) for i in (0, 1)], names=["a", "b"])
                out = []
        if block:
            out += _block_links(block, at[1], at[2], percent)
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], type=pa.int64()) for i in (0, 1)], names=["a", "b"])

    return rows.mapInArrow(run, "a bigint, b bigint")


def _among(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of df whose id is in ids; ids are broadcast only if few by count."""
    ids = ids.select("id").distinct()
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_semi")


def _deal(hits: DataFrame) -> DataFrame:
    """Members (band, key, id, component, lead) of buckets that hold several components: key, p, q, band, part, id, component, lead.

    Parts p and q of a bucket meet where those columns are equal.  Members of the bucket's largest component have nothing to
    decide among themselves: their parts (the last ones) meet those of the others only.
    """
    each = hits.groupBy("band", "key", "component").agg(F.count("*").alias("n"))
    mixed = each.groupBy("band", "key").agg(F.max(F.struct("n", "component")).alias("most"), F.sum("n").alias("size"), F.count("*").alias("kinds")).where("kinds > 1")
    parts = lambda n: F.ceil(n / BLOCK).cast("int")
    mixed = mixed.select("band", "key", F.col("most.component").alias("main"), parts(F.col("size") - F.col("most.n")).alias("others"), parts(F.col("most.n")).alias("last"))
    main = F.col("component") == F.col("main")
    return (
        hits.join(mixed, ["band", "key"])
        .withColumn("part", F.when(main, F.col("others") + F.pmod(F.xxhash64("id"), "last")).otherwise(F.pmod(F.xxhash64("id"), "others")).cast("int"))
        .withColumn("q", F.explode(F.sequence(F.lit(0), F.col("others") - 1 + F.when(main, 0).otherwise(F.col("last")))))
        .select("key", F.least("part", "q").alias("p"), F.greatest("part", "q").alias("q"), "band", "part", "id", "component", "lead")
    )


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """Per row: id_col, n_shingles, component_id (smallest id reachable by links), kept."""
    ship(df.sparkSession)
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    signed = cut(_signatures(rows, percent))
    known = signed.where("id is not null and n > 0")

    # classes of equal sets; the smallest id stands for its class
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS))
    classes = known.groupBy("class").agg(F.min("id").alias("rep"), F.count("*").alias("size")).where("size > 1")
    classes = classes.select("class", "rep", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")).alias("salt"))
    spread = cut(known.select("id", "class", salt.alias("salt")).join(classes, ["class", "salt"]).where("id <> rep").select("id", "class", "rep").distinct())
    reps = known.join(spread, ["id", "class"], "left_anti").dropDuplicates(["id", "class"])

    members = reps.select("id", F.posexplode("bands").alias("band", "key"))
    buckets = members.groupBy("band", "key").agg(F.min("id").alias("lead"), F.count("*").alias("size")).where("size > 1")
    hits = cut(members.join(buckets, ["band", "key"]))

    sets = cut(_sets(_among(rows, hits)).dropDuplicates(["id", "hashes"]))
    pairs = hits.where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("id").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("n", "filled", "registers", "hashes")]), side)
    links = cut(_stars(pairs, percent).unionByName(spread.select(F.col("rep").alias("a"), F.col("id").alias("b"))))
    found = cut(components(links))

    label = found.select(F.col("node").alias("id"), "component")
    open_hits = hits.where("size > 2").join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
    dealt = (
        _deal(open_hits)
        .join(sets, "id")
        .select("key", "p", "q", "band", "part", "id", "component", "lead", "n", "filled", "registers", "hashes")
        .repartition("key", "p", "q")
        .sortWithinPartitions("key", "p", "q")
    )
    late = cut(_blocks(dealt, percent).distinct())
    if late.take(1):
        found = cut(components(late.unionByName(found.select(F.col("node").alias("a"), F.col("component").alias("b")))))

    out = signed.select("id", F.col("n").alias("n_shingles"))
    out = out.join(found.select(F.col("node").alias("id"), "component"), "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of df whose id is the smallest of its component, with all their columns."""
    (name,) = fresh_names(df, "gone")
    gone = near_duplicates(df, id_col, text_col, percent).where("not kept").select(F.col(id_col).alias(name)).distinct()
    return df.join(gone, df[id_col] == gone[name], "left_anti")
