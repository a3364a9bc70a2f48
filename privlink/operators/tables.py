"""All pairs of rows with uid_a < uid_b, compared block by block within a task: no row of a pair is joined, and no field of it is sent on.

Rows are dealt over ``blocks`` parts and each part meets each, so a row is copied 2 * ``blocks`` times and a task holds two parts.  Exhaustive as
``linkage.self_pairs`` is: nulls agree with nothing, null uids are in no pair, repeated uids pair with others row by row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.similarity import LETTERS, THRESHOLD, jaro_winkler
from ..runtime import ship

#: Rows of the left part that are compared with the right part at a time, and pairs that are handed on at a time.
STRIP, GIVEN = 64, 1 << 17


def block_tables(df: DataFrame, uid: str, fields: list[str], blocks: int, answer, schema: T.StructType, last=lambda state: ()) -> DataFrame:
    """What ``answer`` (of a task's state and the rows of two parts as Arrow tables (uid, fields)) says of all parts, and ``last`` at a task's end."""
    ship(df.sparkSession)
    part = F.pmod(F.xxhash64(uid), F.lit(blocks)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    dealt = df.where(F.col(uid).isNotNull()).select(part.alias("_p"), F.col(uid), *fields)
    left = dealt.select(F.lit(0).alias("_s"), F.col("_p").alias("_i"), other.alias("_j"), uid, *fields)
    right = dealt.select(F.lit(1).alias("_s"), other.alias("_i"), F.col("_p").alias("_j"), uid, *fields)
    both = left.unionByName(right).repartitionByRange(blocks * blocks, "_i", "_j").sortWithinPartitions("_i", "_j", "_s")

    def run(batches):
        state, kept, before = {}, [], None

        def pair():
            whole = pa.Table.from_batches(kept)
            at = int((whole.column("_s").to_numpy() == 0).sum())
            if 0 < at < whole.num_rows:
                rows = whole.drop_columns(["_s", "_i", "_j"])
                yield from answer(state, rows.slice(0, at).combine_chunks(), rows.slice(at).combine_chunks())

        for batch in batches:
            place = batch.column(1).to_numpy().astype(np.int64) * blocks + batch.column(2).to_numpy()
            cuts = [0, *(np.flatnonzero(place[1:] != place[:-1]) + 1).tolist(), len(place)]
            for s, t in zip(cuts, cuts[1:], strict=False):
                if s == t:
                    continue
                if kept and place[s] != before:
                    yield from pair()
                    kept = []
                kept.append(batch.slice(s, t - s))
                before = place[s]
        if kept:
            yield from pair()
        yield from last(state)

    return both.mapInArrow(run, schema)


def in_order(a: pa.Table, b: pa.Table) -> tuple[pa.Table, pa.Table, np.ndarray]:
    """Both parts in order of uid, and for each row of a the first row of b with a larger one."""
    a, b = (t.take(pa.compute.sort_indices(t.column(0))) for t in (a, b))
    x, y = (t.column(0).to_pylist() for t in (a, b))
    if x and not isinstance(x[0], (int, float)):
        rank = {v: i for i, v in enumerate(sorted({*x, *y}))}
        x, y = ([rank[v] for v in z] for z in (x, y))
    return a, b, np.searchsorted(np.array(y), np.array(x), side="right")


def _low(c: np.ndarray) -> np.ndarray:
    """The lowest bit that is set."""
    return c & (~c + c.dtype.type(1))


class _Some:
    """Parts of columns, taken as they are asked for."""

    def __init__(self, columns, only: np.ndarray):
        self.columns, self.only = columns, only

    def __contains__(self, key) -> bool:
        return key in self.columns

    def __getitem__(self, key) -> np.ndarray:
        return self.columns[key][self.only]


class Strings:
    """Different strings of at most ``LETTERS`` letters, shorter ones first, ready to be compared with others."""

    def __init__(self, values: list[str]):
        self.values = sorted(values, key=len)
        self.sizes = np.fromiter(map(len, self.values), np.int64, len(values))
        top = int(self.sizes.max(initial=0))
        self.kind = np.uint32 if top <= 32 else np.uint64
        self.letters = {c: i for i, c in enumerate(sorted({c for v in self.values for c in v}))}
        self.codes = np.full((top, len(values)), len(self.letters), np.int64)  # behind a string's end: no letter
        for i, v in enumerate(self.values):
            self.codes[: len(v), i] = [self.letters[c] for c in v]
        self.places = {c: np.zeros(len(values), self.kind) for c in self.letters}
        for c, i in self.letters.items():
            for p in range(top):
                self.places[c] |= (self.codes[p] == i).astype(self.kind) << self.kind(p)
        self.reach = np.maximum(self.sizes // 2 - 1, 0)
        self.windows = [self._window(p) for p in range(top)]

    def of(self, only: np.ndarray) -> Strings:
        """Those at some ascending places."""
        out = object.__new__(Strings)
        out.values, out.sizes, out.kind, out.letters, out.codes = only, self.sizes[only], self.kind, self.letters, self.codes[:, only]
        out.places, out.windows = _Some(self.places, only), _Some(self.windows, only)
        return out

    def _window(self, p: int) -> np.ndarray:
        full = (1 << (8 * np.dtype(self.kind).itemsize)) - 1
        kinds, at = np.unique(self.reach, return_inverse=True)
        return np.array([(((1 << (p + r + 1)) - 1) & ~((1 << max(0, p - r)) - 1)) & full for r in kinds.tolist()], self.kind)[at]


def _scores(places, windows, count: int, shorter, longer, kind) -> np.ndarray:
    """Jaro: of each letter of the shorter strings, its places in the longer ones and the window that it may be found in."""
    size = len(shorter) if isinstance(shorter, np.ndarray) else len(longer)
    free, found = np.full(size, np.iinfo(kind).max, kind), []
    for i in range(count):
        at = _low(places[i] & windows[i] & free)
        free ^= at
        found.append(at != 0)
    left = ~free
    m = np.bitwise_count(left).astype(np.int64)
    apart = np.zeros(size, np.int64)
    for i in range(count):
        at = np.where(found[i], _low(left), kind(0))
        left ^= at
        apart += found[i] & ((at & places[i]) == 0)
    return np.where(m > 0, (m / np.maximum(shorter, 1) + m / np.maximum(longer, 1) + (m - apart // 2) / np.maximum(m, 1)) / 3, 0.0)


def jaro_winkler_row(x: str, y: Strings, only: np.ndarray | None = None) -> np.ndarray:
    """``jaro_winkler`` of x with all of y (or those at the ascending places ``only``)."""
    n = len(x)
    if only is not None:
        y = y.of(only)
    wide = np.uint64 if n > 32 else y.kind
    at = int(np.searchsorted(y.sizes, n))  # those before are shorter than x
    out = np.zeros(len(y.values))
    if at:
        count = int(y.sizes[at - 1])
        table = np.array([sum(1 << i for i, c in enumerate(x) if c == d) for d in y.letters] + [0], wide)
        r = max(n // 2 - 1, 0)
        windows = [wide((((1 << (i + r + 1)) - 1) & ~((1 << max(0, i - r)) - 1)) & int(np.iinfo(wide).max)) for i in range(count)]
        out[:at] = _scores([table[y.codes[i, :at]] for i in range(count)], windows, count, y.sizes[:at], n, wide)
    if at < len(out):
        none = np.zeros(len(out) - at, y.kind)
        places = [y.places[c][at:] if c in y.places else none for c in x]
        out[at:] = _scores(places, [y.windows[i][at:] for i in range(n)], n, n, y.sizes[at:], y.kind)
    some = np.flatnonzero(out > 0.7)
    prefix, still = np.zeros(len(some)), np.ones(len(some), bool)
    for i, c in enumerate(x[: len(y.codes)]):
        still &= y.codes[i, some] == y.letters.get(c, -1)
        if not still.any():
            break
        prefix += still
    out[some] += np.minimum(0.1, 1 / np.maximum(y.sizes[some], max(n, 1))) * prefix * (1 - out[some])
    return out


def _sure(n: int, k: int, threshold: float) -> tuple[int, int]:
    """Of strings of n and k letters: the least number of common letters that may reach the threshold, and that from which on all do."""
    score = lambda m, t: (m / min(n, k) + m / max(n, k) + (m - t) / m) / 3
    top = min(n, k)
    may = next((m for m in range(1, top + 1) if score(m, 0) >= threshold), top + 1)
    must = next((m + 1 for m in range(top, 0, -1) if score(m, m // 2) < threshold), 1)
    return may, must


def matching_rows(xs: list[str], y: Strings, threshold: float):
    """For each of the strings, in any order: it, and which of y it matches.

    Up to a threshold of 0.7 a common beginning doesn't count, and the number of common letters often tells.  It is the same from either
    side (the windows move on with the letters, so taking the first free place leaves most for the others), and strings that begin
    alike share the work on their beginnings.
    """
    if threshold > 0.7 or not len(y.values):
        for x in xs:
            yield x, jaro_winkler_row(x, y) >= threshold
        return
    before, size, codes = "", -1, y.codes.astype(np.int16) if len(y.letters) < 1 << 15 else y.codes
    for x in sorted(xs, key=lambda v: (len(v), v)):
        n = len(x)
        if n != size:
            kind = np.uint64 if n > 32 else y.kind
            full, none = np.iinfo(kind).max, np.zeros(len(y.values), kind)
            lengths, at = np.unique(y.sizes, return_inverse=True)
            reach = [max(max(k, n) // 2 - 1, 0) for k in lengths.tolist()]
            windows = [np.array([((1 << (i + r + 1)) - 1) & ~((1 << max(0, i - r)) - 1) & int(full) for r in reach], kind)[at] for i in range(n)]
            may, must = (np.array(v, np.uint8)[at] for v in zip(*[_sure(n, k, threshold) for k in lengths.tolist()], strict=True))
            sure = [np.array([[(m / min(n, k) + m / max(n, k) + (m - (m - p) // 2) / m) / 3 >= threshold if 0 < p <= m <= k else False for p in range(n + 1)] for m in range(n + 1)]) for k in lengths.tolist()]
            sure = np.array(sure)
            states, before, size = [np.full(len(y.values), full, kind)], "", n
            begins, same = [np.zeros(len(y.values), np.uint8)], [np.ones(len(y.values), bool)]
            places = {c: v.astype(kind, copy=False) for c, v in y.places.items()}
        p = next((i for i, (c, d) in enumerate(zip(x, before, strict=False)) if c != d), min(n, len(before)))
        for stack in (states, begins, same):
            del stack[p + 1 :]
        for i in range(p, n):
            free = states[-1]
            c = places.get(x[i], none) & windows[i]
            c &= free
            c &= np.negative(c)  # the lowest bit
            states.append(free ^ c)
            same.append(same[-1] & (codes[i] == y.letters.get(x[i], -1)) if i < len(codes) else same[0] & False)
            begins.append(begins[-1] + same[-1])
        before = x
        m = np.bitwise_count(~states[-1])
        out = m >= must
        open_ = np.flatnonzero((m >= may) & ~out)
        if len(open_):  # a common beginning is matched with itself, so none of it is transposed
            out[open_] = sure[at[open_], m[open_], begins[-1][open_]]
            open_ = open_[~out[open_]]
        if len(open_):
            out[open_] = jaro_winkler_row(x, y, open_) >= threshold
        yield x, out


class Matches:
    """Which of the values of a field of the right part those of the left part match."""

    def __init__(self, left: pa.ChunkedArray, right: pa.ChunkedArray, threshold: float):
        xs, ys = left.to_pylist(), right.to_pylist()
        different = sorted({v for v in ys if v is not None})
        short, long = Strings([v for v in different if len(v) <= LETTERS]), [v for v in different if len(v) > LETTERS]
        every = [*short.values, *long]
        at = {v: i for i, v in enumerate(every)} | {None: len(every)}
        self.right, self.count, self.rows = np.array([at[v] for v in ys]), len(every) + 1, {None: np.packbits(np.zeros(len(every) + 1, bool))}
        values = {v for v in xs if v is not None}
        for x, row in matching_rows([v for v in values if len(v) <= LETTERS], short, threshold):
            self.rows[x] = np.packbits(np.concatenate([row, [jaro_winkler(x, v) >= threshold for v in long], [False]]).astype(bool))
        for x in values - self.rows.keys():
            self.rows[x] = np.packbits(np.array([*[jaro_winkler(x, v) >= threshold for v in every], False]))
        self.left = xs

    def of(self, i: int) -> np.ndarray:
        """For row i of the left part each row of the right part, as 0 or 1."""
        return np.unpackbits(self.rows[self.left[i]], count=self.count)[self.right]


def _vectors(a: pa.Table, b: pa.Table, threshold: float):
    """For runs of rows of a: the first of them, and the vectors with the rows of b, bit j for field j."""
    fields = [Matches(a.column(c), b.column(c), threshold) for c in a.column_names[1:]]
    for e in range(0, a.num_rows, STRIP):
        out = np.zeros((min(STRIP, a.num_rows - e), b.num_rows), np.int16)
        for i, row in enumerate(out):
            for j, field in enumerate(fields):
                row |= field.of(e + i).astype(np.int16) << j
        yield e, out


def vector_counts(df: DataFrame, uid: str, fields: list[str], threshold: float = THRESHOLD, blocks: int = 8) -> DataFrame:
    """(vec, n): how many pairs have each Jaro-Winkler vector, zeros included."""
    schema = T.StructType().add("vec", T.IntegerType()).add("n", T.LongType())

    def answer(state, a, b):
        a, b, start = in_order(a, b)
        counts = state.setdefault("n", np.zeros(1 << len(fields), np.int64))
        for e, vectors in _vectors(a, b, threshold):
            for i, row in enumerate(vectors):
                counts += np.bincount(row[start[e + i] :], minlength=len(counts))
        yield from ()

    def last(state):
        counts = state.get("n", np.zeros(1 << len(fields), np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(counts), dtype=np.int32)), pa.array(counts)], names=["vec", "n"])

    found = block_tables(df, uid, fields, blocks, answer, schema, last).groupBy("vec").agg(F.sum("n").alias("n"))
    every = df.sparkSession.range(1 << len(fields)).select(F.col("id").cast("int").alias("vec"))
    return every.join(found, "vec", "left").select("vec", F.coalesce("n", F.lit(0)).alias("n"))


def _given(a: pa.Table, b: pa.Table, i: np.ndarray, j: np.ndarray, columns: list[np.ndarray], schema: T.StructType):
    for at in range(0, len(i), GIVEN):
        s = slice(at, at + GIVEN)
        ids = [t.column(0).combine_chunks().take(pa.array(k[s])) for t, k in ((a, i), (b, j))]
        ids = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in ids]
        yield pa.RecordBatch.from_arrays([*ids, *[pa.array(c[s]) for c in columns]], names=[f.name for f in schema])


def _of_pairs(df: DataFrame, uid: str, *names: str) -> T.StructType:
    kind = df.schema[uid].dataType
    return T.StructType([T.StructField(f"{uid}_{s}", kind) for s in "ab"] + [T.StructField(n, T.IntegerType()) for n in names])


def _after(start: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the pairs of a run, given where each row's begin."""
    return np.nonzero(np.arange(size) >= start[:, None])


def vector_pairs(df: DataFrame, uid: str, fields: list[str], threshold: float = THRESHOLD, blocks: int = 8) -> DataFrame:
    """({uid}_a, {uid}_b, vec) of all pairs, by Jaro-Winkler."""
    schema = _of_pairs(df, uid, "vec")

    def answer(state, a, b):
        a, b, start = in_order(a, b)
        for e, vectors in _vectors(a, b, threshold):
            i, j = _after(start[e : e + len(vectors)], b.num_rows)
            yield from _given(a, b, i + e, j, [vectors[i, j].astype(np.int32)], schema)

    return block_tables(df, uid, fields, blocks, answer, schema)


def filter_pairs(df: DataFrame, uid: str, enc: str, blocks: int = 8) -> DataFrame:
    """({uid}_a, {uid}_b, common, total) of all pairs of filters: the ones in common, and the sum of both filters' ones.  Null filters are in no pair."""
    schema = _of_pairs(df, uid, "common", "total")

    def words(table):
        raw = np.frombuffer(b"".join(table.column(1).to_pylist()), np.uint8).reshape(table.num_rows, -1)
        full = np.zeros((len(raw), 8 * -(-raw.shape[1] // 8)), np.uint8)
        full[:, : raw.shape[1]] = raw
        return np.ascontiguousarray(full.view("<u8").T)

    def answer(state, a, b):
        a, b, start = in_order(a, b)
        x, y = words(a), words(b)
        ones = [np.bitwise_count(w).sum(0, dtype=np.int32) for w in (x, y)]
        for e in range(0, a.num_rows, STRIP):
            i, j = _after(start[e : e + STRIP], b.num_rows)
            common = np.zeros((min(STRIP, a.num_rows - e), b.num_rows), np.int32)
            for v, w in zip(x, y, strict=True):
                common += np.bitwise_count(v[e : e + STRIP, None] & w)
            yield from _given(a, b, i + e, j, [common[i, j], ones[0][i + e] + ones[1][j]], schema)

    return block_tables(df.where(F.col(enc).isNotNull()), uid, [enc], blocks, answer, schema)
