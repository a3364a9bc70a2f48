"""Fuzzy line dedup against brute force that is written here from its description alone."""

import functools
import random
import re
from collections import Counter

import pytest
import xxhash
from privlink.llm import lines
from pyspark.sql import functions as F

M64 = (1 << 64) - 1


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@functools.cache
def fours(a):
    return Counter(a[i : i + 4] for i in range(len(a) - 3))


def near(a, b):
    """By the edit distance; an edit takes at most four runs of four characters away, which rules most pairs out first."""
    most = int(0.1 * max(len(a), len(b)) + 1e-9)
    return abs(len(a) - len(b)) <= most and (fours(a) - fours(b)).total() <= 4 * most and distance(a, b) <= most


def normal(line):
    return " ".join(w for w in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", line.lower()) if w)


def hashed(*texts):
    h = 42
    for t in texts:
        h = xxhash.xxh64_intdigest(t.encode(), seed=h)
    return h - (1 << 64) if h >> 63 else h


@functools.cache
def blocks(norm):
    """Eight majorities of the three features that follow a point on the circle; None under ten characters."""
    if len(norm) < 10:
        return None
    w = norm.split(" ")
    found = {hashed(norm[i : i + 4]) for i in range(len(norm) - 3)} if len(w) < 12 else {hashed(a, b) for a, b in zip([""] + w, w + [""], strict=True)}
    circle, out = sorted(found), []
    for t in range(8):
        at = next((i for i, h in enumerate(circle) if h >= -(1 << 63) + t * (1 << 61)), 0)
        x, y, z = (circle[(at + k) % len(circle)] for k in range(3))
        out.append((x & y) | (x & z) | (y & z))
    return out


def linked(a, b):
    x, y = blocks(a), blocks(b)
    if x is None or y is None or not any(p == q for p, q in zip(x, y, strict=True)):
        return False
    return sum(((p ^ q) & M64).bit_count() for p, q in zip(x, y, strict=True)) <= lines.DISTANCE and near(a, b)


def expected(rows, link):
    """(id, line_no) -> (keep_id, keep_line, group_size, kept) for rows (id, text)."""
    places = {}
    for i, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            if normal(line):
                places.setdefault(normal(line), []).append((i, k))
    label = {n: n for n in places}

    def root(n):
        while label[n] != n:
            n = label[n]
        return n

    norms = sorted(places)
    for k, a in enumerate(norms):
        for b in norms[:k]:
            if root(a) != root(b) and link(a, b):
                label[root(a)] = root(b)
    groups = {}
    for n in norms:
        groups.setdefault(root(n), []).extend(places[n])
    return {p: (*min(g), len(g), p == min(g)) for g in groups.values() for p in g}


def result(frame):
    return {(r.doc_id, r.line_no): (r.keep_id, r.keep_line, r.group_size, r.kept) for r in lines.line_groups(frame).collect()}


def typos(rnd, base, least, most):
    other = list(base)
    for at in rnd.sample(range(len(base)), rnd.randint(least, most)):
        k = rnd.randrange(len(other[at]))
        other[at] = other[at][:k] + rnd.choice(["", "x", other[at][k] + "q"]) + other[at][k + 1 :]
    return other


@pytest.fixture(scope="module")
def word():
    rnd = random.Random(12)
    return lambda: "".join(rnd.choice("abcdefghijklmnoprstué") for _ in range(rnd.randint(4, 9)))


def test_groups(spark, word):
    rnd = random.Random(1)
    texts = [None, "", " \t\n", "...", "one", "One!", "two words", "tenletters", "tenletterz", "x" * 5000, "é" * 30, "é" * 29 + "e", "Same line here", "same  LINE, here"]
    for n in (4, 9, 11, 12, 13, 30, 60):
        base = [word() for _ in range(n)]
        texts += [" ".join(base), "first\n" + ", ".join(base).upper()] + ["\n".join(" ".join(typos(rnd, base, 0, max(1, n // 8))) for _ in range(2)) for _ in range(3)]
        swapped = list(base)
        swapped[n // 2] = word()
        texts += [" ".join(swapped), " ".join(base[:-1]), " ".join(base[n // 2 :] + base[: n // 2])]
    rows = list(enumerate(texts))
    frame = spark.createDataFrame([(i, t, "x", 1, "y", 2, 3) for i, t in rows], "doc_id bigint, text string, line string, h int, norm string, _gid int, _gone int").repartition(4)
    want = expected(rows, linked)
    assert result(frame) == want and sum(not v[3] for v in want.values()) > 20
    left = {r.doc_id: r for r in lines.drop_lines(frame).collect()}
    assert left[0].text is None and left[1].text == "" and left[5].text == "" and left[13].text == "" and left[3].text == "..." and left[4]._gone == 3
    for i, t in rows[1:]:
        assert left[i].text == "\n".join(x for k, x in enumerate(t.split("\n")) if want.get((i, k), (0, 0, 0, True))[3])
    assert lines.line_groups(frame.limit(0)).count() == 0 and lines.drop_lines(frame.limit(0)).count() == 0


def test_repeated_rows_and_null_ids(spark):
    line = "a line of several words that stands in more than one row"
    frame = spark.createDataFrame([(None, line), ("d2", line), ("d2", line), ("d1", "another\n" + line + "s")], "doc_id string, text string")
    got = sorted(((r.doc_id or "~", r.line_no, r.keep_id, r.keep_line, r.group_size, r.kept) for r in lines.line_groups(frame).collect()))
    assert got == [("d1", 0, "d1", 0, 1, True), ("d1", 1, "d1", 1, 4, True), ("d2", 0, "d1", 1, 4, False), ("d2", 0, "d1", 1, 4, False), ("~", 0, "d1", 1, 4, False)]


def test_open_buckets(spark, word, monkeypatch):
    """Many lines that share blocks and are not all near each other: components equal those of all pairs, also in small parts."""
    rnd = random.Random(10)
    base = [word() for _ in range(40)]
    texts = []
    for _ in range(70):
        other = list(base)
        for at in rnd.sample(range(40), rnd.randint(2, 6)):
            other[at] = word()
        texts.append(" ".join(other))
    rows = list(enumerate(texts))
    want = expected(rows, linked)
    assert 5 < len({v[:2] for v in want.values()}) < 60
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    monkeypatch.setattr(lines, "PART", 8)
    assert result(frame) == want


def test_recall(spark, word):
    """Of the links that edit similarity alone gives, at least 0.9 are within a group (0.94 here, where typos are in up to a
    sixth of the words), and no group holds anything else."""
    rnd = random.Random(13)
    texts = []
    for n in (6, 8, 11, 12, 20, 30, 60, 100) * 8:
        base = [word() for _ in range(n)]
        texts += [" ".join(base)] + [" ".join(typos(rnd, base, 1, max(1, n // 6))) for _ in range(3)]
        other = list(base)
        for at in rnd.sample(range(n), max(1, n // 15)):
            other[at] = word()
        texts.append(" ".join(other))
    truth = expected(list(enumerate(texts)), near)
    got = result(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3))
    links = [(a, b) for a in range(len(texts)) for b in range(a) if truth[a, 0][:2] == truth[b, 0][:2] and near(texts[a], texts[b])]
    found = sum(got[a, 0][:2] == got[b, 0][:2] for a, b in links)
    assert len(links) > 200 and found >= 0.9 * len(links)
    assert all(truth[a, 0][:2] == truth[b, 0][:2] for a in range(len(texts)) for b in range(a) if got[a, 0][:2] == got[b, 0][:2])


def test_lines_that_sum_alike(spark):
    """The Thue-Morse word and its complement collide in sums of bytes times powers modulo 2^64; they are two lines here."""
    t = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    got = result(spark.createDataFrame([(1, t), (2, t.translate(str.maketrans("ab", "ba")))], "doc_id bigint, text string"))
    assert {v[2] for v in got.values()} == {1}


def test_close(spark):
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abc𝄞é") for _ in range(rnd.randint(1, 6))) for _ in range(40)]
    pairs = [("a", "a"), ("ab cd", "ab"), ("ab", "ab cd ef"), ("a" * 30, "a" * 33), ("a" * 30, "a" * 34), ("x y", "y x")]
    for _ in range(400):
        a = [rnd.choice(words) for _ in range(rnd.randint(1, 60))]
        b = list(a)
        for _ in range(rnd.randint(0, 6)):
            at = rnd.randrange(len(b) + 1)
            b[at : at + rnd.randint(0, 1)] = [rnd.choice(words)] * rnd.randint(0, 2)
        if rnd.random() < 0.2:
            b = b[len(b) // 2 :] + b[: len(b) // 2]
        pairs.append((" ".join(a), " ".join(b)))
    most = F.floor(F.greatest(F.length("a"), F.length("b")) * 0.1 + 1e-9).cast("int")
    got = {(r.a, r.b): r.near for r in spark.createDataFrame(pairs, "a string, b string").select("a", "b", lines.close("a", "b", most).alias("near")).collect()}
    assert all(got[a, b] == near(a, b) for a, b in pairs)
    assert 50 < sum(got.values()) < len(got) - 50
