"""All pairs compared block by block: what pair by pair gives, without a join."""

import random

import pytest
from pyspark.sql import functions as F
from test_copies import PEOPLE

from privlink import queries
from privlink.functions import similarity
from privlink.operators import linkage, tables

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("letters", ["ab", "abcdefgh", "0123456789#Sé😀"])
def test_rows_of_scores(letters):
    draw = random.Random(3)
    texts = sorted({"".join(draw.choices(letters, k=draw.randrange(0, size))) for size in (20, 65) for _ in range(60)})
    y = tables.Strings(texts)
    for x in [*texts, "zz", "ab" * 32]:
        assert tables.jaro_winkler_row(x, y).tolist() == [similarity.jaro_winkler(x, v) for v in y.values]
    for threshold in (0.5, 0.7, 0.9):
        for x, row in tables.matching_rows(texts, y, threshold):
            assert row.tolist() == [similarity.jaro_winkler(x, v) >= threshold for v in y.values]


def test_vectors_of_blocks(spark):
    rows = [*PEOPLE, (10, "ab" * 40, "y"), (11, "ab" * 40 + "c", "")]
    df = spark.createDataFrame(rows, "id int, name string, kind string")
    want = linkage.similarity_vectors(linkage.self_pairs(df, "id", ["name", "kind"]), ["name", "kind"]).select("id_a", "id_b", "vec")
    assert sorted(map(tuple, tables.vector_pairs(df, "id", ["name", "kind"], blocks=2).collect())) == sorted(map(tuple, want.collect()))
    counts = sorted(map(tuple, tables.vector_counts(df, "id", ["name", "kind"], blocks=2).collect()))
    assert counts == sorted(map(tuple, linkage.vector_histogram(want, 2).collect()))
    assert sorted(map(tuple, tables.vector_counts(df.limit(0), "id", ["name", "kind"], blocks=2).collect())) == [(v, 0) for v in range(4)]


def test_filters_of_blocks(spark):
    rows = [("a", 3), ("b", 3), ("b", 5), ("c", None), (None, 7), ("d", 0), ("e", 255)]
    df = spark.createDataFrame([(i, None if v is None else bytes([v, 1])) for i, v in rows], "id string, enc binary")
    there = [(i, v) for i, v in rows if i and v is not None]
    want = sorted((i, j, (v & w).bit_count() + 1, v.bit_count() + w.bit_count() + 2) for i, v in there for j, w in there if i < j)
    assert sorted(map(tuple, tables.filter_pairs(df, "id", "enc", blocks=2).collect())) == want


@pytest.mark.parametrize("name", ["private_similarity", "linkage_scores", "vector_histogram"])
def test_no_pair_is_joined(spark, monkeypatch, name):
    monkeypatch.setattr(linkage, "class_pairs", lambda *a: pytest.fail("a row for each pair goes through a join"))
    assert queries.queries()[name](spark, DATA).agg(F.count("*")).first()[0] > 0
