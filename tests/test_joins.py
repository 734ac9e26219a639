"""Joins on time against plain versions, for any width of a slice."""

import random

import pytest

from sedimenta.operators import joins


def sides(spark):
    r = random.Random(7)
    key = lambda: r.choice([None, 1, 1, 1, 2, 3])
    at = lambda: r.choice([None, *range(60)])
    left = [(i, key(), at()) for i in range(300)]
    right = [(key(), at(), r.choice([None, 5, 6]), i) for i in range(80)]
    return left, right, spark.createDataFrame(left, "id long, k int, t long"), spark.createDataFrame(right, "k int, t long, v int, w long")


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_as_of(spark, width):
    left, right, a, b = sides(spark)
    expected = []
    for i, k, t in left:
        near = [(y, -1 if v is None else v, w) for x, y, v, w in right if None not in (k, t, x, y) and x == k and y <= t]
        y, v, w = max(near, default=(None, None, None))
        expected.append((i, k, t, y, None if v == -1 else v, w))
    got = joins.as_of(a, b, ["k"], "t", "t", width)
    assert got.columns == ["id", "k", "t", "right_t", "right_v", "right_w"]
    assert sorted(map(tuple, got.collect()), key=lambda x: x[0]) == expected


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_within(spark, width):
    left, right, a, _ = sides(spark)
    spans = [(k, t, None if t is None else t + (w % 9) - 1, w) for k, t, _, w in right]
    b = spark.createDataFrame(spans, "k int, a long, b long, w long")
    expected = sorted((i, w) for i, k, t in left for x, s, e, w in spans if None not in (k, t, x, s) and x == k and s <= t < e)
    got = joins.within(a, b, ["k"], "t", "a", "b", width).select("id", "right_w")
    assert sorted(map(tuple, got.collect())) == expected


def test_empty_sides_and_names(spark):
    _, _, a, b = sides(spark)
    assert joins.as_of(a.where("false"), b, ["k"], "t", "t").count() == 0
    assert joins.as_of(a, b.where("false"), ["k"], "t", "t").where("right_t IS NULL").count() == 300
    assert joins.within(a, b.where("false").withColumn("e", b.t), ["k"], "t", "t", "e").count() == 0
    with pytest.raises(ValueError):
        joins.as_of(a, b, ["k"], "t", "t", prefix="")
    with pytest.raises(ValueError):
        joins.as_of(a, b, [], "t", "t")
