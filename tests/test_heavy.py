import random
from collections import Counter

import pytest
from panelith.operators import heavy


def table(spark, rows, schema="k bigint, a bigint"):
    return spark.createDataFrame(rows, schema)


@pytest.fixture
def skewed():
    rng = random.Random(1)
    return [(rng.choice([1] * 50 + [2] * 20 + list(range(3, 33)) + [None] * 10), i) for i in range(3000)]


def test_heavy_keys_are_exact(spark, skewed):
    got = {(r[0], r[1], r[2]) for r in heavy.heavy_keys(table(spark, skewed), ["k"], 0.05).collect()}
    n = Counter(k for k, _ in skewed)
    assert got == {("k", k, c) for k, c in n.items() if k is not None and c >= 0.05 * len(skewed)}


def test_heavy_keys_of_nothing(spark):
    assert heavy.heavy_keys(table(spark, []), ["k", "a"]).collect() == []
    assert heavy.heavy_keys(table(spark, [(None, None)] * 5), ["k", "a"]).collect() == []


def test_any_share_is_answered(spark, skewed, monkeypatch):
    with pytest.raises(ValueError):
        heavy.heavy_keys(table(spark, []), ["k"], 0)
    n = Counter(k for k, _ in skewed)
    want = {("k", k, c) for k, c in n.items() if k is not None}
    assert {tuple(r) for r in heavy.heavy_keys(table(spark, skewed), ["k"], 1e-4).collect()} == want
    monkeypatch.setattr(heavy, "MOST_TRACKED", 10)
    assert {tuple(r) for r in heavy.heavy_keys(table(spark, skewed), ["k"], 1e-4).collect()} == want


@pytest.mark.parametrize(("most", "once"), [(200_000, False), (0, False), (0, True)])
@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_skew_join_equals_join(spark, skewed, how, most, once, monkeypatch):
    monkeypatch.setattr(heavy, "BROADCAST_ROWS", most)
    left = table(spark, skewed + skewed[:5])
    right = table(spark, [(1, 10), (1, 11), (2, 20), (7, 70), (None, 5)], "_k bigint, b bigint")
    got = heavy.skew_join(left, right, "k", how, share=0.05, once=once)
    want = left.join(right, left["k"] == right["_k"], how)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert got.columns == want.columns


def test_skew_join_of_empty_sides_and_clashing_names(spark):
    some, none = table(spark, [(1, 2), (1, 2)]), table(spark, [])
    assert heavy.skew_join(none, some.withColumnRenamed("k", "_k"), "k", "inner").collect() == []
    got = heavy.skew_join(some, some.withColumnRenamed("k", "_k"), "k", "left")
    assert got.columns == ["k", "a", "_k", "a_right"] and got.count() == 4
    assert heavy.skew_join(some, none.withColumnRenamed("k", "_k"), "k", "left").count() == 2


def test_key_results(spark):
    rows = [(1, 5, 2, 10.0), (1, 5, 2, 30.0), (1, 6, 0, 9.0), (1, 7, 4, None), (None, 1, 1, 1.0), (2, None, None, float("nan"))]
    df = spark.createDataFrame(rows, "k bigint, m bigint, w bigint, v double")
    got = {r[0]: tuple(r)[1:] for r in heavy.key_results(df, "k", "m", "w", "v", 0.02).collect()}
    assert got == {1: (4, 3, 40.0, 1), 2: (1, 0, None, 0)}
