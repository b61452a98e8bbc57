import datetime as dt
import random

import pytest
from panelith.operators import references


def day(n):
    return None if n is None else dt.datetime(2000, 1, 1) + dt.timedelta(days=n)


CHILD, PARENT = "id bigint, key bigint, t timestamp_ntz, prov string", "matr bigint, a timestamp_ntz, b timestamp_ntz, prov string"


def run(spark, children, parents):
    c = spark.createDataFrame([(i, k, day(t), "x") for i, k, t in children], CHILD)
    p = spark.createDataFrame([(k, day(a), day(b), "y") for k, a, b in parents], PARENT)
    found = references.orphans(c, "key", "t", p, "matr", "a", "b")
    kinds = references.orphan_kinds(found, "key", "t", p, "matr", "a")
    return sorted((r["id"], r["kind"]) for r in kinds.collect())


def brute(children, parents):
    out = []
    for i, k, t in children:
        if k is None:
            continue
        own = [(a, b) for m, a, b in parents if m == k and a is not None]
        if t is None or not any(a <= t and (b is None or b > t) for a, b in own):
            known = any(m == k for m, _, _ in parents)
            out.append((i, "unknown" if not known else "deleted" if t is not None and any(a <= t for a, _ in own) else "later"))
    return sorted(out)


def test_edges(spark):
    parents = [(1, 0, 10), (1, 10, 20), (1, 30, None), (2, 5, 5), (3, None, None), (None, 0, None), (4, 0, 10), (4, 0, 10)]
    children = [(1, 1, -1), (2, 1, 0), (3, 1, 10), (4, 1, 20), (5, 1, 30), (6, 2, 5), (7, 3, 5), (8, None, 5), (9, 9, 5), (10, 4, None), (11, 4, 9), (11, 9, 5)]
    assert run(spark, children, parents) == brute(children, parents)


def test_empty_tables(spark):
    assert run(spark, [], [(1, 0, None)]) == []
    assert run(spark, [(1, 1, 1), (2, 1, 1)], []) == [(1, "unknown"), (2, "unknown")]


@pytest.mark.parametrize("bits", [1 << 26, 64])
def test_random_against_brute_force(spark, bits, monkeypatch):
    monkeypatch.setattr(references, "MAX_BITS", bits)
    rng = random.Random(7)
    parents = [(rng.randrange(40), a := rng.randrange(100), None if rng.random() < 0.2 else a + rng.randrange(30)) for _ in range(80)]
    children = [(i, rng.choice([0] * 40 + list(range(60))), rng.randrange(120)) for i in range(400)]
    assert run(spark, children, parents) == brute(children, parents)


def test_filter_has_no_false_negatives(spark):
    keys = spark.range(5000).select((references.F.col("id") * 7919).alias("k"))
    words, bits = references.bloom_filter(keys, "k")
    hit = references.might_contain(words.scalar(), references.F.col("k"), bits)
    assert keys.where(~hit).count() == 0
    other = spark.range(5000).select((references.F.col("id") * 7919 + 1).alias("k"))
    assert other.where(hit).count() < 500
