import numpy as np
import pytest
from panelith.llm import percentiles, set_sketches

F = set_sketches.F
ALL = {"all": ["k"]}


def sketch(h):
    return set_sketches.unpack(set_sketches.pack(np.stack(set_sketches.observe(h), 1)))


@pytest.mark.parametrize("n", [0, 1, 40, 900, 30_000, 400_000])
def test_counts_within_stated_error(n):
    h = np.random.default_rng(n).integers(-(2**63), 2**63 - 1, (6, n))
    got = set_sketches.estimate([sketch(x) for x in h])
    assert np.abs(got.mean() - n) <= 3 * set_sketches.ERROR * n / np.sqrt(6) + 0.5


@pytest.mark.parametrize(("a", "b", "both"), [(5000, 9000, 4000), (40_000, 300, 200), (100, 100, 0), (0, 0, 700)])
def test_joint_estimates(a, b, both):
    h = np.random.default_rng(a).integers(-(2**63), 2**63 - 1, a + b + both)
    u, i, j, eu, ei, ej = set_sketches.joint(sketch(np.r_[h[:a], h[a + b :]]), sketch(h[a:]))
    n = a + b + both
    assert abs(u - n) <= 4 * eu + 1 and abs(i - both) <= 4 * ei + 1 and abs(j - both / n) <= 4 * ej + 1 / n
    assert max(eu, ei) <= 1.2 * set_sketches.ERROR * n + 1 and ej <= 1.2 * set_sketches.ERROR + 1 / n


def test_stated_errors_of_pairs_are_those_observed():
    rng, seen = np.random.default_rng(8), []
    for _ in range(40):
        h = rng.integers(-(2**63), 2**63 - 1, 18_000)
        u, i, j, eu, ei, ej = set_sketches.joint(sketch(h[:12_000]), sketch(h[6000:]))
        seen.append([(u - 18_000) / eu, (i - 6000) / ei, (j - 1 / 3) / ej])
    assert (np.abs(np.std(seen, 0) - 1) < 0.4).all()


@pytest.mark.parametrize(("base", "registers"), [(1.01, 4096), (2.0, 4096), (1.05, 256), (1.2, 65_536)])
def test_other_bases_and_registers(spark, base, registers):
    """Values beyond a byte or ten bits, and none but a few, keep their register and their error."""
    law = set_sketches.Law(registers, base)
    df = spark.range(300_000).selectExpr("id % 3 AS g", "id * 7 AS a")
    got = {r["g"]: r for r in set_sketches.counts(set_sketches.sketches(df, ["g"], ["a"], law), law).collect()}
    for g, n in ((None, 300_000), ("0", 100_000), ("1", 100_000), ("2", 100_000)):
        assert abs(got[g]["estimate"] - n) <= 4 * law.error * n
    with pytest.raises(ValueError):
        set_sketches.Law(4096, 1.0)


def test_groups_against_exact_counts(spark):
    rng = np.random.default_rng(2)
    rows = [(int(rng.integers(3)) or None, "pq"[int(rng.random() < 0.1)], int(rng.integers(5000)), None if i % 9 == 0 else int(rng.integers(40)), 1) for i in range(8000)] * 2
    df = spark.createDataFrame(rows, "day int, prov string, a bigint, b bigint, level int").repartition(5)
    got = {(r["level"], r["day"], r["prov"], r["field"]): r for r in set_sketches.counts(set_sketches.sketches(df, ["day", "prov"], ["a", "b"])).collect()}
    want = {}
    for d, p, a, b, _ in rows:
        for level in range(4):
            for f, x in (("a", a), ("b", b)):
                if x is not None:
                    want.setdefault((level, str(d) if level & 1 and d is not None else None, p if level & 2 else None, f), set()).add(x)
    assert set(got) == set(want)
    for k, s in want.items():
        assert abs(got[k]["estimate"] - len(s)) <= 4 * set_sketches.ERROR * len(s) + 0.6


def test_fields_without_a_value_have_no_sketch(spark):
    df = spark.range(4).selectExpr("cast(id % 2 as string) AS day", "id AS a", "cast(null as bigint) AS b")
    got = set_sketches.counts(set_sketches.sketches(df, ["day"], ["a", "b"])).collect()
    assert {(r["level"], r["day"], r["field"], round(r["estimate"])) for r in got} == {(0, None, "a", 4), (1, "0", "a", 2), (1, "1", "a", 2)}


def test_merged_days_equal_the_whole(spark):
    df = spark.range(3000).selectExpr("cast(id % 7 as string) AS day", "id * 31 AS a")
    whole = set_sketches.sketches(df, [], ["a"])
    parts = set_sketches.sketches(df.where("day < '3'"), [], ["a"]).unionByName(set_sketches.sketches(df.where("day >= '3'"), [], ["a"]))
    assert set_sketches.merged(parts, ["level", "field"]).collect() == whole.collect()
    assert set_sketches.counts(set_sketches.sketches(df.limit(0), ["day"], ["a"])).collect() == []


def exact(rows, shares):
    by = {}
    for k, m, v in rows:
        if v is not None and v == v:
            by.setdefault((k, m), []).append(v)
    return {k: (len(v), *[sorted(v)[max(1, int(np.ceil(q * len(v)))) - 1] for q in shares]) for k, v in by.items()}


@pytest.mark.parametrize(("proposals", "chunk", "held"), [(63, 400_000, 40_000), (7, 150, 40_000), (2, 60, 0)])
def test_percentiles_are_exact(spark, proposals, chunk, held, monkeypatch):
    """With few proposals, small chunks and a state that isn't broadcast, too."""
    for k, v in (("PROPOSALS", proposals), ("CHUNK", chunk), ("BROADCAST_ROWS", held), ("FEW", 1024 if held else 0)):
        monkeypatch.setattr(percentiles, k, v)
    rounds = []
    made = percentiles._count
    monkeypatch.setattr(percentiles, "_count", lambda *x: rounds.append(1) or made(*x))
    rng = np.random.default_rng(1)
    rows = [(int(k) if k else None, "m", float(v)) for k, v in zip(rng.choice([0, 1, 1, 1, 1, 2], 3000), np.round(rng.lognormal(size=3000), 1), strict=True)]
    rows += [(1, "m", 7.0)] * 900 + [(2, "m", float("inf")), (2, "m", float("-inf"))] * 3 + [(9, "m", None), (8, "m", float("nan")), (7, "m", -1.0)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "k bigint, m string, v double, n int").repartition(6)
    shares = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = {(r["k"], r["m"]): tuple(r)[2:] for r in percentiles.percentiles(df, ["k", "m"], ["v"], {"all": ["k", "m"]}, shares).drop("level", "measure").collect()}
    assert got == exact(rows, shares)
    assert rounds
    assert percentiles.percentiles(df.limit(0), ["k"], ["v"], ALL, [0.5]).collect() == []


def test_combined_days_within_epsilon(spark):
    rng = np.random.default_rng(4)
    v = np.sort(rng.normal(size=20_000))
    df = spark.createDataFrame([(1, float(x), int(rng.integers(9))) for x in v], "k bigint, v double, day int").repartition(3)
    parts = None
    for d in range(9):
        p = percentiles.summaries(df.where(f"day = {d}"), ["k"], ["v"], ALL, 0.02)
        parts = p if parts is None else parts.unionByName(p)
    got = percentiles.combined(parts, ["level", "k", "measure"], [0.1, 0.5, 0.9], 0.02).first()
    assert got["n"] == v.size and parts.selectExpr("max(length(values))").first()[0] <= 16 * 201
    for q in (0.1, 0.5, 0.9):
        assert abs(np.searchsorted(v, got[f"p{round(100 * q)}"], "right") / v.size - q) <= 0.02
    assert percentiles.combined(percentiles.summaries(df.limit(0), ["k"], ["v"], ALL), ["level", "k", "measure"], [0.5]).collect() == []


def test_rank_errors(spark):
    df = spark.createDataFrame([(i % 2, float(i)) for i in range(200)], "k bigint, v double")
    found = percentiles.percentiles(df, ["k"], ["v"], ALL, [0.1, 0.5])
    assert [r["error"] for r in percentiles.rank_errors(df, ["k"], ["v"], ALL, found, [0.1, 0.5]).collect()] == [0, 0]
    off = found.withColumn("p50", F.col("p50") + 10)
    assert [r["error"] for r in percentiles.rank_errors(df, ["k"], ["v"], ALL, off, [0.1, 0.5]).collect()] == [0.05, 0.05]


def test_search_that_does_not_end_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(percentiles, "ROUNDS", 0)
    monkeypatch.setattr(percentiles, "PROPOSALS", 3)
    with pytest.raises(RuntimeError):
        percentiles.percentiles(spark.range(100).selectExpr("1L AS k", "cast(id AS double) AS v"), ["k"], ["v"], ALL, [0.5])
