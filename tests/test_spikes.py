import os

import numpy as np
import pandas as pd
import pytest
from panelith.functions.robust import robust_pca, segments, weighted_quantiles
from panelith.operators import spikes

SCHEMA = "id bigint, source string, period bigint, pay double, days bigint, weeks bigint, feed string"


def found(spark, rows):
    df = spark.createDataFrame([(*r, "extra") for r in rows], SCHEMA)
    return sorted(r[0] for r in spikes.implausible(df).collect())


def normal(n, seed=1, sources=("a", "b")):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        w = int(rng.integers(1, 53))
        s = sources[int(rng.integers(len(sources)))]
        out.append((i, s, 1990 + int(rng.integers(4)), round(float(w * np.exp(rng.normal(6 if s == "a" else 9, 0.1))), 2), w * (5 if s == "a" else 6), w))
    return out


def test_impossible_and_spikes(spark):
    rows = normal(4000)
    bad = {10: (-5.0, 10, 2), 20: (900.0, 400, 52), 30: (900.0, 10, 54), 40: (500.0, 20, 2), 50: (500.0, 3, 0)}
    for i, x in bad.items():
        rows[i] = (*rows[i][:3], *x)
    for i in (100, 200):
        r = rows[i]
        rows[i] = (*r[:3], r[3] * (10 if i == 100 else 0.1), *r[4:])
    r = rows[300]
    rows[300] = (*r[:4], max(1, r[4] // 4), r[5])
    assert found(spark, rows) == sorted([*bad, 100, 200, 300])


def test_nulls_idle_and_empty(spark):
    rows = normal(1500)
    rows[5] = (5, "a", 1990, None, None, None)
    rows[6] = (6, "a", 1990, 0.0, 0, 0)
    rows[7] = (7, None, None, float("nan"), 10, 2)
    rows += [rows[8]]
    assert found(spark, rows) == []
    assert found(spark, []) == []


def test_habitual_second_level_is_normal(spark):
    rng = np.random.default_rng(3)
    rows = [(i, s, p, x * (5.0 if rng.random() < 0.12 else 1.0), d, w) for i, s, p, x, d, w in normal(4000)]
    assert found(spark, rows) == []


@pytest.mark.parametrize("bits", [2, 4, 15])
def test_runs_against_brute_force(spark, bits, monkeypatch):
    monkeypatch.setattr(spikes, "BLOCK_BITS", bits)
    monkeypatch.setattr(spikes, "SUPER_BITS", 2)
    monkeypatch.setattr(spikes, "BROADCAST_ROWS", 3 if bits == 2 else 100_000)
    rng = np.random.default_rng(bits)
    rows, v = [], 0
    for i in range(600):
        if rng.random() < 0.15:
            v += 1
        rows.append((i, "ab"[int(rng.random() < 0.2)], 1990 + i % 2, None if rng.random() < 0.01 else float(v), 1, 1))
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    got = {r[0] for r in spikes.stuck(df, spikes.Limits(habit=0.9)).collect()}
    want = set()
    for s in "ab":
        own = [r for r in rows if r[1] == s]
        i = 0
        while i < len(own):
            j = i
            while j < len(own) and own[j][3] is not None and own[j][3] == own[i][3]:
                j += 1
            if j - i >= 8:
                want |= {r[0] for r in own[i:j]}
            i = max(j, i + 1)
    assert got == want and want


def test_habitual_values_make_no_runs(spark):
    rows = [(i, "a", 1990 + i % 3, 100.0 + i, 5 * (52 if i % 10 else 20), 52 if i % 10 else 20, "x") for i in range(400)]
    assert spikes.stuck(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_robust_pca_separates_bursts():
    base = np.tile([0.7, 0.2, 0.1, 0.0], (10, 1))
    d = base.copy()
    d[3, 3] = 0.3
    low, sparse = robust_pca(d)
    assert np.abs(low - base).max() < 0.03 and sparse[3, 3] > 0.25
    assert robust_pca(np.zeros((3, 2)))[0].sum() == 0
    wide = np.tile(np.r_[0.7, 0.2, 0.1, np.zeros(40)], (10, 1))
    assert np.abs(robust_pca(wide)[0] - wide).max() < 0.03


def daily(rng, days, a_day, spikes_a_day, burst):
    """day, bin: a level about 100 each day, a second one about 130, some records far off, and on one day many at 160."""
    rows = []
    for day in range(days):
        b = np.r_[rng.normal(100, 3, a_day), rng.normal(130, 2, a_day // 12), rng.integers(0, 60, spikes_a_day), np.full(burst * (day == 5), 160)]
        rows += [(day, int(x)) for x in b]
    return np.array(rows).T


@pytest.mark.parametrize("a_day", [200, 3000])
def test_spikes_come_from_the_sparse_part(a_day, monkeypatch):
    """What is off, and a burst on one day, is sparse, the second level is not; without the split these cases are lost."""
    day, bins = daily(np.random.default_rng(4), 40, a_day, 1, a_day // 3)
    lim, one = spikes.Limits(), np.ones(bins.size, np.int64)
    held, first, sparse = spikes.profile(day, bins, one, lim.pay_floor, lim)
    off, burst = bins < 60, bins == 160
    assert sparse[off].all() and sparse[burst].all()
    assert sparse[(abs(bins - 100) < 3) | (abs(bins - 130) < 2)].mean() < 0.02
    assert held[160 - first] < lim.pay_share <= held[130 - first]
    monkeypatch.setattr(spikes, "robust_pca", lambda m: (m, np.zeros_like(m)))
    held, first, sparse = spikes.profile(day, bins, one, lim.pay_floor, lim)
    assert not sparse[burst].any() and held[160 - first] >= lim.pay_share
    assert a_day > 250 or not sparse[off].any()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables here")
def test_switching_the_split_off_loses_spikes_of_the_test_table(monkeypatch):
    e = pd.read_parquet("/root/testdata/sf0.1/earnings.parquet").query("feed == 'vr2' and sett_r > 0 and sett_r <= 53 and retrib03 > 0")
    lim, day = spikes.Limits(), e["loaded_at"].dt.floor("D").astype("int64").to_numpy()
    fine = np.floor(np.log(e["retrib03"] / e["sett_r"]) / spikes.PAY_BIN).astype(int)
    centre = fine.groupby(e["anno"]).median().astype(int)
    bins = ((fine - e["anno"].map(centre)) // spikes.PAY_COARSE).to_numpy()
    far, one = abs(bins) > 18, np.ones(bins.size, np.int64)
    assert far.sum() > 50 and spikes.profile(day, bins, one, lim.pay_floor, lim)[2][far].mean() > 0.99
    monkeypatch.setattr(spikes, "robust_pca", lambda m: (m, np.zeros_like(m)))
    assert spikes.profile(day, bins, one, lim.pay_floor, lim)[2][far].mean() < 0.5


def test_a_year_without_pay_still_has_its_weeks_and_days_tested(spark):
    rows = [(*r[:3], None if r[2] == 1991 else r[3], *r[4:]) for r in normal(4000)]
    k = next(i for i, r in enumerate(rows) if r[2] == 1991 and r[5] > 20)
    rows[k] = (*rows[k][:4], rows[k][4] // 4, rows[k][5])
    assert found(spark, rows) == [k]


def test_segments_and_quantiles():
    assert segments(np.array([0, 1, 1, 0, 1, 0, 0, 1], bool), 1) == [(1, 4), (7, 7)]
    assert segments(np.zeros(3, bool), 1) == []
    assert weighted_quantiles(np.array([1, 2, 3]), np.array([1, 1, 2]), [0.25, 0.5, 1]).tolist() == [1, 2, 3]
