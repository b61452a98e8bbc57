import numpy as np
import pytest
from panelith.functions import linalg
from panelith.functions.quantiles import quantiles
from panelith.operators import clusters, estimators, graph, panel, prep, reports
from panelith.sources import tables


def cells(spark, rows):
    return spark.createDataFrame(rows, "unit bigint, outcome string, value double")


def factor_rows(kind, spans, n, each=60):
    rng = np.random.default_rng(2)
    units = each * len(spans)
    y = rng.normal(size=(units, 3)) @ rng.normal(size=(n, 3)).T if kind == "factor" else rng.normal(size=(units, 1)) + rng.normal(size=(1, n))
    rows = [(i, f"t{t}", float(y[i, t])) for i in range(units) for t in range(*spans[i // each])]
    means = {"; ".join(f"t{t}" for t in range(*s)): y[k * each : (k + 1) * each].mean(0) for k, s in enumerate(spans)}
    return rows, means


@pytest.mark.parametrize(("kind", "name", "spans", "n"), [("factor", "apm_rank_3", [(0, 4), (1, 8), (4, 9)], 9), ("additive", "twfe_clustered", [(0, 4), (1, 7), (4, 8)], 8), ("additive", "twfe_apm_rank_1", [(0, 4), (1, 7), (4, 8)], 8)])
def test_exact_recovery_of_every_cohort(spark, kind, name, spans, n):
    rows, truth = factor_rows(kind, spans, n)
    p = panel.build(cells(spark, rows), 4, 60)
    got = estimators.means(p, [name]).collect()
    assert len(got) == 3 * n
    for r in got:
        assert abs(r["outcome_mean"] - truth[r["cohort_key"]][int(r["outcome"][1:])]) < 1e-8


def test_two_way_equals_dummy_regression():
    rng = np.random.default_rng(4)
    obs, units = [], []
    for i in range(40):
        c = [(0, 1, 2), (1, 3), (2, 3, 4)][i % 3]
        w = float(rng.uniform(0.5, 2))
        y = rng.normal(size=len(c))
        units.append((c, w, y))
        obs += [(i, t, w, v) for t, v in zip(c, y, strict=True)]
    x = np.zeros((len(obs), 45))
    for k, (i, t, _, _) in enumerate(obs):
        x[k, i] = x[k, 40 + t] = 1
    root = np.sqrt([o[2] for o in obs])
    beta = np.linalg.pinv(x * root[:, None]) @ (root * [o[3] for o in obs])
    cohorts = {}
    for c in {u[0] for u in units}:
        own = [(i, u) for i, u in enumerate(units) if u[0] == c]
        w = np.array([u[1] for _, u in own])
        y = np.array([u[2] for _, u in own])
        cohorts[str(c)] = linalg.Cohort(np.array(c), w.sum(), w @ y / w.sum(), (y * w[:, None]).T @ y)
    got = linalg.two_way_means(cohorts, 5)
    for c in cohorts:
        own = [(i, u[1]) for i, u in enumerate(units) if str(u[0]) == c]
        alpha = sum(w * beta[i] for i, w in own) / sum(w for _, w in own)
        assert np.allclose(got[c], alpha + beta[40:], atol=1e-9)


def test_unconnected_outcomes_and_short_cohorts_are_null(spark):
    rows = [(i, t, float(i + len(t))) for i in range(6) for t in (("a", "b") if i < 3 else ("c", "d"))]
    p = panel.build(cells(spark, rows), 2, 2)
    got = {(r["cohort_key"], r["outcome"]): r["outcome_mean"] for r in estimators.means(p, ["twfe_clustered"]).collect()}
    assert got["a; b", "c"] is None and got["a; b", "a"] is not None
    assert all(r["outcome_mean"] is None for r in estimators.means(p, ["apm_rank_3"]).collect())


def test_panel_thresholds_weights_and_nulls(spark):
    rows = [(1, "a", 1.0), (1, "b", 2.0), (2, "a", 3.0), (2, "b", 4.0), (3, "a", 5.0), (4, "a", 1.0), (4, "c", 1.0), (5, None, 1.0), (None, "a", 1.0), (2, "z", None)]
    p = panel.build(cells(spark, rows), 2, 2)
    assert {(r["unit"], r["cohort_key"], r["weight"]) for r in p.units.collect()} == {(1, "a; b", 0.5), (2, "a; b", 0.5)}
    q = p.reweighted(spark.createDataFrame([(1, 3.0)], "unit bigint, weight double"))
    assert [tuple(r) for r in q.units.select("unit", "weight").collect()] == [(1, 3.0)] and q.data.count() == 2
    left = p.without("a; b", "b")
    assert left.data.count() == 2 and left.units.count() == 2
    assert panel.build(cells(spark, []), 2, 2).units.count() == 0


def test_left_out_statistics_equal_rebuilt_panel(spark):
    rows, _ = factor_rows("factor", [(0, 4), (1, 8), (4, 9)], 9)
    p = panel.build(cells(spark, rows), 2, 10)
    key, t = "t1; t2; t3; t4; t5; t6; t7", "t3"
    outcomes, cohorts = linalg.from_rows(panel.moments(p).toPandas())
    edited = {**cohorts, key: cohorts[key].without(outcomes.index(t))}
    _, rebuilt = linalg.from_rows(panel.moments(p.without(key, t)).toPandas())
    assert np.allclose(linalg.factor_means(edited, 9, 2)[key], linalg.factor_means(rebuilt, 9, 2)[key])


def test_components_ties_and_unreached(spark):
    o = spark.createDataFrame([(k, t) for k in ("a; b", "b; c", "x; y", "y; z") for t in k.split("; ")], "cohort_key string, outcome string")
    assert {tuple(r) for r in graph.components(o, 1).collect()} == {("a; b", "a; b"), ("b; c", "a; b"), ("x; y", "x; y"), ("y; z", "x; y")}
    assert {r[0] for r in graph.identified_outcomes(o, 1).collect()} == {"a", "b", "c"}
    d = {(r[0], r[1]): r[2] for r in graph.hop_distances(o, 1).collect()}
    assert d["a; b", "a"] == 0 and d["a; b", "c"] == 1 and d["a; b", "x"] is None
    assert {r[0] for r in graph.components(o, 3).select("component").collect()} == {"a; b", "b; c", "x; y", "y; z"}


def test_bootstrap_weights_and_intervals(spark):
    p = panel.build(cells(spark, [(i, t, float(i % 7)) for i in range(30) for t in "ab"]), 2, 2)
    w = estimators.bayesian_weights(p, 3)
    assert all(abs(r[1] - 1) < 1e-9 for r in w.groupBy("b").sum("weight").collect())
    points = spark.createDataFrame([("p", 1.0), ("q", 2.0)], "parameter string, estimate double")
    sims = spark.createDataFrame([(b, "p", 1.0) for b in range(5)] + [(b, "q", 2.0 + b / 10) for b in range(5)] + [(9, "q", float("nan")), (10, "q", None)], "b int, parameter string, sim_estimate double")
    out = {r["parameter"]: r for r in estimators.intervals(points, sims, 4).collect()}
    assert out["p"]["sigma"] == 0 and out["p"]["crit_val"] == 0 and out["p"]["ci_lower"] == 1.0
    assert out["q"]["ci_lower"] < 2 < out["q"]["ci_upper"]


def test_prep_edges(spark):
    e = spark.createDataFrame([(1, 10, 2000, 5, 25, 100.0, "ZZ"), (1, 10, 2001, 0, 0, 9.0, None), (2, 11, 2000, 4, 20, None, None), (3, None, 2000, 1, 5, 5.0, ""), (4, 99, 2000, 1, 5, 5.0, "PD")], "worker bigint, firm bigint, year bigint, paid_weeks bigint, paid_days bigint, earnings double, province string")
    f = spark.createDataFrame([(10, "PD"), (11, None)], "firm bigint, province string")
    assert [r["worker"] for r in prep.match_data(e, f, 1990, 2001, tables.PROVINCES).collect()] == [1]
    assert sorted(r["worker"] for r in prep.match_data(e, f, 1990, 2001, None).collect()) == [1, 2, 3, 4]
    avg = prep.avg_weekly_earnings(e, ["worker"]).collect()
    assert {r[0]: r[1] for r in avg} == {1: 109 / 5, 3: 5.0, 4: 5.0}
    b = prep.year_bins(spark.createDataFrame([(1995,), (1998,), (1999,)], "year bigint"), 4)
    assert [r[1] for r in b.orderBy("year").collect()] == [1995, 1995, 1999]
    m = spark.createDataFrame([(1, 1, 0), (1, 1, 4), (2, 1, 0), (1, 2, 0), (None, 1, 0)], "worker bigint, firm bigint, year_cluster bigint")
    assert sorted(tuple(r) for r in prep.always_present(m).collect()) == [(1, 1, 0), (1, 1, 4)]


def test_quantiles_and_clusters(spark):
    rng = np.random.default_rng(0)
    x = np.r_[rng.normal(size=500), [1.5] * 300]
    got = quantiles(spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double"), "v", clusters.GRID)
    assert np.allclose(got, np.quantile(x, clusters.GRID))
    assert quantiles(spark.createDataFrame([], "v double"), "v", [0.5]) == []
    rows = [(f"p{i % 2}", i, float(v)) for i in range(20) for v in rng.normal(10 if i < 10 else 20, 1, 8)] + [("q", 99, 5.0)]
    df = spark.createDataFrame(rows, "province string, firm bigint, wage double")
    d = clusters.group_distributions(df, ["firm", "province"], "wage", clusters.wage_grid(df, "wage"))
    vectors = clusters.distribution_vectors(d, ["firm", "province"])
    got = clusters.cluster(vectors, ["province"], [1, 2]).collect()
    out = {r["firm"]: r["cluster"] for r in got if r["num_clusters"] == 2}
    assert {r["cluster"] for r in got if r["num_clusters"] == 1} == {1} and len(got) == 42
    assert {out[i] for i in range(10)} == {2} and {out[i] for i in range(10, 20)} == {1} and out[99] == 1
    assert clusters.cluster(vectors, [], [2]).count() == 21
    assert clusters.cluster(vectors.limit(0), ["province"], [2]).count() == 0


def test_clusters_that_do_not_converge_are_reported(spark, monkeypatch):
    monkeypatch.setattr(clusters, "STEPS", 1)
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, "p", [float(v) for v in np.sort(rng.random(5))], 1) for i in range(30)], "firm bigint, province string, cdf array<double>, num_workers bigint")
    with pytest.warns(UserWarning):
        clusters.cluster(df, ["province"], [3])


def test_grid_of_clusterings(spark):
    """Bins that don't fit are left out; firms that miss a year cluster are; only the first year cluster's wages decide."""
    rng = np.random.default_rng(2)
    rows = [(w, f, y, 10, float(10 * np.exp(rng.normal(5 + f % 2 * (y < 2000), 0.05))), "PD") for f in range(6) for w in range(f * 10, f * 10 + 8) for y in range(1998, 2002)] + [(900, 77, 1998, 10, 10.0, "PD")]
    df = spark.createDataFrame(rows, "worker bigint, firm bigint, year bigint, paid_weeks bigint, earnings double, province string")
    got = clusters.clusterings(lambda first: df.where(f"year >= {first}"), [1998, 2001], [1, 2, 3], [1, 2], 2001).collect()
    assert {(r["start_year"], r["year_cluster_size"], r["num_clusters"]) for r in got} == {(1998, n, k) for n in (1, 2, 3) for k in (1, 2)} | {(2001, 1, k) for k in (1, 2)}
    assert {r["firm"]: r["firm_type"] for r in got if r["start_year"] == 1998 and r["year_cluster_size"] == 2 and r["num_clusters"] == 2} == {f: 2 - f % 2 for f in range(6)}


def test_replicate_moments_equal_weighted_ones(spark):
    """Of panels whose cells come in any order, through several batches."""
    rng = np.random.default_rng(5)
    rows = [(i, t, float(rng.normal())) for i in range(60) for t in rng.permutation(list("abc" if i % 3 else "bd")).tolist()]
    p = panel.build(cells(spark, rows).repartition(3), 2, 2)
    weights = estimators.bayesian_weights(p, 2)
    got = {(r["b"], r["cohort_key"], r["t"], r["s"]): r for r in panel.replicate_moments(p, 2).collect()}
    for b in (1, 2):
        q = p.reweighted(weights.where(f"b = {b}"))
        want = panel.moments(q).collect()
        assert len(want) * 2 == len(got)
        scale = sum(got[b, r["cohort_key"], r["t"], r["s"]]["w"] for r in want) / sum(r["w"] for r in want)
        for r in want:
            x = got[b, r["cohort_key"], r["t"], r["s"]]
            assert abs(x["second"] - scale * r["second"]) < 1e-9 * scale and (r["mean"] is None or abs(x["mean"] - r["mean"]) < 1e-9)


def test_left_out_means_against_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = [(i, t, float(rng.normal(ord(t)))) for i in range(60) for t in ("abc" if i % 3 else "bd")]
    p = panel.build(cells(spark, rows), 2, 2)
    got = {(r["b"], r["cohort_key"], r["outcome"], r["est_name"]): r["boot_outcome_mean"] for r in estimators.left_out_means(p, 1).collect()}
    e = {r["unit"]: r["weight"] for r in estimators.bayesian_weights(p, 1).collect()}
    mean = lambda keep, t: sum(e[i] * v for i, s, v in rows if s == t and keep(i)) / sum(e[i] for i, s, v in rows if s == t and keep(i))
    assert got == {}, got  # only b is shared, so that no cohort has another outcome that others have
    rows += [(i, "c", float(rng.normal(99))) for i in range(0, 60, 3)]
    got = {(r["b"], r["cohort_key"], r["outcome"], r["est_name"]): r["boot_outcome_mean"] for r in estimators.left_out_means(panel.build(cells(spark, rows), 2, 2), 1).collect()}
    full, few = (lambda i: i % 3 > 0), (lambda i: i % 3 == 0)
    assert abs(got[1, "b; c; d", "b", "others"] - mean(full, "b")) < 1e-9
    assert abs(got[1, "b; c; d", "b", "shifted"] - (mean(full, "b") + mean(few, "c") - mean(full, "c"))) < 1e-9


def test_estimators_of_ones_own(spark):
    rows, truth = factor_rows("factor", [(0, 4), (1, 8), (4, 9)], 9)
    p = panel.build(cells(spark, rows), 3, 10)
    _, cohorts = linalg.from_rows(panel.moments(p).toPandas())
    first = sorted(cohorts)[0]
    own = {"mine": lambda c, n: linalg.two_way_residual_means(c, n, lambda d, k: {key: np.zeros(k) for key in d}), "ranks": lambda c, n: linalg.factor_means(c, n, 2, lambda x: linalg.cohort_factors(x, 3), set(c) - {first})}
    got = {(r["est_name"], r["cohort_key"], r["outcome"]): r["outcome_mean"] for r in estimators.means(p, ["twfe_clustered"], own=own).collect()}
    assert len(got) == 3 * len(cohorts) * 9
    assert all(got["mine", k, t] == got["twfe_clustered", k, t] for n, k, t in got if n == "mine")
    assert p.only(first).units.select("cohort_key").distinct().collect()[0][0] == first
    assert estimators.leave_one_out(p, ["twfe_clustered"], 3).count() == 3 * len(estimators.left_out_cells(p))


class _Reweighted(estimators.DataGeneratingProcess):
    def __init__(self, p):
        self.panel = p

    def draw(self, b):
        return self.panel.reweighted(self.panel.units.selectExpr("unit", f"CAST({b} AS DOUBLE) AS weight"))


def test_simulation_with_a_process_of_ones_own(spark):
    p = panel.build(cells(spark, [(i, t, float(i)) for i in range(6) for t in "ab"]), 2, 2)
    label = lambda q: panel.cohort_means(q).selectExpr("outcome AS parameter", "outcome_mean AS estimate")
    got = estimators.simulate(_Reweighted(p), {"mean": label}, 3).collect()
    assert {(r["b"], r["parameter"], r["sim_estimate"]) for r in got} == {(b, t, 2.5) for b in (1, 2, 3) for t in "ab"}
    one = estimators.BayesianBootstrap(p, 4).draw(2)
    assert abs(one.units.agg({"weight": "sum"}).first()[0] - 1) < 1e-9


def test_reports_edges(spark):
    s = spark.createDataFrame([(1, 3, 1), (2, 3, 1), (3, 99, 101), (4, 99, 101), (4, 99, 101), (5, None, 2), (6, 1, 4), (7, 1, 4), (8, 3, 5), (9, 3, 5)], "rider_id bigint, first_week_id bigint, treatment_week_id bigint")
    assert sorted(r["week"] for r in reports.spell_weeks(s.where("rider_id = 1")).collect()) == [1, 2, 3]
    c = reports.spell_cohorts(s, 2)
    assert {r["cohort"] for r in c.collect()} == {"03 - 01", "99 - 101", "01 - 04", "03 - 05"}
    assert {tuple(r) for r in reports.spell_overlaps(c).where("cohort_l < cohort_r").collect()} == {("01 - 04", "03 - 05", 1)}


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1990, 4, 3, 7, "PD")], "start_year bigint, year_cluster_size bigint, num_clusters bigint, firm bigint, province string")
    tables.write_parquet(df, str(tmp_path / "c"), ["start_year", "year_cluster_size", "num_clusters"])
    assert spark.read.parquet(str(tmp_path / "c")).where("start_year = 1990").count() == 1
    tables.write_csv(df, str(tmp_path / "d"))
    back = tables.read_csv(spark, str(tmp_path / "d"), "start_year bigint, year_cluster_size bigint, num_clusters bigint, firm bigint, province string")
    assert back.collect() == df.collect()
    assert tables.unfinished(df, back, ["firm"]).count() == 0


def test_cohorts_and_weights_that_come_with_the_data(spark):
    rows = [(1, "a", 1.0, 2.0), (1, "b", 2.0, 2.0), (2, "a", 3.0, 5.0), (2, "b", 3.0, 5.0), (3, "a", 1.0, None), (3, "b", 1.0, None)]
    df = spark.createDataFrame(rows, "unit bigint, outcome string, value double, w double")
    sets = spark.createDataFrame([(1, ["z", "a", "b"]), (2, ["b", "a", "z", "a"]), (9, ["a", "b", "z"]), (3, None)], "unit bigint, cohort array<string>")
    p = panel.build(df, 3, 2, cohorts=sets)
    assert {(r["unit"], r["cohort_key"], r["weight"]) for r in p.units.collect()} == {(1, "a; b; z", 0.5), (2, "a; b; z", 0.5)}
    assert {(r["unit"], r["weight"]) for r in panel.build(df, 2, 2, weight_column="w").units.collect()} == {(1, 2.0), (2, 5.0)}


def test_report_of_counts(spark, caplog):
    df = spark.createDataFrame([(1, 1, "PD"), (1, 2, "PD"), (2, 2, "VE"), (3, None, None)], "worker bigint, firm bigint, province string")
    with caplog.at_level("INFO"):
        assert prep.log_counts(df) == [(None, 4, 2, 3), ("PD", 2, 2, 1), ("VE", 1, 1, 1)]
    assert "all: 4 records of 2 firms and 3 workers" in caplog.text


def test_stata_files_in_chunks(spark, tmp_path):
    import pandas as pd

    df = pd.DataFrame({"matr_az": np.arange(7), "prov": list("abcdefg")})
    df.to_stata(str(tmp_path / "x.dta"), write_index=False)
    tables.stata_to_parquet(spark, str(tmp_path / "x.dta"), str(tmp_path / "x"), 3)
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "x")).collect()) == list(zip(range(7), "abcdefg", strict=True))


def test_resuming_leaves_what_is_not_done(spark):
    work = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "cohort_key string, outcome string")
    done = spark.createDataFrame([("a", "x"), ("a", "x")], "cohort_key string, outcome string")
    assert {tuple(r) for r in tables.unfinished(work, done, ["cohort_key", "outcome"]).collect()} == {("a", "y"), ("b", "x")}


@pytest.mark.parametrize("name", ["twfe_clustered", "apm_rank_1", "apm_rank_2", "twfe_apm_rank_1"])
def test_left_out_estimates_equal_those_of_edited_cohorts(spark, name):
    rows, _ = factor_rows("factor", [(0, 4), (1, 8), (4, 9)], 9)
    _, cohorts = linalg.from_rows(panel.moments(panel.build(cells(spark, rows), 2, 10)).toPandas())
    spots = [(k, t) for k, c in cohorts.items() for t in c.at.tolist()]
    want = [linalg.estimate(name, cohorts | {k: cohorts[k].without(t)}, 9)[k][t] for k, t in spots]
    assert np.allclose(linalg.left_out(name, cohorts, 9, spots), want, equal_nan=True)
