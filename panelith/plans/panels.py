"""Queries of the panel operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clusters, coverage, estimators, graph, panel, prep, reports
from ..operators.panel import Panel
from ..session import cut, table, union_all
from ..sources import tables

FIRST, LAST, BIN = 1990, 2001, 4
MIN_OUTCOMES, MIN_UNITS, REPLICATES = 2, 20, 100


def _matches(spark: SparkSession, d: str, first: int = FIRST) -> DataFrame:
    return prep.match_data(tables.earnings(spark, f"{d}/earnings.parquet"), tables.firms(spark, f"{d}/firms.parquet"), first, LAST, tables.PROVINCES)


def _binned(spark: SparkSession, d: str, first: int = FIRST, size: int = BIN) -> DataFrame:
    return prep.year_bins(_matches(spark, d, first), size)


def _present(spark: SparkSession, d: str, first: int = FIRST, size: int = BIN) -> DataFrame:
    return prep.always_present(_binned(spark, d, first, size))


def _typed_cells(present: DataFrame, clusters_found: DataFrame, first: int, size: int, k: int) -> DataFrame:
    """Cells of the panel of workers by type, province and year cluster of their firms; repeated rows of clusters count once."""
    c = clusters_found.where((F.col("start_year") == first) & (F.col("year_cluster_size") == size) & (F.col("num_clusters") == k) & F.col("province").isNotNull())
    types = c.groupBy(F.col("firm").alias("_k"), F.col("province").alias("_p")).agg(F.min("firm_type").alias("firm_type"))
    typed = prep.skew_join(present, types, "firm", "inner", F.col("province") == F.col("_p"), once=True)
    avg = prep.avg_weekly_earnings(typed, ["worker", "firm_type", "province", "year_cluster"])
    return prep.log_cells(avg, "worker", prep.outcome_label("firm_type", "province", "year_cluster"))


def _cells(spark: SparkSession, d: str, first: int = FIRST, size: int = BIN, k: int = 3) -> DataFrame:
    return _typed_cells(_present(spark, d, first, size), table(spark, d, "firm_clusters"), first, size, k)


def _flag(spark: SparkSession, d: str) -> Panel:
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("unit"), F.concat("l_returnflag", "l_linestatus").alias("outcome"), F.ln("l_extendedprice").alias("v"))
    return panel.build(rows.groupBy("unit", "outcome").agg(F.avg("v").alias("value")), MIN_OUTCOMES, MIN_UNITS)


def _years(spark: SparkSession, d: str) -> Panel:
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("unit"), F.year("l_shipdate").cast("string").alias("outcome"), F.ln("l_extendedprice").alias("v"))
    return panel.build(rows.groupBy("unit", "outcome").agg(F.avg("v").alias("value")), MIN_OUTCOMES, MIN_UNITS)


def _r(*names: str) -> list:
    return [F.round(c, 6).alias(c) for c in names]


def match_filter(spark: SparkSession, d: str) -> DataFrame:
    return _matches(spark, d).select("worker", "firm", "year", "paid_weeks", "earnings", "province")


def year_bins(spark: SparkSession, d: str) -> DataFrame:
    return _binned(spark, d).groupBy("year", "year_cluster").agg(F.count(F.lit(1)).alias("n_records"))


def always_present(spark: SparkSession, d: str) -> DataFrame:
    return _present(spark, d).groupBy("worker", "firm", "year_cluster").agg(F.count(F.lit(1)).alias("n_records"))


def avg_weekly_earnings(spark: SparkSession, d: str) -> DataFrame:
    return prep.avg_weekly_earnings(_binned(spark, d), ["worker", "firm", "year_cluster"])


def counts_by_province(spark: SparkSession, d: str) -> DataFrame:
    return _matches(spark, d).groupBy("province").agg(F.count_distinct("firm").alias("n_firms"), F.count_distinct("worker").alias("n_workers"), F.count(F.lit(1)).alias("n_records"))


def outcome_labels(spark: SparkSession, d: str) -> DataFrame:
    out = _cells(spark, d).groupBy("outcome").agg(F.count(F.lit(1)).alias("n_cells"))
    part = F.split("outcome", "_")
    return out.select("outcome", part[0].cast("bigint").alias("firm_type"), part[1].alias("province"), part[2].cast("bigint").alias("year_cluster"), "n_cells")


def log_earnings(spark: SparkSession, d: str) -> DataFrame:
    return _cells(spark, d).select("unit", "outcome", *_r("value"))


def worker_cohort_sizes(spark: SparkSession, d: str) -> DataFrame:
    return panel.build(_cells(spark, d), MIN_OUTCOMES, 5).cohort_sizes()


def groups_observed_hist(spark: SparkSession, d: str) -> DataFrame:
    return _cells(spark, d).groupBy("unit").agg(F.count(F.lit(1)).alias("n_outcomes")).groupBy("n_outcomes").agg(F.count(F.lit(1)).alias("n_units"))


#: min_outcomes, min_units and rank of the coverage report.
GRID = [(MIN_OUTCOMES, n, r) for n in (5, 10) for r in (1, 2)]


def _coverage(spark: SparkSession, d: str) -> DataFrame:
    """Cluster sizes over the grid for every clustering in the table firm_clusters."""
    found, parts = table(spark, d, "firm_clusters"), []
    settings = sorted(tuple(r) for r in found.select("start_year", "year_cluster_size", "num_clusters").dropna("any").distinct().collect())
    for first, size in sorted({x[:2] for x in settings}):
        present = cut(_present(spark, d, first, size))
        for k in [x[2] for x in settings if x[:2] == (first, size)]:
            sizes = coverage.over_grid(cut(_typed_cells(present, found, first, size, k)), GRID)
            parts.append(sizes.select(*[F.lit(v).cast("bigint").alias(c) for c, v in (("start_year", first), ("year_cluster_size", size), ("num_clusters", k))], "*"))
    return union_all(parts)


def panel_cluster_sizes(spark: SparkSession, d: str) -> DataFrame:
    out = _coverage(spark, d)
    return out.select(*out.columns[:-2], *_r("share_workers", "share_workers_panel"))


def panel_coverage(spark: SparkSession, d: str) -> DataFrame:
    out = coverage.summary(_coverage(spark, d), ["start_year", "year_cluster_size", "num_clusters"])
    return out.select(*[F.round(c, 6).alias(c) if "share" in c else c for c in out.columns])


def unit_cohorts(spark: SparkSession, d: str) -> DataFrame:
    return _flag(spark, d).units.select("unit", "cohort_key")


def cohort_sizes(spark: SparkSession, d: str) -> DataFrame:
    return _flag(spark, d).cohort_sizes()


def panel_build(spark: SparkSession, d: str) -> DataFrame:
    return _flag(spark, d).cells().select("unit", "outcome", "cohort_key", *_r("value"))


def unit_weights_default(spark: SparkSession, d: str) -> DataFrame:
    return _flag(spark, d).units.select("unit", F.round("weight", 12).alias("weight"))


def panel_reweighted(spark: SparkSession, d: str) -> DataFrame:
    p = _flag(spark, d)
    q = p.reweighted(p.units.select("unit", (F.col("unit") % 7 + 1).cast("double").alias("weight")))
    return panel.cohort_means(q).select("cohort_key", "outcome", *_r("outcome_mean"))


def panel_identified(spark: SparkSession, d: str) -> DataFrame:
    return graph.identified_panel(_years(spark, d), 2).cohort_sizes()


def panel_left_out(spark: SparkSession, d: str) -> DataFrame:
    p = _flag(spark, d)
    return p.without("AF; RF", "RF").data.groupBy("outcome").agg(F.count(F.lit(1)).alias("n_cells"))


def cohort_outcome_means(spark: SparkSession, d: str) -> DataFrame:
    return panel.cohort_means(_flag(spark, d), weighted=False).select("cohort_key", "outcome", *_r("outcome_mean"))


def cohort_weighted_means(spark: SparkSession, d: str) -> DataFrame:
    return panel.cohort_means(_flag(spark, d)).select("cohort_key", "outcome", *_r("outcome_mean"))


def cohort_demeaned(spark: SparkSession, d: str) -> DataFrame:
    return panel.demeaned(_flag(spark, d)).select("unit", "cohort_key", "outcome", *_r("value"))


def cohort_moments(spark: SparkSession, d: str) -> DataFrame:
    return panel.moments(_flag(spark, d)).select("cohort_key", "t", "s", *_r("w", "second"))


def overlap_edges_r1(spark: SparkSession, d: str) -> DataFrame:
    return graph.overlap_edges(graph.cohort_outcomes(_years(spark, d)), 1)


def overlap_edges_r2(spark: SparkSession, d: str) -> DataFrame:
    return graph.overlap_edges(graph.cohort_outcomes(_years(spark, d)), 2)


def overlap_components(spark: SparkSession, d: str) -> DataFrame:
    return graph.components(graph.cohort_outcomes(_years(spark, d)), 2)


def identified_outcomes_r1(spark: SparkSession, d: str) -> DataFrame:
    return graph.identified_outcomes(graph.cohort_outcomes(_years(spark, d)), 1)


def identified_outcomes_r2(spark: SparkSession, d: str) -> DataFrame:
    return graph.identified_outcomes(graph.cohort_outcomes(_years(spark, d)), 2)


def outcome_hop_distances(spark: SparkSession, d: str) -> DataFrame:
    return graph.hop_distances(graph.cohort_outcomes(_years(spark, d)), 1)


#: Start year and bin size of the wage distributions and clusters: those of the final panel.
START, SIZE = 1998, 2
WAGE_GROUP = ["year_cluster", "firm", "province"]


def _wages(spark: SparkSession, d: str) -> DataFrame:
    return cut(prep.avg_weekly_earnings(_present(spark, d, START, SIZE), ["worker", *WAGE_GROUP]))


def wage_quantile_grid(spark: SparkSession, d: str) -> DataFrame:
    grid = clusters.wage_grid(_wages(spark, d), "avg_weekly_earnings")
    return spark.createDataFrame(list(enumerate(grid)), "grid_idx bigint, q double").select("grid_idx", *_r("q"))


def group_wage_cdf(spark: SparkSession, d: str) -> DataFrame:
    w = _wages(spark, d)
    out = clusters.group_distributions(w, WAGE_GROUP, "avg_weekly_earnings", clusters.wage_grid(w, "avg_weekly_earnings"))
    return out.select(*WAGE_GROUP, F.col("grid_idx").cast("bigint").alias("grid_idx"), "num_workers", *_r("cdf"))


def wage_cdf_wide(spark: SparkSession, d: str) -> DataFrame:
    """A column for some points of the grid, of the first year cluster, which firms are clustered by."""
    at = [0, 24, 49, 74, 99]
    first = group_wage_cdf(spark, d).where((F.col("year_cluster") == START) & F.col("grid_idx").isin(at))
    return first.groupBy("firm", "province", "num_workers").pivot("grid_idx", at).agg(F.first("cdf")).na.fill(0.0).withColumnsRenamed({str(k): f"q{k}" for k in at})


def firm_clusters(spark: SparkSession, d: str) -> DataFrame:
    """The final panel's setting, for every number of clusters of the grid."""
    return clusters.clusterings(lambda first: _matches(spark, d, first), [START], [SIZE], [1, 2, 3, 4, 5], LAST)


def cohort_spectra(spark: SparkSession, d: str) -> DataFrame:
    return estimators.spectra(_flag(spark, d)).select("cohort_key", "cohort_size", "spectrum_idx", *_r("eigenvalue"))


def spectra_trace(spark: SparkSession, d: str) -> DataFrame:
    return estimators.spectra(_flag(spark, d)).groupBy("cohort_key", "cohort_size").agg(F.round(F.sum("eigenvalue"), 5).alias("trace"))


def spectra_norm(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("eigenvalue")
    return estimators.spectra(_flag(spark, d)).groupBy("cohort_key").agg(F.round(F.sqrt(F.sum(e * e)), 5).alias("norm"))


def _means(spark: SparkSession, d: str, *names: str) -> DataFrame:
    return estimators.means(_flag(spark, d), list(names)).select("est_name", "cohort_key", "outcome", *_r("outcome_mean"))


def twfe_means(spark: SparkSession, d: str) -> DataFrame:
    return _means(spark, d, "twfe_clustered").drop("est_name")


def twfe_resid_apm(spark: SparkSession, d: str) -> DataFrame:
    return _means(spark, d, "twfe_apm_rank_1")


def apm_rank1_means(spark: SparkSession, d: str) -> DataFrame:
    return _means(spark, d, "apm_rank_1", "apm_demeaned_rank_1")


def bayes_weights(spark: SparkSession, d: str) -> DataFrame:
    return estimators.bayesian_weights(_flag(spark, d), 3).select("unit", "b", F.round(F.col("weight") * 1e6, 6).alias("weight"))


def _boot(spark: SparkSession, d: str) -> tuple[Panel, DataFrame]:
    p = _flag(spark, d)
    return p, estimators.observed_means(p, REPLICATES)


def bootstrap_obs_means(spark: SparkSession, d: str) -> DataFrame:
    return _boot(spark, d)[1].select("b", "cohort_key", "outcome", *_r("outcome_mean"))


def _intervals(spark: SparkSession, d: str) -> DataFrame:
    p, sims = _boot(spark, d)
    label = F.concat("cohort_key", F.lit(" -> "), "outcome").alias("parameter")
    points = panel.cohort_means(p).select(label, F.col("outcome_mean").alias("estimate"))
    return estimators.intervals(points, sims.select("b", label, F.col("outcome_mean").alias("sim_estimate")), p.units.count())


def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    return _intervals(spark, d).select("parameter", *[F.round(c, 5).alias(c) for c in ("point_est", "ci_lower", "ci_upper", "sigma", "crit_val")])


def sup_t_band(spark: SparkSession, d: str) -> DataFrame:
    return _intervals(spark, d).select("parameter", *[F.round(c, 5).alias(c) for c in ("point_est", "sup_cb_lower", "sup_cb_upper")])


def bootstrap_twfe_ci(spark: SparkSession, d: str) -> DataFrame:
    return estimators.bayesian_bootstrap(_flag(spark, d), "twfe_clustered", REPLICATES)


def loo_candidates(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(estimators.left_out_cells(_flag(spark, d)), "cohort_key string, cohort_size bigint, outcome string")


def loo_sim_ests(spark: SparkSession, d: str) -> DataFrame:
    return estimators.leave_one_out(_flag(spark, d), ["twfe_clustered", "apm_rank_1"], REPLICATES)


def _sims(spark: SparkSession, d: str) -> DataFrame:
    return estimators.left_out_means(_flag(spark, d), REPLICATES)


def _pipeline_sims(spark: SparkSession, d: str) -> DataFrame:
    """From records, firms and their clusters to the panel of identified outcomes, and each cell that can be left out estimated without it."""
    p = panel.build(cut(_cells(spark, d, START, SIZE)), MIN_OUTCOMES, MIN_UNITS)
    return estimators.leave_one_out(graph.identified_panel(p, 2), ["twfe_clustered", "apm_rank_1"], REPLICATES)


def pipeline_err_stats(spark: SparkSession, d: str) -> DataFrame:
    return estimators.error_stats(_pipeline_sims(spark, d))


def pipeline_err_summaries(spark: SparkSession, d: str) -> DataFrame:
    return estimators.error_summaries(estimators.against_baseline(estimators.error_stats(_pipeline_sims(spark, d)), "twfe_clustered"))


def loo_err_stats(spark: SparkSession, d: str) -> DataFrame:
    return estimators.error_stats(loo_sim_ests(spark, d))


def err_stats(spark: SparkSession, d: str) -> DataFrame:
    return estimators.error_stats(_sims(spark, d)).select("est_name", "cohort_key", "cohort_size", "outcome", "err_stat", *_r("value"))


def _compared(spark: SparkSession, d: str) -> DataFrame:
    return estimators.against_baseline(estimators.error_stats(_sims(spark, d)), "others")


def err_stats_vs_baseline(spark: SparkSession, d: str) -> DataFrame:
    return _compared(spark, d).select("est_name", "cohort_key", "outcome", "err_stat", *_r("value_diff"), F.round("value_ratio", 4).alias("value_ratio"))


def err_stat_summaries(spark: SparkSession, d: str) -> DataFrame:
    out = estimators.error_summaries(_compared(spark, d))
    return out.select("est_name", "err_stat", "n", *[F.round(c, 4).alias(c) for c in out.columns[3:]])


def rel_err_cdf(spark: SparkSession, d: str) -> DataFrame:
    out = estimators.ratio_distribution(_compared(spark, d))
    return out.select("est_name", "err_stat", "cohort_key", "outcome", F.round("value_ratio", 4).alias("value_ratio"), *_r("share_cells", "share_units"))


def cohort_rectangles(spark: SparkSession, d: str) -> DataFrame:
    return reports.cohort_rectangles(_flag(spark, d))


def eigengap_dist(spark: SparkSession, d: str) -> DataFrame:
    return reports.eigengaps(estimators.spectra(_flag(spark, d)))


def hop_reach_dist(spark: SparkSession, d: str) -> DataFrame:
    p = _years(spark, d)
    return reports.hop_reach(graph.hop_distances(graph.cohort_outcomes(p), 1), p.cohort_sizes()).select("hops", "reached", "n_cohorts", "n_units", *_r("share_cohorts", "share_units"))


def overlap_graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return reports.sharing_edges(graph.cohort_outcomes(_years(spark, d)))


def block_missing_nonid(spark: SparkSession, d: str) -> DataFrame:
    """Firms as units, the types they are found to have as outcomes: types of other provinces are never reached."""
    rows = table(spark, d, "firm_clusters").where("province IS NOT NULL").select(F.col("firm").alias("unit"), F.concat("province", F.lit("_"), F.col("firm_type").cast("string")).alias("outcome")).distinct()
    return reports.not_reached_in_two_steps(cut(graph.cohort_outcomes(panel.build(rows.withColumn("value", F.lit(1.0)), 1, 5))))


def rider_panel_expand(spark: SparkSession, d: str) -> DataFrame:
    return reports.spell_weeks(table(spark, d, "rider_spells"))


def rider_panel_cohorts(spark: SparkSession, d: str) -> DataFrame:
    return reports.spell_panel(table(spark, d, "rider_spells"), 2)


def highlighted_missing_cells(spark: SparkSession, d: str) -> DataFrame:
    p = _years(spark, d)
    every = reports.cohort_rectangles(p)
    first = every.orderBy("unit_id_min", "cohort_key").first()
    missing = p.data.select("outcome").distinct().join(every.where(F.col("cohort_key") == (first[0] if first else "")).select("outcome"), "outcome", "left_anti").withColumn("cohort_key", F.lit(first[0] if first else ""))
    return reports.highlighted_cells(every, missing, first[0] if first else "")


def rider_cohorts(spark: SparkSession, d: str) -> DataFrame:
    return reports.spell_cohorts(table(spark, d, "rider_spells"), 2).select("cohort", "n_riders")


def rider_overlap_edges(spark: SparkSession, d: str) -> DataFrame:
    return reports.spell_overlaps(reports.spell_cohorts(table(spark, d, "rider_spells"), 2))


QUERIES = {f.__name__: f for f in (
    match_filter, year_bins, always_present, avg_weekly_earnings, counts_by_province, outcome_labels, log_earnings, worker_cohort_sizes, groups_observed_hist, panel_cluster_sizes, panel_coverage, unit_cohorts, cohort_sizes, panel_build,
    unit_weights_default, panel_reweighted, panel_identified, panel_left_out, cohort_outcome_means, cohort_weighted_means, cohort_demeaned, cohort_moments, overlap_edges_r1, overlap_edges_r2, overlap_components, identified_outcomes_r1,
    identified_outcomes_r2, outcome_hop_distances, wage_quantile_grid, group_wage_cdf, wage_cdf_wide, firm_clusters, cohort_spectra, spectra_trace, spectra_norm, twfe_means, twfe_resid_apm, apm_rank1_means, bayes_weights, bootstrap_obs_means,
    bootstrap_ci, sup_t_band, bootstrap_twfe_ci, loo_candidates, loo_sim_ests, loo_err_stats, pipeline_err_stats, pipeline_err_summaries, err_stats, err_stats_vs_baseline, err_stat_summaries, rel_err_cdf, cohort_rectangles, eigengap_dist, hop_reach_dist, overlap_graph_edges,
    block_missing_nonid, rider_panel_expand, rider_panel_cohorts, highlighted_missing_cells, rider_cohorts, rider_overlap_edges)}

_PROV = ", ".join(f"'{p}'" for p in tables.PROVINCES)


def _match(first: int = FIRST, size: int = BIN) -> str:
    return f"""f AS (SELECT matr_az AS firm, nullif(arg_max(p, (loaded_at, p, coalesce(cap, -1))), '') AS province FROM (SELECT matr_az, cap, coalesce(upper(trim(prov)), '') AS p, loaded_at FROM firms WHERE matr_az IS NOT NULL) GROUP BY 1),
m AS (SELECT cod_pgr AS worker, e.matr_az AS firm, anno AS year, sett_r AS paid_weeks, retrib03 AS earnings, f.province FROM earnings e JOIN f ON f.firm = e.matr_az WHERE anno BETWEEN {first} AND {LAST} AND sett_r > 0 AND f.province IN ({_PROV})),
b AS (SELECT *, CAST((SELECT min(year) FROM m) + floor((year - (SELECT min(year) FROM m)) / {size}.0) * {size} AS BIGINT) AS year_cluster FROM m),
t AS (SELECT count(DISTINCT year_cluster) AS n FROM b), ff AS (SELECT firm FROM b GROUP BY 1 HAVING count(DISTINCT year_cluster) = (SELECT n FROM t)), wf AS (SELECT worker FROM b WHERE worker IS NOT NULL GROUP BY 1 HAVING count(DISTINCT year_cluster) = (SELECT n FROM t)),
ap AS (SELECT * FROM b WHERE firm IN (SELECT firm FROM ff) AND worker IN (SELECT worker FROM wf))"""


def _cells_sql(first: int = FIRST, size: int = BIN, k: int = 3) -> str:
    return f"""{_match(first, size)}, ty AS (SELECT firm, province, min(firm_type) AS firm_type FROM firm_clusters WHERE start_year = {first} AND year_cluster_size = {size} AND num_clusters = {k} AND province IS NOT NULL GROUP BY 1, 2),
a AS (SELECT worker, firm_type, ap.province, year_cluster, CAST(sum(CAST(earnings AS DECIMAL(28,4))) AS DOUBLE) / sum(paid_weeks) AS v FROM ap JOIN ty ON ty.firm = ap.firm AND ty.province = ap.province WHERE firm_type IS NOT NULL GROUP BY 1, 2, 3, 4 HAVING count(*) = count(earnings)),
cells AS (SELECT worker AS unit, firm_type || '_' || province || '_' || year_cluster AS outcome, ln(v) AS value FROM a WHERE v > 0)"""


_MATCH, _CELLS = _match(), _cells_sql()


def _panel(outcome: str) -> str:
    cells = f"cells AS (SELECT l_orderkey AS unit, {outcome} AS outcome, avg(ln(l_extendedprice)) AS value FROM lineitem GROUP BY 1, 2)"
    return cells + ", " + _cohorts(MIN_UNITS)


def _cohorts(least: int, outcomes: int = MIN_OUTCOMES) -> str:
    return f"""u0 AS (SELECT unit, string_agg(outcome, '; ' ORDER BY outcome) AS cohort_key, count(*) AS k FROM cells GROUP BY unit),
c AS (SELECT cohort_key, count(*) AS n FROM u0 WHERE k >= {outcomes} GROUP BY 1 HAVING count(*) >= {least}),
units AS (SELECT unit, u0.cohort_key, n, 1.0::DOUBLE / (SELECT sum(n) FROM c)::DOUBLE AS w FROM u0 JOIN c ON c.cohort_key = u0.cohort_key),
d AS (SELECT cells.*, cohort_key, n, w FROM cells JOIN units ON units.unit = cells.unit),
co AS (SELECT DISTINCT cohort_key, outcome FROM d)"""


_FLAG, _YEARS = _panel("l_returnflag || l_linestatus"), _panel("CAST(year(l_shipdate) AS VARCHAR)")
_DIGITS = f"""wr AS (SELECT unit, b, -ln(CAST((CAST('0x' || substr(md5('0|' || b || '|' || unit), 1, 13) AS BIGINT)) AS DOUBLE) / 4503599627370496.0 + 0.5 / 4503599627370496.0) AS e FROM units, range(1, %d) t(b)),
bw AS (SELECT unit, b, e / sum(e) OVER (PARTITION BY b) AS bw FROM wr)"""
_BOOT = _FLAG + ", " + _DIGITS % (REPLICATES + 1) + ", sims AS (SELECT b, cohort_key, outcome, sum(bw * value) / sum(bw) AS v, sum(bw) AS w FROM d JOIN bw ON bw.unit = d.unit GROUP BY 1, 2, 3)"
_CI = _BOOT + """, o AS (SELECT cohort_key, outcome, sum(w * value) / sum(w) AS o FROM d GROUP BY 1, 2), nn AS (SELECT sqrt(CAST(sum(n) AS DOUBLE)) AS rn FROM c),
ro AS (SELECT b, sims.cohort_key || ' -> ' || sims.outcome AS parameter, o, rn, rn * (v - o) AS root FROM sims JOIN o ON o.cohort_key = sims.cohort_key AND o.outcome = sims.outcome, nn),
sg AS (SELECT parameter, (quantile_cont(root, 0.75) - quantile_cont(root, 0.25)) / 1.3489795003921634::DOUBLE AS sigma FROM ro GROUP BY 1),
tt AS (SELECT b, ro.parameter, o, rn, sigma, CASE WHEN root = 0 THEN 0 ELSE abs(root) / sigma END AS t FROM ro JOIN sg ON sg.parameter = ro.parameter),
cr AS (SELECT parameter, min(o) AS o, min(rn) AS rn, min(sigma) AS sigma, quantile_cont(t, 0.95) AS crit FROM tt GROUP BY 1),
su AS (SELECT quantile_cont(top, 0.95) AS sup FROM (SELECT max(t) AS top FROM tt GROUP BY b))"""
_SIMS = _BOOT + """, tr AS (SELECT cohort_key, outcome, min(n) AS cohort_size, avg(value) AS tv FROM d GROUP BY 1, 2),
lo AS (SELECT *, CASE WHEN count(*) OVER e > 1 THEN (sum(w * v) OVER e - w * v) / (sum(w) OVER e - w) END AS others FROM sims WINDOW e AS (PARTITION BY b, outcome)),
lg AS (SELECT *, v - others AS gap FROM lo WHERE others IS NOT NULL), ls AS (SELECT *, count(*) OVER c AS k, others + (sum(gap) OVER c - gap) / (count(*) OVER c - 1) AS shifted FROM lg WINDOW c AS (PARTITION BY b, cohort_key)),
si AS (SELECT b, ls.cohort_key, ls.outcome, cohort_size, tv, others AS bv, 'others' AS est_name FROM ls JOIN tr ON tr.cohort_key = ls.cohort_key AND tr.outcome = ls.outcome WHERE k > 1
 UNION ALL SELECT b, ls.cohort_key, ls.outcome, cohort_size, tv, shifted, 'shifted' FROM ls JOIN tr ON tr.cohort_key = ls.cohort_key AND tr.outcome = ls.outcome WHERE k > 1),
ww AS (SELECT est_name, cohort_key, cohort_size, outcome, abs(avg(bv - tv)) AS abs_bias, stddev_samp(bv) AS sd, sqrt(avg((bv - tv) * (bv - tv))) AS rmse FROM si GROUP BY 1, 2, 3, 4),
es AS (SELECT est_name, cohort_key, cohort_size, outcome, 'abs_bias' AS err_stat, abs_bias AS value FROM ww UNION ALL SELECT est_name, cohort_key, cohort_size, outcome, 'sd', sd FROM ww UNION ALL SELECT est_name, cohort_key, cohort_size, outcome, 'rmse', rmse FROM ww),
cm AS (SELECT x.*, y.value - x.value AS value_diff, x.value / y.value AS value_ratio FROM es x JOIN es y ON y.cohort_key = x.cohort_key AND y.outcome = x.outcome AND y.err_stat = x.err_stat WHERE x.est_name <> 'others' AND y.est_name = 'others')"""


def _edges(r: int) -> str:
    return f"ed AS (SELECT x.cohort_key AS src, y.cohort_key AS dst, count(*) AS overlap FROM co x JOIN co y ON y.outcome = x.outcome AND x.cohort_key < y.cohort_key GROUP BY 1, 2 HAVING count(*) >= {r})"


def _parts(r: int) -> str:
    return _YEARS + ", " + _edges(r) + """, be AS (SELECT src, dst FROM ed UNION ALL SELECT dst, src FROM ed), re AS (SELECT cohort_key AS src, cohort_key AS node FROM c UNION SELECT re.src, be.dst FROM re JOIN be ON be.src = re.node),
pa AS (SELECT src AS cohort_key, min(node) AS component FROM re GROUP BY 1), bp AS (SELECT component FROM pa GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1),
idn AS (SELECT DISTINCT outcome FROM co JOIN pa ON pa.cohort_key = co.cohort_key WHERE component = (SELECT component FROM bp))"""


_HOPS = _YEARS + ", " + _edges(1) + """, be AS (SELECT src, dst FROM ed UNION ALL SELECT dst, src FROM ed), wk AS (SELECT cohort_key AS src, cohort_key AS node, 0 AS k FROM c UNION SELECT wk.src, be.dst, k + 1 FROM wk JOIN be ON be.src = wk.node WHERE k < 6),
sh AS (SELECT src, node, min(k) AS k FROM wk GROUP BY 1, 2), hd AS (SELECT c.cohort_key, oo.outcome, (SELECT min(k) FROM sh JOIN co ON co.cohort_key = sh.node WHERE sh.src = c.cohort_key AND co.outcome = oo.outcome) AS distance FROM c, (SELECT DISTINCT outcome FROM co) oo)"""
_WAGES = _match(START, SIZE) + ", w AS (SELECT worker, year_cluster, firm, province, CAST(sum(CAST(earnings AS DECIMAL(28,4))) AS DOUBLE) / sum(paid_weeks) AS x FROM ap GROUP BY 1, 2, 3, 4 HAVING count(*) = count(earnings)), g AS (SELECT i AS grid_idx, (SELECT quantile_cont(x, [" + ", ".join(map(repr, clusters.GRID)) + "]) FROM w)[i + 1] AS q FROM range(100) t(i))"
_CDF = _WAGES + ", cdf AS (SELECT year_cluster, firm, province, grid_idx, count(*) AS num_workers, avg(CASE WHEN x <= q THEN 1.0 ELSE 0.0 END) AS cdf FROM w, g GROUP BY 1, 2, 3, 4)"
#: The clusterings of the test tables.
_SETTINGS = [(1990, 4, 3), (1994, 4, 3), (1998, 2, 3), (1998, 2, 5)]


def _sizes(setting: tuple[int, int, int], least: int, r: int) -> str:
    config = ", ".join(f"CAST({v} AS BIGINT) AS {c}" for c, v in zip(("start_year", "year_cluster_size", "num_clusters"), setting, strict=True))
    return f"""WITH RECURSIVE {_cells_sql(*setting)}, {_cohorts(least)}, {_edges(r)}, be AS (SELECT src, dst FROM ed UNION ALL SELECT dst, src FROM ed), re AS (SELECT cohort_key AS src, cohort_key AS node FROM c UNION SELECT re.src, be.dst FROM re JOIN be ON be.src = re.node),
pa AS (SELECT src AS cohort_key, min(node) AS component FROM re GROUP BY 1), bp AS (SELECT component FROM pa GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1),
idn AS (SELECT DISTINCT outcome FROM co JOIN pa ON pa.cohort_key = co.cohort_key WHERE component = (SELECT component FROM bp)),
sz AS (SELECT cells.outcome, count(*) AS num_workers, count(units.unit) AS num_workers_panel, CAST(split_part(cells.outcome, '_', 3) AS BIGINT) AS year_cluster FROM cells LEFT JOIN units ON units.unit = cells.unit GROUP BY 1)
SELECT {config}, CAST({MIN_OUTCOMES} AS BIGINT) AS min_outcomes, CAST({least} AS BIGINT) AS min_units, CAST({r} AS BIGINT) AS rank, year_cluster, outcome, num_workers, num_workers_panel, outcome IN (SELECT outcome FROM idn) AS identified,
 num_workers_panel / CAST(sum(num_workers) OVER (PARTITION BY year_cluster) AS DOUBLE) AS share_workers, num_workers_panel / nullif(CAST(sum(num_workers_panel) OVER (PARTITION BY year_cluster) AS DOUBLE), 0) AS share_workers_panel FROM sz"""


_SIZES = " UNION ALL ".join(f"SELECT * FROM ({_sizes(x, least, r)})" for x in _SETTINGS for _, least, r in GRID)
_SPELLS = "s AS (SELECT DISTINCT rider_id, first_week_id AS f, treatment_week_id AS l FROM rider_spells WHERE rider_id IS NOT NULL AND first_week_id IS NOT NULL AND treatment_week_id IS NOT NULL), k AS (SELECT f, l, count(*) AS n_riders, CASE WHEN length(f::VARCHAR) >= 2 THEN f::VARCHAR ELSE lpad(f::VARCHAR, 2, '0') END || ' - ' || CASE WHEN length(l::VARCHAR) >= 2 THEN l::VARCHAR ELSE lpad(l::VARCHAR, 2, '0') END AS cohort FROM s GROUP BY f, l HAVING count(*) >= 2)"
_MEAN = "SELECT cohort_key, outcome, round(%s, 6) AS outcome_mean FROM d GROUP BY 1, 2"

SQL = {
    "match_filter": f"WITH {_MATCH} SELECT worker, firm, year, paid_weeks, earnings, province FROM m",
    "year_bins": f"WITH {_MATCH} SELECT year, year_cluster, count(*) AS n_records FROM b GROUP BY 1, 2",
    "always_present": f"WITH {_MATCH} SELECT worker, firm, year_cluster, count(*) AS n_records FROM ap GROUP BY 1, 2, 3",
    "avg_weekly_earnings": f"WITH {_MATCH} SELECT worker, firm, year_cluster, CAST(sum(CAST(earnings AS DECIMAL(28,4))) AS DOUBLE) / sum(paid_weeks) AS avg_weekly_earnings FROM b WHERE worker IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) = count(earnings)",
    "counts_by_province": f"WITH {_MATCH} SELECT province, count(DISTINCT firm) AS n_firms, count(DISTINCT worker) AS n_workers, count(*) AS n_records FROM m GROUP BY 1",
    "outcome_labels": f"WITH {_CELLS} SELECT outcome, CAST(split_part(outcome, '_', 1) AS BIGINT) AS firm_type, split_part(outcome, '_', 2) AS province, CAST(split_part(outcome, '_', 3) AS BIGINT) AS year_cluster, count(*) AS n_cells FROM cells GROUP BY 1",
    "log_earnings": f"WITH {_CELLS} SELECT unit, outcome, round(value, 6) AS value FROM cells",
    "worker_cohort_sizes": f"WITH {_CELLS}, {_cohorts(5)} SELECT cohort_key, n AS n_units FROM c",
    "groups_observed_hist": f"WITH {_CELLS} SELECT n_outcomes, count(*) AS n_units FROM (SELECT unit, count(*) AS n_outcomes FROM cells GROUP BY 1) GROUP BY 1",
    "panel_cluster_sizes": f"SELECT * REPLACE (round(share_workers, 6) AS share_workers, round(share_workers_panel, 6) AS share_workers_panel) FROM ({_SIZES})",
    "panel_coverage": f"""WITH y AS (SELECT start_year, year_cluster_size, num_clusters, min_outcomes, min_units, rank, year_cluster, sum(share_workers) AS s, CAST(sum(num_workers) AS BIGINT) AS w, CAST(sum(num_workers_panel) AS BIGINT) AS p, count(*) AS g FROM ({_SIZES}) WHERE identified GROUP BY ALL)
SELECT start_year, year_cluster_size, num_clusters, min_outcomes, min_units, rank, round(min(s), 6) AS min_share_workers, round(max(s), 6) AS max_share_workers, min(w) AS min_num_workers, max(w) AS max_num_workers, min(p) AS min_num_workers_panel, max(p) AS max_num_workers_panel, min(g) AS min_num_groups, max(g) AS max_num_groups FROM y GROUP BY 1, 2, 3, 4, 5, 6""",
    "unit_cohorts": f"WITH {_FLAG} SELECT unit, cohort_key FROM units",
    "cohort_sizes": f"WITH {_FLAG} SELECT cohort_key, n AS n_units FROM c",
    "panel_build": f"WITH {_FLAG} SELECT unit, outcome, cohort_key, round(value, 6) AS value FROM d",
    "unit_weights_default": f"WITH {_FLAG} SELECT unit, round(w, 12) AS weight FROM units",
    "panel_reweighted": f"WITH {_FLAG} SELECT cohort_key, outcome, round(sum((unit % 7 + 1) * value) / sum(unit % 7 + 1), 6) AS outcome_mean FROM d GROUP BY 1, 2",
    "panel_identified": f"WITH RECURSIVE {_parts(2)}, i0 AS (SELECT unit, string_agg(outcome, '; ' ORDER BY outcome) AS cohort_key, count(*) AS k FROM d WHERE outcome IN (SELECT outcome FROM idn) GROUP BY 1) SELECT cohort_key, count(*) AS n_units FROM i0 WHERE k >= {MIN_OUTCOMES} GROUP BY 1 HAVING count(*) >= {MIN_UNITS}",
    "panel_left_out": f"WITH {_FLAG} SELECT outcome, count(*) AS n_cells FROM d WHERE NOT (cohort_key = 'AF; RF' AND outcome = 'RF') GROUP BY 1",
    "cohort_outcome_means": f"WITH {_FLAG} {_MEAN % 'avg(value)'}",
    "cohort_weighted_means": f"WITH {_FLAG} {_MEAN % 'sum(w * value) / sum(w)'}",
    "cohort_demeaned": f"WITH {_FLAG} SELECT unit, cohort_key, outcome, round(value - sum(w * value) OVER g / sum(w) OVER g, 6) AS value FROM d WINDOW g AS (PARTITION BY cohort_key, outcome)",
    "cohort_moments": f"WITH {_FLAG} SELECT x.cohort_key, x.outcome AS t, y.outcome AS s, round(sum(x.w), 6) AS w, round(sum(x.w * x.value * y.value), 6) AS second FROM d x JOIN d y ON y.unit = x.unit GROUP BY 1, 2, 3",
    "overlap_edges_r1": f"WITH {_YEARS}, {_edges(1)} SELECT * FROM ed",
    "overlap_edges_r2": f"WITH {_YEARS}, {_edges(2)} SELECT * FROM ed",
    "overlap_components": f"WITH RECURSIVE {_parts(2)} SELECT * FROM pa",
    "identified_outcomes_r1": f"WITH RECURSIVE {_parts(1)} SELECT * FROM idn",
    "identified_outcomes_r2": f"WITH RECURSIVE {_parts(2)} SELECT * FROM idn",
    "outcome_hop_distances": f"WITH RECURSIVE {_HOPS} SELECT cohort_key, outcome, CAST(distance AS BIGINT) AS distance FROM hd",
    "wage_quantile_grid": f"WITH {_WAGES} SELECT grid_idx, round(q, 6) AS q FROM g",
    "group_wage_cdf": f"WITH {_CDF} SELECT year_cluster, firm, province, grid_idx, num_workers, round(cdf, 6) AS cdf FROM cdf",
    "wage_cdf_wide": f"WITH {_CDF} SELECT firm, province, num_workers, " + ", ".join(f"coalesce(max(CASE WHEN grid_idx = {k} THEN round(cdf, 6) END), 0) AS q{k}" for k in (0, 24, 49, 74, 99)) + f" FROM cdf WHERE year_cluster = {START} GROUP BY 1, 2, 3",
    "spectra_trace": f"WITH {_FLAG} SELECT cohort_key, n AS cohort_size, round(sum(value * value) / n, 5) AS trace FROM d GROUP BY 1, 2",
    "spectra_norm": f"WITH {_FLAG}, mm AS (SELECT x.cohort_key, sum(x.value * y.value) / min(x.n) AS v FROM d x JOIN d y ON y.unit = x.unit GROUP BY x.cohort_key, x.outcome, y.outcome) SELECT cohort_key, round(sqrt(sum(v * v)), 5) AS norm FROM mm GROUP BY 1",
    "twfe_means": f"""WITH RECURSIVE {_FLAG}, mo AS (SELECT cohort_key, outcome, min(n) AS n, avg(value) AS m FROM d GROUP BY 1, 2), os AS (SELECT DISTINCT outcome FROM mo),
it AS (SELECT 0 AS k, outcome, CAST(0 AS DOUBLE) AS e FROM os UNION ALL SELECT k + 1, outcome, e FROM (SELECT x.k, mo.outcome, sum(mo.n * (mo.m - x.a)) / sum(mo.n) AS e FROM mo JOIN (SELECT it.k, y.cohort_key, avg(y.m - it.e) AS a FROM it JOIN mo y ON y.outcome = it.outcome GROUP BY 1, 2) x ON x.cohort_key = mo.cohort_key GROUP BY 1, 2) WHERE k < 300),
la AS (SELECT outcome, e FROM it WHERE k = 300), fe AS (SELECT cohort_key, avg(m - e) AS a FROM mo JOIN la ON la.outcome = mo.outcome GROUP BY 1) SELECT cohort_key, la.outcome, round(a + e, 6) AS outcome_mean FROM fe, la""",
    "bayes_weights": f"WITH {_FLAG}, {_DIGITS % 4} SELECT unit, b, round(bw * 1e6, 6) AS weight FROM bw",
    "bootstrap_obs_means": f"WITH {_BOOT} SELECT b, cohort_key, outcome, round(v, 6) AS outcome_mean FROM sims",
    "bootstrap_ci": f"WITH {_CI} SELECT parameter, round(o, 5) AS point_est, round(o - crit * sigma / rn, 5) AS ci_lower, round(o + crit * sigma / rn, 5) AS ci_upper, round(sigma, 5) AS sigma, round(crit, 5) AS crit_val FROM cr",
    "sup_t_band": f"WITH {_CI} SELECT parameter, round(o, 5) AS point_est, round(o - sup * sigma / rn, 5) AS sup_cb_lower, round(o + sup * sigma / rn, 5) AS sup_cb_upper FROM cr, su",
    "err_stats": f"WITH {_SIMS} SELECT est_name, cohort_key, cohort_size, outcome, err_stat, round(value, 6) AS value FROM es",
    "err_stats_vs_baseline": f"WITH {_SIMS} SELECT est_name, cohort_key, outcome, err_stat, round(value_diff, 6) AS value_diff, round(value_ratio, 4) AS value_ratio FROM cm",
    "err_stat_summaries": f"""WITH {_SIMS}, p AS (SELECT est_name, err_stat, count(*) AS n, avg((value_ratio < 1)::INT::DOUBLE) AS sb, sum((value_ratio < 1)::INT::DOUBLE * cohort_size) / sum(cohort_size) AS sw, avg(value_ratio) AS mr, sum(value_ratio * cohort_size) / sum(cohort_size) AS mw,
 quantile_cont(value_ratio, 0.25) AS q25, quantile_cont(value_ratio, 0.5) AS q50, quantile_cont(value_ratio, 0.75) AS q75 FROM cm GROUP BY 1, 2),
x AS (SELECT est_name, err_stat, quantile_cont(value_ratio, 0.25) AS a, quantile_cont(value_ratio, 0.5) AS b, quantile_cont(value_ratio, 0.75) AS c FROM (SELECT est_name, err_stat, value_ratio, unnest(range(cohort_size)) FROM cm) GROUP BY 1, 2)
SELECT p.est_name, p.err_stat, n, round(sb, 4) AS share_better, round(sw, 4) AS share_better_weighted, round(mr, 4) AS mean_ratio, round(mw, 4) AS mean_ratio_weighted, round(q25, 4) AS q25, round(q50, 4) AS q50, round(q75, 4) AS q75, round(a, 4) AS q25_weighted, round(b, 4) AS q50_weighted, round(c, 4) AS q75_weighted
FROM p JOIN x ON x.est_name = p.est_name AND x.err_stat = p.err_stat""",
    "rel_err_cdf": f"""WITH {_SIMS} SELECT est_name, err_stat, cohort_key, outcome, round(value_ratio, 4) AS value_ratio, round(row_number() OVER o / count(*) OVER g, 6) AS share_cells, round(sum(cohort_size) OVER (o ROWS UNBOUNDED PRECEDING) / sum(cohort_size) OVER g, 6) AS share_units
FROM cm WINDOW g AS (PARTITION BY est_name, err_stat), o AS (PARTITION BY est_name, err_stat ORDER BY value_ratio, cohort_key, outcome)""",
    "cohort_rectangles": f"WITH {_FLAG}, r AS (SELECT cohort_key, n, CAST(sum(n) OVER (ORDER BY n DESC, cohort_key ROWS UNBOUNDED PRECEDING) AS BIGINT) AS z FROM c) SELECT r.cohort_key, co.outcome, z - n + 1 AS unit_id_min, z AS unit_id_max FROM r JOIN co ON co.cohort_key = r.cohort_key",
    "hop_reach_dist": f"""WITH RECURSIVE {_HOPS}, ne AS (SELECT cohort_key, distance AS hops, count(*) AS k FROM hd WHERE distance IS NOT NULL GROUP BY 1, 2), st AS (SELECT cohort_key, hops, sum(k) OVER (PARTITION BY cohort_key ORDER BY hops) AS reached FROM ne),
al AS (SELECT * FROM st UNION ALL SELECT c.cohort_key, (SELECT max(hops) FROM st), (SELECT max(reached) FROM st) FROM c), gr AS (SELECT hops, reached, count(*) AS n_cohorts, CAST(sum(n) AS BIGINT) AS n_units FROM al JOIN c ON c.cohort_key = al.cohort_key GROUP BY 1, 2)
SELECT CAST(hops AS BIGINT) AS hops, CAST(reached AS DOUBLE) AS reached, n_cohorts, n_units, round(row_number() OVER o / sum(n_cohorts) OVER g, 6) AS share_cohorts, round(sum(n_units) OVER (o ROWS UNBOUNDED PRECEDING) / sum(n_units) OVER g, 6) AS share_units FROM gr WINDOW g AS (PARTITION BY hops), o AS (PARTITION BY hops ORDER BY reached)
UNION ALL SELECT DISTINCT CAST(hops AS BIGINT), (SELECT CAST(min(reached) AS DOUBLE) FROM gr) - 1e-10, NULL, NULL, 0, 0 FROM gr""",
    "overlap_graph_edges": f"WITH {_YEARS} SELECT x.cohort_key AS cohort_l, y.cohort_key AS cohort_r, x.outcome FROM co x JOIN co y ON y.outcome = x.outcome AND x.cohort_key <> y.cohort_key",
    "block_missing_nonid": f"""WITH cells AS (SELECT DISTINCT firm AS unit, province || '_' || firm_type AS outcome, 1.0 AS value FROM firm_clusters WHERE province IS NOT NULL AND firm IS NOT NULL AND firm_type IS NOT NULL), {_cohorts(5, 1)},
e AS (SELECT DISTINCT x.cohort_key AS l, y.cohort_key AS r FROM co x JOIN co y ON y.outcome = x.outcome AND x.cohort_key <> y.cohort_key), one AS (SELECT l AS cohort_key, outcome FROM e JOIN co ON co.cohort_key = r), two AS (SELECT l AS cohort_key, outcome FROM e JOIN one ON one.cohort_key = r)
SELECT c.cohort_key, o.outcome FROM (SELECT DISTINCT cohort_key FROM co) c, (SELECT DISTINCT outcome FROM co) o EXCEPT (SELECT * FROM co UNION SELECT * FROM one UNION SELECT * FROM two)""",
    "rider_panel_expand": f"WITH {_SPELLS} SELECT rider_id, unnest(CASE WHEN f <= l THEN range(f, l + 1) ELSE range(f, l - 1, -1) END) AS week FROM s",
    "rider_panel_cohorts": f"WITH {_SPELLS} SELECT rider_id, cohort, unnest(CASE WHEN s.f <= s.l THEN range(s.f, s.l + 1) ELSE range(s.f, s.l - 1, -1) END) AS week FROM s JOIN k ON k.f = s.f AND k.l = s.l",
    "highlighted_missing_cells": f"""WITH {_YEARS}, r AS (SELECT cohort_key, n, CAST(sum(n) OVER (ORDER BY n DESC, cohort_key ROWS UNBOUNDED PRECEDING) AS BIGINT) AS z FROM c), f AS (SELECT * FROM r ORDER BY z LIMIT 1)
SELECT r.cohort_key, co.outcome, z - n + 1 AS unit_id_min, z AS unit_id_max, 'observed' AS cell_kind FROM r JOIN co ON co.cohort_key = r.cohort_key
UNION ALL SELECT f.cohort_key, o.outcome, z - n + 1, z, 'missing' FROM f, (SELECT DISTINCT outcome FROM co) o WHERE NOT EXISTS (SELECT 1 FROM co WHERE co.cohort_key = f.cohort_key AND co.outcome = o.outcome)""",
    "rider_cohorts": f"WITH {_SPELLS} SELECT cohort, n_riders FROM k",
    "rider_overlap_edges": f"WITH {_SPELLS} SELECT x.cohort AS cohort_l, y.cohort AS cohort_r, least(x.l, y.l) - greatest(x.f, y.f) AS weeks_overlapping FROM k x JOIN k y ON x.f < y.l AND x.l > y.f WHERE x.f < x.l AND y.f < y.l",
}
