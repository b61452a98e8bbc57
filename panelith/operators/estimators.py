"""Cohort means of all outcomes, with replicates, intervals and leave-one-out simulation."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import linalg
from ..session import union_all
from .panel import SEPARATOR, Panel, exponentials, moments, replicate_moments

#: Difference of the normal distribution's quartiles.
NORMAL_IQR = 1.3489795003921634


def means(panel: Panel, names: list[str], replicates: int = 0, seed: int = 0, own: dict[str, Callable] | None = None) -> DataFrame:
    """(b,) est_name, cohort_key, outcome, outcome_mean for every cohort and outcome; null where it isn't identified. With replicates
    for each of so many draws of weights.

    Units are summed up to cohort moments in the executors; only those, a square of the outcomes a cohort, meet in one kernel. own:
    estimators of one's own by name, from cohorts by key and the number of outcomes to means by key.
    """
    rows = replicate_moments(panel, replicates, seed) if replicates else moments(panel)
    by_name = {k: partial(linalg.estimate, k) for k in names} | (own or {})

    def run(g: pd.DataFrame) -> pd.DataFrame:
        outcomes, cohorts = linalg.from_rows(g)
        out = [(name, k, t, v) for name, f in by_name.items() for k, x in f(cohorts, len(outcomes)).items() for t, v in zip(outcomes, x.tolist(), strict=True)]
        df = pd.DataFrame(out, columns=["est_name", "cohort_key", "outcome", "outcome_mean"])
        return df.assign(b=g["b"].iloc[0]) if replicates else df

    schema = "est_name string, cohort_key string, outcome string, outcome_mean double"
    if replicates:
        out = rows.groupBy("b").applyInPandas(run, schema + ", b bigint")
    else:
        out = rows.groupBy(F.lit("all")).applyInPandas(run, schema)
    return out.withColumn("outcome_mean", F.nanvl("outcome_mean", F.lit(None).cast("double")))


def bayesian_weights(panel: Panel, n: int, seed: int = 0) -> DataFrame:
    """unit, b, weight: standard exponential draws over their sum in each replicate 1..n, from a hash of seed, replicate and unit."""
    raw = panel.units.select("unit", F.posexplode(exponentials(n, seed)).alias("b", "e")).withColumn("b", (F.col("b") + 1).cast("bigint"))
    total = raw.groupBy("b").agg(F.sum("e").alias("total"))
    return raw.join(F.broadcast(total), "b").select("unit", "b", (F.col("e") / F.col("total")).alias("weight"))


def observed_means(panel: Panel, n: int, seed: int = 0) -> DataFrame:
    """b, cohort_key, outcome, outcome_mean under each of n draws of weights."""
    return replicate_moments(panel, n, seed).where("t = s").select("b", "cohort_key", F.col("t").alias("outcome"), F.col("mean").alias("outcome_mean"))


def left_out_means(panel: Panel, n: int, seed: int = 0) -> DataFrame:
    """b, cohort_key, cohort_size, outcome, est_name, boot_outcome_mean, true_outcome_mean: each cell as if it were left out, in each of n
    draws of weights, by two estimators in closed form: 'others', the mean of the outcome over all other cohorts, and 'shifted',
    that plus how far the cohort lies from the others in its other outcomes on average. Cells that no other cohort has, and cohorts
    without another outcome that others have, have no estimates."""
    cells = replicate_moments(panel, n, seed).where("t = s").select("b", "cohort_key", F.col("t").alias("outcome"), "w", "mean")
    each, own = Window.partitionBy("b", "outcome"), Window.partitionBy("b", "cohort_key")
    rest = F.count(F.lit(1)).over(each) > 1
    others = F.when(rest, (F.sum(F.col("w") * F.col("mean")).over(each) - F.col("w") * F.col("mean")) / (F.sum("w").over(each) - F.col("w")))
    gap = cells.withColumn("others", others).where("others IS NOT NULL").withColumn("gap", F.col("mean") - F.col("others"))
    shift = (F.sum("gap").over(own) - F.col("gap")) / (F.count("gap").over(own) - 1)
    made = gap.withColumn("k", F.count("gap").over(own)).withColumn("shifted", F.col("others") + shift).where("k > 1")
    wide = made.select("b", "cohort_key", "outcome", "others", "shifted").unpivot(["b", "cohort_key", "outcome"], ["others", "shifted"], "est_name", "boot_outcome_mean")
    truth = panel.cells().groupBy("cohort_key", "outcome").agg(F.avg("value").alias("true_outcome_mean"), F.count(F.lit(1)).alias("cohort_size"))
    return wide.join(truth, ["cohort_key", "outcome"])


def intervals(points: DataFrame, replicates: DataFrame, n_units: int, level: float = 0.95) -> DataFrame:
    """parameter, point_est, ci_lower, ci_upper, sup_cb_lower, sup_cb_upper, sigma, crit_val from points(parameter, estimate) and
    replicates(b, parameter, sim_estimate).

    Null and NaN replicates are left out. A spread of zero gives a statistic of 0 for roots of zero; other roots then have
    no finite statistic and are left out of the critical values.
    """
    root_n = float(np.sqrt(n_units))
    sims = replicates.where(F.col("sim_estimate").isNotNull() & ~F.isnan("sim_estimate")).join(F.broadcast(points), "parameter")
    roots = sims.withColumn("root", root_n * (F.col("sim_estimate") - F.col("estimate")))
    spread = roots.groupBy("parameter").agg(((F.percentile("root", F.lit(0.75)) - F.percentile("root", F.lit(0.25))) / NORMAL_IQR).alias("sigma"))
    stats = roots.join(F.broadcast(spread), "parameter").withColumn("abs_t", F.when(F.col("root") == 0, 0.0).otherwise(F.try_divide(F.abs("root"), F.col("sigma"))))
    crit = stats.groupBy("parameter").agg(F.percentile("abs_t", F.lit(level)).alias("crit_val"))
    sup = stats.groupBy("b").agg(F.max("abs_t").alias("top")).agg(F.percentile("top", F.lit(level))).scalar()
    out = points.join(spread, "parameter").join(crit, "parameter").withColumn("sup", sup)
    half = lambda c: F.col(c) * F.col("sigma") / root_n
    return out.select("parameter", F.col("estimate").alias("point_est"), (F.col("estimate") - half("crit_val")).alias("ci_lower"), (F.col("estimate") + half("crit_val")).alias("ci_upper"),
                      (F.col("estimate") - half("sup")).alias("sup_cb_lower"), (F.col("estimate") + half("sup")).alias("sup_cb_upper"), "sigma", "crit_val")


def bayesian_bootstrap(panel: Panel, name: str, n: int = 100, seed: int = 0) -> DataFrame:
    """Intervals of an estimator's cohort means; parameters are 'cohort -> outcome'."""
    label = F.concat("cohort_key", F.lit(" -> "), "outcome").alias("parameter")
    points = means(panel, [name]).where("outcome_mean IS NOT NULL").select(label, F.col("outcome_mean").alias("estimate"))
    sims = means(panel, [name], n, seed).select("b", label, F.col("outcome_mean").alias("sim_estimate"))
    return intervals(points, sims, panel.units.count())


class DataGeneratingProcess(ABC):
    """What replicates are drawn from."""

    @abstractmethod
    def draw(self, b: int) -> Panel:
        """Replicate b, the same whenever it is drawn."""


@dataclass(frozen=True)
class BayesianBootstrap(DataGeneratingProcess):
    """A panel under new weights of its units."""

    panel: Panel
    replicates: int
    seed: int = 0

    def draw(self, b: int) -> Panel:
        return self.panel.reweighted(bayesian_weights(self.panel, self.replicates, self.seed).where(F.col("b") == b))


def simulate(process: DataGeneratingProcess, by_name: dict[str, Callable[[Panel], DataFrame]], n: int) -> DataFrame:
    """b, est_name, parameter, sim_estimate for estimators of one's own, each from a panel to parameter, estimate.

    One plan a replicate and estimator: means() does the built-in ones for all replicates at once.
    """
    parts = []
    for b in range(1, n + 1):
        drawn = process.draw(b)
        parts += [f(drawn).select(F.lit(b).cast("bigint").alias("b"), F.lit(name).alias("est_name"), "parameter", F.col("estimate").alias("sim_estimate")) for name, f in by_name.items()]
    return union_all(parts)


def _identified(sets: list[frozenset[str]], r: int) -> set[str]:
    """Outcomes of the component of overlapping sets with the most sets; ties by the least joined name."""
    sets = sorted(set(sets), key=lambda s: SEPARATOR.join(sorted(s)))
    holders: dict[str, list[int]] = {}
    for i, s in enumerate(sets):
        for t in s:
            holders.setdefault(t, []).append(i)
    parent = list(range(len(sets)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        shared: dict[int, int] = {}
        for t in s:
            for j in holders[t]:
                if j < i:
                    shared[j] = shared.get(j, 0) + 1
        for j, k in shared.items():
            if k >= r:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    by: dict[int, list[int]] = {}
    for i in range(len(sets)):
        by.setdefault(find(i), []).append(i)
    best = max(by.items(), key=lambda kv: (len(kv[1]), -kv[0]))[1] if by else []
    return {t for i in best for t in sets[i]}


def left_out_cells(panel: Panel, rank: int = 2, most: int = 15) -> list[tuple[str, int, str]]:
    """(cohort_key, n_units, outcome) to leave out: of the largest cohorts with more than rank outcomes the first so many that
    have a cell still identified, at that rank, without it."""
    sizes = panel.cohort_sizes().orderBy(F.desc("n_units"), "cohort_key").collect()
    own = {r[0]: frozenset(r[0].split(SEPARATOR)) for r in sizes}
    found, cohorts = [], 0
    for r in sizes:
        if cohorts == most:
            break
        if len(own[r[0]]) <= rank:
            continue
        cells = []
        for t in sorted(own[r[0]]):
            rest = [s for k, s in own.items() if k != r[0]] + [own[r[0]] - {t}]
            if t in _identified(rest, rank):
                cells.append((r[0], r[1], t))
        cohorts += bool(cells)
        found += cells
    return found


def leave_one_out(panel: Panel, names: list[str], n: int, seed: int = 0, rank: int = 2, most: int = 15) -> DataFrame:
    """b, cohort_key, cohort_size, outcome, est_name, boot_outcome_mean, true_outcome_mean: each left-out cell estimated without it
    in every replicate. Moments are summed once for all cells; a cell is left out by dropping its row and column."""
    cells = left_out_cells(panel, rank, most)
    spark = panel.data.sparkSession
    rows = replicate_moments(panel, n, seed)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        outcomes, cohorts = linalg.from_rows(g)
        place = {t: i for i, t in enumerate(outcomes)}
        b, out = int(g["b"].iloc[0]), []
        for name in names:
            made = linalg.left_out(name, cohorts, len(outcomes), [(key, place[t]) for key, _, t in cells])
            out += [(b, key, size, t, name, v) for (key, size, t), v in zip(cells, made, strict=True)]
        return pd.DataFrame(out, columns=["b", "cohort_key", "cohort_size", "outcome", "est_name", "boot_outcome_mean"])

    if not cells:
        return spark.createDataFrame([], "b bigint, cohort_key string, cohort_size bigint, outcome string, est_name string, boot_outcome_mean double, true_outcome_mean double")
    sims = rows.groupBy("b").applyInPandas(run, "b bigint, cohort_key string, cohort_size bigint, outcome string, est_name string, boot_outcome_mean double")
    truth = panel.cells().groupBy("cohort_key", "outcome").agg(F.avg("value").alias("true_outcome_mean"))
    return sims.join(F.broadcast(truth.where(F.col("cohort_key").isin(sorted({c[0] for c in cells})))), ["cohort_key", "outcome"])


def spectra(panel: Panel) -> DataFrame:
    """cohort_key, cohort_size, spectrum_idx, eigenvalue of the unweighted second moments, descending."""
    ones = panel.units.select("unit", F.lit(1).cast("bigint").alias("b"), F.lit(1.0).alias("weight"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        _, cohorts = linalg.from_rows(g)
        ((key, c),) = cohorts.items()
        v = np.linalg.eigvalsh(c.second / c.weight)[::-1]
        return pd.DataFrame({"cohort_key": key, "cohort_size": round(c.weight), "spectrum_idx": np.arange(1, v.size + 1), "eigenvalue": v})

    return moments(panel, ones).groupBy("cohort_key").applyInPandas(run, "cohort_key string, cohort_size bigint, spectrum_idx bigint, eigenvalue double")


def error_stats(sims: DataFrame) -> DataFrame:
    """est_name, cohort_key, cohort_size, outcome, err_stat, value: bias, sd and rmse of simulated cells."""
    e = F.col("boot_outcome_mean") - F.col("true_outcome_mean")
    wide = sims.groupBy("est_name", "cohort_key", "cohort_size", "outcome").agg(F.abs(F.avg(e)).alias("abs_bias"), F.stddev_samp("boot_outcome_mean").alias("sd"), F.sqrt(F.avg(e * e)).alias("rmse"))
    return wide.unpivot(["est_name", "cohort_key", "cohort_size", "outcome"], ["abs_bias", "sd", "rmse"], "err_stat", "value")


def against_baseline(stats: DataFrame, baseline: str) -> DataFrame:
    """Each other estimator's error beside the baseline's: value_diff = baseline - other, value_ratio = other / baseline."""
    base = stats.where(F.col("est_name") == baseline).select("cohort_key", "outcome", "err_stat", F.col("value").alias("base_value"))
    out = stats.where(F.col("est_name") != baseline).join(base, ["cohort_key", "outcome", "err_stat"])
    return out.withColumn("value_diff", F.col("base_value") - F.col("value")).withColumn("value_ratio", F.try_divide("value", "base_value"))


def error_summaries(compared: DataFrame) -> DataFrame:
    """By est_name and err_stat: cells, share better than the baseline, mean ratio and its quartiles, plain and by cohort size."""
    x, w = F.col("value_ratio"), F.col("cohort_size")
    q = lambda p, *f: F.percentile(x, F.lit(p), *f)
    return compared.where(x.isNotNull()).groupBy("est_name", "err_stat").agg(
        F.count(F.lit(1)).alias("n"), F.avg((x < 1).cast("double")).alias("share_better"), (F.sum((x < 1).cast("double") * w) / F.sum(w)).alias("share_better_weighted"), F.avg(x).alias("mean_ratio"), (F.sum(x * w) / F.sum(w)).alias("mean_ratio_weighted"),
        q(0.25).alias("q25"), q(0.5).alias("q50"), q(0.75).alias("q75"), q(0.25, w).alias("q25_weighted"), q(0.5, w).alias("q50_weighted"), q(0.75, w).alias("q75_weighted"))


def ratio_distribution(compared: DataFrame) -> DataFrame:
    """Cells of each err_stat in order of their ratio, with rank and cumulated cohort size as shares."""
    by = Window.partitionBy("est_name", "err_stat")
    order = by.orderBy("value_ratio", "cohort_key", "outcome")
    rank, size = F.row_number().over(order), F.sum("cohort_size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return compared.where("value_ratio IS NOT NULL").select("est_name", "err_stat", "cohort_key", "outcome", "value_ratio", (rank / F.count(F.lit(1)).over(by)).alias("share_cells"), (size / F.sum("cohort_size").over(by)).alias("share_units"))

