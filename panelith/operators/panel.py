"""Unbalanced panels: cells of units and outcomes, and the cohorts of units observed in the same outcomes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATOR = "; "


@dataclass(frozen=True)
class Panel:
    """data: unit, outcome, value. units: unit, cohort ARRAY<STRING>, cohort_key STRING, weight DOUBLE; one row a unit."""

    data: DataFrame
    units: DataFrame
    min_outcomes: int
    min_units: int

    def cells(self) -> DataFrame:
        return self.data.join(self.units.select("unit", "cohort_key", "weight"), "unit")

    def cohort_sizes(self) -> DataFrame:
        return self.units.groupBy("cohort_key").agg(F.count(F.lit(1)).alias("n_units"))

    def cohorts(self) -> dict[str, frozenset[str]]:
        """Outcomes of each cohort, as its units' data have them now. Cohorts hold min_units units each, so that they are few."""
        rows = self.units.select("cohort_key").distinct().collect()
        return {r[0]: frozenset(r[0].split(SEPARATOR)) for r in rows}

    def reweighted(self, weights: DataFrame) -> Panel:
        """The same panel with the weights of weights(unit, weight), which stay as they are; units without one drop out."""
        units = self.units.drop("weight").join(weights.select("unit", "weight"), "unit")
        return replace(self, units=units, data=self.data.join(units.select("unit"), "unit", "left_semi"))

    def restricted(self, outcomes: list[str]) -> Panel:
        """Only those outcomes; cohorts are formed again and both thresholds applied again, once; weights stay."""
        return build(self.data.where(F.col("outcome").isin(outcomes)), self.min_outcomes, self.min_units, self.units.select("unit", "weight"))

    def only(self, cohort_key: str) -> Panel:
        """One cohort, with its weights as they are."""
        units = self.units.where(F.col("cohort_key") == cohort_key)
        return replace(self, units=units, data=self.data.join(units.select("unit"), "unit", "left_semi"))

    def without(self, cohort_key: str, outcome: str) -> Panel:
        """The cells of one cohort and outcome deleted; labels and weights stay."""
        gone = self.units.where(F.col("cohort_key") == cohort_key).select("unit")
        hit = self.data.where(F.col("outcome") == outcome).join(gone, "unit", "left_anti")
        return replace(self, data=self.data.where(F.col("outcome") != outcome).unionByName(hit))


def build(cells: DataFrame, min_outcomes: int, min_units: int, weights: DataFrame | None = None, cohorts: DataFrame | None = None, weight_column: str | None = None) -> Panel:
    """A panel of cells(unit, outcome, value), one row a cell, whose units have min_outcomes outcomes at least and share their
    set of outcomes with min_units units at least; weights(unit, weight), or a column of cells that is the same in all of a
    unit's rows, or else 1 by the number of units that remain.

    cohorts(unit, cohort ARRAY<STRING>): sets of outcomes attached beforehand, in place of those that the cells have; units without
    one drop out. Null units, outcomes and values are no cells.
    """
    data = cells.select("unit", F.col("outcome").cast("string").alias("outcome"), F.col("value").cast("double").alias("value")).dropna("any")
    if cohorts is None:
        units = data.groupBy("unit").agg(F.sort_array(F.collect_set("outcome")).alias("cohort"))
    else:
        units = cohorts.select("unit", F.sort_array(F.array_distinct("cohort")).alias("cohort")).dropna("any").dropDuplicates(["unit"]).join(data.select("unit").distinct(), "unit", "left_semi")
    units = units.where(F.size("cohort") >= min_outcomes).withColumn("cohort_key", F.array_join("cohort", SEPARATOR))
    sizes = units.groupBy("cohort_key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_units)
    units = units.join(sizes.select("cohort_key"), "cohort_key", "left_semi")
    if weight_column is not None:
        weights = cells.where(F.col(weight_column).isNotNull()).groupBy("unit").agg(F.max(weight_column).cast("double").alias("weight"))
    if weights is None:
        units = units.withColumn("weight", F.lit(1.0) / sizes.agg(F.sum("n")).scalar())
    else:
        units = units.join(weights, "unit")
    units = units.select("unit", "cohort", "cohort_key", "weight")
    return Panel(data.join(units.select("unit"), "unit", "left_semi"), units, min_outcomes, min_units)


def cohort_means(panel: Panel, weighted: bool = True) -> DataFrame:
    """cohort_key, outcome, outcome_mean over the units of a cohort."""
    mean: Column = F.sum(F.col("weight") * F.col("value")) / F.sum("weight") if weighted else F.avg("value")
    return panel.cells().groupBy("cohort_key", "outcome").agg(mean.alias("outcome_mean"))


def demeaned(panel: Panel) -> DataFrame:
    """unit, cohort_key, outcome, value less the weighted mean of its cohort and outcome."""
    m = cohort_means(panel)
    return panel.cells().join(m, ["cohort_key", "outcome"]).select("unit", "cohort_key", "outcome", (F.col("value") - F.col("outcome_mean")).alias("value"))


def moments(panel: Panel, replicates: DataFrame | None = None) -> DataFrame:
    """(b,) cohort_key, t, s, w, mean, second: weight of a cohort, weighted mean of t, and sum of weight times values of t and s.

    A unit's cells are gathered once, its pairs made inside the row. replicates(unit, b, weight) takes the place of the weights.
    """
    vectors = panel.data.groupBy("unit").agg(F.collect_list(F.struct("outcome", "value")).alias("x")).join(panel.units.select("unit", "cohort_key", "weight"), "unit")
    keys = ["cohort_key"]
    if replicates is not None:
        vectors, keys = vectors.drop("weight").join(replicates, "unit"), ["b", "cohort_key"]
    pairs = vectors.select(*keys, "weight", "x", F.explode("x").alias("p")).select(*keys, "weight", "p", F.explode("x").alias("q")).where("p.outcome <= q.outcome")
    half = pairs.groupBy(*keys, F.col("p.outcome").alias("t"), F.col("q.outcome").alias("s")).agg(
        F.sum("weight").alias("w"), (F.sum(F.col("weight") * F.col("p.value")) / F.sum("weight")).alias("mean"), F.sum(F.col("weight") * F.col("p.value") * F.col("q.value")).alias("second"))
    other = half.where("t < s").select(*keys, F.col("s").alias("t"), F.col("t").alias("s"), "w", F.lit(None).cast("double").alias("mean"), "second")
    return half.unionByName(other)


def exponentials(n: int, seed: int = 0, unit: str = "unit") -> Column:
    """ARRAY of n standard exponential draws for a unit, from a hash of seed, replicate 1..n and unit."""

    def draw(b: Column) -> Column:
        digest = F.md5(F.concat(F.lit(f"{seed}|"), b.cast("string"), F.lit("|"), F.col(unit).cast("string")))
        return -F.ln((F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52))

    return F.transform(F.sequence(F.lit(1).cast("bigint"), F.lit(n).cast("bigint")), draw)


def replicate_moments(panel: Panel, n: int, seed: int = 0) -> DataFrame:
    """b 1..n, cohort_key, t, s, w, mean, second: moments under exponential weights, which are not divided by their sum, as means
    and estimates don't depend on it.

    A unit's cells and draws meet in its row; tasks add up whole cohorts by matrix products and send a row for each cohort, pair
    of outcomes and replicate, whatever the number of units.
    """
    vectors = panel.data.groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("outcome", "value"))).alias("x")).join(panel.units.select("unit", "cohort_key"), "unit")
    rows = vectors.select("cohort_key", F.transform("x", lambda c: c["outcome"]).alias("ts"), F.transform("x", lambda c: c["value"]).alias("v"), exponentials(n, seed).alias("e"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            keys, off = batch.column("cohort_key").to_pylist(), batch.column("v").offsets.to_numpy()
            v, e = batch.column("v").flatten().to_numpy(), batch.column("e").flatten().to_numpy().reshape(-1, n)
            ts, by = batch.column("ts"), {}
            for i, k in enumerate(keys):
                by.setdefault((k, int(off[i + 1] - off[i])), []).append(i)
            for (k, size), at in by.items():
                x = v[(off[at] - off[0])[:, None] + np.arange(size)]
                key = (k, tuple(ts[at[0]].as_py()))
                a, b = np.triu_indices(size)
                made = np.concatenate([np.ones((len(at), 1)), x, x[:, a] * x[:, b]], 1).T @ e[at]
                held[key] = held[key] + made if key in held else made
        for (k, names), made in held.items():
            a, b = np.triu_indices(len(names))
            m = a.size
            yield pa.RecordBatch.from_pydict({
                "b": pa.array(np.tile(np.arange(1, n + 1), m)), "cohort_key": pa.array([k] * (m * n), pa.string()), "t": pa.array(np.repeat(names, n)[np.r_[*[np.arange(i * n, i * n + n) for i in a]]].tolist(), pa.string()),
                "s": pa.array(np.repeat([names[i] for i in b], n).tolist(), pa.string()), "w": pa.array(np.tile(made[0], m)), "own": pa.array(made[1 + a].reshape(-1)), "second": pa.array(made[1 + len(names) :].reshape(-1))})

    parts = rows.mapInArrow(sums, "b bigint, cohort_key string, t string, s string, w double, own double, second double")
    half = parts.groupBy("b", "cohort_key", "t", "s").agg(F.sum("w").alias("w"), (F.sum("own") / F.sum("w")).alias("mean"), F.sum("second").alias("second"))
    other = half.where("t < s").select("b", "cohort_key", F.col("s").alias("t"), F.col("t").alias("s"), "w", F.lit(None).cast("double").alias("mean"), "second")
    return half.unionByName(other)
