"""Groups by the distribution of what they pay: empirical distributions on a common grid, and weighted clusters of them."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import quantiles
from ..session import cut, union_all
from . import prep

GRID = [round(0.01 + 0.98 * i / 99, 12) for i in range(100)]
RESTARTS, STEPS = 10, 200


def wage_grid(cells: DataFrame, value: str) -> list[float]:
    return quantiles(cells, value, GRID)


def _below(x: Column, grid: list[float]) -> Column:
    """How many points of the ascending grid lie below x, by halving."""

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.lit(grid[mid]) < x, search(mid + 1, hi)).otherwise(search(lo, mid))

    return search(0, len(grid))


def group_distributions(cells: DataFrame, group: list[str], value: str, grid: list[float]) -> DataFrame:
    """group, grid_idx 0.., cdf, num_workers: share of a group's cells at or below each grid point. Null groups and values drop out.

    Cells are counted by group and grid point first, so that a large group is a few counts.
    """
    rows = cells.dropna(subset=[*group, value])
    bins = rows.withColumn("bin", _below(F.col(value), grid))
    held = bins.groupBy(*group, "bin").agg(F.count(F.lit(1)).alias("n")).groupBy(*group).agg(F.sum("n").alias("num_workers"), F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("at"))
    steps = F.transform(F.sequence(F.lit(0), F.lit(len(grid) - 1)), lambda i: F.coalesce(F.col("at")[i], F.lit(0)))
    running = F.aggregate(steps, F.array().cast("array<bigint>"), lambda a, n: F.array_append(a, F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + n))
    wide = held.withColumn("c", running)
    return wide.select(*group, "num_workers", F.posexplode("c").alias("grid_idx", "c")).withColumn("cdf", F.col("c") / F.col("num_workers")).drop("c")


def distribution_vectors(distributions: DataFrame, group: list[str]) -> DataFrame:
    """group, num_workers, cdf ARRAY<DOUBLE> in grid order."""
    pairs = distributions.groupBy(*group, "num_workers").agg(F.array_sort(F.collect_list(F.struct("grid_idx", "cdf"))).alias("x"))
    return pairs.select(*group, "num_workers", F.transform("x", lambda p: p["cdf"]).alias("cdf"))


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    return b.column("cdf").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared, of each row of x to each row of c."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1), 0)


def cluster(vectors: DataFrame, within: list[str], ks: list[int], restarts: int = RESTARTS) -> DataFrame:
    """vectors(..., num_workers, cdf) with num_clusters, one of ks, and cluster 1..k, ordered by the clusters' mean distribution from the
    highest pay on: weighted k-means within each group of within, or over all.

    Starts are members taken at even steps of the mean distribution, and others by a seeded draw among a bounded number kept for
    each group; all groups, ks and restarts that still move advance together, a pass adding up sums for each centre by key in the
    executors. The start with the least cost is kept; fewer members than k give fewer clusters. Starts that don't converge in
    STEPS passes are reported as a warning.
    """
    data = cut(vectors.withColumn("_w", F.to_json(F.struct(*[F.col(c).cast("string") for c in within])) if within else F.lit("")))
    mean = F.aggregate("cdf", F.lit(0.0), lambda a, x: a + x)
    ranked = data.select("_w", "cdf", mean.alias("m"), F.xxhash64("cdf").alias("h"))
    # a bounded number of seeds for each group: the members with the smallest hashes
    order = Window.partitionBy("_w").orderBy("h", "m")
    seeds: dict[str, list] = {}
    for r in ranked.dropDuplicates(["_w", "h"]).withColumn("i", F.row_number().over(order)).where("i <= 2000").collect():
        seeds.setdefault(r["_w"], []).append((r["m"], r["cdf"]))
    rng = np.random.default_rng(5)
    centres: dict[tuple[str, int, int], np.ndarray] = {}
    for w, rows in sorted(seeds.items()):
        rows.sort()
        x = np.array([c for _, c in rows])
        for k in ks:
            kk = min(k, len(x))
            starts = [np.linspace(0, len(x) - 1, kk + 2).astype(int)[1:-1]] + [np.sort(rng.choice(len(x), kk, replace=False)) for _ in range(restarts - 1)]
            centres |= {(w, k, i): x[s] for i, s in enumerate(starts)}

    def sums_of(held: dict[tuple[str, int, int], np.ndarray]):
        by: dict[str, list] = {}
        for (w, k, i), c in held.items():
            by.setdefault(w, []).append((k, i, c))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[tuple, np.ndarray] = {}
            for b in batches:
                ws, n, x = np.array(b.column("_w").to_pylist()), b.column("num_workers").to_numpy().astype(float), _matrix(b)
                for w in np.unique(ws).tolist():
                    at = ws == w
                    xs, ns = x[at], n[at]
                    for k, i, c in by.get(w, []):
                        d = _distances(xs, c)
                        weights = np.zeros((len(c), len(xs)))
                        weights[d.argmin(1), np.arange(len(xs))] = ns
                        made = np.r_[(weights @ xs).ravel(), weights.sum(1), (d.min(1) * ns).sum()]
                        total[w, k, i] = total[w, k, i] + made if (w, k, i) in total else made
            keys = list(total)
            yield pa.RecordBatch.from_pydict({"_w": pa.array([t[0] for t in keys], pa.string()), "k": pa.array([t[1] for t in keys], pa.int32()), "i": pa.array([t[2] for t in keys], pa.int32()), "x": pa.array([v.tobytes() for v in total.values()], pa.binary())})

        return run

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xs = [np.sum([np.frombuffer(x) for x in row], 0).tobytes() for row in b.column("xs").to_pylist()]
            yield pa.RecordBatch.from_pydict({"_w": b.column("_w"), "k": b.column("k"), "i": b.column("i"), "x": pa.array(xs, pa.binary())})

    def measured(held: dict[tuple[str, int, int], np.ndarray]) -> dict[tuple[str, int, int], np.ndarray]:
        parts = data.select("_w", "num_workers", "cdf").mapInArrow(sums_of(held), "_w string, k int, i int, x binary")
        sums = parts.groupBy("_w", "k", "i").agg(F.collect_list("x").alias("xs")).mapInArrow(added, "_w string, k int, i int, x binary")
        return {(r["_w"], r["k"], r["i"]): np.frombuffer(r["x"]) for r in sums.toLocalIterator()}

    moving = dict(centres)
    for _ in range(STEPS):
        if not moving:
            break
        for key, v in measured(moving).items():
            c = centres[key]
            s, m = v[: c.size].reshape(c.shape), v[c.size : -1]
            to = np.where(m[:, None] > 0, s / np.maximum(m, 1e-300)[:, None], c)
            centres[key] = to
            if np.abs(to - c).max() < 1e-9:
                del moving[key]
            else:
                moving[key] = to
    if moving:
        warnings.warn(f"{len(moving)} of {len(centres)} starts did not converge in {STEPS} steps", stacklevel=2)
    best: dict[str, list[tuple[int, np.ndarray]]] = {}
    costs = {key: v[-1] for key, v in measured(centres).items()} if centres else {}
    for w in seeds:
        for k in ks:
            c = centres[min(((w, k, i) for i in range(restarts)), key=lambda key: (costs[key], key[2]))]
            best.setdefault(w, []).append((k, c[np.argsort(c.mean(1), kind="stable")]))
    names = vectors.columns

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ws, x = np.array(b.column("_w").to_pylist()), _matrix(b)
            for j, k in enumerate(ks):
                own = np.zeros(len(ws), np.int64)
                for w in np.unique(ws).tolist():
                    own[ws == w] = _distances(x[ws == w], best[w][j][1]).argmin(1) + 1
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(np.full(len(ws), k), pa.int64()), pa.array(own, pa.int64())], [*names, "num_clusters", "cluster"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema.fields)
    return data.mapInArrow(label, f"{types}, num_clusters bigint, cluster bigint")


def first_bin_vectors(binned: DataFrame, start_year: int) -> DataFrame:
    """firm, province, num_workers, cdf of the records' first year cluster, on the grid of average weekly earnings of all year clusters:
    what firms are clustered by. binned has worker, firm, province, year_cluster, paid_weeks, earnings."""
    cells = cut(prep.avg_weekly_earnings(binned, ["worker", "year_cluster", "firm", "province"]))
    dists = group_distributions(cells, ["year_cluster", "firm", "province"], "avg_weekly_earnings", wage_grid(cells, "avg_weekly_earnings"))
    return distribution_vectors(dists.where(F.col("year_cluster") == start_year).drop("year_cluster"), ["firm", "province"])


def clusterings(matches: Callable[[int], DataFrame], start_years: list[int], bin_sizes: list[int], ks: list[int], last_year: int) -> DataFrame:
    """start_year, year_cluster_size, num_clusters, firm, province, num_workers, firm_type for the whole grid of start years, bin sizes that
    fit and numbers of clusters; matches gives the records from a start year on."""
    parts = []
    for start in start_years:
        records = cut(matches(start))
        for size in [n for n in bin_sizes if n <= last_year - start + 1]:
            v = first_bin_vectors(prep.always_present(prep.year_bins(records, size)), start)
            parts.append(v.select(F.lit(start).cast("bigint").alias("start_year"), F.lit(size).cast("bigint").alias("year_cluster_size"), "*"))
    return cluster(union_all(parts), ["start_year", "year_cluster_size", "province"], ks).withColumnRenamed("cluster", "firm_type").drop("cdf")
