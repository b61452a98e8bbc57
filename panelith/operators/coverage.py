"""How much of the workers' groups a panel keeps and identifies, for a grid of thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import union_all
from . import graph, panel


def cluster_sizes(cells: DataFrame, min_outcomes: int, min_units: int, rank: int) -> DataFrame:
    """min_outcomes, min_units, rank, year_cluster, outcome, num_workers, num_workers_panel, identified, share_workers and
    share_workers_panel (a group's workers in the panel by all workers, and by all in the panel, of its year cluster) for
    cells(unit, outcome 'type_province_year', value). A year without workers in the panel has null shares of it."""
    p = panel.build(cells, min_outcomes, min_units)
    known = graph.identified_outcomes(graph.cohort_outcomes(p), rank).withColumn("identified", F.lit(True))
    kept = cells.join(p.units.select("unit", F.lit(True).alias("in_panel")), "unit", "left")
    n = kept.groupBy("outcome").agg(F.count(F.lit(1)).alias("num_workers"), F.count_if(F.coalesce("in_panel", F.lit(False))).alias("num_workers_panel"))
    n = n.join(known, "outcome", "left").withColumn("identified", F.coalesce("identified", F.lit(False))).withColumn("year_cluster", F.element_at(F.split("outcome", "_"), -1).cast("bigint"))
    year, x = Window.partitionBy("year_cluster"), F.col("num_workers_panel").cast("double")
    shares = [F.try_divide(x, F.sum(c).over(year).cast("double")).alias(s) for c, s in (("num_workers", "share_workers"), ("num_workers_panel", "share_workers_panel"))]
    config = [F.lit(v).cast("bigint").alias(k) for k, v in (("min_outcomes", min_outcomes), ("min_units", min_units), ("rank", rank))]
    return n.select(*config, "year_cluster", "outcome", "num_workers", "num_workers_panel", "identified", *shares)


def over_grid(cells: DataFrame, grid: list[tuple[int, int, int]]) -> DataFrame:
    return union_all([cluster_sizes(cells, *config) for config in grid])


def summary(sizes: DataFrame, settings: list[str] = []) -> DataFrame:  # noqa: B006
    """For each configuration, and settings if sizes has such columns, the least and most over year clusters of what its identified
    groups add up to."""
    by = [*settings, "min_outcomes", "min_units", "rank"]
    years = sizes.where("identified").groupBy(*by, "year_cluster").agg(F.sum("share_workers").alias("share_workers"), F.sum("num_workers").alias("num_workers"), F.sum("num_workers_panel").alias("num_workers_panel"), F.count(F.lit(1)).alias("num_groups"))
    return years.groupBy(*by).agg(*[f(c).alias(f"{n}_{c}") for c in ("share_workers", "num_workers", "num_workers_panel", "num_groups") for f, n in ((F.min, "min"), (F.max, "max"))])
