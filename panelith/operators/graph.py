"""The overlap graph of cohorts. Cohorts hold a least number of units each, so that they are few; edges are found by outcome."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, union_all
from .panel import Panel


def cohort_outcomes(panel: Panel) -> DataFrame:
    """cohort_key, outcome, as the panel's data have them."""
    own = panel.data.groupBy("unit").agg(F.sort_array(F.collect_set("outcome")).alias("c")).select("c").distinct()
    return own.select(F.array_join("c", "; ").alias("cohort_key"), F.explode("c").alias("outcome"))


def overlap_edges(outcomes: DataFrame, r: int) -> DataFrame:
    """src < dst, overlap: pairs of cohorts that share r outcomes at least, found by joining on the outcome."""
    other = outcomes.select(F.col("cohort_key").alias("dst"), "outcome")
    pairs = outcomes.withColumnRenamed("cohort_key", "src").join(other, "outcome").where("src < dst")
    return pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("overlap")).where(F.col("overlap") >= r)


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select("dst", "src"))


def components(outcomes: DataFrame, r: int) -> DataFrame:
    """cohort_key, component: the least cohort_key that can be reached over edges; labels spread until none changes."""
    nodes = outcomes.select("cohort_key").distinct()
    edges = cut(_both_ways(overlap_edges(outcomes, r)))
    labels = cut(nodes.withColumn("component", F.col("cohort_key")))
    while True:
        offered = edges.join(labels.withColumnRenamed("cohort_key", "src"), "src").groupBy("dst").agg(F.min("component").alias("offer"))
        # a label's own label is tried too, which halves the steps on long chains
        jump = labels.select(F.col("cohort_key").alias("component"), F.col("component").alias("further"))
        new = labels.join(jump, "component", "left").join(offered.withColumnRenamed("dst", "cohort_key"), "cohort_key", "left")
        new = cut(new.select("cohort_key", F.least("component", F.coalesce("further", "component"), F.coalesce("offer", "component")).alias("next"), "component"))
        if new.where("next < component").isEmpty():
            return labels
        labels = new.select("cohort_key", F.col("next").alias("component"))


def identified_outcomes(outcomes: DataFrame, r: int) -> DataFrame:
    """outcome: those of the component with the most cohorts; on ties that with the least cohort_key."""
    parts = components(outcomes, r)
    best = parts.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return outcomes.join(parts.join(best, "component", "left_semi"), "cohort_key", "left_semi").select("outcome").distinct()


def identified_panel(panel: Panel, r: int) -> Panel:
    kept = [x[0] for x in identified_outcomes(cohort_outcomes(panel), r).collect()]
    return panel.restricted(kept)


def hop_distances(outcomes: DataFrame, r: int) -> DataFrame:
    """cohort_key, outcome, distance: least number of edges to a cohort with the outcome; null where none is reached.

    Outcomes spread along the edges, a step at a time, so that there is a row for each cohort and outcome, not for each pair of cohorts.
    """
    edges = cut(_both_ways(overlap_edges(outcomes, r)).withColumnsRenamed({"src": "cohort_key", "dst": "to"}))
    front = cut(outcomes.select("cohort_key", "outcome", F.lit(0).cast("bigint").alias("distance")).distinct())
    steps = [front]
    while not front.isEmpty():
        reached = front.join(edges, "cohort_key").select(F.col("to").alias("cohort_key"), "outcome").distinct()
        front = cut(reached.join(union_all(steps), ["cohort_key", "outcome"], "left_anti").withColumn("distance", F.lit(len(steps)).cast("bigint")))
        steps.append(front)
    # what a report needs: a row for every cohort and outcome, the outcomes of a panel being few
    every = outcomes.select("cohort_key").distinct().join(outcomes.select("outcome").distinct(), F.lit(True))
    return every.join(union_all(steps), ["cohort_key", "outcome"], "left").select("cohort_key", "outcome", "distance")
