"""Tables behind the plots of panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .panel import Panel


def running(by, *order):
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def cohort_rectangles(panel: Panel) -> DataFrame:
    """cohort_key, outcome, unit_id_min, unit_id_max: units numbered from the largest cohort on, cohort by cohort."""
    sizes = panel.cohort_sizes()
    order = Window.orderBy(F.desc("n_units"), "cohort_key")
    upto = F.sum("n_units").over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = sizes.withColumn("unit_id_max", upto).withColumn("unit_id_min", F.col("unit_id_max") - F.col("n_units") + 1)
    return placed.select("cohort_key", F.explode(F.split("cohort_key", "; ")).alias("outcome"), "unit_id_min", "unit_id_max")


def eigengaps(spectra: DataFrame) -> DataFrame:
    """Cohorts in order of the ratio of an eigenvalue to the one before, by spectrum_idx, as shares; anchored at 0."""
    by = Window.partitionBy("cohort_key").orderBy("spectrum_idx")
    gaps = spectra.withColumn("next", F.lead("eigenvalue").over(by)).where("next IS NOT NULL").withColumn("ratio", F.try_divide("next", "eigenvalue"))
    order, whole = running(["spectrum_idx"], "ratio", "cohort_key"), Window.partitionBy("spectrum_idx")
    out = gaps.select("spectrum_idx", "ratio", (F.count(F.lit(1)).over(order) / F.count(F.lit(1)).over(whole)).alias("share_cohorts"), (F.sum("cohort_size").over(order) / F.sum("cohort_size").over(whole)).alias("share_units"))
    anchor = gaps.select("spectrum_idx").distinct().select("spectrum_idx", *[F.lit(0.0).alias(c) for c in ("ratio", "share_cohorts", "share_units")])
    return out.unionByName(anchor)


def hop_reach(distances: DataFrame, sizes: DataFrame) -> DataFrame:
    """hops, reached, n_cohorts, n_units, share_cohorts, share_units: by hops the numbers of outcomes that cohorts reach when they reach new
    ones there, with the rank of the number among them by all cohorts, and the cumulated units by all. Every cohort has one more
    row at the last hop with the most that any reaches; every hop has an anchor of shares 0 just below the least. Unreached outcomes count nowhere."""
    new = distances.where("distance IS NOT NULL").groupBy("cohort_key", F.col("distance").alias("hops")).agg(F.count(F.lit(1)).alias("n"))
    steps = new.select("cohort_key", "hops", F.sum("n").over(running(["cohort_key"], "hops")).alias("reached"))
    top = steps.agg(F.max("hops").alias("hops"), F.max("reached").alias("reached"))
    ends = steps.select("cohort_key").distinct().join(F.broadcast(top), F.lit(True)).select("cohort_key", "hops", "reached")
    groups = steps.unionByName(ends).join(sizes, "cohort_key").groupBy("hops", "reached").agg(F.count(F.lit(1)).alias("n_cohorts"), F.sum("n_units").alias("n_units"))
    order, whole = running(["hops"], "reached"), Window.partitionBy("hops")
    out = groups.select("hops", F.col("reached").cast("double").alias("reached"), "n_cohorts", "n_units", (F.count(F.lit(1)).over(order) / F.sum("n_cohorts").over(whole)).alias("share_cohorts"), (F.sum("n_units").over(order) / F.sum("n_units").over(whole)).alias("share_units"))
    anchor = groups.select("hops").distinct().join(F.broadcast(groups.agg((F.min("reached") - 1e-10).alias("reached"))), F.lit(True))
    none = F.lit(None).cast("bigint")
    return out.unionByName(anchor.select("hops", "reached", none.alias("n_cohorts"), none.alias("n_units"), F.lit(0.0).alias("share_cohorts"), F.lit(0.0).alias("share_units")))


def sharing_edges(outcomes: DataFrame) -> DataFrame:
    """cohort_l, cohort_r, outcome: a row for each outcome that two cohorts share, both ways."""
    return outcomes.withColumnRenamed("cohort_key", "cohort_l").join(outcomes.withColumnRenamed("cohort_key", "cohort_r"), "outcome").where("cohort_l <> cohort_r").select("cohort_l", "cohort_r", "outcome")


def not_reached_in_two_steps(outcomes: DataFrame) -> DataFrame:
    """cohort_key, outcome: neither observed, nor observed in a cohort that shares an outcome, nor in one that shares one with such."""
    edges = sharing_edges(outcomes).select("cohort_l", "cohort_r").distinct()
    one = edges.join(outcomes.withColumnRenamed("cohort_key", "cohort_r"), "cohort_r").select(F.col("cohort_l").alias("cohort_key"), "outcome")
    two = edges.join(one.withColumnRenamed("cohort_key", "cohort_r"), "cohort_r").select(F.col("cohort_l").alias("cohort_key"), "outcome")
    known = outcomes.select("cohort_key", "outcome").union(one).union(two).distinct()
    every = outcomes.select("cohort_key").distinct().join(F.broadcast(outcomes.select("outcome").distinct()), F.lit(True))
    return every.join(known, ["cohort_key", "outcome"], "left_anti")


def highlighted_cells(rectangles: DataFrame, missing: DataFrame, cohort_key: str) -> DataFrame:
    """The rectangles, and with the same unit ids the cells that cohort_key misses; cell_kind 'observed' or 'missing'."""
    ids = rectangles.where(F.col("cohort_key") == cohort_key).select("cohort_key", "unit_id_min", "unit_id_max").distinct()
    gone = missing.where(F.col("cohort_key") == cohort_key).join(ids, "cohort_key").withColumn("cell_kind", F.lit("missing"))
    return rectangles.withColumn("cell_kind", F.lit("observed")).unionByName(gone, allowMissingColumns=True)


def spell_panel(spells: DataFrame, least: int) -> DataFrame:
    """rider_id, week, cohort for the spells of cohorts with that many riders at least."""
    rows = spells.dropna("any").distinct()
    kept = spell_cohorts(spells, least).select(F.col("first_week").alias("first_week_id"), F.col("last_week").alias("treatment_week_id"), "cohort")
    return rows.join(kept, ["first_week_id", "treatment_week_id"]).select("rider_id", "cohort", F.explode(F.sequence("first_week_id", "treatment_week_id")).alias("week"))


def spell_cohorts(spells: DataFrame, least: int) -> DataFrame:
    """first_week, last_week, cohort, n_riders of spells between the same weeks with that many riders at least. Spells with a null
    week drop out, repeated rows count once; weeks are padded to two digits and never cut."""
    pad = lambda c: F.when(F.length(F.col(c).cast("string")) >= 2, F.col(c).cast("string")).otherwise(F.lpad(F.col(c).cast("string"), 2, "0"))
    rows = spells.dropna("any").distinct().withColumns({"first_week": F.col("first_week_id"), "last_week": F.col("treatment_week_id")})
    return rows.groupBy("first_week", "last_week").agg(F.count(F.lit(1)).alias("n_riders")).where(F.col("n_riders") >= least).withColumn("cohort", F.concat(pad("first_week"), F.lit(" - "), pad("last_week")))


def spell_weeks(spells: DataFrame) -> DataFrame:
    """rider_id, week: every week from the first to the last, either way round; null weeks and repeated rows drop out."""
    rows = spells.dropna("any").distinct()
    return rows.select("rider_id", F.explode(F.sequence("first_week_id", "treatment_week_id")).alias("week"))


def spell_overlaps(cohorts: DataFrame) -> DataFrame:
    """cohort_l, cohort_r, weeks_overlapping for cohorts whose half-open intervals overlap, both ways and with themselves.

    Cohorts are spread over their weeks and joined by week, each pair once, at the later of their starts.
    """
    rows = cohorts.where("first_week < last_week").select("cohort", "first_week", "last_week")
    spread = rows.withColumn("week", F.explode(F.sequence("first_week", F.col("last_week") - 1)))
    r = spread.select(F.col("cohort").alias("cohort_r"), F.col("first_week").alias("f"), F.col("last_week").alias("l"), "week")
    pairs = spread.withColumnRenamed("cohort", "cohort_l").join(r, "week").where(F.col("week") == F.greatest("first_week", "f"))
    return pairs.select("cohort_l", "cohort_r", (F.least("last_week", "l") - F.greatest("first_week", "f")).alias("weeks_overlapping"))
