"""From worker-firm records to cells of a panel."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .heavy import heavy_candidates, skew_join, task_share

LOG = logging.getLogger(__name__)


def match_data(earnings: DataFrame, firms: DataFrame, first_year: int, last_year: int, provinces: list[str] | None = None) -> DataFrame:
    """Records with paid weeks in those years, with their firm's attributes in place of their own province; those of firms in
    other or unknown provinces are left out, unless provinces is None. Null years and weeks are left out."""
    e = earnings.drop("province").where(F.col("year").between(first_year, last_year) & (F.col("paid_weeks") > 0))
    f = firms.withColumnRenamed("firm", "_k")
    if provinces is None:
        return skew_join(e, f, "firm", "left", once=True).drop("_k")
    return skew_join(e, f.where(F.col("province").isin(provinces)), "firm", "inner", once=True).drop("_k")


def year_bins(df: DataFrame, size: int) -> DataFrame:
    """With year_cluster, the first year of the bin of size years, counted from the first year in df."""
    first = df.agg(F.min("year")).scalar()
    return df.withColumn("year_cluster", (first + F.floor((F.col("year") - first) / size) * size).cast("bigint"))


def always_present(df: DataFrame) -> DataFrame:
    """Records whose firm and worker both appear in every year cluster of df; judged once, on df as it is. Null keys drop out."""
    df = cut(df)
    every = df.select("year_cluster").distinct().agg(F.count(F.lit(1))).scalar()

    def in_all(key: str) -> DataFrame:
        pairs = df.where(F.col(key).isNotNull()).select(key, "year_cluster").distinct()
        return pairs.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == every).select("_k")

    return skew_join(skew_join(df, in_all("firm"), "firm", "left_semi", once=True), in_all("worker"), "worker", "left_semi", heavy=heavy_candidates(df, ["worker"], task_share(df))[1]["worker"], once=True)


def log_counts(matches: DataFrame) -> list[tuple]:
    """Logs, and gives, the numbers of records, firms and workers of all matches (province None) and of each province; those
    without a province count in the whole only. Provinces are few."""
    counts = [F.count(F.lit(1)), F.count_distinct("firm"), F.count_distinct("worker")]
    rows = [(None, *matches.agg(*counts).first()), *sorted(tuple(r) for r in matches.where("province IS NOT NULL").groupBy("province").agg(*counts).collect())]
    for province, records, firms, workers in rows:
        LOG.info("%s: %d records of %d firms and %d workers", province or "all", records, firms, workers)
    return rows


def avg_weekly_earnings(df: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of earnings by sum of paid weeks for each group; groups with a null in their keys or earnings drop out.

    Earnings are added as DECIMAL(38,4), so that no order of addition shows.
    """
    rows = df
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    out = rows.groupBy(*keys).agg(F.sum(F.col("earnings").cast("decimal(28,4)")).alias("e"), F.sum("paid_weeks").alias("w"), F.count_if(F.col("earnings").isNull()).alias("nulls"))
    return out.where("nulls = 0 AND w > 0").select(*keys, (F.col("e").cast("double") / F.col("w")).alias("avg_weekly_earnings"))


def outcome_label(*parts: str) -> Column:
    """Parts joined by '_'; null if one is null."""
    cols = [x for p in parts for x in (F.lit("_"), F.col(p).cast("string"))]
    return F.concat(*cols[1:])


def log_cells(df: DataFrame, unit: str, outcome: Column) -> DataFrame:
    """unit, outcome, value: the log of positive average weekly earnings."""
    return df.where("avg_weekly_earnings > 0").select(F.col(unit).alias("unit"), outcome.alias("outcome"), F.ln("avg_weekly_earnings").alias("value"))
