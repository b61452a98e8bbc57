"""Exact quantiles of one column over any number of rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

MAX_PROBS = 10_000


def quantiles(df: DataFrame, column: str, probs: list[float]) -> list[float]:
    """Quantiles with linear interpolation (position p (n - 1)) of the non-null, non-NaN values; none for empty input.

    Values are counted, spread by range and sorted there; running counts need only a total of each range.
    """
    if len(probs) > MAX_PROBS:
        raise ValueError(f"more than {MAX_PROBS} quantiles")
    v = F.col(column).cast("double")
    counted = df.where(v.isNotNull() & ~F.isnan(v)).groupBy(v.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ranged = cut(counted.repartitionByRange("v").withColumn("part", F.spark_partition_id()))
    parts = {r["part"]: r["n"] for r in ranged.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    if not parts:
        return []
    total, before, offsets = sum(parts.values()), 0, {}
    for k in sorted(parts):
        offsets[k], before = before, before + parts[k]
    at = np.array(probs) * (total - 1)
    ranks = sorted({int(x) for x in np.r_[np.floor(at), np.ceil(at)]})
    start = F.create_map(*[F.lit(x) for kv in offsets.items() for x in kv])[F.col("part")]
    c = F.sum("n").over(Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)) + start
    hit = ranged.withColumn("c", c).withColumn("r", F.filter(F.array(*[F.lit(x) for x in ranks]), lambda r: (r < F.col("c")) & (r >= F.col("c") - F.col("n")))).where(F.size("r") > 0)
    value = {r: row["v"] for row in hit.select("v", "r").collect() for r in row["r"]}
    low = np.floor(at).astype(int)
    return [value[a] + (value[min(a + 1, total - 1)] - value[a]) * (x - a) if x > a else value[a] for a, x in zip(low.tolist(), at.tolist(), strict=True)]
