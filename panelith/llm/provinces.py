"""The province of a firm, for grouping its records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.heavy import skew_join

#: Firms up to which their provinces may be broadcast: about 4 MB.
BROADCAST_FIRMS = 100_000


def with_province(earnings: DataFrame, firms: DataFrame) -> DataFrame:
    """earnings with prov: of its firm's registry rows with a province (blanks and case aside) that of the latest loaded, the
    greater on ties; null where the firm has none, is unknown or is null."""
    prov = F.nullif(F.upper(F.trim("prov")), F.lit(""))
    known = firms.select(F.col("matr_az").alias("_k"), prov.alias("_p"), "loaded_at").where(F.col("_k").isNotNull() & F.col("_p").isNotNull())
    last = known.groupBy("_k").agg(F.max(F.struct("loaded_at", "_p"))["_p"].alias("prov"))
    if last.limit(BROADCAST_FIRMS + 1).count() <= BROADCAST_FIRMS:
        return earnings.join(F.broadcast(last), earnings["matr_az"] == F.col("_k"), "left").drop("_k")
    return skew_join(earnings, last, "matr_az", "left").drop("_k")
