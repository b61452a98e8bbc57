"""Per-key work where a few keys hold most rows.

Heavy keys are found with a mergeable frequent-items sketch, which misses none above its error, and counted exactly.
Joins send the heavy keys' rows through a broadcast of the few rows that belong to them, and the other keys through the
ordinary shuffle; or, where the left side is costly to make and is to be made once, spread the heavy keys' rows over salts in
one shuffle. Null keys match nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, union_all

#: Items the sketch follows at least and at most; its error is at most 3.5 / items of the rows.
TRACKED, MOST_TRACKED = 16_384, 1_000_000
#: Rows of the other side that may be broadcast for the heavy keys.
BROADCAST_ROWS = 200_000
#: Copies of the other side's rows that belong to heavy keys, where these are spread.
SALTS = 64


def heavy_candidates(df: DataFrame, keys: list[str], share: float) -> tuple[int, dict[str, list[int]]]:
    """Rows of df and, for each key column, at most 2 / share + 1 values, among them all with that share of the rows.

    One pass; the sketches merge across partitions and follow more items for lesser shares; below what they can tell, values are
    counted. Nulls count as rows, not as values.
    """
    if not 0 < share <= 1:
        raise ValueError("share must lie above 0 and not above 1")
    tracked = max(TRACKED, 1 << math.ceil(math.log2(8 * 3.5 / share)))
    if tracked > MOST_TRACKED:
        n = df.count()
        return n, {c: [r[0] for r in df.where(F.col(c).isNotNull()).groupBy(c).count().where(F.col("count") >= share * n).select(c).collect()] for c in keys}
    k = int(2 / share) + 1
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.expr(f"approx_top_k(`{c}`, {k}, {tracked})").alias(f"k{i}") for i, c in enumerate(keys)]).first()
    n, least = row["n"], share * row["n"]
    return n, {c: [x["item"] for x in row[f"k{i}"] or [] if x["item"] is not None and x["count"] >= least] for i, c in enumerate(keys)}


def task_share(df: DataFrame) -> float:
    """The share of rows from which a key is heavy for a join: half of an even task's, and 1 % at most."""
    return min(0.01, max(0.5 / int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8 * 3.5 / MOST_TRACKED * 2))


def heavy_keys(df: DataFrame, keys: list[str], share: float = 0.02) -> DataFrame:
    """key_field, key_value, n_rows: the values of each (BIGINT) key column that hold at least that share of all rows of df.

    Empty input gives no rows; null keys count among all rows but are never heavy; ties and repeated rows count as they stand.
    """
    n, found = heavy_candidates(df, keys, share)
    parts = []
    for c in keys:
        hit = df.where(F.col(c).isin(found[c])) if found[c] else df.where(F.lit(False))
        parts.append(hit.groupBy(F.col(c).cast("bigint").alias("key_value")).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(c).alias("key_field"), "key_value", "n_rows"))
    return union_all(parts).where(F.col("n_rows") >= F.lit(share) * F.lit(n))


def skew_join(left: DataFrame, right: DataFrame, key: str, how: str = "left", on: Column | None = None, share: float | None = None, heavy: list[int] | None = None, once: bool = False) -> DataFrame:
    """left joined with right on key (how: inner, left, left_semi or left_anti), with no task left with a heavy key.

    right has the key under the name "_k" beside its own columns; those that left has too get "_right" added. on is a further
    condition. Values of key with at least that share of left's rows (by default task_share) are heavy, unless given. once: left
    is read by one branch only, heavy keys are salted, and so are nulls. Nulls match nothing; either side may be empty.
    """
    right = right.withColumnsRenamed({c: f"{c}_right" for c in right.columns if c in left.columns})
    if heavy is None:
        heavy = heavy_candidates(left, [key], share or task_share(left))[1][key]
    is_heavy = F.col(key).isin(heavy) if heavy else F.lit(False)
    match = F.col(key) == F.col("_k")
    match = match if on is None else match & on
    if once:
        rows = left if how in ("left", "left_anti") else left.where(F.col(key).isNotNull())
        salt = F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)).cast("int")
        salted = rows.withColumn("_salt", F.when(is_heavy | F.col(key).isNull(), salt).otherwise(0))
        every = F.array(F.lit(0)) if not heavy else F.when(F.col("_k").isin(heavy), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        return salted.join(right.withColumn("_rsalt", F.explode(every)), match & (F.col("_salt") == F.col("_rsalt")), how).drop("_salt", "_rsalt")
    light = left.where(F.col(key).isNotNull() & ~is_heavy).join(right.where(~F.col("_k").isin(heavy)) if heavy else right, match, how)
    parts = [light]
    if heavy:
        few = cut(right.where(F.col("_k").isin(heavy)))
        if few.count() <= BROADCAST_ROWS:
            parts.append(left.where(is_heavy).join(F.broadcast(few), match, how))
        else:
            salted = left.where(is_heavy).withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)).cast("int"))
            copies = few.withColumn("_rsalt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            parts.append(salted.join(copies, match & (F.col("_salt") == F.col("_rsalt")), how).drop("_salt", "_rsalt"))
    if how in ("left", "left_anti"):
        nulls = left.where(F.col(key).isNull())
        if how == "left":
            nulls = nulls.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema.fields])
        parts.append(nulls)
    return union_all(parts)


def key_results(records: DataFrame, key: str, member: str, weight: str, value: str, share: float | None = None) -> DataFrame:
    """For each non-null key: n_records, n_members (different), total_value, and n_above, the records whose value per weight
    lies above the key's own (total value by total weight, over records where both are there and the weight is positive).

    Totals are pre-aggregated before they are shuffled; the comparison joins records with their key's totals by skew_join.
    Keys without a usable record have null totals and no n_above. Values are added as DECIMAL(38,4), so that no order of
    addition shows.
    """
    rows = records.select(F.col(key).alias("key"), F.col(member).alias("member"), F.col(weight).alias("w"), F.col(value).alias("v")).where(F.col("key").isNotNull())
    usable = F.col("v").isNotNull() & ~F.isnan("v") & (F.col("w") > 0)
    v, w = F.when(usable, F.col("v")).cast(T.DecimalType(28, 4)), F.when(usable, F.col("w"))
    totals = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n_records"), F.sum(v).alias("t"), F.sum(w).alias("tw"))
    members = rows.groupBy("key", "member").agg(F.lit(1).alias("one")).groupBy("key").agg(F.count("member").alias("n_members"))
    heavy = heavy_candidates(rows, ["key"], share or task_share(rows))[1]["key"]
    bar = totals.where(F.col("tw") > 0).select(F.col("key").alias("_k"), (F.col("t").cast("double") / F.col("tw")).alias("bar"))
    above = skew_join(rows.where(usable).select("key", "w", "v"), bar, "key", "inner", heavy=heavy).where(F.col("v") / F.col("w") > F.col("bar")).groupBy("key").agg(F.count(F.lit(1)).alias("n_above"))
    return (
        totals.join(members, "key").join(above, "key", "left")
        .select("key", "n_records", "n_members", F.col("t").cast("double").alias("total_value"), F.coalesce("n_above", F.lit(0)).cast("bigint").alias("n_above"))
    )
