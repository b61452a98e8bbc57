"""References to rows that do not exist, or not at the time.

A Bloom filter over the parents' keys, of bounded size and sent along as a scalar subquery, proves most unknown keys
absent without a join. References it lets pass are verified exactly against the parents' validity intervals.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .heavy import heavy_candidates, skew_join, task_share

#: Bits of the filter for one key, and the most for all: 32 MB, for 26 million keys. Beyond that more references are verified, none
#: is lost.
BITS_PER_KEY, MAX_BITS = 10, 1 << 28
HASHES = 4


def _positions(key: Column, bits: int) -> list[Column]:
    a, b = F.xxhash64(key), F.xxhash64(key, F.lit(1))
    return [F.pmod(a.bitwiseXOR(F.shiftleft(b, i)) if i else a, F.lit(bits).cast("bigint")) for i in range(HASHES)]


def bloom_filter(keys: DataFrame, key: str) -> tuple[DataFrame, int]:
    """One row with words ARRAY<BIGINT>, the filter over the non-null values of key; and its number of bits, a power of 2."""
    n = keys.agg(F.approx_count_distinct(key)).first()[0]
    bits = min(MAX_BITS, max(1 << 12, 1 << math.ceil(math.log2(max(1, n) * BITS_PER_KEY))))
    at = keys.where(F.col(key).isNotNull()).select(F.explode(F.array(*_positions(F.col(key), bits))).alias("p"))
    words = at.groupBy((F.shiftright("p", 6)).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p & 63L AS INT))")).alias("v"))
    zeros = keys.sparkSession.range(bits // 64).select(F.col("id").alias("w"), F.lit(0).cast("bigint").alias("v"))
    dense = words.union(zeros).groupBy("w").agg(F.bit_or("v").alias("v"))
    return dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "v"))), lambda x: x["v"]).alias("words")), bits


def might_contain(words: Column, key: Column, bits: int) -> Column:
    def hit(p: Column) -> Column:
        bit = F.call_function("shiftright", F.get(words, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63).cast("bigint")).cast("int"))
        return bit.bitwiseAND(F.lit(1).cast("bigint")) == 1

    first, *rest = [hit(p) for p in _positions(key, bits)]
    for x in rest:
        first = first & x
    return first


def validity(parents: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """_k, valid_from, valid_until (exclusive, null: open): for each key the disjoint intervals in which some row is valid.

    Rows are valid from start up to end; a null end is open; rows with a null key or start, or that end before they start,
    are never valid. Repeated rows are merged before the shuffle; overlapping ones within a key and year first, so that a
    key with very many rows reaches its last window already merged.
    """
    far = F.lit("9999-12-31 00:00:00").cast("timestamp_ntz")
    rows = (
        parents.select(F.col(key).alias("_k"), F.col(start).cast("timestamp_ntz").alias("a"), F.coalesce(F.col(end).cast("timestamp_ntz"), far).alias("b"))
        .where(F.col("_k").isNotNull() & F.col("a").isNotNull() & (F.col("a") < F.col("b")))
        .groupBy("_k", "a").agg(F.max("b").alias("b"))
    )

    def merged(df: DataFrame, by: list) -> DataFrame:
        w = Window.partitionBy(*by).orderBy("a", "b")
        before = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
        island = F.sum(F.when(before >= F.col("a"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
        return df.withColumn("i", island).groupBy(*by, "i").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("i")

    by_year = merged(rows.withColumn("y", F.year("a")), ["_k", "y"]).drop("y")
    return merged(by_year, ["_k"]).select("_k", F.col("a").alias("valid_from"), F.when(F.col("b") < far, F.col("b")).alias("valid_until"))


def orphans(children: DataFrame, key: str, at: str, parents: DataFrame, parent_key: str, start: str, end: str) -> DataFrame:
    """The rows of children, as they stand, whose non-null key no parent row holds as valid at the time in column at.

    Null keys refer to nothing and never come out. A null time is valid for no parent, so such a row comes out. Repeated
    rows each count. Without parents every reference is an orphan. Columns of children starting with "_" are not allowed.
    """
    refs = children.where(F.col(key).isNotNull())
    words, bits = bloom_filter(parents.select(parent_key), parent_key)
    maybe = might_contain(cut(words).scalar(), F.col(key), bits)
    valid = cut(validity(parents, parent_key, start, end)).withColumnsRenamed({"valid_from": "_from", "valid_until": "_until"})
    t = F.col(at).cast("timestamp_ntz")
    within = (F.col("_from") <= t) & (F.col("_until").isNull() | (F.col("_until") > t))
    return refs.where(~maybe).unionByName(skew_join(refs.where(maybe), valid, key, "left_anti", within, heavy=heavy_candidates(refs, [key], task_share(refs))[1][key], once=True))


def orphan_kinds(found: DataFrame, key: str, at: str, parents: DataFrame, parent_key: str, start: str) -> DataFrame:
    """found with kind: 'unknown' (no parent row has the key), 'later' (all its rows start later), else 'deleted'.

    A null time or parent start never counts as earlier.
    """
    first = parents.where(F.col(parent_key).isNotNull()).groupBy(F.col(parent_key).alias("_k")).agg(F.min(F.col(start).cast("timestamp_ntz")).alias("_first"), F.lit(True).alias("_known"))
    kind = F.when(F.col("_known").isNull(), "unknown").when(F.col("_first") <= F.col(at).cast("timestamp_ntz"), "deleted").otherwise("later")
    return skew_join(found, first, key, "left").withColumn("kind", kind).drop("_k", "_first", "_known")
