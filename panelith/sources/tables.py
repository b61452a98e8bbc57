"""Readers that rename and cast at the boundary, and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Provinces of the region under study, a fixed value.
PROVINCES = ["BL", "PD", "RO", "TV", "VE", "VR", "VI"]


def earnings(spark: SparkSession, path: str) -> DataFrame:
    """worker, firm, year, paid_weeks, paid_days, earnings, province (empty as null)."""
    return spark.read.parquet(path).select(
        F.col("cod_pgr").cast("bigint").alias("worker"), F.col("matr_az").cast("bigint").alias("firm"), F.col("anno").cast("bigint").alias("year"), F.col("sett_r").cast("bigint").alias("paid_weeks"),
        F.col("gior_r").cast("bigint").alias("paid_days"), F.col("retrib03").cast("double").alias("earnings"), F.nullif("prov_l", F.lit("")).alias("province"),
    )


def firms(spark: SparkSession, path: str) -> DataFrame:
    """One row a firm: firm, postal_code, city, province, taxation_code of its latest loaded row (ties: the greatest), so that a
    join with it repeats no record."""
    row = F.struct("loaded_at", F.nullif(F.upper(F.trim("prov")), F.lit("")).alias("province"), F.col("cap").cast("bigint").alias("postal_code"), F.nullif("comune", F.lit("")).alias("city"), F.col("csc").cast("bigint").alias("taxation_code"))
    last = spark.read.parquet(path).where("matr_az IS NOT NULL").groupBy(F.col("matr_az").cast("bigint").alias("firm")).agg(F.max(row).alias("r"))
    return last.select("firm", "r.postal_code", "r.city", "r.province", "r.taxation_code")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Replaces what is at path; by: columns of Hive-style directories, as start_year=/year_cluster_size=/num_clusters= for clusters."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def unfinished(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a work list whose keys aren't written yet."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def stata_to_parquet(spark: SparkSession, source: str, target: str, chunk: int = 100_000) -> None:
    """A Stata file on the driver's disk as Parquet, read in chunks."""
    import pandas as pd

    mode = "overwrite"
    with pd.read_stata(source, chunksize=chunk) as parts:
        for part in parts:
            spark.createDataFrame(part).write.mode(mode).parquet(target)
            mode = "append"
