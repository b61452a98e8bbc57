"""What every operator needs from the session."""

from __future__ import annotations

import os
import tempfile
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut, kept in the folder that spark.checkpoint.dir names.

    A folder of our own is set only where the session names none and runs in one process, as in tests.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="panelith-"))
    return df.checkpoint()


def reach_workers(spark: SparkSession) -> None:
    """Lets Python workers that see this folder import the package, wherever they were started, and keeps their matrix products to
    the core that their task has. Clusters whose machines don't share the folder take the package as --py-files."""
    for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS"):
        spark.sparkContext.environment.setdefault(name, "1")
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parent.parent)
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def union_all(dfs: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, dfs)
