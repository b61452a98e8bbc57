"""Queries p1, p2 and p5, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import heavy, references, spikes
from ..session import table, union_all


def _references(spark: SparkSession, d: str) -> list[tuple[str, DataFrame]]:
    e = table(spark, d, "earnings").select("rec_id", F.col("matr_az").alias("key"), "loaded_at", F.col("anno").alias("period"))
    c = table(spark, d, "firm_clusters").select("rec_id", F.col("firm").alias("key"), "loaded_at", F.col("start_year").alias("period"))
    return [("earnings", e), ("firm_clusters", c)]


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    firms = table(spark, d, "firms", ["matr_az", "loaded_at", "deleted_at"])
    refs = union_all([x.select(F.lit(name).alias("src_table"), "*") for name, x in _references(spark, d)])
    return references.orphans(refs, "key", "loaded_at", firms, "matr_az", "loaded_at", "deleted_at")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("src_table", "rec_id")


def p1_orphan_report(spark: SparkSession, d: str) -> DataFrame:
    firms = table(spark, d, "firms", ["matr_az", "loaded_at"])
    found = references.orphan_kinds(_orphans(spark, d), "key", "loaded_at", firms, "matr_az", "loaded_at")
    return found.groupBy("src_table", "period", "kind").agg(F.count(F.lit(1)).alias("n_records"), F.count_distinct("key").alias("n_keys"))


def _records(spark: SparkSession, d: str) -> DataFrame:
    day = F.unix_date(F.to_date("loaded_at")).alias("day")
    return table(spark, d, "earnings").select(F.col("rec_id").alias("id"), F.col("feed").alias("source"), F.col("anno").alias("period"), day, F.col("retrib03").alias("pay"), F.col("gior_r").alias("days"), F.col("sett_r").alias("weeks"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return spikes.implausible(_records(spark, d)).select(F.col("id").alias("rec_id"))


def p2_out_of_range(spark: SparkSession, d: str) -> DataFrame:
    return spikes.out_of_range(_records(spark, d)).select(F.col("id").alias("rec_id"))


def p2_stuck(spark: SparkSession, d: str) -> DataFrame:
    return spikes.stuck(_records(spark, d)).select(F.col("id").alias("rec_id"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "earnings", ["matr_az", "cod_pgr"])
    return heavy.heavy_keys(e, ["matr_az", "cod_pgr"], 0.02).select("key_field", "key_value")


def p5_firm_results(spark: SparkSession, d: str) -> DataFrame:
    out = heavy.key_results(table(spark, d, "earnings"), "matr_az", "cod_pgr", "sett_r", "retrib03")
    return out.select(F.col("key").alias("matr_az"), "n_records", F.col("n_members").alias("n_workers"), F.round("total_value", 2).alias("total_pay"), "n_above")


def p5_worker_results(spark: SparkSession, d: str) -> DataFrame:
    out = heavy.key_results(table(spark, d, "earnings"), "cod_pgr", "matr_az", "sett_r", "retrib03")
    return out.select(F.col("key").alias("cod_pgr"), "n_records", F.col("n_members").alias("n_firms"), F.round("total_value", 2).alias("total_pay"), "n_above")


QUERIES = {f.__name__: f for f in (p1_found, p1_orphan_report, p2_found, p2_out_of_range, p2_stuck, p5_found, p5_firm_results, p5_worker_results)}

_REFS = """refs AS (SELECT 'earnings' AS src_table, rec_id, matr_az AS k, loaded_at AS t, anno AS period FROM earnings WHERE matr_az IS NOT NULL
  UNION ALL SELECT 'firm_clusters', rec_id, firm, loaded_at, start_year FROM firm_clusters WHERE firm IS NOT NULL),
orphans AS (SELECT * FROM refs WHERE NOT EXISTS (SELECT 1 FROM firms f WHERE f.matr_az = refs.k AND f.loaded_at <= refs.t AND (f.deleted_at IS NULL OR f.deleted_at > refs.t)))"""


def _results(key: str, member: str, name: str) -> str:
    return f"""WITH x AS (SELECT {key} AS k, {member} AS m, CASE WHEN retrib03 IS NOT NULL AND NOT isnan(retrib03) AND sett_r > 0 THEN CAST(retrib03 AS DECIMAL(28,4)) END AS v,
  CASE WHEN retrib03 IS NOT NULL AND NOT isnan(retrib03) AND sett_r > 0 THEN sett_r END AS w, retrib03 AS raw FROM earnings WHERE {key} IS NOT NULL),
t AS (SELECT k, count(*) AS n_records, count(DISTINCT m) AS n, sum(v) AS t, sum(w) AS tw FROM x GROUP BY k),
a AS (SELECT x.k, count(*) AS n_above FROM x JOIN t ON t.k = x.k WHERE x.v IS NOT NULL AND x.raw / x.w > CAST(t.t AS DOUBLE) / t.tw GROUP BY x.k)
SELECT t.k AS {key}, n_records, n AS {name}, round(CAST(t AS DOUBLE), 2) AS total_pay, CAST(coalesce(n_above, 0) AS BIGINT) AS n_above FROM t LEFT JOIN a ON a.k = t.k"""


def _stuck(c: str) -> str:
    """Records in runs of the values of c that their feed doesn't hold habitually."""
    return f"""SELECT rec_id FROM (SELECT *, count(*) OVER (PARTITION BY feed, g, v) AS k FROM (SELECT rec_id, feed, {c} AS v, worked, row_number() OVER (PARTITION BY feed ORDER BY rec_id) - row_number() OVER (PARTITION BY feed, {c} ORDER BY rec_id) AS g FROM e)) r
WHERE v IS NOT NULL AND k >= 8 AND worked AND NOT EXISTS (SELECT 1 FROM (SELECT feed, v, count(*) AS held FROM (SELECT feed, anno, {c} AS v, count(*) AS n FROM e WHERE {c} IS NOT NULL GROUP BY ALL) x
 JOIN (SELECT feed AS f, anno AS a, count(*) AS total FROM e GROUP BY ALL) t ON f = feed AND a = anno AND n >= 0.15 * total GROUP BY ALL) h JOIN (SELECT feed AS f, count(DISTINCT anno) AS years FROM e GROUP BY 1) y ON f = feed WHERE h.feed = r.feed AND h.v = r.v AND held * 2 >= years)"""


SQL = {
    "p2_out_of_range": """SELECT rec_id FROM earnings WHERE (retrib03 < 0 OR gior_r < 0 OR sett_r < 0) OR sett_r > 53 OR gior_r > 366 OR (sett_r BETWEEN 0 AND 53 AND gior_r > 7 * sett_r)""",
    "p2_stuck": f"""WITH e AS (SELECT rec_id, coalesce(feed, chr(1)) AS feed, coalesce(anno, -1) AS anno, CASE WHEN NOT isnan(retrib03) THEN retrib03 END AS pay, CAST(gior_r AS DOUBLE) AS days, CAST(sett_r AS DOUBLE) AS weeks,
 NOT (coalesce(retrib03 = 0, true) AND coalesce(gior_r = 0, true) AND coalesce(sett_r = 0, true)) AS worked FROM earnings)
SELECT DISTINCT rec_id FROM ({" UNION ALL ".join(map(_stuck, ("pay", "days", "weeks")))})""",
    "p1_found": f"WITH {_REFS} SELECT src_table, rec_id FROM orphans",
    "p1_orphan_report": f"""WITH {_REFS}, first AS (SELECT matr_az AS k, min(loaded_at) AS f FROM firms GROUP BY 1)
SELECT src_table, period, CASE WHEN first.k IS NULL THEN 'unknown' WHEN f <= t THEN 'deleted' ELSE 'later' END AS kind, count(*) AS n_records, count(DISTINCT orphans.k) AS n_keys
FROM orphans LEFT JOIN first ON first.k = orphans.k GROUP BY 1, 2, 3""",
    "p5_found": """SELECT 'matr_az' AS key_field, matr_az AS key_value FROM earnings WHERE matr_az IS NOT NULL GROUP BY matr_az HAVING count(*) >= 0.02 * (SELECT count(*) FROM earnings)
UNION ALL SELECT 'cod_pgr', cod_pgr FROM earnings WHERE cod_pgr IS NOT NULL GROUP BY cod_pgr HAVING count(*) >= 0.02 * (SELECT count(*) FROM earnings)""",
    "p5_firm_results": _results("matr_az", "cod_pgr", "n_workers"),
    "p5_worker_results": _results("cod_pgr", "matr_az", "n_firms"),
}
