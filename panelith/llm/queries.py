"""Queries p3, p4, p6, p7 and p8, and their SQL where it can express them."""

from __future__ import annotations

from functools import reduce
from operator import add, and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import leaks, mixing, percentiles, residue, set_sketches
from .provinces import with_province


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents", ["doc_id", "text"]), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p6_item_report(spark: SparkSession, d: str) -> DataFrame:
    found = leaks.leaks(table(spark, d, "documents", ["doc_id", "text"]), table(spark, d, "eval_items"))
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"), F.count_if("answered").alias("n_answered"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "documents", ["doc_id", "text"]))


SHARES = [0.1, 0.25, 0.5, 0.75, 0.9]


def _grouped(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "earnings", ["matr_az", "cod_pgr", "anno", "sett_r", "retrib03", "loaded_at"])
    return with_province(e, table(spark, d, "firms", ["matr_az", "prov", "loaded_at"]))


def _readings(spark: SparkSession, d: str) -> DataFrame:
    return _grouped(spark, d).select("matr_az", "prov", "anno", F.to_date("loaded_at").alias("load_day"), "retrib03", F.col("sett_r").cast("double").alias("sett_r"))


#: A firm in a year and a province in a year.
LEVELS = {"firm": ["matr_az!", "prov", "anno"], "province": ["prov", "anno"]}
BY, MEASURES = ["matr_az", "prov", "anno"], ["retrib03", "sett_r"]
GROUP = ["level", *BY, "measure"]


def p3_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return percentiles.percentiles(_readings(spark, d), BY, MEASURES, LEVELS, SHARES)


def p3_combined_days(spark: SparkSession, d: str) -> DataFrame:
    """Each load day is summed up by itself; percentiles are read off the union of the days' summaries."""
    days = {level: ["load_day", *named] for level, named in LEVELS.items()}
    return percentiles.combined(percentiles.summaries(_readings(spark, d), ["load_day", *BY], MEASURES, days), GROUP, SHARES)


def p3_rank_errors(spark: SparkSession, d: str) -> DataFrame:
    """Whether the combined days' percentiles keep the stated error, against all values of each group."""
    out = percentiles.rank_errors(_readings(spark, d), BY, MEASURES, LEVELS, p3_combined_days(spark, d), SHARES)
    return out.select(*GROUP, "n", (F.col("error") <= percentiles.EPSILON).alias("within"))


DIMS = ["load_day", "anno", "prov"]


def _sets(spark: SparkSession, d: str) -> DataFrame:
    rows = _grouped(spark, d).withColumn("load_day", F.to_date("loaded_at"))
    return set_sketches.sketches(rows, DIMS, ["cod_pgr", "matr_az"])


def p4_distinct_counts(spark: SparkSession, d: str) -> DataFrame:
    out = set_sketches.counts(_sets(spark, d))
    level = F.concat_ws(",", *[F.when(F.col("level").bitwiseAND(F.lit(1 << i)) > 0, c) for i, c in enumerate(DIMS)])
    return out.select(level.alias("level"), *DIMS, "field", *[F.round(c, 2).alias(c) for c in ("estimate", "low", "high")])


def p4_within_bounds(spark: SparkSession, d: str) -> DataFrame:
    """The exact number of each group, and whether the estimate lies within five standard errors of it (and one for rounding)."""
    rows = _grouped(spark, d).withColumn("load_day", F.to_date("loaded_at")).select(*[F.col(c).cast("string").alias(c) for c in DIMS], "cod_pgr", "matr_az")
    bits = [(1 - F.grouping(c)) * (1 << i) for i, c in enumerate(DIMS)]
    exact = rows.cube(*DIMS).agg(reduce(add, bits).cast("int").alias("level"), F.count_distinct("cod_pgr").alias("cod_pgr"), F.count_distinct("matr_az").alias("matr_az"))
    exact = exact.unpivot(["level", *DIMS], ["cod_pgr", "matr_az"], "field", "n").withColumnsRenamed({c: f"_{c}" for c in ("level", *DIMS, "field")})
    found = set_sketches.counts(_sets(spark, d))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("level", *DIMS, "field")])
    within = F.abs(F.col("estimate") - F.col("n")) <= 5 * set_sketches.ERROR * F.col("n") + 1
    return found.join(exact, same).select("level", *DIMS, "field", "n", within.alias("within"))


def p4_year_overlaps(spark: SparkSession, d: str) -> DataFrame:
    years = set_sketches.sketches(_grouped(spark, d), ["anno", "prov"], ["cod_pgr", "matr_az"]).where("level = 3")
    a = years.select("field", "prov", F.col("anno").cast("bigint").alias("anno"), F.col("registers").alias("a"))
    b = years.select(F.col("field").alias("f"), F.col("prov").alias("p"), (F.col("anno").cast("bigint") - 1).alias("y"), F.col("registers").alias("b"))
    pairs = a.join(b, (a["field"] == F.col("f")) & a["prov"].eqNullSafe(F.col("p")) & (a["anno"] == F.col("y"))).select("field", "prov", "anno", "a", "b")
    out = set_sketches.overlaps(pairs)
    return out.select("field", "prov", "anno", *[F.round(c, 4).alias(c) for c in out.columns if c not in ("field", "prov", "anno")])


def p7_copies(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents", ["doc_id", "source", "text"]), table(spark, d, "mix_targets"))[0]


def p7_checks(spark: SparkSession, d: str) -> DataFrame:
    """Of each source whether no document is used too often, and whether the tokens are what was wanted to within one document."""
    copies, shares = mixing.mix(table(spark, d, "documents", ["doc_id", "source", "text"]), table(spark, d, "mix_targets"))
    longest = copies.groupBy(F.col("source").alias("_s")).agg(F.max("n_tokens").alias("longest"))
    out = shares.join(longest, F.col("source") == F.col("_s"), "left")
    near = F.abs(F.col("used_tokens") - F.col("wanted_tokens")) <= F.coalesce("longest", F.lit(0)) + 1e-6 * F.col("wanted_tokens")
    return out.select("source", "n_documents", (F.col("most_copies") <= F.col("max_copies")).alias("seldom"), near.alias("near"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents", ["doc_id", "source", "text"]), table(spark, d, "mix_targets"))[1]


QUERIES = {f.__name__: f for f in (p3_percentiles, p3_combined_days, p3_rank_errors, p4_distinct_counts, p4_within_bounds, p4_year_overlaps, p6_found, p6_item_report, p7_copies, p7_checks, p7_shares, p8_found)}
_PICKS = ", ".join(f"max(CASE WHEN i = greatest(1, CAST(ceil({q} * n) AS BIGINT)) THEN v END) AS p{round(100 * q)}" for q in SHARES)
_READINGS = """f AS (SELECT matr_az, arg_max(p, (loaded_at, p)) AS prov FROM (SELECT matr_az, nullif(upper(trim(prov)), '') AS p, loaded_at FROM firms) WHERE p IS NOT NULL AND matr_az IS NOT NULL GROUP BY matr_az),
e AS (SELECT e.matr_az, f.prov, anno, retrib03, CAST(sett_r AS DOUBLE) AS sett_r FROM earnings e LEFT JOIN f ON f.matr_az = e.matr_az),
m AS (SELECT matr_az, prov, anno, 'retrib03' AS measure, retrib03 AS v FROM e UNION ALL SELECT matr_az, prov, anno, 'sett_r', sett_r FROM e),
x AS (SELECT * FROM (SELECT 'firm' AS level, matr_az, prov, anno, measure, v FROM m WHERE matr_az IS NOT NULL UNION ALL SELECT 'province', NULL, prov, anno, measure, v FROM m) WHERE v IS NOT NULL AND NOT isnan(v))"""
SQL: dict[str, str] = {
    "p3_percentiles": f"""WITH {_READINGS},
r AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY level, matr_az, prov, anno, measure) AS n FROM x WINDOW w AS (PARTITION BY level, matr_az, prov, anno, measure ORDER BY v))
SELECT level, matr_az, prov, anno, measure, n, {_PICKS} FROM r GROUP BY level, matr_az, prov, anno, measure, n""",
    "p3_rank_errors": f"WITH {_READINGS} SELECT level, matr_az, prov, anno, measure, count(*) AS n, true AS within FROM x GROUP BY ALL",
    "p4_within_bounds": """WITH f AS (SELECT matr_az, arg_max(p, (loaded_at, p)) AS prov FROM (SELECT matr_az, nullif(upper(trim(prov)), '') AS p, loaded_at FROM firms) WHERE p IS NOT NULL AND matr_az IS NOT NULL GROUP BY matr_az),
e AS (SELECT e.matr_az, cod_pgr, CAST(CAST(loaded_at AS DATE) AS VARCHAR) AS load_day, CAST(anno AS VARCHAR) AS anno, f.prov FROM earnings e LEFT JOIN f ON f.matr_az = e.matr_az),
c AS (SELECT 7 - (grouping(load_day) + 2 * grouping(anno) + 4 * grouping(prov)) AS level, load_day, anno, prov, count(DISTINCT cod_pgr) AS w, count(DISTINCT matr_az) AS m FROM e GROUP BY CUBE (load_day, anno, prov))
SELECT CAST(level AS INTEGER) AS level, load_day, anno, prov, 'cod_pgr' AS field, w AS n, true AS within FROM c WHERE w > 0 UNION ALL SELECT CAST(level AS INTEGER), load_day, anno, prov, 'matr_az', m, true FROM c WHERE m > 0""",
    "p7_checks": """WITH d AS (SELECT lower(replace(trim(source), '-', '_')) AS source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1)
SELECT lower(replace(trim(t.source), '-', '_')) AS source, CAST(coalesce(d.n, 0) AS BIGINT) AS n_documents, true AS seldom, true AS near FROM mix_targets t LEFT JOIN d ON d.source = lower(replace(trim(t.source), '-', '_'))""",
}
