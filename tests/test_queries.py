import os

import pytest
from panelith.plans import registry

from sqlcheck import same

SF = "/root/testdata/sf0.001"
#: Queries that are not run twice.
LONG = {"firm_clusters", "loo_candidates", "loo_sim_ests", "loo_err_stats", "bootstrap_twfe_ci", "pipeline_err_stats", "pipeline_err_summaries"}
#: Queries of records that are too few at this scale for a cohort or a case.
EMPTY = {"pipeline_err_stats", "pipeline_err_summaries"}
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@needs_data
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    same(spark, registry.queries()[name], registry.oracle_sql()[name], SF)


@needs_data
@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    """Rows, no column of nulls only, and the same rows again."""
    df = registry.queries()[name](spark, SF)
    shown = lambda rows: sorted(tuple(f"{x:.6g}" if isinstance(x, float) else str(x) for x in r) for r in rows)
    rows = shown(df.collect())
    assert rows or name in EMPTY
    assert name in EMPTY or all(r is not None for r in df.selectExpr(*[f"max(`{c}`)" for c in df.columns]).first())
    assert name in LONG or rows == shown(registry.queries()[name](spark, SF).collect())


@needs_data
def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
@pytest.mark.parametrize("name", ["bootstrap_obs_means", "loo_sim_ests"])
def test_a_hundred_replicates(spark, name):
    assert registry.queries()[name](spark, SF).select("b").distinct().count() == 100
