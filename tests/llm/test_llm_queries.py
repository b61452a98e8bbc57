import os

import pytest
from panelith.llm import queries

from sqlcheck import same

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@needs_data
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    same(spark, queries.QUERIES[name], queries.SQL[name], SF)


@needs_data
@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_without_sql_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


@needs_data
def test_combined_days_have_every_group(spark, monkeypatch):
    """Firms and provinces alike, from summaries by load day; groups this small lose nothing in them."""
    keys = []
    made = queries.percentiles.summaries
    monkeypatch.setattr(queries.percentiles, "summaries", lambda rows, by, *x: keys.append(by) or made(rows, by, *x))
    got, want = (sorted(map(tuple, q(spark, SF).collect()), key=str) for q in (queries.p3_combined_days, queries.p3_percentiles))
    assert got == want and {r[0] for r in got} == {"firm", "province"}
    assert keys == [["load_day", *queries.BY]]
