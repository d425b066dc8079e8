"""Every registered query gives the rows its SQL states, none is empty, none pairs all rows."""

import check
import pytest

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert check.compare(con, df, name).startswith(("ok", "rows"))


def test_entry(spark):
    rows = {r.split: r for r in entry.entry(spark).collect()}
    assert set(rows) == {"train", "test"} and all(0.5 < r.accuracy <= 1 for r in rows.values())
