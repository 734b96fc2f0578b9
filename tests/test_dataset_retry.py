"""Dataset queries on symbols that lack bars at the target session."""

import pytest

from barloom import testbed as T
from suite import ledgers
from test_repeated_symbols import check


@pytest.fixture(scope="module")
def traded(spark, tmp_path_factory):
    """Ten symbols with weekly lines: 2 and 6 without one in the target week, 7 with lines of that week only."""
    folder = tmp_path_factory.mktemp("traded")
    lines = spark.range(0, 340 * 10).selectExpr("id", "id % 10 AS n", "date_add(DATE '1995-01-02', CAST(floor(id / 10) * 7 AS INT)) AS day")
    lines = lines.filter("NOT (n IN (2, 6) AND day = DATE '2001-06-18') AND (n <> 7 OR day = DATE '2001-06-18')")
    lines.selectExpr(
        "id AS l_orderkey", "id % 997 AS l_partkey", "n * 4 AS l_suppkey", "1 AS l_linenumber", "10.0D AS l_quantity",
        "1000.0D + (id * 37) % 501 AS l_extendedprice", "timestamp(day) AS l_shipdate").write.parquet(f"{folder}/lineitem.parquet")
    return folder


@pytest.mark.parametrize("name", ["k07_commit_dataset", "a20_dataset_store", "j21_publish_dataset"])
def test_symbols_without_a_bar_at_the_target_session(spark, traded, name):
    check(spark, traded, name, "lineitem")


def test_lines_are_grouped_once_for_sessions_and_months(spark, traded):
    """Sessions and months are those of session_bars, and dataset bars read the stored sessions, not the lines again."""
    for interval, bars in zip(("1d", "1mo"), T.session_and_month_bars(spark, str(traded)), strict=True):
        want = T.session_bars(spark, str(traded), interval)
        assert bars.dtypes == want.dtypes
        assert sorted(bars.collect()) == sorted(want.collect())
    plan = ledgers._dataset_bars(spark, str(traded), True)._jdf.queryExecution().executedPlan().toString()
    assert "l_shipdate" not in plan
