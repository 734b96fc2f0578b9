"""Queries against their SQL on keys that only larger tables hold."""

import duckdb
import pytest

import __spark_entry__ as entry


def rows(values):
    return sorted((tuple(r) for r in values), key=repr)


def check(spark, folder, name, *tables):
    """The query's rows equal its SQL's, whatever their order."""
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = entry.queries()[name](spark, str(folder)).select(*columns).collect()
    assert rows(got) == rows(want.fetchall())


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """Part keys of two directories: the second has the first one's symbols again."""
    folder = tmp_path_factory.mktemp("parts")
    keys = spark.range(0, 400).unionByName(spark.range(16000, 16400))
    keys.selectExpr("id AS p_partkey", "concat('part ', id) AS p_name", "CAST(id % 37 AS INT) AS p_size").write.parquet(f"{folder}/part.parquet")
    return folder


@pytest.mark.parametrize("name", ["j24_curated_pool", "c09_pool_semi_join"])
def test_pool_members_belong_to_their_directory(spark, parts, name):
    check(spark, parts, name, "part")


@pytest.mark.parametrize("name", ["j19_run_ledger", "c07_ledger_counts", "c08_ledger_violations"])
def test_results_belong_to_the_member_of_their_directory(spark, parts, name):
    check(spark, parts, name, "part")


def test_pairs_of_lists_in_several_volumes(spark, parts):
    check(spark, parts, "j12_two_lists", "part")


def test_marker_of_a_wrong_code_is_no_code(spark, tmp_path):
    """Supplier 4000 has the code 000000."""
    days = spark.range(0, 40).selectExpr("timestamp(date_add(DATE '1998-01-01', CAST(id AS INT))) AS l_shipdate", "id AS l_orderkey")
    lines = days.selectExpr("l_orderkey", "l_orderkey + 1 AS l_partkey", "explode(array(3L, 4000L)) AS l_suppkey", "1 AS l_linenumber",
                            "10.0D AS l_quantity", "100.0D + l_orderkey AS l_extendedprice", "l_shipdate")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    check(spark, tmp_path, "a01_tilde_quotes", "lineitem")


def test_every_completed_minute_of_a_session_counts(spark, tmp_path):
    minutes = spark.range(0, 300).selectExpr("id AS event_id", "timestamp_seconds(1705708800 + id * 60) AS ts", "'click' AS event_type", "CAST(id AS DOUBLE) AS value")
    minutes.write.parquet(f"{tmp_path}/events.parquet")
    check(spark, tmp_path, "b14_completion_filter", "events")


@pytest.fixture(scope="module")
def suppliers(spark, tmp_path_factory):
    """Groups of four suppliers whose symbols stand again 8000 groups later, with weekly lines of the first ones."""
    folder = tmp_path_factory.mktemp("suppliers")
    keys = spark.range(0, 400).unionByName(spark.range(32000, 32400))
    keys.selectExpr("id AS s_suppkey", "concat('supplier ', id) AS s_name").write.parquet(f"{folder}/supplier.parquet")
    lines = spark.range(0, 340 * 100).selectExpr(
        "id AS l_orderkey", "id % 997 AS l_partkey", "id % 100 * 4 AS l_suppkey", "1 AS l_linenumber", "10.0D AS l_quantity",
        "1000.0D + (id * 37) % 501 AS l_extendedprice", "timestamp(date_add(DATE '1995-01-02', CAST(floor(id / 100) * 7 AS INT))) AS l_shipdate")
    lines.write.parquet(f"{folder}/lineitem.parquet")
    return folder


@pytest.mark.parametrize("name", ["c14_suspension_join", "j17_rule_screen", "j17_screen_counts"])
def test_stocks_belong_to_their_catalog_number(spark, suppliers, name):
    check(spark, suppliers, name, "supplier", "lineitem")
