"""Watchlist pages per owner."""

from pyspark.sql import functions as F

from barloom.operators import watchlist as W

ENTRY = "owner string, symbol string, name string, verified_at int"


def pages(spark, entries, preferences, **more):
    out = W.watchlist_pages(spark.createDataFrame(entries, ENTRY), spark.createDataFrame(preferences, "owner string, selected_symbol string"), **more)
    return {r.owner: ([i.symbol for i in r["items"]], r.selected and r.selected.name, r.total, r.has_more, r.next_after) for r in out.collect()}


def test_pages_of_owners(spark):
    entries = [("a", f"s{i}", f"n{i}", i) for i in (3, 1, 2, 4)] + [("b", "s9", None, None), (None, "s1", "x", 1), ("c", None, "x", 1)]
    chosen = [("a", "s4"), ("b", "s1"), ("d", "s1"), ("b2", None), (None, "s1")]
    assert pages(spark, entries, chosen, limit=2) == {
        "a": (["s1", "s2"], "n4", 4, True, "s2"), "b": (["s9"], None, 1, False, None), "d": ([], None, 0, False, None), "b2": ([], None, 0, False, None)}
    assert pages(spark, entries, chosen, limit=2, after=F.lit("s2"))["a"] == (["s3", "s4"], "n4", 4, False, None)
    assert pages(spark, entries, chosen, limit=4)["a"][3:] == (False, None)


def test_no_watchlists(spark):
    assert pages(spark, [], []) == {}


def test_pages_are_cut_before_the_shuffle(spark):
    df = spark.range(10).selectExpr("CAST(id % 3 AS STRING) AS owner", "CAST(id AS STRING) AS symbol", "'n' AS name", "1 AS verified_at")
    plan = W.watchlist_pages(df, df.selectExpr("owner", "symbol AS selected_symbol"), limit=2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
