"""Private watchlists: a page per owner with the selected entry."""

from pyspark.sql import Column, DataFrame, Window, functions as F


def selected_entries(watchlist: DataFrame, preferences: DataFrame) -> DataFrame:
    """(owner, selected): the entry an owner's preference names; a preference for an absent entry gives no row."""
    entry = F.struct("symbol", "name", "verified_at").alias("selected")
    chosen = preferences.select("owner", F.col("selected_symbol").alias("symbol"))
    return watchlist.join(chosen, ["owner", "symbol"]).select("owner", entry)


def watchlist_pages(watchlist: DataFrame, preferences: DataFrame, after: Column | None = None, limit=100) -> DataFrame:
    """One row per owner: items after a symbol, selected entry, total, has_more and next_after.

    watchlist: one row per owner and symbol, with name and verified_at;
    preferences: one row per owner, selected_symbol. Rows are cut to a page
    by rank before they are shuffled, so an owner may hold any share of them.
    Owners with a preference but without entries have an empty page; rows
    without an owner or symbol belong to nobody.
    """
    own = watchlist.filter("owner IS NOT NULL AND symbol IS NOT NULL")
    rows = own if after is None else own.filter(F.col("symbol") > after)
    rank = F.row_number().over(Window.partitionBy("owner").orderBy("symbol", "verified_at", "name"))
    rows = rows.withColumn("_rank", rank).filter(F.col("_rank") <= limit + 1)
    page = rows.groupBy("owner").agg(F.sort_array(F.collect_list(F.struct("_rank", "symbol", "name", "verified_at"))).alias("_page"))
    totals = own.groupBy("owner").agg(F.count("*").alias("total"))
    owners = preferences.filter("owner IS NOT NULL").select("owner").distinct()
    out = totals.join(page, "owner", "left").join(selected_entries(own, preferences), "owner", "left").join(owners, "owner", "full")
    got = F.coalesce("_page", F.array().cast(page.schema["_page"].dataType))
    items = F.transform(F.slice(got, 1, limit), lambda x: x.dropFields("_rank"))
    more = F.size(got) > limit
    return out.select(
        "owner", items.alias("items"), "selected", F.coalesce("total", F.lit(0)).alias("total"), more.alias("has_more"),
        F.when(more, F.get(got, F.lit(limit - 1))["symbol"]).alias("next_after"))
