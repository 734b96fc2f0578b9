"""Sector, membership and benchmark context."""

from pyspark.sql import DataFrame, Window, functions as F

from .paging import looked_up, offsets_before, range_bucket

# Fixed value: number of categories in the taxonomy that ranks are valid for.
RANKED_CATEGORIES = 49


def sector_leaders(sectors: DataFrame, k: int = 10) -> DataFrame:
    """Top and bottom k sectors by change, each a distributed top-k."""
    top = sectors.orderBy(F.col("change_percent").desc(), "code").limit(k)
    bottom = sectors.orderBy(F.col("change_percent").asc(), "code").limit(k)
    return top.select(F.lit("leaders").alias("direction"), "*").unionByName(
        bottom.select(F.lit("laggards").alias("direction"), "*")
    )


def sector_context(primary: DataFrame, fallback: DataFrame, k: int = 10) -> DataFrame:
    """Leaders and laggards of one provider taxonomy.

    The fallback taxonomy is used whole, only when the primary has no rows;
    the two are never merged.
    """
    present = primary.limit(1).agg(F.count("*").alias("n"))
    use_primary = present.select(F.max(F.col("n") > 0)).scalar()
    a = sector_leaders(primary, k).filter(use_primary).withColumn("selection_reason", F.lit("PRIMARY"))
    b = sector_leaders(fallback, k).filter(~use_primary).withColumn(
        "selection_reason", F.lit("PRIMARY_UNAVAILABLE_WHOLE_FALLBACK")
    )
    return a.unionByName(b)


def rank_sectors(sectors: DataFrame, expected_size: int | None = RANKED_CATEGORIES, name="rank_descending") -> DataFrame:
    """Competition rank by change, NULL unless the taxonomy has its known size.

    Ranks come from counts per distinct change value, so ties share a rank.
    Values are ordered inside sampled ranges, and ranges above are counted.
    Rows without a change keep a NULL rank.
    """
    counts = sectors.filter("change_percent IS NOT NULL").groupBy("change_percent").agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_part", range_bucket(counts, "change_percent"))
    above = offsets_before(counts, "_part", F.sum("_n"), descending=True)
    inside = Window.partitionBy("_part").orderBy(F.col("change_percent").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rank = looked_up(above, "_part") + F.coalesce(F.sum("_n").over(inside), F.lit(0)) + 1
    ranks = counts.select("change_percent", rank.alias("_rank"))
    out = sectors.join(ranks, "change_percent", "left")
    if expected_size is not None:
        size = sectors.agg(F.count("*").alias("n")).scalar()
        return out.withColumn("universe_size", size).withColumn(
            name, F.when(F.col("universe_size") == expected_size, F.col("_rank"))
        ).drop("_rank")
    return out.withColumnRenamed("_rank", name)


def stock_sector_context(membership: DataFrame, sectors: DataFrame, expected_size=RANKED_CATEGORIES) -> DataFrame:
    """Membership joined with its sector on code, then checked on label."""
    ranked = rank_sectors(sectors, expected_size).select(
        F.col("code"), F.col("name").alias("sector_name"), "change_percent", "rank_descending"
    )
    joined = membership.join(ranked, "code", "left")
    found = F.col("sector_name").isNotNull()
    agree = found & (F.col("sector_name") == F.col("name"))
    error = F.when(~found, "MEMBERSHIP_NOT_IN_SECTOR_UNIVERSE").when(~agree, "MEMBERSHIP_SECTOR_LABEL_MISMATCH")
    return joined.select(
        *membership.columns,
        error.alias("error"),
        F.when(agree, F.col("change_percent")).alias("change_percent"),
        F.when(agree, F.col("rank_descending")).alias("rank_descending"),
        agree.alias("available"),
    )


def market_context(benchmarks: DataFrame, leaders: DataFrame) -> DataFrame:
    """One row: usable benchmarks and sectors; unavailable only if both are empty."""
    b = benchmarks.agg(F.count("*").alias("benchmarks"), F.count_if(F.col("error").isNotNull()).alias("benchmark_errors"))
    s = leaders.agg(F.count("*").alias("n")).scalar()
    usable = F.col("benchmarks") - F.col("benchmark_errors")
    return b.withColumn("sectors", s).withColumn(
        "status", F.when((usable == 0) & (F.col("sectors") == 0), "MARKET_CONTEXT_UNAVAILABLE").otherwise("available")
    )
