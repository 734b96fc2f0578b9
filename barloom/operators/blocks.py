"""Row blocks: bounded partitions for ordered work over series of any length.

A series may hold most of a table. Ordered work over it is cut into blocks:
a two-level count gives each row its index, the index gives a block, and each
window then runs inside one block, with a short halo of earlier rows or a
carry from the preceding block.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F


def join_on(left: DataFrame, right: DataFrame, keys, how="inner") -> DataFrame:
    """Join on equal keys where null equals null; the left side's keys are kept."""
    keys = list(keys)
    other = right.select(*[F.col(k).alias(f"_on_{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_on_{i}")) for i, k in enumerate(keys)]
    out = left.join(other, same, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"_on_{i}" for i in range(len(keys))])


def with_row_index(df: DataFrame, keys, order, coarse: Column, name="row_index") -> DataFrame:
    """Zero-based row index per key without gathering a key in one task.

    `coarse` is a bucket that rises with `order` (a date, a session) and holds
    a bounded number of rows per key.
    """
    keys = list(keys)
    df = df.withColumn("_coarse", coarse)
    counts = df.groupBy(*keys, "_coarse").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_coarse").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_coarse", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys, "_coarse").orderBy(*order)
    ranked = df.withColumn("_rn", F.row_number().over(inside))
    joined = join_on(ranked, offsets, [*keys, "_coarse"])
    return joined.withColumn(name, F.col("_base") + F.col("_rn") - 1).drop("_coarse", "_rn", "_base")


def with_halo(df: DataFrame, reach: int, block: int = 4096, index="row_index") -> DataFrame:
    """Copy the last `reach` rows of each block into the next one.

    Windows looking back at most `reach` rows give exact results when
    partitioned by (keys, block_id); drop rows with `is_halo` afterwards.
    """
    if reach > block:
        raise ValueError("reach must not exceed the block length")
    own = F.floor(F.col(index) / block)
    tail = (F.col(index) % block) >= block - reach
    ids = F.when(tail, F.array(own, own + 1)).otherwise(F.array(own))
    return df.withColumn("block_id", F.explode(ids)).withColumn("is_halo", F.col("block_id") > own)


def with_previous_value(df: DataFrame, keys, order, value: str, coarse: Column, name: str) -> DataFrame:
    """Value of the preceding row of a series, one (key, coarse) bucket at a time.

    The first row of a bucket takes the last value of the preceding bucket,
    from a summary with one row per bucket.
    """
    keys = list(keys)
    df = df.withColumn("_coarse", coarse)
    last = df.groupBy(*keys, "_coarse").agg(F.max_by(value, order).alias("_last"))
    across = Window.partitionBy(*keys).orderBy("_coarse")
    carry = last.select(*keys, "_coarse", F.lag("_last").over(across).alias("_carry"))
    inside = Window.partitionBy(*keys, "_coarse").orderBy(order)
    first = F.row_number().over(inside) == 1
    df = df.withColumn("_first", first).withColumn("_lag", F.lag(value).over(inside))
    df = join_on(df, carry, [*keys, "_coarse"])
    picked = F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_lag"))
    return df.withColumn(name, picked).drop("_coarse", "_first", "_lag", "_carry")
