"""Keyset and offset pages, budgets, batches and result order."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from .blocks import with_row_index


def page_after(df: DataFrame, key: str, after: Column, n: int, cursor: str | None = None) -> DataFrame:
    """First n rows with key > after; `has_more` and an optional cursor column.

    The limit is a top-k, so only n + 1 rows leave each partition.
    """
    rows = df.filter(F.col(key) > after).orderBy(key).limit(n + 1)
    return _flag(rows, F.col(key).asc(), key, n, cursor)


def page_before(df: DataFrame, key: str, before: Column | None, n: int, cursor: str | None = None) -> DataFrame:
    """Latest n rows with key < before, in ascending order, plus `has_more`."""
    rows = df if before is None else df.filter(F.col(key) < before)
    rows = rows.orderBy(F.col(key).desc()).limit(n + 1)
    return _flag(rows, F.col(key).desc(), key, n, cursor).orderBy(key)


def _flag(rows, order, key, n, cursor):
    # The input holds at most n + 1 rows here.
    one = F.lit(1)
    out = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(one).orderBy(order)))
    everything = Window.partitionBy(one)
    out = out.withColumn("has_more", F.count("*").over(everything) > n)
    if cursor:
        last = F.max(F.when(F.col("_rn") == n, F.col(key))).over(everything)
        out = out.withColumn(cursor, F.when(F.col("has_more"), last))
    return out.filter(F.col("_rn") <= n).drop("_rn")


def offset_page(df: DataFrame, key: str, offset: int, limit: int) -> DataFrame:
    return df.orderBy(key).offset(offset).limit(limit)


def page_evidence(page: DataFrame, offset: int, limit: int) -> DataFrame:
    """End-of-source evidence of one page: a short page is its only sign."""
    n = F.count("*")
    return page.agg(
        n.alias("returned"), (n < limit).alias("source_page_end_observed"),
        F.when(n == limit, F.lit(offset + limit)).alias("next_offset"),
    )


def integer_bucket(key: str, bits: int = 16) -> Column:
    """Bucket of a unique integer key: at most 2**bits rows each."""
    return F.shiftright(F.col(key).cast("long"), bits)


PARTS = 64


def _tree(column: Column, tie: Column, cuts: list, low: int, high: int) -> Column:
    """Number of cuts at or below (column, tie), found by halving."""
    if low == high:
        return F.lit(low)
    mid = (low + high) // 2
    key, t = cuts[mid]
    below = (column < F.lit(key)) | ((column == F.lit(key)) & (tie < F.lit(t)))
    return F.when(below, _tree(column, tie, cuts, low, mid)).otherwise(_tree(column, tie, cuts, mid + 1, high))


def range_bucket(df: DataFrame, key: str, parts: int = PARTS, per_part: int = 64) -> Column:
    """Bucket of about 1 / `parts` of the rows each, rising with `key` of any ordered type; NULL comes first.

    Cuts are taken from a hashed sample of about parts * per_part different
    rows, which the driver may hold. They compare the key and then the hash of
    the row, so a key that holds a large share of the rows is cut as well.
    """
    tie = F.xxhash64(*df.columns)
    every = max(1, df.count() // (parts * per_part))
    sample = df.select(F.col(key).alias("k"), tie.alias("t")).filter(F.col("k").isNotNull() & (F.pmod("t", F.lit(every)) == 0)).distinct()
    found = sorted((r.k, r.t) for r in sample.collect())
    cuts = [found[len(found) * i // parts] for i in range(1, parts)] if found else []
    cuts = sorted(set(cuts))
    return F.when(F.col(key).isNull(), F.lit(0)).otherwise(_tree(F.col(key), tie, cuts, 0, len(cuts)) + 1)


def offsets_before(rows: DataFrame, bucket: str, n: Column, descending=False) -> dict:
    """{bucket: sum of n in the buckets before it}, for the few buckets of `range_bucket`."""
    sizes = {r[0]: r[1] for r in rows.groupBy(bucket).agg(n).collect()}
    total, out = 0, {}
    for b in sorted(sizes, reverse=descending):
        out[b] = total
        total += sizes[b]
    return out


def looked_up(found: dict, bucket: str) -> Column:
    pairs = [F.lit(x) for b, v in found.items() for x in (b, v)]
    return F.element_at(F.create_map(*pairs), F.col(bucket)) if pairs else F.lit(0)


def with_position(df: DataFrame, key: str, name="position", parts: int = PARTS) -> DataFrame:
    """Zero-based position in whole-table key order: rows are numbered inside sampled ranges, and ranges counted."""
    rows = df.withColumn("_part", range_bucket(df, key, parts)).withColumn("_tie", F.xxhash64(*df.columns))
    before = offsets_before(rows, "_part", F.count("*"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(key, "_tie"))
    return rows.withColumn(name, (looked_up(before, "_part") + inside - 1).cast("long")).drop("_part", "_tie")


def with_budget(df: DataFrame, key: str, maximum: int) -> DataFrame:
    """First `maximum` rows in order are processed; the rest say so."""
    out = with_position(df, key)
    return out.withColumn("state", F.when(F.col("position") >= maximum, "unprocessed").otherwise("processed"))


def with_batches(df: DataFrame, key: str, size: int = 20) -> DataFrame:
    out = with_position(df, key)
    return out.withColumn("batch_id", F.floor(F.col("position") / size))


def result_order(df: DataFrame, keys, tie: str, flags="risk_flags") -> DataFrame:
    """Position within each run: unflagged matches first, then the tie column.

    A run is cut along sampled ranges of the tie column, so one run may hold
    all rows.
    """
    rows = df.withColumn("_flagged", F.coalesce(F.size(flags) > 0, F.lit(False)).cast("int"))
    coarse = F.col("_flagged") * (2 * PARTS) + range_bucket(df, tie)
    out = with_row_index(rows, keys, ["_flagged", tie], coarse, "position")
    return out.withColumn("position", F.col("position") + 1).drop("_flagged")
