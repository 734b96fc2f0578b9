"""Rule features and a hashed n-gram log-likelihood ratio, all in DataFrame functions.

One- and two-word sequences are hashed into buckets. The trusted texts and the
whole corpus each give a multinomial over the buckets; a text's ratio is the
sum over its sequences of log p(trusted) - log p(corpus), divided by their
number. Every text is kept or not by one fixed threshold.

Null and empty texts have no words: all counts are 0, the base rules fail and
they are not kept. Every row is judged by itself, repeated ones too. With no
trusted text the two multinomials are equal by smoothing and the ratio
decides nothing: only the base rules do. Other columns are not read.
"""

from pyspark.sql import Column, DataFrame, functions as F

from .common import GAP

#: Ratios are summed as whole numbers of this size, so sums do not depend on their order.
UNIT = 1_000_000


def words(text: Column) -> Column:
    """Words of a text in order, as `[^\\x20\\x09-\\x0D]+` finds them."""
    parts = F.split(text, GAP)
    # Only the first and last parts can be empty, where blanks begin or end the text.
    return F.array_remove(parts, "")


def _pairwise(a: Column, b: Column, shift: int, combine) -> Column:
    """combine(a[i], b[i + shift]) for every i that has both."""
    n = F.greatest(F.size(b) - shift, F.lit(0))
    return F.zip_with(F.slice(a, 1, n), F.slice(b, shift + 1, n), combine)


def hashed(rows: DataFrame) -> DataFrame:
    """Adds _u, the hashes of the words `_w`, and _p, those of neighbouring pairs; each is computed once."""
    rows = rows.withColumn("_u", F.transform("_w", lambda x: F.xxhash64(x))).drop("_w")
    return rows.withColumn("_p", _pairwise(F.col("_u"), F.col("_u"), 1, lambda a, b: F.xxhash64(a, b)))


def features(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the hashes _u, _p of words and pairs."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("_t")).select("doc_id", "_t", words(F.col("_t")).alias("_w"))
    rows = rows.select(
        "doc_id", "_w", F.size("_w").cast("long").alias("n_words"), F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"), lines.alias("_lines"))
    rows = rows.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")).drop("_lines")
    rows = hashed(rows)
    rows = rows.withColumn("_g", _pairwise(F.col("_p"), F.col("_u"), 2, lambda p, c: F.xxhash64(p, c)))
    repeats = F.when(F.size(F.array_distinct("_g")) == F.size("_g"), F.lit(0).cast("long")).otherwise(_covered(F.col("_g")))
    return rows.withColumn("n_repeat_words", repeats).drop("_g")


def _covered(grams: Column, width=3) -> Column:
    """Words covered by windows whose hash stands twice or more: equal hashes are neighbours once sorted."""
    placed = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    # Places of repeated windows: where a neighbour in the sorted order has the same hash.
    shifted = F.concat(F.array(F.struct(F.lit(None).cast("long").alias("g"), F.lit(-1).alias("i"))), placed)
    before = F.zip_with(shifted, placed, lambda a, b: F.when(a["g"] == b["g"], F.array(a["i"], b["i"])))
    places = F.sort_array(F.array_distinct(F.flatten(F.array_compact(before))))
    nexts = F.slice(places, 2, F.greatest(F.size(places), F.lit(1)))
    steps = F.zip_with(places, nexts, lambda a, b: F.when(b.isNull(), F.lit(width)).otherwise(F.least(b - a, F.lit(width))))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x.cast("long"))


def _bucket(h: Column, buckets: int) -> Column:
    return F.pmod(h, F.lit(buckets)).cast("int")


def ratios(docs: DataFrame, trusted: DataFrame, buckets: int, smoothing: float, most: int) -> DataFrame:
    """One row: `ratio`, an array with the scaled log ratio of every bucket.

    docs: doc_id, _w. All texts are counted for the corpus; for the target,
    those of at most `most` trusted ids, the ones with the least hashes: a
    proven bound for the broadcast, so no text is shuffled. Counts are summed
    before they are shuffled; there are `buckets` of them.
    """
    ids = trusted.filter("doc_id IS NOT NULL").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    marked = docs.join(F.broadcast(ids.withColumn("_ok", F.lit(1))), "doc_id", "left")
    each = hashed(marked).select(F.col("_ok").isNotNull().alias("ok"), F.explode(F.concat("_u", "_p")).alias("h"))
    sums = each.groupBy(_bucket(F.col("h"), buckets).alias("bucket")).agg(F.count("*").alias("raw"), F.count_if("ok").alias("good"))
    empty = sums.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("raw"), F.lit(0).cast("long").alias("good"))
    table = sums.unionByName(empty).groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good"))
    listed = table.agg(F.array_sort(F.collect_list(F.struct("bucket", "raw", "good"))).alias("t"), F.sum("raw").alias("n_raw"), F.sum("good").alias("n_good"))

    def share(x, n):
        return (x + smoothing) / (n + smoothing * buckets)

    one = F.transform("t", lambda x: F.round((F.log(share(x["good"], F.col("n_good"))) - F.log(share(x["raw"], F.col("n_raw")))) * UNIT).cast("long"))
    return listed.select(F.when(F.col("n_good") > 0, one).otherwise(F.array_repeat(F.lit(0).cast("long"), buckets)).alias("ratio"))


def judged(docs: DataFrame, trusted: DataFrame, id_col="doc_id", text_col="text", buckets=1 << 14, smoothing=1.0, threshold=-0.045, most=20_000) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, ratio.

    trusted: doc_id of the texts of the target, of which `most` are learned
    from. A text is kept if no base rule fails and its mean log ratio is at
    least `threshold`.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    table = ratios(docs.select(F.col(f"`{id_col}`").alias("doc_id"), words(text).alias("_w")), trusted, buckets, smoothing, most)
    # `buckets` numbers, whatever the corpus' size: a literal that every lambda reads in place.
    weights = F.split(F.lit(",".join(map(str, table.first().ratio))), ",").cast("array<bigint>")
    rows = features(docs, id_col, text_col)

    def total(hashes):
        return F.aggregate(hashes, F.lit(0).cast("long"), lambda s, h: s + F.get(weights, _bucket(h, buckets)))

    n = F.size("_u") + F.size("_p")
    rows = rows.withColumn("ratio", F.when(n > 0, (total("_u") + total("_p")) / (n * F.lit(float(UNIT)))))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & F.coalesce(F.col("ratio") >= threshold, F.lit(False))).alias("kept"), "ratio")
