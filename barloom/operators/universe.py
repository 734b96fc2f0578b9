"""Universe classification, list reconciliation, digests and run ledgers."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.clock import strict_date
from ..functions.symbols import dataset_symbol, supported_symbol
from ..functions.text import nfkc, st_name

# The five exclusive classes and the ledger states.
CLASSES = ("eligible_mainboard_non_st", "excluded_st_name", "excluded_other_boards", "unclassified", "unsupported")
RUN_STATES = ("match", "not_match", "insufficient_data", "failed_without_result", "pending")
ELIGIBLE = CLASSES[0]


def directory_reason(row_dates=("list_date",)) -> Column:
    """First identity fault of a directory row; NULL when it is sound."""
    c = F.col
    ident = (
        c("market").isin("SH", "SZ", "BJ") & c("ticker").rlike(r"^\d{6}$")
        & (c("symbol") == F.concat(F.lower("market"), c("ticker")))
        & (c("thscode") == F.concat_ws(".", "ticker", "market")) & (c("asset_type") == "a-share")
    )
    name_bad = (F.trim("name") == "") | (F.length("name") > 80) | c("name").rlike(r"[\x00-\x1f\x7f]")
    return (
        F.when(~F.coalesce(ident, F.lit(False)), "MAINBOARD_DIRECTORY_IDENTITY_MISMATCH")
        .when(~c("market_data_supported").eqNullSafe(supported_symbol(c("symbol"))), "MAINBOARD_DIRECTORY_SUPPORT_MISMATCH")
        .when(F.coalesce(name_bad, F.lit(True)), "MAINBOARD_DIRECTORY_INVALID_NAME")
    )


def with_normalized_names(directory: DataFrame, name="name", out="nfkc_name") -> DataFrame:
    """NFKC name column. ASCII names are copied; others go through Arrow."""
    return directory.withColumn(out, F.trim(nfkc(F.col(name))))


def classify_universe(directory: DataFrame) -> DataFrame:
    """Add classification, board, reason_code and st_prefix to sound rows."""
    df = with_normalized_names(directory)
    ticker, sh, sz = F.col("ticker"), F.col("market") == "SH", F.col("market") == "SZ"
    st = st_name(F.col("nfkc_name"))
    main = (sh & ticker.rlike("^(600|601|603|605)")) | (sz & ticker.between("000001", "004999"))
    rules = [
        (~F.col("market_data_supported"), "unsupported", None, "MARKET_DATA_SYMBOL_SYNTAX_UNSUPPORTED"),
        (F.col("market") == "BJ", "excluded_other_boards", "beijing", "BEIJING_NOT_SH_SZ_MAINBOARD"),
        (sh & ticker.startswith("689"), "excluded_other_boards", "star_cdr", "STAR_OR_STAR_CDR_NOT_MAINBOARD_NORMAL_A_SHARE"),
        (sh & ticker.startswith("688"), "excluded_other_boards", "star", "STAR_OR_STAR_CDR_NOT_MAINBOARD_NORMAL_A_SHARE"),
        (sz & ticker.rlike("^30[01]"), "excluded_other_boards", "chinext", "CHINEXT_NOT_MAINBOARD"),
        (sz & ticker.between("001001", "001199"), "excluded_other_boards", "sz_mainboard_cdr", "SZ_MAINBOARD_CDR_NOT_NORMAL_A_SHARE"),
        (main & st & sh, "excluded_st_name", "sh_mainboard", "NFKC_DISPLAY_NAME_ST_PREFIX"),
        (main & st, "excluded_st_name", "sz_mainboard", "NFKC_DISPLAY_NAME_ST_PREFIX"),
        (main & sh, ELIGIBLE, "sh_mainboard", "NORMAL_MAINBOARD_CODE_AND_NO_ST_NAME_PREFIX"),
        (main, ELIGIBLE, "sz_mainboard", "NORMAL_MAINBOARD_CODE_AND_NO_ST_NAME_PREFIX"),
    ]
    verdict = None
    for test, cls, board, reason in rules:
        value = F.struct(F.lit(cls).alias("classification"), F.lit(board).cast("string").alias("board"), F.lit(reason).alias("reason_code"))
        verdict = F.when(test, value) if verdict is None else verdict.when(test, value)
    verdict = verdict.otherwise(F.struct(
        F.lit("unclassified").alias("classification"), F.lit(None).cast("string").alias("board"),
        F.lit("NO_FIXED_NORMAL_A_SHARE_BOARD_CLASSIFICATION").alias("reason_code")))
    return df.withColumn("_v", verdict).withColumn("st_prefix", st).select("*", "_v.*").drop("_v", "nfkc_name")


def partition_counts(classified: DataFrame, keys=()) -> DataFrame:
    """Rows per class and their total, per source or overall."""
    agg = [F.count_if(F.col("classification") == c).alias(c) for c in CLASSES]
    return classified.groupBy(*keys).agg(F.count("*").alias("provider_rows"), *agg)


def build_universe(directory: DataFrame, keys=(), identity=("symbol",)):
    """(classified rows, rejected rows) of directories keyed by `keys`.

    A directory with any unsound or repeated identity is rejected whole.
    """
    keys = list(keys)
    checked = directory.withColumn("reason", directory_reason())
    per = [*keys, *identity]
    faults = checked.filter("reason IS NOT NULL").select(*keys, "reason")
    repeats = directory.groupBy(*per).agg(F.count("*").alias("_n")).filter("_n > 1").select(
        *keys, F.lit("MAINBOARD_DIRECTORY_DUPLICATE_IDENTITY").alias("reason"))
    rejected = faults.unionByName(repeats).groupBy(*keys).agg(F.min("reason").alias("reason"))
    if keys:
        sound = directory.join(rejected, keys, "left_anti")
    else:
        sound = directory.filter(rejected.select(F.count("reason")).scalar() == 0)
    return classify_universe(sound), rejected


def union_lists(first: DataFrame, second: DataFrame, keys=(), identity=("symbol",)):
    """Union of two exchange lists and the identities that occur twice, within each of `keys`."""
    both = first.unionByName(second)
    repeated = both.groupBy(*keys, *identity).agg(F.count("*").alias("occurrences")).filter("occurrences > 1")
    return both, repeated


def metadata_mismatches(rows: DataFrame, first_rows: DataFrame, keys=("symbol",)) -> DataFrame:
    """First-page rows absent from the full list or differing in name or date."""
    full = rows.select(*keys, F.col("name").alias("_name"), F.col("list_date").alias("_date"))
    j = first_rows.join(full, list(keys), "left")
    same = F.col("_name").eqNullSafe(F.col("name")) & F.col("_date").eqNullSafe(F.col("list_date"))
    return j.filter(~same).select(*keys, "name", "list_date", F.col("_name").alias("listed_name"), F.col("_date").alias("listed_date"))


def reconcile_counts(classified: DataFrame, reported: DataFrame, source="source_id") -> DataFrame:
    """Per source: rows, reported total and whether they agree."""
    counts = partition_counts(classified, [source])
    j = counts.join(reported, source, "full")
    return j.withColumn("reconciled", F.coalesce(F.col("provider_rows") == F.col("total_reported"), F.lit(False)))


def build_two_lists(sse: DataFrame, szse: DataFrame, first_page: DataFrame, reported: DataFrame, today: Column, keys=("directory_id",), identity=("symbol",)):
    """(classified rows, verdicts) of pairs of exchange lists that stand or fall together.

    `identity` tells the rows of a pair apart, in both lists and on the first page.

    first_page: rows of the second list's first page (symbol, name, list_date)
    and reported: its recordcount and source_effective_date, each with `keys`.
    A pair is refused whole, for its first reason in a fixed order: an empty
    list, a count other than the reported one or a date to come; a first-page
    row that the list does not confirm; an identity that occurs twice, or any
    unsound row. A verdict has the rows of both lists, their classes and, for
    sound pairs, the digest.
    """
    keys = list(keys)
    sizes = sse.groupBy(*keys).agg(F.count("*").alias("sse_rows")).join(szse.groupBy(*keys).agg(F.count("*").alias("szse_rows")), keys, "full")
    pairs = reported.select(*keys, "recordcount", "source_effective_date").join(sizes, keys, "full").fillna(0, ["sse_rows", "szse_rows"])
    counts = (F.col("sse_rows") == 0) | (F.col("szse_rows") == 0) | F.col("source_effective_date").isNull() | (F.col("source_effective_date") > today)
    wrong_count = ~F.coalesce(F.col("recordcount") == F.col("szse_rows"), F.lit(False))
    # A symbol may stand twice in the list; one row of it that agrees does not hide the other.
    unconfirmed = metadata_mismatches(szse, first_page, [*keys, *identity]).select(*keys).distinct().withColumn("_page", F.lit(True))
    both, repeated = union_lists(sse, szse, keys, identity)
    rows, rejected = build_universe(both, keys, identity)
    verdict = pairs.join(unconfirmed, keys, "left").join(rejected.withColumnRenamed("reason", "_row"), keys, "left")
    twice = repeated.select(*keys).distinct().withColumn("_twice", F.lit(True))
    verdict = verdict.join(twice, keys, "left").withColumn("reason", F.when(
        F.coalesce(counts, F.lit(True)), "PUBLIC_DIRECTORY_INVALID_COUNTS_OR_DATE").when(wrong_count, "SZSE_WORKBOOK_METADATA_COUNT_MISMATCH")
        .when(F.col("_page"), "SZSE_WORKBOOK_METADATA_IDENTITY_MISMATCH").when(F.col("_twice"), "PUBLIC_DIRECTORY_DUPLICATE_IDENTITY").otherwise(F.col("_row")))
    sound = verdict.filter("reason IS NULL").select(*keys)
    classified = rows.join(sound, keys, "left_semi")
    verdict = verdict.select(*keys, "sse_rows", "szse_rows", "reason").join(manifest(classified, keys), keys, "left")
    return classified, verdict


def row_hash(columns) -> Column:
    """Digest of one row; NULL and text are told apart by JSON."""
    return F.sha2(F.to_json(F.array(*[F.col(c).cast("string") for c in columns])), 256)


LANES = 4
_WRAP = 2**64


def table_digest(df: DataFrame, columns, keys=()) -> DataFrame:
    """Order-insensitive digest of a table or of each key's rows.

    A multiset hash: each row's 256-bit digest is cut into four 64-bit lanes,
    and the lanes are summed modulo 2^64 over all rows, repeated ones
    included. Sums commute, so this is one hash aggregate with partial
    combine; no list of rows exists anywhere. The digest hashes the row count
    and the four sums.
    """
    keys = list(keys)
    hashed = df.select(*keys, row_hash(columns).alias("h"))
    # 20 digits a lane leave room for 10^18 rows in the sum.
    lanes = [F.conv(F.substring("h", 16 * i + 1, 16), 16, 10).cast("decimal(20,0)").alias(f"_l{i}") for i in range(LANES)]
    sums = [F.sum(f"_l{i}").cast("decimal(38,0)").alias(f"_l{i}") for i in range(LANES)]
    total = hashed.select(*keys, *lanes).groupBy(*keys).agg(F.count("*").alias("_n"), *sums)
    wrapped = [F.coalesce(F.pmod(F.col(f"_l{i}"), F.lit(str(_WRAP)).cast("decimal(38,0)")), F.lit(0)).cast("decimal(20,0)").cast("string") for i in range(LANES)]
    return total.select(*keys, F.sha2(F.concat_ws(":", F.col("_n").cast("string"), *wrapped), 256).alias("digest"))


def tree_digest(df: DataFrame, columns, keys=(), levels=(4, 2)) -> DataFrame:
    """Order-insensitive digest of a table or of each key's rows, as a tree of SHA-256 hashes.

    Equal rows are counted first; then sorted digests are hashed together
    along prefixes of the row hash, so that every row enters a hash and no
    group holds the whole table: a leaf has one in 65,536 of a key's rows.
    """
    keys = list(keys)
    level = df.select(*keys, row_hash(columns).alias("h")).groupBy(*keys, "h").agg(F.count("*").alias("n"))
    level = level.select(*keys, "h", F.concat_ws(":", "h", F.col("n").cast("string")).alias("v"))
    for width in (*levels, 0):
        prefix = F.substring("h", 1, width) if width else F.lit("")
        level = level.groupBy(*keys, prefix.alias("h")).agg(F.array_sort(F.collect_list("v")).alias("v"))
        level = level.select(*keys, "h", F.sha2(F.array_join("v", ","), 256).alias("v"))
    return level.select(*keys, F.col("v").alias("digest"))


def manifest(classified: DataFrame, keys=()) -> DataFrame:
    """Partition map and digest, one row per directory."""
    keys = list(keys)
    counts = partition_counts(classified, keys)
    parts = F.create_map(*[x for c in CLASSES for x in (F.lit(c), F.col(c))])
    counts = counts.select(*keys, "provider_rows", parts.alias("partition"))
    columns = ("symbol", "name", "classification", "board", "list_date")
    digest = table_digest(classified, columns, keys)
    if keys:
        return counts.join(digest, keys)
    return counts.withColumn("digest", digest.select(F.max("digest")).scalar())


def curated_pool(pool: DataFrame, classified: DataFrame, expected_hash: str | None = None, keys=("symbol",)):
    """(admitted members, rejected members) of a curated pool.

    A member needs pool-code syntax, no ST prefix and an eligible directory
    row of the same name. A wrong pool hash rejects every member. `keys` tell
    members apart; where there are several directories, theirs are among them.
    """
    keys = list(keys)
    eligible = classified.filter(F.col("classification") == ELIGIBLE).select(*keys, F.col("name").alias("_dir_name"))
    named = with_normalized_names(pool)
    j = named.join(eligible, keys, "left")
    code = F.when(~F.coalesce(dataset_symbol(F.col("symbol")), F.lit(False)) | st_name(F.col("nfkc_name")), "INVALID_PUBLIC_MAINBOARD_ITEM").when(
        ~F.coalesce(F.col("_dir_name") == F.col("name"), F.lit(False)), "CURATED_MEMBER_IDENTITY_MISMATCH")
    if expected_hash is not None:
        digest = table_digest(pool, ("symbol", "name")).select(F.max("digest")).scalar()
        code = F.when(digest != expected_hash, "INVALID_CURATED_UNIVERSE").otherwise(code)
    j = j.withColumn("reason", code).drop("nfkc_name", "_dir_name")
    return j.filter("reason IS NULL").drop("reason"), j.filter("reason IS NOT NULL")


# -- run ledger ------------------------------------------------------------------
def ledger_violations(universe: DataFrame, results: DataFrame, expected_session: Column, keys=("symbol",)) -> DataFrame:
    """Results a run must not contain: foreign, repeated, bad state, other session. `keys` tell members apart."""
    keys = list(keys)
    foreign = results.join(universe.select(*keys), keys, "left_anti").select(*keys, F.lit("FOREIGN_RESULT").alias("violation"))
    repeated = results.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1").select(*keys, F.lit("REPEATED_RESULT").alias("violation"))
    state = results.filter(~F.coalesce(F.col("status").isin(*RUN_STATES), F.lit(False))).select(*keys, F.lit("INVALID_STATUS").alias("violation"))
    mixed = results.filter(F.col("expected_session_date") != expected_session).select(*keys, F.lit("MIXED_EXPECTED_SESSION").alias("violation"))
    return foreign.unionByName(repeated).unionByName(state).unionByName(mixed)


def run_ledger(universe: DataFrame, results: DataFrame, keys=("symbol",)) -> DataFrame:
    """Every eligible member with its state; members, told apart by `keys`, without a result are pending."""
    keys = list(keys)
    known = results.select(*keys, "status")
    return universe.select(*keys).join(known, keys, "left").select(
        *keys, F.coalesce("status", F.lit("pending")).alias("status"))


def ledger_counts(ledger: DataFrame, states=RUN_STATES, state="status", keys=()) -> DataFrame:
    """State counts with the identity that they add up to the members."""
    counts = ledger.groupBy(*keys).agg(
        F.count("*").alias("members"), *[F.count_if(F.col(state) == s).alias(s) for s in states])
    total = sum((F.col(s) for s in states[1:]), F.col(states[0]))
    return counts.withColumn("partition_valid", total == F.col("members")).withColumn("complete", F.col("pending") == 0)


SERIES_KEYS = ("1d:none", "1w:none", "1mo:none", "1d:qfq")
TUPLE = ("run_id", "target_session", "calendar_version", "policy_version", "manifest_hash")


def admit_batches(assignments: DataFrame, batches: DataFrame, records: DataFrame, run: dict, results: DataFrame) -> DataFrame:
    """Final state per symbol after whole-batch admission.

    assignments: batch_id, symbol. batches: batch_id and the freeze tuple it
    claims. records: batch_id, symbol, key and the tuple of its dataset.
    results: symbol, state. A batch breaking any rule turns all its symbols
    into failure; a batch never consumed leaves them unprocessed.
    """
    off_tuple = F.lit(False)
    for k in TUPLE:
        off_tuple = off_tuple | ~F.coalesce(F.col(k) == F.lit(run[k]), F.lit(False))
    claims = batches.groupBy("batch_id").agg(F.bool_or(off_tuple).alias("_bad_claim"))
    sizes = assignments.groupBy("batch_id").agg(F.count("*").alias("_symbols"))
    inside = records.join(assignments.withColumn("_in", F.lit(True)), ["batch_id", "symbol"], "left")
    off_data = F.lit(False)
    for k in ("run_id", "target_session", "calendar_version", "policy_version"):
        off_data = off_data | ~F.coalesce(F.col(k) == F.lit(run[k]), F.lit(False))
    keyed = inside.groupBy("batch_id", "symbol", "key").agg(
        F.count("*").alias("_n"), F.bool_or(F.col("_in").isNull()).alias("_outside"), F.bool_or(off_data).alias("_off"))
    per_batch = keyed.groupBy("batch_id").agg(
        F.sum("_n").alias("_records"),
        F.bool_or(F.col("_outside") | ~F.col("key").isin(*SERIES_KEYS)).alias("_scope"),
        F.bool_or(F.col("_n") > 1).alias("_repeat"), F.bool_or("_off").alias("_off"))
    verdict = claims.join(sizes, "batch_id").join(per_batch, "batch_id", "left")
    code = (
        F.when(F.col("_bad_claim"), "BATCH_FREEZE_MISMATCH")
        .when(F.col("_records") > F.col("_symbols") * len(SERIES_KEYS), "BATCH_RECORD_BOUNDS")
        .when(F.col("_scope"), "BATCH_SYMBOL_SCOPE")
        .when(F.col("_repeat"), "BATCH_DUPLICATE_SYMBOL_KEY")
        .when(F.col("_off"), "BATCH_FREEZE_MISMATCH")
    )
    verdict = verdict.select("batch_id", code.alias("code"), F.lit(True).alias("_consumed"))
    out = assignments.join(verdict, "batch_id", "left").join(results.select("symbol", "state"), "symbol", "left")
    state = (
        F.when(F.col("_consumed").isNull(), "unprocessed").when(F.col("code").isNotNull(), "failure")
        .otherwise(F.coalesce("state", F.lit("insufficient")))
    )
    reason = F.when(F.col("_consumed").isNull(), "PENDING_LOCAL_BATCH").otherwise(F.col("code"))
    return out.select("batch_id", "symbol", state.alias("state"), reason.alias("reason"))
