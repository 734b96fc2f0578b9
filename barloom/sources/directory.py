"""Directory, workbook and suggestion captures."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.clock import strict_date
from ..functions.symbols import normalize_symbol, supported_symbol
from ..functions.text import decode_entities
from .captures import first_code, split_valid

# Identity of the two exchange list responses.
SSE_QUERY = "COMMON_SSE_CP_GPJCTPZ_GPLB_GP_L"
SSE_KEYS = ("A_STOCK_CODE", "SEC_NAME_CN", "LIST_DATE", "STOCK_TYPE", "LIST_BOARD", "DELIST_DATE")
SZSE_CATALOG, SZSE_TAB, SZSE_TITLE, MAIN_BOARD = "1110", "tab1", "A股列表", "主板"
SZSE_HEADERS = ("板块", "A股代码", "A股简称", "A股上市日期")

_SSE_ROW = "array<struct<" + ",".join(f"{k}:string" for k in SSE_KEYS) + ">>"
_SSE = (f"struct<sqlId:string,type:string,isPagination:string,actionErrors:array<string>,actionMessages:array<string>,"
        f"fieldErrors:map<string,string>,result:{_SSE_ROW},"
        f"pageHelp:struct<pageNo:int,pageCount:int,pageSize:int,total:int,data:{_SSE_ROW}>>")
_SZSE = ("array<struct<error:string,metadata:struct<catalogid:string,tabkey:string,name:string,pageno:int,pagesize:int,"
         "recordcount:int,pagecount:int,subname:string>,data:array<struct<agdm:string,agjc:string,agssrq:string,bk:string>>>>")
_TICKERS = ("struct<code:int,data:struct<timestamp:bigint,item:array<struct<asset_type:string,exchange:string,ticker:string,"
            "thscode:string,name:string,currency:string,list_date:string,end_date:string,last_trade_date:string,last_delivery_date:string>>>>")


def _name_bad(name: Column, markup=True) -> Column:
    odd = r"[\x00-\x1f\x7f<>]" if markup else r"[\x00-\x1f\x7f]"
    return F.coalesce((F.trim(name) == "") | (F.length(name) > 80) | name.rlike(odd), F.lit(True))


def directory_item(ticker: Column, market: str, name: Column, listed: Column, source_id: str) -> Column:
    """Typed directory struct with its own reason code."""
    symbol = F.concat(F.lit(market.lower()), ticker)
    reason = (
        F.when(~F.coalesce(ticker.rlike(r"^\d{6}$"), F.lit(False)), "PUBLIC_DIRECTORY_INVALID_IDENTITY")
        .when(_name_bad(name), "PUBLIC_DIRECTORY_INVALID_NAME")
        .when(strict_date(listed).isNull(), "PUBLIC_DIRECTORY_INVALID_DATE")
    )
    return F.struct(
        symbol.alias("symbol"), ticker.alias("ticker"), F.concat_ws(".", ticker, F.lit(market)).alias("thscode"),
        F.lit(market).alias("market"), F.trim(name).alias("name"), F.lit("a-share").alias("asset_type"),
        supported_symbol(symbol).alias("market_data_supported"), strict_date(listed).alias("list_date"),
        F.lit(source_id).alias("source_id"), reason.alias("code"))


def _finish(df: DataFrame, extra=()):
    """Split captures on reason and explode the items of the valid ones."""
    symbols = F.transform("_items", lambda i: i["symbol"])
    repeated = F.when(F.size(F.array_distinct(symbols)) < F.size(symbols), "PUBLIC_DIRECTORY_DUPLICATE_IDENTITY")
    df = df.withColumn("reason", F.coalesce("reason", first_code(F.transform("_items", lambda i: i["code"])), repeated))
    good, bad = split_valid(df)
    return good.select("capture_id", *extra, F.inline("_items")).drop("code"), bad.select("capture_id", "reason")


def decode_sse_directory(raw: DataFrame):
    """Exchange list as JSON: both copies must agree and totals reconcile."""
    df = raw.withColumn("_d", F.from_json("body", _SSE))
    d = F.col("_d")
    rows, page = d["result"], d["pageHelp"]
    whole = (
        (d["sqlId"] == SSE_QUERY) & (d["type"] == "inParams") & (d["isPagination"] == "true")
        & (F.size(d["actionErrors"]) == 0) & (F.size(d["actionMessages"]) == 0) & (F.size(d["fieldErrors"]) == 0)
        & (F.size(rows) >= 1) & (page["pageNo"] == 1) & (page["pageCount"] == 1)
        & (page["pageSize"] >= F.size(rows)) & (page["total"] == F.size(rows)) & (F.size(page["data"]) == F.size(rows))
    )
    pairs = F.zip_with(rows, page["data"], lambda a, b: a.eqNullSafe(b))
    in_scope = F.transform(rows, lambda r: (r["STOCK_TYPE"] == "1") & (r["LIST_BOARD"] == "1") & (r["DELIST_DATE"] == "-"))
    agree = F.forall(pairs, lambda x: x) & F.forall(in_scope, lambda x: F.coalesce(x, F.lit(False)))
    df = df.withColumn("reason", F.when(~F.coalesce(whole, F.lit(False)), "SSE_DIRECTORY_INCOMPLETE_OR_INVALID")
                       .when(~F.coalesce(agree, F.lit(False)), "SSE_DIRECTORY_IDENTITY_OR_SCOPE_MISMATCH"))
    df = df.withColumn("_items", F.transform(rows, lambda r: directory_item(
        r["A_STOCK_CODE"], "SH", r["SEC_NAME_CN"], r["LIST_DATE"], "sse_public_mainboard")))
    return _finish(df)


def linked_name(html: Column) -> Column:
    """Name inside `<a ...><u>name</u></a>`, entities decoded; NULL otherwise."""
    inner = F.regexp_extract(html, r"^<a\s+[^<>]*>\s*<u>([^<>]*)</u>\s*</a>$", 1)
    text = decode_entities(inner)
    return F.when((inner != "") & ~text.rlike(r"(?i)&(#|[a-z])"), text)


def decode_szse_metadata(raw: DataFrame):
    """First metadata page: (first rows with counts, quarantine)."""
    df = raw.withColumn("_doc", F.from_json("body", _SZSE))
    tabs = F.filter("_doc", lambda s: (s["metadata"]["catalogid"] == SZSE_CATALOG) & (s["metadata"]["tabkey"] == SZSE_TAB))
    df = df.withColumn("_n", F.size(tabs)).withColumn("_s", F.get(tabs, F.lit(0)))
    m, rows = F.col("_s.metadata"), F.col("_s.data")
    whole = (
        F.col("_s.error").isNull() & (m["name"] == SZSE_TITLE) & (m["pageno"] == 1) & (m["pagesize"] >= 1)
        & (m["recordcount"] >= 1) & (m["pagecount"] == F.ceil(m["recordcount"] / m["pagesize"]))
        & (F.size(rows) == F.least(m["recordcount"], m["pagesize"])) & strict_date(F.trim(m["subname"])).isNotNull()
    )
    scope = F.forall(rows, lambda r: F.coalesce(r["bk"] == MAIN_BOARD, F.lit(False)))
    df = df.withColumn("reason", F.when(F.col("_doc").isNull(), "SZSE_METADATA_INVALID").when(F.col("_n") != 1, "SZSE_METADATA_AMBIGUOUS")
                       .when(~F.coalesce(whole, F.lit(False)), "SZSE_METADATA_INVALID").when(~scope, "SZSE_METADATA_SCOPE_MISMATCH"))
    df = df.withColumns({"recordcount": m["recordcount"], "source_effective_date": strict_date(F.trim(m["subname"]))})
    # Linked names are decoded in table rows: the text function is not usable
    # inside an array function.
    good, bad = split_valid(df)
    rows = good.select("capture_id", "recordcount", "source_effective_date", F.inline("_s.data"))
    item = directory_item(F.col("agdm"), "SZ", linked_name(F.col("agjc")), F.col("agssrq"), "szse_public_mainboard")
    rows = rows.withColumn("_i", item)
    failed = rows.filter(F.col("_i.code").isNotNull()).groupBy("capture_id").agg(F.min("_i.code").alias("reason"))
    kept = rows.join(failed, "capture_id", "left_anti").select("capture_id", "recordcount", "source_effective_date", "_i.*").drop("code")
    return kept, bad.select("capture_id", "reason").unionByName(failed)


def map_workbook_rows(rows: DataFrame, metadata: DataFrame | None = None, keys=()):
    """Tabular list rows by header name: (items of sound lists, faulty rows with their reason).

    Each required header must occur exactly once. A list is all rows with
    equal `keys` (without keys, all rows); one faulty row, one repeated code
    or a row count other than its metadata's `recordcount` refuses the whole
    list. Faulty rows are returned one by one, a wrong count as one row.
    """
    for header in SZSE_HEADERS:
        if rows.columns.count(header) != 1:
            raise ValueError(f"workbook header {header} must occur exactly once")
    board, code, name, listed = (F.col(f"`{h}`") for h in SZSE_HEADERS)
    out = rows.withColumn("_i", directory_item(code, "SZ", name, listed, "szse_public_mainboard"))
    reason = F.when(~F.coalesce(board == MAIN_BOARD, F.lit(False)), "SZSE_WORKBOOK_SCOPE_MISMATCH").otherwise(F.col("_i.code"))
    rest = [c for c in rows.columns if c not in SZSE_HEADERS]
    good, bad = split_valid(out.withColumn("reason", reason))
    bad = bad.select(*rest, "reason")
    keys = list(keys)
    per_code = good.groupBy(*keys, "_i.symbol").count().filter("count > 1").withColumn("reason", F.lit("PUBLIC_DIRECTORY_DUPLICATE_IDENTITY"))
    faults = bad.select(*keys, "reason").unionByName(per_code.select(*keys, "reason"))
    if metadata is not None:
        counted = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
        if keys:
            wrong = counted.join(metadata.select(*keys, "recordcount").distinct(), keys)
        else:
            wrong = counted.withColumn("recordcount", metadata.agg(F.max("recordcount")).scalar())
        faults = faults.unionByName(wrong.filter("_n <> recordcount").select(*keys, F.lit("SZSE_WORKBOOK_COUNT_MISMATCH").alias("reason")))
    refused = faults.select(*keys).distinct() if keys else faults.agg(F.count("*").alias("_faults"))
    if keys:
        good = good.join(refused, keys, "left_anti")
    else:
        good = good.filter(refused.select("_faults").scalar() == 0)
    missing = [c for c in rest if c not in keys]
    extra = faults.join(bad.select(*keys, "reason").distinct(), [*keys, "reason"], "left_anti")
    extra = extra.select(*keys, *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in missing], "reason")
    return good.select(*rest, "_i.*").drop("code"), bad.unionByName(extra)


def decode_ticker_pages(raw: DataFrame, limit: int, expected_snapshot: int | None = None):
    """Provider ticker pages: (items, pages, quarantine).

    Pages carry counts and end-of-source evidence; a short page is the only
    sign that the source ended.
    """
    df = raw.withColumn("_d", F.from_json("body", _TICKERS))
    d = F.col("_d.data")
    items, stamp = d["item"], d["timestamp"]
    now = F.unix_millis("fetched_at")

    def parse(r):
        symbol = F.concat(F.lower(r["exchange"]), r["ticker"])
        ident = (
            (r["asset_type"] == "a-share") & r["exchange"].isin("SH", "SZ", "BJ") & r["ticker"].rlike(r"^\d{6}$")
            & (r["thscode"] == F.concat_ws(".", r["ticker"], r["exchange"]))
        )
        dates = ("list_date", "end_date", "last_trade_date", "last_delivery_date")
        bad_date = F.lit(False)
        for k in dates:
            bad_date = bad_date | (r[k].isNotNull() & ~F.coalesce(r[k].rlike(r"^\d{4}-\d{2}-\d{2}$") & strict_date(r[k]).isNotNull(), F.lit(False)))
        code = (
            F.when(~F.coalesce(ident, F.lit(False)), "DIRECTORY_IDENTITY_MISMATCH")
            .when(_name_bad(r["name"], markup=False), "DIRECTORY_INVALID_NAME")
            .when(r["currency"] != "CNY", "DIRECTORY_INVALID_CURRENCY")
            .when(bad_date, "DIRECTORY_INVALID_DATE")
        )
        return F.struct(
            symbol.alias("symbol"), r["ticker"].alias("ticker"), r["thscode"].alias("thscode"), r["exchange"].alias("market"),
            F.trim(r["name"]).alias("name"), F.lit("a-share").alias("asset_type"), supported_symbol(symbol).alias("market_data_supported"),
            *[strict_date(r[k]).alias(k) for k in dates], code.alias("code"))

    df = df.withColumn("_items", F.transform(items, parse))
    symbols = F.transform("_items", lambda i: i["symbol"])
    reason = (
        F.when(F.coalesce(F.col("_d.code") != 0, F.lit(True)), "DIRECTORY_BUSINESS_ERROR")
        .when(F.coalesce((F.size(items) > limit) | (stamp <= 0) | (stamp > now + 5000), F.lit(True)), "DIRECTORY_INVALID_RESPONSE")
    )
    if expected_snapshot is not None:
        reason = reason.when(stamp != expected_snapshot, "DIRECTORY_SNAPSHOT_CHANGED")
    df = df.withColumn("reason", F.coalesce(
        reason, first_code(F.transform("_items", lambda i: i["code"])),
        F.when(F.size(F.array_distinct(symbols)) < F.size(symbols), "DIRECTORY_DUPLICATE_IDENTITY")))
    df = df.withColumn("snapshot_timestamp", stamp)
    good, bad = split_valid(df)
    n = F.size("_items")
    supported = F.size(F.filter("_items", lambda i: i["market_data_supported"]))
    pages = good.select(
        "capture_id", "snapshot_timestamp", "page_offset", n.alias("returned_count"), supported.alias("market_data_supported_count"),
        (n < limit).alias("source_page_end_observed"), F.when(n == limit, F.col("page_offset") + limit).alias("next_offset"))
    rows = good.select("capture_id", "snapshot_timestamp", F.inline("_items")).drop("code")
    return rows, pages, bad.select("capture_id", "reason")


def decode_suggestions(raw: DataFrame, limit: int | None = None):
    """Suggestion rows `exchange~code~name~~type^...`: one row per A-share match.

    With a `limit` only the first rows of a response are examined, and
    `truncated` says whether there were more. `position` is the row's place
    in the response.
    """
    text = F.regexp_extract("body", r'^\s*v_hint\s*=\s*"((?:[^"\\]|\\.)*)"\s*;?\s*$', 1)
    plain = F.get_json_object(F.concat(F.lit('{"v":"'), text, F.lit('"}')), "$.v")
    rows = F.split(plain, r"\^", -1)
    df = raw.select(*[c for c in raw.columns if c != "body"], (F.size(rows) > limit if limit else F.lit(False)).alias("truncated"),
                    F.posexplode(F.slice(rows, 1, limit) if limit else rows).alias("position", "_r"))
    f = F.split("_r", "~", -1)
    at = lambda i: F.get(f, F.lit(i))
    symbol = F.concat(at(0), at(1))
    fine = (
        (at(4) == "GP-A") & at(0).isin("sh", "sz", "bj") & at(1).rlike(r"^\d{6}$") & (at(2) != "")
        & (F.length(at(2)) <= 80) & ~at(2).rlike(r"[<>\x00-\x1f]") & (normalize_symbol(symbol) == symbol)
    )
    return df.filter(fine).select(
        *[c for c in df.columns if c != "_r"], symbol.alias("symbol"), at(2).alias("name"), at(0).alias("exchange"))
