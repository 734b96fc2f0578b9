"""Sector lists and stock-to-sector membership pages."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.clock import shanghai_date, strict_date
from ..functions.numbers import finite, strict_number
from .captures import first_code, split_valid

# Link patterns of the membership page.
PAGE_CODE = r"""\bvar\s+papercode\s*=\s*['"]([^'"]+)['"]"""
CATEGORY_LINK = (
    r"""href=["']https://finance\.sina\.com\.cn/data/index\.html#stock-schq-hsgs-xlhy/(new_[a-z0-9]+)["'][^>]*>\s*行业对比\s*</a>"""
)
LABEL_LINK = r"""href=["']https?://vip\.stock\.finance\.sina\.com\.cn/mkt/#(new_[a-z0-9]+)["'][^>]*>([^<>]+)</a>"""

RANKED_ROWS = "array<struct<f2:double,f3:double,f4:double,f12:string,f13:int,f14:string,f297:string>>"
RANKED = f"struct<rc:int,data:struct<total:int,diff:{RANKED_ROWS}>>"


def decode_ranked_sectors(raw: DataFrame, direction: str = "leaders"):
    """Provider-ordered sector lists: (valid sectors, quarantined captures).

    Codes must be unique and the returned order must match the direction.
    """
    df = raw.withColumn("_doc", F.from_json("body", RANKED))
    d = F.col("_doc.data")
    rows = F.coalesce(d["diff"], F.array().cast(RANKED_ROWS))
    df = df.withColumn("_rows", rows)
    rows = F.col("_rows")
    today = shanghai_date(F.col("fetched_at"))

    def code(r, i):
        before = F.get(rows, i - 1)["f3"]
        wrong = (r["f3"] > before) if direction == "leaders" else (r["f3"] < before)
        date = F.when(r["f297"].rlike(r"^\d{8}$"), strict_date(r["f297"]))
        name = F.coalesce(F.trim(r["f14"]) != "", F.lit(False))
        ident = F.coalesce(r["f12"].rlike(r"^BK\d{4,6}$") & (r["f13"] == 90), F.lit(False))
        return (
            F.when(~(ident & name), "INVALID_SECTOR_ID")
            .when(date.isNull(), "SECTOR_DATE_UNAVAILABLE")
            .when(date > today, "INVALID_SECTOR_DATE")
            .when(~finite(r["f2"]) | (r["f2"] <= 0) | ~finite(r["f3"]) | ~finite(r["f4"]), "INVALID_SECTOR_VALUE")
            .when((i > 0) & wrong, "INVALID_SECTOR_SORT")
        )

    codes = F.transform(rows, lambda r: r["f12"])
    df = df.withColumn("reason", F.coalesce(
        F.when((F.col("_doc.rc") != 0) | F.col("_doc.rc").isNull() | (F.size(rows) == 0)
               | F.coalesce(d["total"] < F.size(rows), F.lit(True)), "SECTOR_LIST_UNAVAILABLE"),
        first_code(F.transform(rows, code)),
        F.when(F.size(F.array_distinct(codes)) < F.size(codes), "INVALID_SECTOR_ID")))
    good, bad = split_valid(df.drop("_doc", "body"))
    keep = [c for c in good.columns if c != "_rows"]
    item = F.transform("_rows", lambda r: F.struct(
        r["f12"].alias("code"), r["f14"].alias("name"), r["f3"].alias("change_percent"),
        r["f2"].alias("index_points"), r["f4"].alias("change_points"),
        strict_date(r["f297"]).alias("provider_date_label")))
    return good.select(*keep, F.lit("eastmoney").alias("source"), F.posexplode(item).alias("position", "_s")).select(
        *keep, "source", "position", "_s.*"), bad.drop("_rows")


def decode_mapped_sectors(raw: DataFrame):
    """13-field sector maps: (valid sectors, quarantined captures)."""
    text = F.regexp_extract(F.trim("body"), r"(?s)^var S_Finance_bankuai_sinaindustry\s*=\s*(\{.*\});?$", 1)
    df = raw.withColumn("_map", F.from_json(text, "map<string,string>"))
    pairs = F.transform(F.map_entries("_map"), lambda e: F.struct(e["key"].alias("key"), F.split(e["value"], ",", -1).alias("f")))
    df = df.withColumn("_rows", pairs)
    change = lambda f: strict_number(F.get(f, F.lit(5)))

    def code(e):
        f = e["f"]
        fine = (F.size(f) == 13) & (F.get(f, F.lit(0)) == e["key"]) & e["key"].rlike(r"^new_[a-z0-9]+$") & (F.get(f, F.lit(1)) != "")
        return F.when(~F.coalesce(fine & change(f).isNotNull(), F.lit(False)), "INVALID_SINA_SECTOR")

    df = df.withColumn("reason", F.coalesce(
        F.when(text == "", "INVALID_SINA_SECTOR_WRAPPER"),
        F.when(F.coalesce(F.size("_rows"), F.lit(0)) <= 0, "SINA_SECTORS_UNAVAILABLE"),
        first_code(F.transform("_rows", code))))
    good, bad = split_valid(df.drop("_map", "body"))
    keep = [c for c in good.columns if c not in ("_rows", "source")]
    item = F.transform("_rows", lambda e: F.struct(
        e["key"].alias("code"), F.get(e["f"], F.lit(1)).alias("name"), change(e["f"]).alias("change_percent")))
    out = good.select(*keep, F.lit("sina").alias("source"), F.inline(item))
    return out.withColumn("index_points", F.lit(None).cast("double")), bad.drop("_rows")


def extract_membership(pages: DataFrame):
    """Sector membership from stock pages: (valid, quarantine).

    A page counts only with one identity equal to its symbol, one category
    link and one label link of that category.
    """
    body = F.col("body")
    ids = F.regexp_extract_all(body, F.lit(PAGE_CODE), 1)
    codes = F.regexp_extract_all(body, F.lit(CATEGORY_LINK), 1)
    link_codes = F.regexp_extract_all(body, F.lit(LABEL_LINK), 1)
    link_names = F.regexp_extract_all(body, F.lit(LABEL_LINK), 2)
    df = pages.withColumns({"_ids": ids, "_codes": codes, "_lc": link_codes, "_ln": link_names})
    code = F.get("_codes", F.lit(0))
    named = F.filter(F.arrays_zip(F.col("_lc").alias("c"), F.col("_ln").alias("n")), lambda p: p["c"] == code)
    label = F.trim(F.get(named, F.lit(0))["n"])
    reason = (
        F.when((F.size("_ids") != 1) | (F.get("_ids", F.lit(0)) != F.col("symbol")), "MEMBERSHIP_PAGE_IDENTITY_MISMATCH")
        .when(F.size("_codes") != 1, "MEMBERSHIP_CLASSIFICATION_UNAVAILABLE")
        .when((F.size(named) != 1) | (label == ""), "MEMBERSHIP_LABEL_UNAVAILABLE")
    )
    df = df.withColumns({"code": code, "name": label, "reason": reason}).drop("body", "_ids", "_codes", "_lc", "_ln")
    return split_valid(df)
