"""Raw captures: reading, text decoding and the valid / quarantine split.

A capture is one provider response: capture_id, source, kind, symbol,
interval, adjustment, request_started_at, fetched_at, request_latency_ms,
body. Decoding stays inside the row, so a bulk decode needs no shuffle; one
bad record sends its whole capture to quarantine with a reason.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import pytasks

FORMATS = ("parquet", "json", "csv", "text", "orc")


def read_table(spark: SparkSession, path: str, fmt="parquet", schema=None, **options) -> DataFrame:
    """Read a folder in one of the supported formats."""
    if fmt not in FORMATS:
        raise ValueError(f"unsupported format {fmt!r}")
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        options = {"header": True, **options}
    return reader.options(**options).load(path)


def decode_text(body: Column, charset="utf-8") -> Column:
    """Bytes to text. GB18030 goes through Arrow; ASCII bodies go there as NULL."""
    if charset.lower() != "gb18030":
        return F.decode(body, charset)
    bytes_as_text = F.decode(body, "iso-8859-1")
    ascii_only = bytes_as_text.rlike(r"^[\x00-\x7f]*$")
    decoded = F.udf(pytasks.gb18030_text, "string", useArrow=True)
    return F.coalesce(F.when(ascii_only, bytes_as_text), decoded(F.when(~ascii_only, body)))


def settled(df: DataFrame) -> DataFrame:
    """Same rows, with every column computed exactly once.

    Spark copies a column's expression into filters pushed below it, which
    would decode an array once per element. A one-row generator stops that.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def split_valid(df: DataFrame, reason="reason"):
    """(valid rows without the reason column, quarantined rows with it)."""
    df = settled(df)
    return df.filter(F.col(reason).isNull()).drop(reason), df.filter(F.col(reason).isNotNull())


def quoted_fields(body: Column, symbol: Column, prefix: str, separator: str) -> Column:
    """Fields of `<prefix><symbol>="a<sep>b..."`; NULL when the symbol is absent."""
    marker = F.concat(F.lit(prefix), symbol, F.lit('="'))
    start = F.position(marker, body)
    inside = F.substring_index(F.substring(body, start + F.length(marker), F.length(body)), '"', 1)
    found = (start > 0) & ~inside.rlike(r"[\r\n]")
    return F.when(found, F.split(inside, separator, -1))


def first_code(codes: Column) -> Column:
    """First non-NULL entry of an array of reason codes."""
    return F.get(F.array_compact(codes), F.lit(0))
