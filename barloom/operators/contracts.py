"""Field contracts of dataset documents, judged as columns over VARIANT values.

A contract maps field names to tests. An object is judged in a fixed order: no
object at all, fields the contract does not know, then each field of the
contract in turn (absent, or of the wrong type or value). Documents are judged
row by row without a shuffle; a document without JSON is no object.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.captures import settled

Test = Callable[[Column], Column]


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _string(v: Column) -> Column:
    return F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _number(v: Column) -> Column:
    return F.when(_kind(v).rlike("^(BIGINT|DECIMAL|DOUBLE)"), F.try_variant_get(v, "$", "double"))


def _is_text(s: Column) -> Column:
    return F.length(s).between(1, 1024)


def _is_date(s: Column) -> Column:
    return s.rlike(r"^\d{4}-\d{2}-\d{2}$") & s.try_cast("date").isNotNull()


def _is_clock(s: Column) -> Column:
    return s.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$") & s.try_cast("timestamp").isNotNull()


def text(v: Column) -> Column:
    return _is_text(_string(v))


def date(v: Column) -> Column:
    return _is_date(_string(v))


def clock(v: Column) -> Column:
    return _is_clock(_string(v))


def stamp(v: Column) -> Column:
    return date(v) | clock(v)


def _is_count(n: Column) -> Column:
    return (n == F.floor(n)) & n.between(0, 2000)


def count(v: Column) -> Column:
    return _is_count(_number(v))


def flag(v: Column) -> Column:
    return _kind(v) == "BOOLEAN"


def nothing(v: Column) -> Column:
    return _kind(v) == "VOID"


def number_or_null(v: Column) -> Column:
    return nothing(v) | _number(v).isNotNull()


def flag_or_null(v: Column) -> Column:
    return nothing(v) | flag(v)


def table(v: Column) -> Column:
    return _kind(v).startswith("OBJECT")


def one_of(*values: str) -> Test:
    return lambda v: _string(v).isin(*values)


def is_flag(value: bool) -> Test:
    return lambda v: F.when(flag(v), F.try_variant_get(v, "$", "boolean") == F.lit(value))


def matching(pattern: str) -> Test:
    return lambda v: _string(v).rlike(pattern)


def array_of(each: Test, most: int, distinct=False) -> Test:
    def test(v):
        items = F.try_variant_get(v, "$", "array<variant>")
        fine = (F.size(items) <= most) & F.forall(items, lambda x: F.coalesce(each(x), F.lit(False)))
        if not distinct:
            return fine
        return fine & (F.size(F.array_distinct(F.transform(items, _string))) == F.size(items))

    return test


def anything(v: Column) -> Column:
    return v.isNotNull()


SYMBOL, HASH, VOLUME = r"^(?i)(sh|sz)\d{6}$", "^[0-9a-f]{64}$", "shares; provider unadjusted reported volume"
# The fields of a stored dataset, of its parts and of its bars.
COVERAGE = {
    "requested": lambda v: count(v) & (_number(v) > 0), "returned": count, "first_date": date, "last_date": date, "full_history": is_flag(False),
    "calendar_unverified_rows": count, "missing_scheduled_session_dates": array_of(date, 2000, distinct=True), "calendar_gaps_unverified": flag,
    "missing_session_note": text,
}
CACHE = {"used": is_flag(True), "scope": one_of("explicit_local_dataset")}
UNITS = {
    "price": one_of("CNY"), "volume": one_of(VOLUME), "amount": one_of("unavailable=null"),
}
BAR = {
    "date": date, "source_timestamp": stamp, "open": number_or_null, "high": number_or_null, "low": number_or_null, "close": number_or_null,
    "volume_shares": number_or_null, "amount_cny": nothing, "complete": flag, "calendar_completion": flag_or_null, "completion_basis": text,
    "period_end_session": date, "observed_latest": flag_or_null, "source_finality": one_of("unknown"),
}
DOCUMENT = {
    "dataset_id": text, "symbol": matching(SYMBOL), "source": text, "interval": one_of("1d", "1w", "1mo"),
    "adjustment": one_of("none", "qfq"), "target_session": date, "calendar_version": text, "policy_version": text,
    "content_hash": matching(HASH), "request_started_at": clock, "completion_cutoff": clock, "fetched_at": clock,
    "source_timestamp": stamp, "bars": array_of(anything, 2000), "coverage": table, "units": table, "source_finality": one_of("unknown"),
    "point_in_time": is_flag(False), "cache": table, "warnings": array_of(text, 64),
}


PARTS = {"coverage": COVERAGE, "cache": CACHE, "units": UNITS}


def fields_of(value: Column) -> Column:
    """Fields of a VARIANT object by name, NULL for anything else."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def contract_fault(fields: Column, contract: dict[str, Test], optional=()) -> Column:
    """First fault of an object's fields against a contract, NULL if it has none.

    `fields` is best a stored column: each test looks its field up anew.
    """
    known = F.array(*[F.lit(n) for n in contract])
    faults = [F.when(fields.isNull(), "QUALITY_OBJECT_REQUIRED"), F.when(F.size(F.array_except(F.map_keys(fields), known)) > 0, "QUALITY_UNKNOWN_FIELD")]
    for name, test in contract.items():
        wrong = F.when(~F.coalesce(test(fields[name]), F.lit(False)), "QUALITY_INVALID_FIELD")
        absent = F.lit(None).cast("string") if name in optional else F.lit("QUALITY_MISSING_FIELD")
        faults.append(F.when(fields[name].isNotNull(), wrong).otherwise(absent))
    return F.coalesce(*faults)


def _part_fault(fields: Column, contract: dict[str, Test]) -> Column:
    return F.when(fields.isNotNull(), contract_fault(fields, contract))


# Bars that keep their contract have this schema, and texts that pass; all others are judged field by field.
_NUMBER = r"(BIGINT|DECIMAL\(\d+,\s?\d+\)|DOUBLE|VOID)"
_KINDS = {
    "date": "STRING", "source_timestamp": "STRING", "open": _NUMBER, "high": _NUMBER, "low": _NUMBER, "close": _NUMBER, "volume_shares": _NUMBER,
    "amount_cny": "VOID", "complete": "BOOLEAN", "calendar_completion": "(BOOLEAN|VOID)", "completion_basis": "STRING",
    "period_end_session": "STRING", "observed_latest": "(BOOLEAN|VOID)", "source_finality": "STRING",
}
_PLAIN_BAR = "^OBJECT<" + ", ".join(f"{name}: {_KINDS[name]}" for name in sorted(_KINDS)) + ">$"
_BAR_TEXTS = "struct<date:string,source_timestamp:string,completion_basis:string,period_end_session:string,source_finality:string>"


def _plain_bars(bars: Column) -> Column:
    """Whether each of an array's VARIANT bars keeps its contract, by one schema and one cast a bar."""
    texts = F.transform(bars, lambda x: F.when(F.schema_of_variant(x).rlike(_PLAIN_BAR), F.try_variant_get(x, "$", _BAR_TEXTS)))

    def fine(t):
        stamp_, end = t["source_timestamp"], t["period_end_session"]
        dated = _is_date(t["date"]) & ((stamp_ == t["date"]) | _is_date(stamp_) | _is_clock(stamp_)) & ((end == t["date"]) | _is_date(end))
        return F.coalesce(dated & _is_text(t["completion_basis"]) & (t["source_finality"] == "unknown"), F.lit(False))

    return F.coalesce(F.forall(texts, fine), F.lit(True))


_COUNT = r"(BIGINT|DECIMAL\(\d+,\s?\d+\)|DOUBLE)"
_PLAIN_DOCUMENT = (
    r"^OBJECT<adjustment: STRING, bars: ARRAY<(OBJECT<[^<>]*>|[^<>]*)>, cache: OBJECT<scope: STRING, used: BOOLEAN>, calendar_version: STRING, "
    r"completion_cutoff: STRING, content_hash: STRING, coverage: OBJECT<calendar_gaps_unverified: BOOLEAN, calendar_unverified_rows: " + _COUNT
    + r", first_date: STRING, full_history: BOOLEAN, last_date: STRING, missing_scheduled_session_dates: ARRAY<(VOID|STRING)>, "
    r"missing_session_note: STRING, requested: " + _COUNT + ", returned: " + _COUNT + r">, dataset_id: STRING, fetched_at: STRING, interval: STRING, "
    r"point_in_time: BOOLEAN, policy_version: STRING, request_started_at: STRING, source: STRING, source_finality: STRING, source_timestamp: STRING, "
    r"symbol: STRING, target_session: STRING, units: OBJECT<amount: STRING, price: STRING, volume: STRING>>$")
_DOCUMENT_VALUES = (
    "struct<dataset_id:string,symbol:string,source:string,interval:string,adjustment:string,target_session:string,calendar_version:string,"
    "policy_version:string,content_hash:string,request_started_at:string,completion_cutoff:string,fetched_at:string,source_timestamp:string,"
    "source_finality:string,point_in_time:boolean,cache:struct<used:boolean,scope:string>,units:struct<price:string,volume:string,amount:string>,"
    "coverage:struct<requested:double,returned:double,calendar_unverified_rows:double,first_date:string,last_date:string,full_history:boolean,"
    "missing_scheduled_session_dates:array<string>,missing_session_note:string>>")


def _plain_values(d: Column) -> Column:
    """Whether the values of a document with the plain schema keep the contracts of document, coverage, cache and units."""
    c, at = d["coverage"], d["source_timestamp"]
    lacking = c["missing_scheduled_session_dates"]
    tests = [
        *[_is_text(d[k]) for k in ("dataset_id", "source", "calendar_version", "policy_version")], _is_date(d["target_session"]),
        d["symbol"].rlike(SYMBOL), d["interval"].isin("1d", "1w", "1mo"), d["adjustment"].isin("none", "qfq"), d["content_hash"].rlike(HASH),
        *[_is_clock(d[k]) for k in ("request_started_at", "completion_cutoff", "fetched_at")], _is_date(at) | _is_clock(at),
        d["source_finality"] == "unknown", ~d["point_in_time"], d["cache"]["used"], d["cache"]["scope"] == "explicit_local_dataset",
        d["units"]["price"] == "CNY", d["units"]["volume"] == VOLUME, d["units"]["amount"] == "unavailable=null",
        *[_is_count(c[k]) for k in ("requested", "returned", "calendar_unverified_rows")], c["requested"] > 0, _is_date(c["first_date"]),
        _is_date(c["last_date"]), ~c["full_history"], _is_text(c["missing_session_note"]), F.size(lacking) <= 2000,
        F.forall(lacking, lambda x: F.coalesce(_is_date(x), F.lit(False))), F.size(F.array_distinct(lacking)) == F.size(lacking),
    ]
    fine = tests[0]
    for test in tests[1:]:
        fine = fine & test
    return F.coalesce(fine, F.lit(False))


def _first(codes: Column) -> Column:
    return F.get(F.filter(codes, lambda c: c.isNotNull()), F.lit(0))


def _value_fault(bars: Column) -> Column:
    """First fault of bars in order: dates that do not rise, values, their bounds."""
    def one(bar, i):
        o, h, l, c = (bar[x] for x in ("open", "high", "low", "close"))
        late = (i > 0) & (bar["date"] <= F.get(bars, i - 1)["date"])
        bad = (o <= 0) | (h <= 0) | (l <= 0) | (c <= 0) | (bar["volume_shares"] < 0)
        whole = o.isNotNull() & h.isNotNull() & l.isNotNull() & c.isNotNull()
        shape = whole & ((l > F.least(o, c)) | (h < F.greatest(o, c)) | (l > h))
        return F.when(late, "MALFORMED_BARS").when(bad, "INVALID_FIELD").when(shape, "INVALID_OHLC")

    return _first(F.transform(bars, one))


def document_faults(documents: DataFrame, column: str) -> DataFrame:
    """`documents` with quality_error: the first fault of the JSON dataset in `column`, NULL if it has none.

    Fields come first (document, coverage, cache, units, bars), then the bars'
    order and values, then what the coverage says of them.
    """
    v, b, c = F.col("_variant"), F.col("_bars"), F.col("_span")
    values = "array<struct<date:string,open:double,high:double,low:double,close:double,volume_shares:double>>"
    span = "struct<requested:double,returned:double,calendar_unverified_rows:double,first_date:string,last_date:string>"
    # Each step is stored, as tests would otherwise take the document apart once per look-up.
    rows = settled(documents.withColumn("_variant", F.try_parse_json(column)))
    rows = settled(rows.withColumns({
        "_values": F.when(F.schema_of_variant(v).rlike(_PLAIN_DOCUMENT), F.try_variant_get(v, "$", _DOCUMENT_VALUES)),
        "_items": F.try_variant_get(v, "$.bars", "array<variant>"), "_bars": F.try_variant_get(v, "$.bars", values),
        "_span": F.try_variant_get(v, "$.coverage", span)}))
    plain = _plain_values(F.col("_values")) & F.coalesce(F.size("_items") <= 2000, F.lit(False))
    rows = settled(rows.withColumns({
        "_fields": F.when(~plain, fields_of(v)), "_plain": plain,
        "_items": F.when(~_plain_bars(F.col("_items")), F.col("_items"))}).drop("_variant", "_values"))
    f = F.col("_fields")
    rows = settled(rows.withColumns({
        **{f"_{name}": fields_of(f[name]) for name in PARTS}, "_bar_fields": F.transform("_items", fields_of)}).drop("_items"))
    fields = F.coalesce(
        F.when(~F.col("_plain"), F.coalesce(contract_fault(f, DOCUMENT, optional=("warnings",)),
                                            *[_part_fault(F.col(f"_{name}"), part) for name, part in PARTS.items()])),
        _first(F.transform("_bar_fields", lambda x: contract_fault(x, BAR))))
    rows = settled(rows.withColumn("_fault", fields).drop("_plain", "_fields", "_bar_fields", *[f"_{name}" for name in PARTS]))
    n = F.size(b)
    against = (
        (c["returned"] != n) | (c["returned"] > c["requested"]) | (c["calendar_unverified_rows"] > c["returned"])
        | ((n > 0) & ((c["first_date"] != F.get(b, F.lit(0))["date"]) | (c["last_date"] != F.get(b, n - 1)["date"])))
    )
    error = F.coalesce("_fault", _value_fault(b), F.when(against, "QUALITY_COVERAGE_CONTRADICTION"))
    return rows.withColumn("quality_error", error).drop("_fault", "_bars", "_span")
