"""Field contracts of dataset documents: one document for each fault, and their order."""

import copy
import json

from barloom.operators import contracts


def document():
    bar = {
        "date": "2024-01-02", "source_timestamp": "2024-01-02", "open": 10, "high": 11.5, "low": 9.25, "close": None, "volume_shares": 100,
        "amount_cny": None, "complete": True, "calendar_completion": None, "completion_basis": "schedule", "period_end_session": "2024-01-02",
        "observed_latest": False, "source_finality": "unknown",
    }
    return {
        "dataset_id": "run-1", "symbol": "SH600000", "source": "tencent", "interval": "1d", "adjustment": "none", "target_session": "2024-01-03",
        "calendar_version": "c", "policy_version": "p", "content_hash": "0" * 64, "request_started_at": "2024-01-03T16:00:00+08:00",
        "completion_cutoff": "2024-01-03T16:00:00+08:00", "fetched_at": "2024-01-03T08:00:01.5Z", "source_timestamp": "2024-01-03",
        "bars": [bar, bar | {"date": "2024-01-03", "close": 10.5}], "units": {
            "price": "CNY", "volume": "shares; provider unadjusted reported volume", "amount": "unavailable=null"},
        "coverage": {
            "requested": 5, "returned": 2, "first_date": "2024-01-02", "last_date": "2024-01-03", "full_history": False,
            "calendar_unverified_rows": 0, "missing_scheduled_session_dates": [], "calendar_gaps_unverified": False, "missing_session_note": "none"},
        "source_finality": "unknown", "point_in_time": False, "cache": {"used": True, "scope": "explicit_local_dataset"},
    }


CHANGES = [
    ((), None, None), (("warnings",), ["late"], None), (("warnings",), [""], "QUALITY_INVALID_FIELD"), (("extra",), 1, "QUALITY_UNKNOWN_FIELD"),
    (("symbol",), "600000", "QUALITY_INVALID_FIELD"), (("source",), ..., "QUALITY_MISSING_FIELD"), (("source",), 7, "QUALITY_INVALID_FIELD"),
    (("target_session",), "2024-02-30", "QUALITY_INVALID_FIELD"), (("fetched_at",), "2024-01-03", "QUALITY_INVALID_FIELD"),
    (("point_in_time",), "false", "QUALITY_INVALID_FIELD"), (("coverage",), [], "QUALITY_INVALID_FIELD"),
    (("coverage", "requested"), 0, "QUALITY_INVALID_FIELD"), (("coverage", "returned"), 1.5, "QUALITY_INVALID_FIELD"),
    (("coverage", "missing_scheduled_session_dates"), ["2024-01-02"] * 2, "QUALITY_INVALID_FIELD"), (("coverage", "note"), "x", "QUALITY_UNKNOWN_FIELD"),
    (("cache", "used"), False, "QUALITY_INVALID_FIELD"), (("units", "price"), ..., "QUALITY_MISSING_FIELD"),
    (("bars", 1, "open"), "10", "QUALITY_INVALID_FIELD"), (("bars", 0, "amount_cny"), 5, "QUALITY_INVALID_FIELD"),
    (("bars", 0, "turnover"), 5, "QUALITY_UNKNOWN_FIELD"), (("bars", 0, "date"), ..., "QUALITY_MISSING_FIELD"), (("bars", 1), 3, "QUALITY_OBJECT_REQUIRED"),
    (("bars", 1, "date"), "2024-01-02", "MALFORMED_BARS"), (("bars", 0, "open"), 0, "INVALID_FIELD"), (("bars", 1, "volume_shares"), -1, "INVALID_FIELD"),
    (("bars", 1, "high"), 10.25, "INVALID_OHLC"), (("bars", 0, "high"), 1, None), (("coverage", "requested"), 1, "QUALITY_COVERAGE_CONTRADICTION"),
    (("coverage", "calendar_unverified_rows"), 3, "QUALITY_COVERAGE_CONTRADICTION"),
    (("coverage", "last_date"), "2024-01-02", "QUALITY_COVERAGE_CONTRADICTION"), (("bars",), [], "QUALITY_COVERAGE_CONTRADICTION"),
]


def test_first_fault_of_each_document(spark):
    rows, want = [], {}
    for i, (path, value, code) in enumerate(CHANGES):
        doc = copy.deepcopy(document())
        if path:
            *above, last = path
            part = doc
            for step in above:
                part = part[step]
            if value is ...:
                del part[last]
            else:
                part[last] = value
        rows.append((i, json.dumps(doc)))
        want[i] = code
    both = document() | {"extra": 1}
    both["bars"] = []
    rows += [(100, None), (101, "[1]"), (102, "{broken"), (103, json.dumps(both))]
    want |= {100: "QUALITY_OBJECT_REQUIRED", 101: "QUALITY_OBJECT_REQUIRED", 102: "QUALITY_OBJECT_REQUIRED", 103: "QUALITY_UNKNOWN_FIELD"}
    out = contracts.document_faults(spark.createDataFrame(rows, "id int, doc string"), "doc")
    assert out.columns == ["id", "doc", "quality_error"]
    assert {r.id: r.quality_error for r in out.collect()} == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_contract_of_an_empty_table(spark):
    assert contracts.document_faults(spark.createDataFrame([], "doc string"), "doc").collect() == []


def test_sound_documents_are_accepted_by_schema(spark):
    """A sound document passes the quick test of schema and texts; one fault of any kind sends it to the field tests."""
    from pyspark.sql import functions as F

    bad = document() | {"point_in_time": "false"}
    rows = [(json.dumps(document()),), (json.dumps(bad),)]
    df = spark.createDataFrame(rows, "doc string").select(F.parse_json("doc").alias("v"))
    kinds = [r[0] for r in df.select(F.schema_of_variant("v").rlike(contracts._PLAIN_DOCUMENT)).collect()]
    bars = [r[0] for r in df.select(contracts._plain_bars(F.try_variant_get("v", "$.bars", "array<variant>"))).collect()]
    assert kinds == [True, False] and bars == [True, True]
    values = F.try_variant_get("v", "$", contracts._DOCUMENT_VALUES)
    assert df.select(contracts._plain_values(values)).first()[0]
