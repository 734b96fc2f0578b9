"""Stored documents as screen input: one record for each code, refused inputs, series nobody supplied."""

import json

import pytest

from barloom.operators import adapter
from tests.test_contracts import document

SCHEMA = "symbol string, key string, available boolean, state string, source_finality string, document string, note int"
CALENDAR, POLICY = "exchange-announced-2026-v1", "local-ohlcv-v1"
RUN = {"run_id": "run-1", "target_session": "2024-01-03", "calendar_version": CALENDAR, "policy_version": POLICY}
FRAMES = {"D": {"cutoff_date": "2024-01-03"}, "W": {"cutoff_date": "2024-01-03"}, "M": {"cutoff_date": "2024-01-03", "adjustment": "qfq"}}


def body(symbol, /, **changes):
    return document() | {"symbol": symbol, "calendar_version": CALENDAR, "policy_version": POLICY} | changes


CASES = [
    (True, "ready", {}, None),
    (False, "failed", {}, "UPSTREAM_FAILED_WITHOUT_DATA"), (False, "pending", {}, "SERIES_NOT_AVAILABLE"),
    (True, "partial", {"dataset_id": "x"}, "AVAILABLE_STATE_CONTRADICTION"),
    (True, "ready", {"extra": 1, "dataset_id": "x"}, "QUALITY_UNKNOWN_FIELD"),
    (True, "ready", {"dataset_id": "x", "calendar_version": "x"}, "DATASET_IDENTITY_OR_UNITS"),
    (True, "ready", {"interval": "1w"}, "DATASET_IDENTITY_OR_UNITS"), (True, "ready", {"symbol": "SZ000001"}, "DATASET_IDENTITY_OR_UNITS"),
    (True, "ready", {"source": "sina"}, "DATASET_IDENTITY_OR_UNITS"), (True, "ready", {"target_session": "2024-01-02"}, "DATASET_IDENTITY_OR_UNITS"),
    (True, "ready", {"policy_version": "x", "fetched_at": "2024-01-03T07:00:00Z"}, "DATASET_FREEZE_TUPLE_MISMATCH"),
    (True, "ready", {"fetched_at": "2024-01-03T07:59:59Z"}, "RECEIPT_CLOCK_INVALID"),
    (True, "ready", {"request_started_at": "2024-01-03T15:00:00+08:00"}, "RECEIPT_CLOCK_INVALID"),
]


def records():
    rows = []
    for i, (available, state, changes, _) in enumerate(CASES):
        symbol = f"sh{600000 + i}"
        rows.append((symbol, "1d:none", available, state, "unknown", json.dumps(body(symbol.upper(), **changes)), i))
    return rows


def test_one_code_per_series(spark):
    series, bars, notes = adapter.adapt_documents(spark.createDataFrame(records(), SCHEMA), FRAMES, RUN)
    got = {r.symbol: r.error_code for r in series.collect()}
    want = {f"SH{600000 + i}": c[3] for i, c in enumerate(CASES) if c[3] != "SERIES_NOT_AVAILABLE"}
    assert got == want
    rows = bars.orderBy("date").collect()
    assert [(r.symbol, str(r.date), str(r.period_start), r.close, r.completion) for r in rows] == [
        ("SH600000", "2024-01-02", "2024-01-02", None, "unknown"), ("SH600000", "2024-01-03", "2024-01-03", 10.5, "unknown")]
    codes = {(r.symbol, r.timeframe): r.code for r in notes.collect()}
    # Weeks were not supplied; adjusted months are no known series.
    assert {k: v for k, v in codes.items() if k[0] == "SH600000"} == {("SH600000", "W"): "SERIES_NOT_AVAILABLE", ("SH600000", "M"): "SERIES_NOT_IN_REGISTRY"}
    assert {k[0]: v for k, v in codes.items() if k[1] == "D"} == {
        f"SH{600000 + i}": c[3] for i, c in enumerate(CASES) if c[3] not in (None, "UPSTREAM_FAILED_WITHOUT_DATA")}


def test_last_bar_off_the_target_and_unknown_calendar(spark):
    early = body("SH600000", calendar_version="c")
    early["bars"] = early["bars"][:1]
    early["coverage"] |= {"returned": 1, "last_date": "2024-01-02"}
    empty = body("SH600001", calendar_version="c", bars=[])
    empty["coverage"] |= {"returned": 0}
    rows = [(s, "1d:none", True, "ready", "unknown", json.dumps(x), None) for s, x in (("SH600000", early), ("SH600001", empty))]
    series, bars, notes = adapter.adapt_documents(spark.createDataFrame(rows, SCHEMA), {"D": FRAMES["D"]}, RUN | {"calendar_version": "c"})
    assert {r.symbol: (r.status, r.error_code) for r in series.collect()} == {
        "SH600000": ("error", "OBSERVATION_TARGET_MISMATCH"), "SH600001": ("ready", None)}
    assert bars.collect() == []
    assert sorted((r.symbol, r.code) for r in notes.collect()) == [
        ("SH600000", "CALENDAR_VERSION_UNSUPPORTED"), ("SH600000", "OBSERVATION_TARGET_MISMATCH"), ("SH600001", "CALENDAR_VERSION_UNSUPPORTED")]


BAD = [
    (("x", "1d:none", True, "ready", "unknown", "{}", 0), "ADAPTER_RECORD_INVALID"),
    ((None, "1d:none", True, "ready", "unknown", "{}", 0), "ADAPTER_RECORD_INVALID"),
    (("SZ000001", "1y:none", True, "ready", "unknown", "{}", 0), "ADAPTER_RECORD_INVALID"),
    (("SZ000001", "1d:none", None, "ready", "unknown", "{}", 0), "ADAPTER_RESULT_INVALID"),
    (("SZ000001", "1d:none", True, "lost", "unknown", "{}", 0), "ADAPTER_RESULT_INVALID"),
    (("SZ000001", "1d:none", True, "ready", None, "{}", 0), "ADAPTER_RESULT_INVALID"),
    (("SZ000001", "1d:none", False, "failed", "final", "{}", 0), "ADAPTER_RESULT_INVALID"),
    (("SH600000", "1d:none", False, "failed", None, None, 0), "DUPLICATE_SERIES"),
]


@pytest.mark.parametrize(("row", "code"), BAD[:1] + BAD[-1:])
def test_one_bad_record_refuses_all(spark, row, code):
    series, bars, notes = adapter.adapt_documents(spark.createDataFrame([*records(), row], SCHEMA), FRAMES, RUN)
    assert series.collect() == bars.collect() == []
    assert [(r.symbol, r.code) for r in notes.collect()] == [(None, code)]


def test_batches_are_refused_one_by_one(spark):
    rows = [(*r, b) for b in range(len(BAD)) for r in (records()[0], BAD[b][0])] + [(*r, 99) for r in records()]
    series, _, notes = adapter.adapt_documents(spark.createDataFrame(rows, SCHEMA + ", batch int"), {"D": FRAMES["D"]}, RUN, ["batch"])
    assert {r.batch for r in series.collect()} == {99}
    assert {r.batch: r.code for r in notes.collect() if r.symbol is None} == {b: code for b, (_, code) in enumerate(BAD)}


def test_no_records(spark):
    out = adapter.adapt_documents(spark.createDataFrame([], SCHEMA), FRAMES, RUN)
    assert [df.collect() for df in out] == [[], [], []]
