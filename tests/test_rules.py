import copy
import datetime as dt

import pytest
from pyspark.sql import functions as F

from barloom.operators.calendar import VERIFIED
from barloom.plans import rules as R

TARGET = dt.date(2026, 9, 30)
RUN = {"generation": "synthetic-a", "target_session": "2026-09-30", "calendar_version": "exchange-announced-2026-v1",
       "policy_version": "local-ohlcv-v1", "synthetic": True, "directory_as_of": "2026-09-30"}
FRAMES = {"D": {"cutoff_date": "2026-09-30", "expected_last_date": "2026-09-30"}}
BAR = ("symbol string, timeframe string, date date, period_start date, period_end date, completion string, calendar_completion boolean, "
       "completion_basis string, source string, adjustment string, open double, high double, low double, close double, volume_shares double")
SERIES = ("symbol string, timeframe string, status string, dataset_id string, target_session date, calendar_version string, policy_version string, "
          "request_started_at timestamp, completion_cutoff timestamp, fetched_at timestamp, source string, adjustment string, currency string, "
          "volume_unit string, returned long, missing_sessions array<date>, calendar_gaps_unverified boolean")
AT = dt.datetime(2026, 9, 30, 8, 0)


def condition(cid, left, op, right, tf="D"):
    return {"type": "condition", "id": cid, "timeframe": tf, "left": left, "op": op, "right": right}


def rule(node):
    return {"version": 1, "root": node}


CLOSE = {"kind": "field", "field": "close"}
const = lambda v: {"kind": "constant", "value": v}


class World:
    """Small universe of series with one bar per session up to the target."""

    def __init__(self, dim):
        self.days = sorted(r.date for r in dim.filter(F.col("is_trading") & (F.col("date") <= F.lit(TARGET))).orderBy(F.col("date").desc()).limit(90).collect())
        self.universe, self.stocks, self.series, self.bars = [], [], [], []

    def add(self, symbol, closes, volumes=None, st="non_st", name="name", board="mainboard", status="ready", suspension="active",
            missing=(), series_status="ready", edit=None, returned=None, **series):
        days = self.days[-len(closes):]
        bars = [[symbol, "D", d, d, d, "complete", True, VERIFIED, "tencent", "none", float(c), c + 1.0, c - 1.0, float(c),
                 float(volumes[i]) if volumes else 100.0] for i, (d, c) in enumerate(zip(days, closes))]
        if edit:
            edit(bars)
        self.bars += bars
        self.universe.append((symbol, symbol[:2].upper(), name, board, st, len(self.universe)))
        if status:
            self.stocks.append((symbol, status, suspension, dt.date(2026, 12, 31)))
        base = dict(dataset_id="synthetic-a", target_session=TARGET, policy_version="local-ohlcv-v1", fetched_at=AT, adjustment="none", currency="CNY")
        base.update(series)
        self.series.append((symbol, "D", series_status, base["dataset_id"], base["target_session"], RUN["calendar_version"], base["policy_version"], AT, AT,
                            base["fetched_at"], "tencent", base["adjustment"], base["currency"], "shares", returned if returned is not None else len(bars), list(missing), False))
        return self

    def screen(self, spark, r, limits=None, frames=FRAMES, run=RUN):
        u = spark.createDataFrame(self.universe, "symbol string, exchange string, name string, board string, st_status string, catalog_no long")
        st = spark.createDataFrame(self.stocks, "symbol string, status string, suspension_state string, verified_through date")
        se = spark.createDataFrame(self.series, SERIES)
        b = spark.createDataFrame([tuple(x) for x in self.bars], BAR)
        rows, conditions = R.screen(u, st, se, b, frames, run, r, limits)
        return {x.symbol: x for x in rows.collect()}, {(x.symbol, x.id): x for x in conditions.collect()}, R.screen_counts(rows).first()


def test_operand_values(spark, dim):
    w = World(dim).add("sh600000", [10, 12, 14], [100, 200, 600])
    node = {"type": "group", "op": "AND", "children": [
        condition("ma", {"kind": "ma", "field": "close", "window": 2}, "eq", const(13)),
        condition("vma", {"kind": "volume_ma", "window": 2}, "eq", const(400)),
        condition("chg", {"kind": "change_pct", "window": 2}, "gt", const(39.99)),
        condition("high", {"kind": "prior_high", "window": 2}, "eq", const(13)),
        condition("ratio", {"kind": "volume_ratio", "window": 2}, "eq", const(4)),
        condition("back", {"kind": "field", "field": "close", "offset": 1}, "eq", const(12)),
    ]}
    rows, conditions, _ = w.screen(spark, rule(node))
    assert {c.severity for c in conditions.values()} == {R.MATCH}
    assert rows["sh600000"].state == "match" and rows["sh600000"].passed is True


@pytest.mark.parametrize("closes, state", [([9, 10, 11], "match"), ([9, 9, 10], "no_match"), ([11], "insufficient")])
def test_cross(spark, dim, closes, state):
    rows, _, _ = World(dim).add("sh600000", closes).screen(spark, rule(condition("x", CLOSE, "cross_above", const(10))))
    assert rows["sh600000"].state == state


def test_unknown_beats_match_in_or(spark, dim):
    node = {"type": "group", "op": "OR", "children": [condition("yes", CLOSE, "gt", const(1)), condition("far", {"kind": "ma", "field": "close", "window": 250}, "gt", const(1))]}
    rows, _, _ = World(dim).add("sh600000", [10] * 20).screen(spark, rule(node))
    assert (rows["sh600000"].state, rows["sh600000"].decision, rows["sh600000"].passed) == ("insufficient", "unknown", None)


def _set(index, column, value):
    names = [c.split()[0] for c in BAR.split(", ")]

    def edit(bars):
        bars[index][names.index(column)] = value
    return edit


GT = rule(condition("c", {"kind": "ma", "field": "close", "window": 3}, "gt", const(1)))
FAULTS = [
    (dict(edit=_set(-1, "volume_shares", None)), "insufficient", "MISSING_FIELD"),
    (dict(edit=_set(2, "low", -5.0)), "failure", "INVALID_FIELD"),
    (dict(edit=_set(2, "low", 50.0)), "failure", "INVALID_OHLC"),
    (dict(edit=_set(2, "source", "sina")), "failure", "MIXED_PROVENANCE"),
    (dict(edit=lambda b: b.append(list(b[2]))), "failure", "MALFORMED_BARS"),
    (dict(edit=lambda b: b.pop()), "insufficient", "STALE_DATA"),
    (dict(edit=_set(-1, "completion", "unknown")), "insufficient", "COMPLETION_UNKNOWN"),
    (dict(edit=_set(-2, "completion", "unknown")), "insufficient", "COMPLETION_UNKNOWN"),
    (dict(missing=[dt.date(2026, 9, 29)]), "insufficient", "MISSING_SCHEDULED_SESSIONS"),
    (dict(dataset_id="synthetic-b"), "failure", "DATASET_GENERATION_MISMATCH"),
    (dict(policy_version="other"), "failure", "DATASET_FREEZE_TUPLE_MISMATCH"),
    (dict(fetched_at=dt.datetime(2026, 9, 30, 7, 59)), "failure", "RECEIPT_CLOCK_INVALID"),
    (dict(currency="USD"), "failure", "PROVENANCE_UNITS"),
    (dict(series_status="error"), "failure", "DATA_FAILURE"),
    (dict(series_status="pending"), "insufficient", "MISSING_FRAME"),
    (dict(returned=3), "failure", "QUALITY_COVERAGE_CONTRADICTION"),
]


@pytest.mark.parametrize("change, state, code", FAULTS, ids=[f[2] + str(i) for i, f in enumerate(FAULTS)])
def test_frame_and_window_faults(spark, dim, change, state, code):
    rows, conditions, _ = World(dim).add("sh600000", [10.0] * 6, **change).screen(spark, GT)
    assert rows["sh600000"].state == state
    assert conditions[("sh600000", "c")].codes == [code]


def test_frame_cutoff_must_be_the_target(spark, dim):
    frames = {"D": {"cutoff_date": "2026-09-29", "expected_last_date": "2026-09-29"}}
    _, conditions, _ = World(dim).add("sh600000", [10.0] * 6).screen(spark, GT, frames=frames)
    assert conditions[("sh600000", "c")].codes == ["FRAME_TARGET_MISMATCH"]


def test_golden_snapshot_counts(spark, dim):
    rising = [100 + 0.5 * i for i in range(90)]
    loud = [100.0] * 89 + [200.0]
    rising[-1] = 160.0
    w = World(dim)
    w.add("sh600000", rising, loud)
    w.add("sh600001", [200 - 0.5 * i for i in range(90)])
    w.add("sh600002", [10.0] * 8)
    w.add("sh600003", rising, loud, edit=lambda b: b.pop())
    w.add("sh600004", rising, loud, status="error")
    w.add("sh600005", rising, loud, suspension="unknown")
    w.add("sh600006", rising, loud, edit=_set(-1, "volume_shares", None))
    w.add("sh600007", rising, loud, name="*ST x")
    w.add("sz300001", rising, loud)
    w.add("sh600008", rising, loud, st="unknown")
    rows, _, c = w.screen(spark, R.SWING_PRESET)
    assert (c.total, c.match, c.no_match, c.failure, c.insufficient) == (8, 1, 1, 1, 5)
    assert c.catalog_total == c.excluded_total + c.restriction_excluded_total + c.total == 10
    assert c.total == c.successful + c.failure + c.insufficient + c.unprocessed
    assert rows["sh600004"].gate == "DATA_FAILURE" and rows["sh600008"].gate == "ST_STATUS_UNKNOWN"


def test_limits_only_narrow(spark, dim):
    w = World(dim).add("sh600000", [10.0] * 6).add("sz000001", [10.0] * 6).add("sh600001", [10.0] * 6)
    rows, _, c = w.screen(spark, GT, {"exchanges": ["SH"], "max_processed": 1})
    assert rows["sz000001"].scope == "restriction_excluded"
    assert (rows["sh600000"].state, rows["sh600001"].state, rows["sh600001"].gate) == ("match", "unprocessed", "PROCESS_BUDGET")
    assert c.unprocessed == 1 and c.processed == 1


def test_stale_directory(spark, dim):
    rows, _, _ = World(dim).add("sh600000", [10.0] * 6).screen(spark, GT, run={**RUN, "directory_as_of": "2026-09-29"})
    assert rows["sh600000"].gate == "DIRECTORY_STALE"


def test_rule_checks():
    assert R.validate_rule(R.SWING_PRESET) == []
    good = condition("a", CLOSE, "gt", const(1))
    bad = [
        ({"version": 2, "root": good}, "RULE_VERSION"),
        (rule(condition("a", {"kind": "volume_ma", "window": 5}, "gt", CLOSE)), "UNIT_MISMATCH"),
        (rule(condition("a", const(1), "gt", CLOSE)), "LEFT_CONSTANT"),
        (rule(condition("a", {"kind": "ma", "field": "close", "window": 251}, "gt", const(1))), "INVALID_WINDOW"),
        (rule(condition("a", {"kind": "ma", "field": "volume_shares", "window": 5}, "gt", const(1))), "USE_VOLUME_MA"),
        (rule(condition("a", {"kind": "field", "field": "amount_cny"}, "gt", const(1))), "DISABLED_OR_UNKNOWN_FIELD"),
        (rule(condition("a b", CLOSE, "gt", const(1))), "CONDITION_ID"),
        (rule(condition("a", CLOSE, "between", const(1))), "COMPARISON"),
        (rule(condition("a", CLOSE, "gt", const(1), tf="H")), "TIMEFRAME"),
        (rule({"type": "group", "op": "XOR", "children": [good]}), "GROUP_OPERATOR"),
        (rule({"type": "group", "op": "AND", "children": []}), "GROUP_CHILDREN"),
        (rule({**good, "code": "1+1"}), "UNSUPPORTED_PROPERTY"),
        (rule({"type": "group", "op": "AND", "children": [good, copy.deepcopy(good)]}), "CONDITION_ID"),
    ]
    for r, code in bad:
        assert code in R.validate_rule(r), code
    deep = good
    for _ in range(6):
        deep = {"type": "group", "op": "AND", "children": [deep]}
    assert "RULE_BOUNDS" in R.validate_rule(rule(deep))


def test_tree_severity_table(spark):
    node = {"type": "group", "op": "OR", "children": [condition("a", CLOSE, "gt", const(1)), condition("b", CLOSE, "gt", const(1))]}
    df = spark.createDataFrame([(a, b) for a in range(4) for b in range(4)], "a int, b int")
    either = R.tree_severity(node, lambda c: F.col(c["id"]))
    both = R.tree_severity({**node, "op": "AND"}, lambda c: F.col(c["id"]))
    for r in df.select("a", "b", either.alias("o"), both.alias("n")).collect():
        worst = max(r.a, r.b)
        assert r.o == (worst if worst >= 2 else max(r.a, r.b))
        assert r.n == (worst if worst >= 2 else min(r.a, r.b))
