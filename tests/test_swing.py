import datetime as dt

import pytest
from pyspark.sql import functions as F

from barloom.plans import swing as S

SCHEMA = ("symbol string, source string, adjustment string, date date, source_timestamp timestamp, open double, high double, "
          "low double, close double, volume_shares double, complete boolean, row_no long")
AS_OF = "2026-09-30T15:30:04+08:00"


def sessions(dim, n=80, last="2026-09-30"):
    rows = dim.filter((F.col("is_trading")) & (F.col("date") <= F.lit(last).cast("date"))).orderBy(F.col("date").desc()).limit(n).collect()
    return sorted(r.date for r in rows)


def history(days, closes, symbol="sh600000", last_volume=150.0):
    out = []
    for i, (d, c) in enumerate(zip(days, closes)):
        stamp = dt.datetime(d.year, d.month, d.day, 7)
        volume = last_volume if i == len(days) - 1 else 100.0
        out.append([symbol, "tencent", "qfq", d, stamp, c, c + 0.2, c - 0.2, c, volume, True, i])
    return out


def run(spark, dim, rows, as_of=AS_OF, **kw):
    df = spark.createDataFrame([tuple(r) for r in rows], SCHEMA)
    return {r.symbol: r for r in S.swing_screen(df, dim, F.lit(as_of).cast("timestamp"), **kw).collect()}


def test_phases(spark, dim):
    days = sessions(dim)
    mature = history(days, [100.0 + i for i in range(80)], "sh600000")
    early = history(days, [200.0 - i for i in range(55)] + [146 + 0.5 * i for i in range(24)] + [165.0], "sh600001")
    flat = history(days, [100.0] * 80, "sh600002")
    got = run(spark, dim, mature + early + flat)
    assert (got["sh600000"].status, got["sh600000"].phase) == ("match", "continuation")
    assert got["sh600000"].emerging is True
    assert (got["sh600001"].status, got["sh600001"].phase) == ("match", "emerging")
    assert (got["sh600002"].status, got["sh600002"].reason_code) == ("not_match", "NO_RULE_MATCH")
    assert got["sh600000"].volume_ratio20 == 1.5 and got["sh600000"].used_count == 65
    assert "OVEREXTENDED_MA20" not in got["sh600000"].risk_flags


def _edit(index, **changes):
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def apply(rows):
        row = rows[index]
        for k, v in changes.items():
            row[names.index(k)] = v
        return rows
    return apply


REJECTS = {
    "INVALID_HISTORY_DATE": _edit(70, source_timestamp=dt.datetime(2026, 1, 1)),
    "DUPLICATE_HISTORY_DATE": lambda rows: rows + [[*rows[-1][:-1], len(rows)]],
    "MIXED_HISTORY_BASIS": _edit(70, source="sina"),
    "INVALID_HISTORY_VALUES": _edit(70, low=-1.0),
    "STALE_DAILY_HISTORY": lambda rows: rows[:-1],
    "INSUFFICIENT_COMPLETED_BARS": lambda rows: rows[-64:],
    "MISSING_SCHEDULED_SESSIONS": lambda rows: rows[:40] + rows[41:],
    "BAR_ON_NONTRADING_DATE": _edit(70, date=dt.date(2026, 9, 26), source_timestamp=dt.datetime(2026, 9, 26, 7)),
}


@pytest.mark.parametrize("code", REJECTS)
def test_rejects(spark, dim, code):
    rows = REJECTS[code](history(sessions(dim), [100.0 + i for i in range(80)]))
    got = run(spark, dim, rows)["sh600000"]
    assert (got.status, got.reason_code, got.phase, got.ma20) == ("insufficient_data", code, None, None)


def test_zero_baseline(spark, dim):
    rows = history(sessions(dim), [100.0 + i for i in range(80)])
    for r in rows:
        r[9] = 0.0
    assert run(spark, dim, rows)["sh600000"].reason_code == "NONPOSITIVE_VOLUME_BASELINE"


def test_first_fault_in_input_order_wins(spark, dim):
    rows = history(sessions(dim), [100.0 + i for i in range(80)])
    rows = _edit(30, low=-1.0)(rows)
    rows = _edit(60, source="sina")(rows)
    assert run(spark, dim, rows)["sh600000"].reason_code == "INVALID_HISTORY_VALUES"


def test_current_day_is_skipped_before_its_boundary(spark, dim):
    rows = history(sessions(dim), [100.0 + i for i in range(80)])
    got = run(spark, dim, rows, as_of="2026-09-30T15:30:03+08:00")["sh600000"]
    assert got.excluded_current_date == 1 and got.last_date == dt.date(2026, 9, 29) and got.status != "insufficient_data"


def test_members_without_bars_stay_in_the_result(spark, dim):
    rows = history(sessions(dim), [100.0 + i for i in range(80)])
    universe = spark.createDataFrame([("sh600000",), ("sh600777",)], "symbol string")
    got = run(spark, dim, rows, universe=universe)
    assert got["sh600777"].reason_code == "INVALID_HISTORY"


def test_threshold_bounds():
    assert S.thresholds({"max_return_5d_pct": 30})["max_return_5d_pct"] == 30
    for bad in ({"x": 1}, {"max_return_5d_pct": 0}, {"breakout_volume_ratio": float("nan")}, {"breakout_volume_ratio": True}):
        with pytest.raises(ValueError):
            S.thresholds(bad)


def test_summary_adds_up_and_contract_holds(spark, dim):
    days = sessions(dim)
    rows = history(days, [100.0 + i for i in range(80)]) + history(days, [100.0] * 80, "sh600002") + history(days[:30], [1.0] * 30, "sh600003")
    df = spark.createDataFrame([tuple(r) for r in rows], SCHEMA)
    result = S.swing_screen(df, dim, F.lit(AS_OF).cast("timestamp"))
    s = S.swing_summary(result).first()
    assert s.total == s.match + s.not_match + s.insufficient_data == 3
    assert S.check_swing_result(result).count() == 0
    assert S.check_swing_result(result.withColumn("phase", F.lit("emerging"))).count() >= 2


def test_histories_of_another_basis_and_out_of_order(spark, dim):
    days = sessions(dim)
    shuffled = history(days, [100.0 + i for i in range(80)], "sh600000")
    shuffled[10][-1], shuffled[20][-1] = 20, 10
    other = [[*r[:1], "sina", *r[2:]] for r in history(days, [100.0] * 80, "sh600001")]
    mixed = history(days, [100.0] * 80, "sh600002")
    mixed[5][1] = "sina"
    got = run(spark, dim, shuffled + other + mixed)
    assert got["sh600000"].reordered is True and got["sh600000"].status == "match"
    assert (got["sh600001"].reason_code, got["sh600001"].reordered) == ("INVALID_HISTORY_BASIS", False)
    assert got["sh600002"].reason_code == "MIXED_HISTORY_BASIS"
    many = run(spark, dim, shuffled, requested=79)
    assert many["sh600000"].reason_code == "INVALID_HISTORY_BASIS"
    wrong = spark.createDataFrame([tuple(r) for r in shuffled], SCHEMA).withColumn("interval", F.lit("1w"))
    assert S.swing_screen(wrong, dim, F.lit(AS_OF).cast("timestamp")).first().reason_code == "INVALID_HISTORY_BASIS"
