"""Declarative condition screens.

A rule is a dictionary; it is checked on the driver and turned into columns.
Each series contributes a bounded tail of bars, sized from the rule.
"""

import json
import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.clock import shanghai_date
from ..functions.numbers import finite
from ..functions.symbols import excluded_name, is_screen_mainboard
from ..operators.calendar import VERIFIED
from ..operators.indicators import Series
from ..operators.paging import with_budget
from ..sources.captures import settled


def adapter_completion(complete: Column, calendar: Column, basis: Column) -> Column:
    """complete / partial / unknown from stored completion evidence."""
    verified = basis == VERIFIED
    return (
        F.when(verified & complete & calendar, "complete")
        .when(verified & ~complete & ~calendar, "partial")
        .otherwise("unknown")
    )


def completion_known(completion, calendar, basis, start, end, verified_from, verified_through) -> Column:
    """Whether a bar's completion is backed by calendar evidence."""
    consistent = ((completion != "complete") | calendar) & ((completion != "partial") | ~calendar)
    inside = (start >= verified_from) & (end <= verified_through)
    return F.coalesce(calendar.isNotNull() & consistent & (basis == VERIFIED) & inside, F.lit(False))


# -- rule dictionaries --------------------------------------------------------
# Rule bounds and vocabulary.
MAX_DEPTH, MAX_NODES, MAX_WINDOW, MAX_OFFSET = 6, 100, 250, 250
FRAMES = ("D", "W", "M")
FIELDS = ("open", "high", "low", "close", "volume_shares")
OPS = ("gt", "gte", "lt", "lte", "eq", "neq", "cross_above", "cross_below")
OPERANDS = {
    "constant": ("kind", "value"),
    "field": ("kind", "field", "offset"),
    "ma": ("kind", "field", "window", "offset"),
    "volume_ma": ("kind", "window", "offset"),
    "change_pct": ("kind", "window", "offset"),
    "prior_high": ("kind", "window", "offset"),
    "volume_ratio": ("kind", "window", "offset"),
}
UNITS = {"change_pct": "percent", "volume_ratio": "ratio", "volume_ma": "shares", "prior_high": "CNY"}
SUPPORTED_CALENDARS = {"exchange-announced-2026-v1": ("2026-01-01", "2026-12-31")}
SUPPORTED_POLICIES = ("local-ohlcv-v1",)

SWING_PRESET = {
    "version": 1,
    "root": {"type": "group", "op": "AND", "children": [
        {"type": "condition", "id": "trend", "timeframe": "D", "op": "gt",
         "left": {"kind": "ma", "field": "close", "window": 20}, "right": {"kind": "ma", "field": "close", "window": 60}},
        {"type": "condition", "id": "breakout", "timeframe": "D", "op": "gt",
         "left": {"kind": "field", "field": "close"}, "right": {"kind": "prior_high", "window": 20}},
        {"type": "condition", "id": "volume", "timeframe": "D", "op": "gte",
         "left": {"kind": "volume_ratio", "window": 5}, "right": {"kind": "constant", "value": 1.2}},
    ]},
}


def _is_int(v, low, high):
    return isinstance(v, int) and not isinstance(v, bool) and low <= v <= high


def _unit(e):
    if e.get("kind") == "constant":
        return None
    fallback = {"volume_shares": "shares"}.get(e.get("field"), "CNY" if e.get("field") in FIELDS else None)
    return UNITS.get(e.get("kind"), fallback)


def _operand_errors(e):
    if not isinstance(e, dict):
        return ["INVALID_OPERAND"]
    kind = e.get("kind")
    if kind not in OPERANDS:
        return ["DISABLED_OR_UNKNOWN_INDICATOR"]
    errors = ["UNSUPPORTED_PROPERTY" for k in e if k not in OPERANDS[kind]]
    if kind == "constant":
        v = e.get("value")
        number = isinstance(v, (int, float)) and not isinstance(v, bool) and abs(v) <= 1e15
        return errors + ([] if number else ["INVALID_THRESHOLD"])
    if "offset" in e and not _is_int(e["offset"], 0, MAX_OFFSET):
        errors.append("INVALID_OFFSET")
    if kind in ("field", "ma") and e.get("field") not in FIELDS:
        errors.append("DISABLED_OR_UNKNOWN_FIELD")
    if kind == "ma" and e.get("field") == "volume_shares":
        errors.append("USE_VOLUME_MA")
    if kind != "field" and not _is_int(e.get("window"), 1, MAX_WINDOW):
        errors.append("INVALID_WINDOW")
    return errors


def conditions_of(node):
    if node["type"] == "condition":
        return [node]
    return [c for child in node["children"] for c in conditions_of(child)]


def validate_rule(rule) -> list[str]:
    """Error codes of a rule dictionary; empty when it may be compiled."""
    if not isinstance(rule, dict):
        return ["INVALID_RULE"]
    errors = ["UNSUPPORTED_PROPERTY" for k in rule if k not in ("version", "root")]
    if rule.get("version") != 1:
        errors.append("RULE_VERSION")
    ids, nodes = set(), 0
    pending = [(rule.get("root"), 1)]
    while pending:
        node, depth = pending.pop()
        nodes += 1
        if nodes > MAX_NODES or depth > MAX_DEPTH:
            errors.append("RULE_BOUNDS")
            break
        if not isinstance(node, dict):
            errors.append("INVALID_NODE")
        elif node.get("type") == "group":
            errors += ["UNSUPPORTED_PROPERTY" for k in node if k not in ("type", "op", "children")]
            if node.get("op") not in ("AND", "OR"):
                errors.append("GROUP_OPERATOR")
            children = node.get("children")
            if not isinstance(children, list) or not 1 <= len(children) <= MAX_NODES:
                errors.append("GROUP_CHILDREN")
            else:
                pending += [(c, depth + 1) for c in children]
        elif node.get("type") == "condition":
            errors += ["UNSUPPORTED_PROPERTY" for k in node if k not in ("type", "id", "timeframe", "left", "op", "right")]
            cid = node.get("id")
            if not isinstance(cid, str) or not re.fullmatch(r"[A-Za-z0-9_-]{1,64}", cid) or cid in ids:
                errors.append("CONDITION_ID")
            ids.add(cid)
            if node.get("timeframe") not in FRAMES:
                errors.append("TIMEFRAME")
            if node.get("op") not in OPS:
                errors.append("COMPARISON")
            left, right = node.get("left"), node.get("right")
            errors += _operand_errors(left) + _operand_errors(right)
            if isinstance(left, dict) and isinstance(right, dict):
                a, b = _unit(left), _unit(right)
                if a and b and a != b:
                    errors.append("UNIT_MISMATCH")
                if left.get("kind") == "constant":
                    errors.append("LEFT_CONSTANT")
        else:
            errors.append("INVALID_NODE_TYPE")
    return errors


def rule_nodes(node) -> int:
    return 1 if node["type"] == "condition" else 1 + sum(rule_nodes(c) for c in node["children"])


def _checked(rule):
    errors = validate_rule(rule)
    if errors:
        raise ValueError("invalid rule: " + ", ".join(errors))
    return rule["root"]


# -- three-state logic --------------------------------------------------------
# Unknown states must not be hidden by AND / OR, so a state is a number:
NO_MATCH, MATCH, INSUFFICIENT, FAILURE = 0, 1, 2, 3
STATES = ("no_match", "match", "insufficient", "failure")
FAILURE_CODES = (
    "FRAME_TARGET_MISMATCH", "DATA_FAILURE", "DATASET_GENERATION_MISMATCH", "DATASET_FREEZE_TUPLE_MISMATCH",
    "POLICY_VERSION_UNSUPPORTED", "RECEIPT_CLOCK_INVALID", "PROVENANCE_UNITS", "QUALITY_COVERAGE_CONTRADICTION",
    "MALFORMED_BARS", "MIXED_PROVENANCE", "COMPLETION_CONTRADICTION", "FROZEN_DATE_MISMATCH",
    "INVALID_FIELD", "INVALID_OHLC", "NONFINITE_RESULT", "CROSS_FRAME_BASIS_MISMATCH",
)


def severity_of(code: Column) -> Column:
    return F.when(code.isin(*FAILURE_CODES), FAILURE).when(code.isNotNull(), INSUFFICIENT)


def state_name(severity: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in STATES]), severity + 1)


def _worst(cols):
    return cols[0] if len(cols) == 1 else F.greatest(*cols)


def tree_severity(node, of_condition) -> Column:
    """State of a rule tree; every child is evaluated, unknown wins over match."""
    if node["type"] == "condition":
        return of_condition(node)
    children = [tree_severity(c, of_condition) for c in node["children"]]
    worst = _worst(children)
    known = worst if node["op"] == "OR" else (children[0] if len(children) == 1 else F.least(*children))
    return F.when(worst >= INSUFFICIENT, worst).otherwise(known)


def _compare(op, left, right, left0=None, right0=None):
    return {
        "gt": lambda: left > right, "gte": lambda: left >= right, "lt": lambda: left < right,
        "lte": lambda: left <= right, "eq": lambda: left == right, "neq": lambda: left != right,
        "cross_above": lambda: (left0 <= right0) & (left > right),
        "cross_below": lambda: (left0 >= right0) & (left < right),
    }[op]()


def _span(e) -> int:
    """Bars an operand needs, counted back from the bar it is read at."""
    if e["kind"] in ("constant", "field"):
        return 1
    return e["window"] + (0 if e["kind"] in ("ma", "volume_ma") else 1)


def _field(e):
    return {"volume_ma": "volume_shares", "volume_ratio": "volume_shares", "prior_high": "high",
            "change_pct": "close"}.get(e["kind"]) or e["field"]


def _reach(conditions) -> int:
    need = 1
    for c in conditions:
        cross = 1 if c["op"].startswith("cross_") else 0
        for e in (c["left"], c["right"]):
            need = max(need, _span(e) + e.get("offset", 0) + cross)
    return need


# -- operands over a bounded tail of bars ---------------------------------------
def _operand(e, back: int) -> Column:
    """struct(code, value) of an operand read `back` bars before the newest.

    Written as SQL text: the expression is long, and text is parsed at once.
    """
    if e["kind"] == "constant":
        return F.expr(f"struct(CAST(NULL AS string) AS code, {float(e['value'])!r}D AS value)")
    span = _span(e)
    back = back + e.get("offset", 0)
    length = span - 1 if e["kind"] == "prior_high" else span
    sample = f"slice(_tail, greatest(size(_tail) - {back + span - 1}, 1), {length})"
    values = f"transform({sample}, b -> b.{_field(e)})"
    total = lambda v: f"aggregate({v}, 0D, (a, x) -> a + x)"
    zero = "false"
    if e["kind"] == "field":
        value = f"get({values}, 0)"
    elif e["kind"] in ("ma", "volume_ma"):
        value = f"{total(values)} / {e['window']}"
    elif e["kind"] == "prior_high":
        value = f"array_max({values})"
    elif e["kind"] == "change_pct":
        value = f"(get({values}, {span - 1}) / get({values}, 0) - 1) * 100"
    else:
        mean = f"({total(f'slice({values}, 1, {span - 1})')} / {span - 1})"
        zero = f"{mean} = 0"
        value = f"get({values}, {span - 1}) / nullif({mean}, 0D)"
    last = f"get(_tail, size(_tail) - {back + 1}).date"
    gap = f"exists(missing_sessions, m -> m >= get({sample}, 0).period_start AND m <= {last})"
    fault = f"get(filter({sample}, b -> b.fault IS NOT NULL), 0).fault"
    code = f"""CASE WHEN size(_tail) < {back + span} THEN 'INSUFFICIENT_HISTORY'
        WHEN calendar_gaps_unverified THEN 'CALENDAR_GAPS_UNVERIFIED'
        WHEN {gap} THEN 'MISSING_SCHEDULED_SESSIONS'
        WHEN exists({sample}, b -> NOT b.usable) THEN 'COMPLETION_UNKNOWN'
        WHEN {fault} IS NOT NULL THEN {fault}
        WHEN {zero} THEN 'ZERO_BASELINE' END"""
    checked = f"transform(array(struct({code} AS code, {value} AS value)), s -> struct(coalesce(s.code, CASE WHEN NOT coalesce(abs(s.value) < double('Infinity'), false) THEN 'NONFINITE_RESULT' END) AS code, CASE WHEN s.code IS NULL THEN s.value END AS value))"
    return F.expr(f"get({checked}, 0)")


def _condition(c, column_of) -> Column:
    """struct(id, severity, codes, left, right) of one condition."""
    cross = c["op"].startswith("cross_")
    now = [column_of(c["left"], 0), column_of(c["right"], 0)]
    before = [column_of(c["left"], 1), column_of(c["right"], 1)] if cross else []
    codes = F.array_compact(F.array(*[x["code"] for x in now + before]))
    worst = F.array_max(F.transform(codes, severity_of))
    passed = _compare(c["op"], *[x["value"] for x in now + before])
    frame = F.col("frame_error")
    severity = F.coalesce(severity_of(frame), worst, F.when(passed, MATCH).otherwise(NO_MATCH))
    return F.struct(
        F.lit(c["id"]).alias("id"),
        severity.cast("int").alias("severity"),
        F.when(frame.isNotNull(), F.array(frame)).otherwise(codes).alias("codes"),
        F.when(frame.isNull(), now[0]["value"]).alias("left"),
        F.when(frame.isNull(), now[1]["value"]).alias("right"),
    )


def bar_fault() -> Column:
    """First reason a bar's five fields cannot be used."""
    o, h, l, c, v = (F.col(x) for x in FIELDS)
    fault = F
    for field, bad in ((o, o <= 0), (h, h <= 0), (l, l <= 0), (c, c <= 0), (v, v < 0)):  # field by field
        fault = fault.when(~finite(field), "MISSING_FIELD").when(bad, "INVALID_FIELD")
    return fault.when((l > F.least(o, c)) | (h < F.greatest(o, c)) | (l > h), "INVALID_OHLC")


def _literal_date(text):
    return F.lit(text).cast("date")


def _per_frame(mapping, default=None):
    """Value of a small frame dictionary picked by the timeframe column."""
    out = F.lit(default)
    for tf, value in mapping.items():
        out = F.when(F.col("timeframe") == tf, value).otherwise(out)
    return out


def prepared_frames(bars: DataFrame, series: DataFrame, frames: dict, run: dict, reach: dict) -> DataFrame:
    """One row per (symbol, timeframe): frame error and a bounded tail of bars.

    Only the newest `reach[timeframe]` usable bars are gathered per series;
    everything else about the history is aggregated.
    """
    used = list(reach)
    cutoff = _per_frame({tf: _literal_date(frames[tf]["cutoff_date"]) for tf in used})
    expected = _per_frame({tf: _literal_date(frames[tf]["expected_last_date"]) for tf in used})
    completed = _per_frame({tf: F.lit(frames[tf].get("mode", "completed") == "completed") for tf in used}, False)
    span = run.get("verified_range") or SUPPORTED_CALENDARS.get(run["calendar_version"])
    rows = bars.filter(F.col("timeframe").isin(*used))
    returned = rows.groupBy("symbol", "timeframe").agg(F.count("*").alias("_rows"), F.count_if(F.col("date").isNull()).alias("_undated"))
    rank = F.row_number().over(Window.partitionBy("symbol", "timeframe", "date").orderBy("source", "adjustment"))
    rows = rows.withColumn("_seen", rank).filter(F.col("_seen") <= 2)
    rows = rows.withColumns({"_cutoff": cutoff, "_expected": expected, "_completed": completed})
    known = F.lit(False)
    if span:
        known = completion_known(
            F.col("completion"), F.col("calendar_completion"), F.col("completion_basis"),
            F.col("period_start"), F.col("period_end"), *[_literal_date(x) for x in span])
    date, completion = F.col("date"), F.col("completion")
    fault = bar_fault()
    quality = F.when(F.col("_seen") == 2, "MALFORMED_BARS").otherwise(
        F.when(fault == "INVALID_FIELD", fault).when(fault == "INVALID_OHLC", fault))
    shape = (
        F.when(
            F.coalesce((F.col("period_start") > date) | (date > F.col("period_end")), F.lit(True))
            | ~completion.isin("complete", "partial", "unknown"), "MALFORMED_BARS")
        .when((date <= F.col("_cutoff")) & (completion == "complete") & (F.col("period_end") > F.col("_cutoff")), "COMPLETION_CONTRADICTION")
    )
    kept = (date <= F.col("_cutoff")) & ~(F.col("_completed") & (completion == "partial"))
    rows = rows.withColumns({"_known": known, "_fault": fault, "_quality": quality, "_shape": shape, "_kept": kept})
    newest = Window.partitionBy("symbol", "timeframe").orderBy(F.col("_kept").desc(), date.desc())
    rows = rows.withColumn("_back", F.row_number().over(newest))
    depth = _per_frame({tf: F.lit(n) for tf, n in reach.items()}, 0)
    usable = (completion != "unknown") & F.col("_known") & (~F.col("_completed") | (completion == "complete"))
    bar = F.struct("date", "period_start", *FIELDS, F.col("_fault").alias("fault"), usable.alias("usable"), "completion")
    kept = F.col("_kept")
    unsure = (date == F.col("_expected")) & (date <= F.col("_cutoff")) & ((completion == "unknown") | ~F.col("_known"))
    agg = rows.groupBy("symbol", "timeframe").agg(
        F.array_sort(F.collect_list(F.when(kept & (F.col("_back") <= depth), bar))).alias("_tail"),
        F.min(F.when(F.col("_quality").isNotNull(), F.struct(date.alias("d"), F.col("_quality").alias("q"))))["q"].alias("_quality"),
        F.min(F.when(F.col("_shape").isNotNull(), F.struct(date.alias("d"), F.col("_shape").alias("q"))))["q"].alias("_shape"),
        F.bool_or(unsure).alias("_unsure"),
        F.max(F.when(kept, date)).alias("actual_last_date"),
        F.min(F.struct("source", "adjustment")).alias("_first_basis"),
        F.max(F.struct("source", "adjustment")).alias("_last_basis"),
    )
    agg = agg.join(returned, ["symbol", "timeframe"])
    agg = agg.withColumn("_quality", F.when(F.col("_undated") > 0, "MALFORMED_BARS").otherwise(F.col("_quality"))).drop("_undated")
    agg = settled(agg)
    out = series.filter(F.col("timeframe").isin(*used)).join(agg, ["symbol", "timeframe"], "left")
    s = F.col
    frame_context = _per_frame({tf: F.lit(_frame_ok(frames.get(tf))) for tf in used}, False)
    on_target = _per_frame({tf: F.lit(frames[tf]["cutoff_date"] == run["target_session"]) for tf in used}, False)
    policy = F.lit(run["policy_version"] in SUPPORTED_POLICIES or bool(run.get("synthetic")))
    receipt = (
        (s("completion_cutoff") == s("request_started_at")) & (s("fetched_at") >= s("request_started_at"))
        & (shanghai_date(s("completion_cutoff")) >= s("target_session"))
    )
    tuple_ok = (
        (s("target_session") == _literal_date(run["target_session"]))
        & (s("calendar_version") == run["calendar_version"]) & (s("policy_version") == run["policy_version"])
    )
    basis = F.struct(s("source").alias("source"), s("adjustment").alias("adjustment"))
    mixed = (s("_first_basis") != basis) | (s("_last_basis") != basis)
    no = lambda c: ~F.coalesce(c, F.lit(False))
    error = (
        F.when(~frame_context, "FRAME_CONTEXT")
        .when(~on_target, "FRAME_TARGET_MISMATCH")
        .when(s("status") == "error", "DATA_FAILURE")
        .when(no(s("status") == "ready"), "MISSING_FRAME")
        .when(no(s("dataset_id") == run["generation"]), "DATASET_GENERATION_MISMATCH")
        .when(no(tuple_ok), "DATASET_FREEZE_TUPLE_MISMATCH")
        .when(~policy, "POLICY_VERSION_UNSUPPORTED")
        .when(no(receipt), "RECEIPT_CLOCK_INVALID")
        .when(no((s("adjustment").isin("none", "qfq", "hfq")) & (s("currency") == "CNY") & (s("volume_unit") == "shares")), "PROVENANCE_UNITS")
        .when(s("_quality").isNotNull(), s("_quality"))
        .when(no(s("returned") == F.coalesce(s("_rows"), F.lit(0))), "QUALITY_COVERAGE_CONTRADICTION")
        .when(s("_shape") == "MALFORMED_BARS", s("_shape"))
        .when(mixed, "MIXED_PROVENANCE")
        .when(s("_shape").isNotNull(), s("_shape"))
        .when(F.coalesce(s("_unsure"), F.lit(False)), "COMPLETION_UNKNOWN")
        .when(s("actual_last_date").isNull(), "NO_ELIGIBLE_BARS")
        .when(s("actual_last_date") < expected, "STALE_DATA")
        .when(s("actual_last_date") > expected, "FROZEN_DATE_MISMATCH")
    )
    return out.withColumn("frame_error", error)


def _frame_ok(frame) -> bool:
    if not isinstance(frame, dict):
        return False
    cutoff, last = frame.get("cutoff_date"), frame.get("expected_last_date")
    return bool(cutoff and last and last <= cutoff and frame.get("mode", "completed") in ("completed", "include_partial"))


def evaluate_conditions(prepared: DataFrame, conditions) -> DataFrame:
    """One row per (symbol, condition): severity, codes, left and right values."""
    memo: dict[str, tuple[str, Column]] = {}

    def column_of(e, back):
        key = json.dumps([e, back], sort_keys=True)
        if key not in memo:
            memo[key] = (f"_op{len(memo)}", _operand(e, back))
        return F.col(memo[key][0])

    by_frame = {}
    for c in conditions:
        by_frame.setdefault(c["timeframe"], []).append(_condition(c, column_of))
    df = prepared.withColumns(dict(memo.values()))
    picked = F.array().cast("array<struct<id:string,severity:int,codes:array<string>,left:double,right:double>>")
    for tf, structs in by_frame.items():
        picked = F.when(F.col("timeframe") == tf, F.array(*structs)).otherwise(picked)
    return df.select("symbol", "timeframe", "frame_error", "actual_last_date", F.inline(picked))


def screen(universe, stocks, series, bars, frames: dict, run: dict, rule: dict, limits=None, member=("symbol",)):
    """Judge a universe with a rule. Returns (rows, conditions).

    universe: symbol, exchange, name, board, st_status, catalog_no.
    stocks: symbol, status, suspension_state, verified_through.
    series: one row per (symbol, timeframe) of frozen-series metadata.
    bars: symbol, timeframe and bar columns with completion evidence.
    member: columns of universe and stocks that tell members apart, where a
    catalog holds a symbol more than once.

    Rows keep every universe member exactly once, excluded ones included.
    """
    root = _checked(rule)
    limits = limits or {}
    conditions = conditions_of(root)
    used = list(dict.fromkeys(c["timeframe"] for c in conditions))
    reach = {tf: _reach([c for c in conditions if c["timeframe"] == tf]) for tf in used}
    members = universe_scope(universe, limits)
    scope = members.filter("scope = 'candidate'")
    if limits.get("max_processed") is not None:
        scope = with_budget(scope, "catalog_no", limits["max_processed"]).withColumnRenamed("state", "_budget")
    else:
        scope = scope.withColumn("_budget", F.lit("processed"))
    # The universe filter comes first: only candidates' histories are read.
    wanted = scope.filter("_budget = 'processed'").select("symbol")
    bars = bars.join(wanted, "symbol", "left_semi")
    prepared = prepared_frames(bars, series.join(wanted, "symbol", "left_semi"), frames, run, reach)
    results = evaluate_conditions(prepared, conditions)
    by_symbol = results.groupBy("symbol").agg(
        F.map_from_entries(F.collect_list(F.struct("id", "severity"))).alias("_states"),
    )
    bases = series.filter(F.col("timeframe").isin(*used) & (F.col("status") == "ready")).groupBy("symbol").agg(
        (F.count_distinct("source", "adjustment") > 1).alias("_mixed_basis"))
    df = scope.join(stocks, list(member), "left").join(bases, "symbol", "left").join(by_symbol, "symbol", "left")
    need = max(frames[tf]["cutoff_date"] for tf in used)
    of = lambda c: F.coalesce(F.element_at("_states", F.lit(c["id"])), F.lit(INSUFFICIENT))
    tree = F.when(F.col("_states").isNull(), F.lit(INSUFFICIENT)).otherwise(tree_severity(root, of))
    active = (F.col("suspension_state") == "active") & (F.col("verified_through") >= _literal_date(need))
    gate = (
        F.when(F.col("_budget") == "unprocessed", "PROCESS_BUDGET")
        .when(F.lit(run["directory_as_of"] < need), "DIRECTORY_STALE")
        .when(F.col("st_status") != "non_st", "ST_STATUS_UNKNOWN")
        .when(F.col("status").isNull(), "MISSING_STOCK")
        .when(F.col("status") == "error", "DATA_FAILURE")
        .when(F.col("status") != "ready", "MISSING_STOCK")
        .when(F.col("suspension_state") == "suspended", "SUSPENDED")
        .when(~F.coalesce(active, F.lit(False)), "SUSPENSION_UNKNOWN")
        .when(F.coalesce("_mixed_basis", F.lit(False)), "CROSS_FRAME_BASIS_MISMATCH")
    )
    state = F.when(F.col("gate") == "PROCESS_BUDGET", "unprocessed").otherwise(
        state_name(F.coalesce(severity_of(F.col("gate")), tree)))
    df = df.withColumn("gate", gate).withColumn("state", state)
    judged = with_decision(df).select("symbol", F.lit("candidate").alias("scope"), "state", "gate", "decision", "passed")
    nothing = F.lit(None)
    rest = members.filter("scope <> 'candidate'").select(
        "symbol", "scope", nothing.cast("string").alias("state"), nothing.cast("string").alias("gate"),
        nothing.cast("string").alias("decision"), nothing.cast("boolean").alias("passed"))
    return judged.unionByName(rest), results


def with_decision(df: DataFrame) -> DataFrame:
    passed = F.when(F.col("state") == "match", True).when(F.col("state") == "no_match", False)
    decision = F.when(passed, "pass").when(~passed, "fail").otherwise("unknown")
    return df.withColumn("passed", passed).withColumn("decision", decision)


def universe_scope(universe: DataFrame, limits=None) -> DataFrame:
    """Split members into excluded, restricted and candidate."""
    limits = limits or {}
    board = is_screen_mainboard(F.col("symbol"), F.col("exchange"), F.col("board"))
    outside = ~F.coalesce(board, F.lit(False)) | (F.col("st_status") == "st") | excluded_name(F.col("name"))
    inside = F.lit(True)
    if limits.get("symbols") is not None:
        inside = inside & F.col("symbol").isin(list(limits["symbols"]))
    if limits.get("exchanges") is not None:
        inside = inside & F.col("exchange").isin(list(limits["exchanges"]))
    scope = F.when(outside, "excluded").when(~inside, "restriction_excluded").otherwise("candidate")
    return universe.withColumn("scope", scope)


def screen_counts(rows: DataFrame) -> DataFrame:
    """Ledger counts; catalog = excluded + restricted + total, total = sum of states."""
    is_ = lambda s: F.count_if(F.col("state") == s)
    c = rows.agg(
        F.count("*").alias("catalog_total"),
        F.count_if(F.col("scope") == "excluded").alias("excluded_total"),
        F.count_if(F.col("scope") == "restriction_excluded").alias("restriction_excluded_total"),
        F.count_if(F.col("scope") == "candidate").alias("total"),
        *[is_(s).alias(s) for s in (*STATES, "unprocessed")],
    )
    return c.withColumn("processed", F.col("total") - F.col("unprocessed")).withColumn(
        "successful", F.col("match") + F.col("no_match"))


def requested_outside_catalog(requested: DataFrame, universe: DataFrame) -> DataFrame:
    return requested.join(universe.select("symbol"), "symbol", "left_anti")


# -- every bar of every series ----------------------------------------------------
def rule_panel(bars: DataFrame, rule: dict, keys=("symbol",), order="date") -> DataFrame:
    """Evaluate a one-timeframe rule at every bar with window operands.

    All operands share one partitioning and order, so Spark plans one shuffle.
    """
    root = _checked(rule)
    conditions = conditions_of(root)
    if len({c["timeframe"] for c in conditions}) != 1:
        raise ValueError("a panel evaluates one timeframe")
    s = Series(keys, order)
    memo: dict[str, tuple[str, Column]] = {}

    def value(e, back=0):
        if e["kind"] == "constant":
            return F.lit(float(e["value"]))
        key = json.dumps([e, back], sort_keys=True)
        if key not in memo:
            n, shift, c = e.get("window", 1), e.get("offset", 0) + back, F.col(_field(e))
            if e["kind"] == "field":
                col = s.lag(c, shift)
            elif e["kind"] in ("ma", "volume_ma"):
                col = s.mean(c, n, shift)
            elif e["kind"] == "prior_high":
                col = s.highest(c, n, shift + 1)
            elif e["kind"] == "change_pct":
                col = (s.lag(c, shift) / s.lag(c, shift + n) - 1) * 100
            else:
                col = s.lag(c, shift) / F.nullif(s.mean(c, n, shift + 1), F.lit(0.0))
            memo[key] = (f"_op{len(memo)}", col)
        return F.col(memo[key][0])

    def severity(c):
        cross = c["op"].startswith("cross_")
        args = [value(c["left"]), value(c["right"])]
        args += [value(c["left"], 1), value(c["right"], 1)] if cross else []
        unknown = args[0].isNull()
        for a in args[1:]:
            unknown = unknown | a.isNull()
        hit = F.when(_compare(c["op"], *args), MATCH).otherwise(NO_MATCH)
        return F.when(unknown, INSUFFICIENT).otherwise(hit)

    states = {f"{c['id']}": severity(c) for c in conditions}
    df = bars.withColumns(dict(memo.values())).withColumns(states)
    total = tree_severity(root, lambda c: F.col(c["id"]))
    return df.withColumn("state", state_name(total)).drop(*[name for name, _ in memo.values()])
