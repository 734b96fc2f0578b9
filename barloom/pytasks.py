"""Small helpers that run inside Python tasks."""

import re
import unicodedata

_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
_REFERENCE = re.compile(r"&(#[xX][0-9a-fA-F]+|#[0-9]+|amp|lt|gt|quot|apos);", re.IGNORECASE)


def nfkc_text(value):
    return None if value is None else unicodedata.normalize("NFKC", value)


def _entity(match):
    body = match.group(1).lower()
    if not body.startswith("#"):
        return _NAMED[body]
    code = int(body[2:], 16) if body[1] == "x" else int(body[1:])
    if code <= 0 or code > 0x10FFFF or 0xD800 <= code < 0xE000:
        raise ValueError("invalid character reference")
    return chr(code)


def entity_text(value):
    """Decoded text, or None where a numeric reference names no character."""
    if value is None:
        return None
    try:
        return _REFERENCE.sub(_entity, value)
    except ValueError:
        return None


def gb18030_text(value):
    return None if value is None else bytes(value).decode("gb18030", errors="replace")


def reduce_block(rows):
    """Reduce arrivals (r, c, t, arrival) to steps, earliest first.

    A step says: a state at or below (r, c, t) ends this block as `outcome`.
    Rows hidden by an earlier row, or leading straight into the next step,
    are dropped. Arrivals are taken from the last to the first; each is held
    against all steps at once, so a block costs a few array operations a row.
    """
    import numpy as np

    values = np.array([row[:3] for row in rows], np.int64)
    held, ends = np.empty((3, len(rows)), np.int64), np.empty(len(rows), np.int64)
    n, first = 0, None  # steps stand in reverse, the earliest last
    for i in range(len(rows) - 1, -1, -1):
        r, c, t = rows[i][:3]
        if first is not None and first[0] >= r and first[1] >= c and first[2] >= t:
            continue
        at = values[i][:, None]
        above = np.flatnonzero((held[:, :n] >= at).all(axis=0))
        end = ends[above[-1]] if len(above) else i
        kept = ~(held[:, :n] <= at).all(axis=0)
        m = int(kept.sum())
        if m < n:
            held[:, :m], ends[:m] = held[:, :n][:, kept], ends[:n][kept]
        held[:, m], ends[m] = values[i], end
        n, first = m + 1, (r, c, t)
    return [(*map(int, held[:, j]), rows[ends[j]]) for j in range(n - 1, -1, -1)]


def _groups(batches, columns, width):
    """Consecutive rows sharing their first `width` values, across batches."""
    current, rows = None, []
    for pdf in batches:
        for row in zip(*(pdf[c].tolist() for c in columns)):
            if row[:width] != current:
                if rows:
                    yield current, rows
                current, rows = row[:width], []
            rows.append(row[width:])
    if rows:
        yield current, rows


def _framed(rows, columns, size=10_000):
    import pandas as pd

    out = []
    for row in rows:
        out.append(row)
        if len(out) >= size:
            yield pd.DataFrame(out, columns=columns)
            out = []
    if out:
        yield pd.DataFrame(out, columns=columns)


def block_steps(keys):
    """Task function: arrivals sorted by (keys, block, arrival) to steps."""
    columns = [*keys, "block", "r", "c", "t", "arrival_no"]
    names = [*keys, "block", "step", "r", "c", "t", "out_r", "out_c", "out_t", "arrival_no"]

    def run(batches):
        return _framed((
            (*group, i, r, c, t, *outcome)
            for group, rows in _groups(batches, columns, len(keys) + 1)
            for i, (r, c, t, outcome) in enumerate(reduce_block(rows))
        ), names)

    return run


def apply_steps(keys):
    """Task function: steps sorted by (keys, block, step) to the final arrival.

    Steps stream by; only the state of the current key is held.
    """
    columns = [*keys, "block", "r", "c", "t", "out_r", "out_c", "out_t", "arrival_no"]
    lowest = (-(2**63), -(2**63), -(2**63), None)

    def final(batches):
        current, state, done = None, lowest, None
        for pdf in batches:
            for row in zip(*(pdf[c].tolist() for c in columns)):
                key, (block, r, c, t, *outcome) = row[:len(keys)], row[len(keys):]
                if key != current:
                    if current is not None:
                        yield (*current, state[3])
                    current, state, done = key, lowest, None
                # The first accepted step ends its block.
                if block != done and r >= state[0] and c >= state[1] and t >= state[2]:
                    state, done = tuple(outcome), block
        if current is not None:
            yield (*current, state[3])

    return lambda batches: _framed(final(batches), [*keys, "arrival_no"])


def session_differences(keep_ms):
    """Stateful processor: differences of a session's cumulative points to the last stored one."""
    import numpy as np
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    class SessionDifferences(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.last = handle.getValueState("last", "ts long, volume double, amount double")

        def handleInputRows(self, key, rows, timerValues):
            # A session has at most 1440 points.
            pdf = pd.concat(list(rows)).sort_values("ts")
            t0, v0, a0 = self.last.get() if self.last.exists() else (None, np.nan, np.nan)
            ts = np.concatenate([[np.nan if t0 is None else t0], pdf.ts.to_numpy(float)])
            volume = np.concatenate([[v0], pdf.volume.to_numpy(float)])
            amount = np.concatenate([[a0], pdf.amount.to_numpy(float)])
            step = lambda x: np.where(x[1:] >= x[:-1], x[1:] - x[:-1], np.nan)
            minutes = (ts[1:] - ts[:-1]) / 60e6
            if t0 is None or ts[-1] >= t0:
                t0 = int(pdf.ts.iloc[-1])
                self.last.update((t0, float(volume[-1]), float(amount[-1])))
            for old in self.handle.listTimers():
                self.handle.deleteTimer(old)
            self.handle.registerTimer(t0 // 1000 + keep_ms)
            yield pd.DataFrame({
                "symbol": key[0], "session_date": key[1], "ts": pdf.ts.to_numpy(), "price": pdf.price.to_numpy(),
                "interval_volume_shares": step(volume), "interval_amount_cny": step(amount),
                "interval_minutes": np.where(minutes >= 0, minutes, np.nan),
            })

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            self.last.clear()
            return iter(())

        def close(self):
            pass

    return SessionDifferences()
