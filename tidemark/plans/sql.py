"""SQL over the raw tables that the Spark queries must agree with."""

from __future__ import annotations

from tidemark.operators import indicators as ind

TICK_BARS = """
ticks AS (
  SELECT event_type AS symbol, date_trunc('hour', ts)::TIMESTAMP AS bts, ts, event_id,
         100.0 * exp(sum((CASE WHEN CAST(round(value * 100) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END) * value / 50000.0)
                     OVER (PARTITION BY event_type ORDER BY ts, event_id)) AS p
  FROM events),
bars AS (
  SELECT symbol, bts AS ts, arg_min(p, (ts, event_id)) AS open, max(p) AS high, min(p) AS low,
         arg_max(p, (ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume,
         row_number() OVER (PARTITION BY symbol ORDER BY bts) - 1 AS bar_idx
  FROM ticks GROUP BY symbol, bts)"""


def chain(name: str, source: str, steps: list[dict[str, str]]) -> str:
    """CTEs name_0, name_1, … and name, each adding a step's columns."""
    parts = []
    for i, step in enumerate(steps):
        to = name if i == len(steps) - 1 else f"{name}_{i}"
        parts.append(f"{to} AS MATERIALIZED (SELECT *, " + ", ".join(f"{x} AS {c}" for c, x in step.items()) + f" FROM {source})")
        source = to
    return ",\n".join(parts)


def window_part() -> str:
    by = "symbol"
    over = "OVER (PARTITION BY symbol ORDER BY bar_idx)"
    runs = {o: f"{f}({x}) {over}" for o, (f, x) in ind.RUNNING.items()}
    return TICK_BARS + ",\n" + chain("w", "bars", [*ind.first_steps(by), runs, *ind.window_steps(by)])


def ewm_part() -> str:
    """Recurrences bar by bar, by a recursive query."""
    grow = lambda x, y, a: f"CASE WHEN {x} IS NULL THEN NULL WHEN {y} IS NULL THEN {x} ELSE {a!r}::DOUBLE * {x} + (1 - {a!r}::DOUBLE) * {y} END"
    first = {o: grow(f"b.{x}", f"e.{o}", a) for o, (x, a, _) in ind.EWM_FIRST.items()}
    signal, d = ind.EWM_SECOND["macd_signal"][1], ind.EWM_SECOND["d"][1]
    return f"""
src AS MATERIALIZED (SELECT symbol, bar_idx, close, rsv FROM w),
e AS (
  SELECT symbol, bar_idx, close AS ema12, close AS ema26, rsv AS k, 0.0::DOUBLE AS macd_signal, rsv AS d FROM src WHERE bar_idx = 0
  UNION ALL
  SELECT symbol, bar_idx, ema12, ema26, k, {grow("(ema12 - ema26)", "s", signal)}, {grow("k", "dd", d)} FROM (
    SELECT b.symbol, b.bar_idx, {", ".join(f"{x} AS {o}" for o, x in first.items())}, e.macd_signal AS s, e.d AS dd
    FROM e JOIN src b ON b.symbol = e.symbol AND b.bar_idx = e.bar_idx + 1)),
em AS MATERIALIZED (SELECT w.*, e.* EXCLUDE (symbol, bar_idx), ema12 - ema26 AS macd FROM w JOIN e USING (symbol, bar_idx))"""


def with_bars(select: str) -> str:
    return f"WITH {TICK_BARS}\n{select}"


def with_windows(select: str, *more: str) -> str:
    return f"WITH {','.join([window_part(), *more])}\n{select}"


def with_indicators(select: str, *more: str) -> str:
    """select over table i, the whole indicator table."""
    return f"WITH RECURSIVE {','.join([window_part(), ewm_part(), chain('i', 'em', ind.ewm_steps('symbol')), *more])}\n{select}"


def rounded(names, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) + 0.0 AS {n}" for n in names)
