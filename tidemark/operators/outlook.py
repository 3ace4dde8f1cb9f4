"""Paths ahead: prices read back from layered features, and members drawn for prototypes that keep none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.windows import frame, lead, only_own, with_halo

#: Bars that a range is taken over, and steps ahead.
HISTORY, STEPS = 20, 5
# The features read, the share of each equation, and the smoothing.
READ = ("c0", "c1", "c2", "c4", "c5")
SHARES, SMOOTHING = (0.42, 0.22, 0.22, 0.07, 0.07), 0.65


def _let(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def prices_ahead(close: str, highs: str, lows: str, atrs: str, rows: str) -> Column:
    """An array of a price for each of `rows` (structs of READ), one read from the other.

    Five equations undo the place in the range and the distances from its ends, a step is held
    within a hundredth of the price or 2.5 ATR, and 0.65 of it is taken; each price enters the
    range of the next.  The ATR is the median of the known ones, or else the range by its bars.
    A null feature is 0, and no rows give no prices; a null close or range gives null prices.
    """
    clip = {c: f"greatest(0D, coalesce(r.{c}, 0D))" if c in ("c1", "c2") else f"least(1D, greatest(0D, coalesce(r.{c}, 0D)))" for c in READ}
    equations = (f"a.lo + {clip['c0']} * a.width", f"a.hi - {clip['c1']} * atr", f"a.lo + {clip['c2']} * atr", f"a.hi - (1 - {clip['c4']}) * a.width", f"a.lo + (1 - {clip['c5']}) * a.width")
    read = " + ".join(f"{w}D * ({x})" for w, x in zip(SHARES, equations, strict=True))
    step = "greatest(s.prev * 0.01D, 2.5D * atr)"
    kept = lambda x: f"concat(if(size({x}) < {HISTORY}, {x}, slice({x}, 2, {HISTORY - 1})), array(p))"
    grown = f"named_struct('prev', p, 'highs', {kept('s.highs')}, 'lows', {kept('s.lows')}, 'told', concat(s.told, array(p)))"
    moved = _let(f"s.prev + {SMOOTHING}D * greatest(-({step}), least({step}, {read} - s.prev))", "p", grown)
    hi, lo = "array_max(s.highs)", "array_min(s.lows)"
    one = _let(f"named_struct('hi', {hi}, 'lo', {lo}, 'width', greatest({hi} - {lo}, s.prev * 0.0005D, 1e-6D))", "a", moved)
    start = f"named_struct('prev', {close}, 'highs', {highs}, 'lows', {lows}, 'told', cast(array() AS array<double>))"
    folded = f"aggregate({rows}, {start}, (s, r) -> {one}, s -> s.told)"
    k = "array_sort(filter(" + atrs + ", x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')))"
    median = _let(k, "k", "if(size(k) = 0, 0D, (get(k, cast((size(k) - 1) div 2 AS int)) + get(k, cast(size(k) div 2 AS int))) / 2)")
    spread = f"greatest((array_max({highs}) - array_min({lows})) / size({highs}), {close} * 0.001D)"
    return F.expr(_let(_let(median, "m", f"if(m > 0, m, {spread})"), "atr", folded))


def future_prices(table: DataFrame, steps: int = STEPS) -> DataFrame:
    """symbol, bar_idx, step (from 1), price: what the next bars' features say of their prices, from
    each bar on.  table: symbol, bar_idx, high, low, close, atr and READ.

    One exchange by pieces.  Towards the end of a series there are as many steps as bars.
    """
    held = with_halo(table.select("symbol", "bar_idx", "high", "low", "close", "atr", *READ), HISTORY - 1, steps)
    back = (f"{HISTORY - 1} PRECEDING", "CURRENT ROW")
    row = "named_struct(" + ", ".join(f"'{c}', cast({c} AS double)" for c in READ) + ")"
    seen = held.selectExpr(
        "symbol", "bar_idx", "close", "own", "chunk",
        *[f"{frame('collect_list', x, *back)} AS {x}s" for x in ("high", "low", "atr")],
        "array_compact(array(" + ", ".join(lead(row, i) for i in range(1, steps + 1)) + ")) AS rows",
    )
    ahead = only_own(seen).select("symbol", "bar_idx", F.posexplode(prices_ahead("close", "highs", "lows", "atrs", "rows")).alias("at", "price"))
    return ahead.select("symbol", "bar_idx", (F.col("at") + 1).alias("step"), "price")


def uniform(seed: int, key: Column, draw: Column) -> Column:
    """A number from 0 to below 1 of (seed, key, draw) alone: 52 bits of a hash, whatever the partitioning."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key, draw.cast("string"))), 1, 13), 16, 10).cast("double") / float(1 << 52)


def synthesised_members(prototypes: DataFrame, seed: int = 0) -> DataFrame:
    """key, member (from 0), won, profit_pct, hold: stand-ins for the trades of prototypes (key,
    member_count, win_rate, avg_profit_pct, avg_hold) of which only means are kept.

    5 to 30 members as the count says, won as often as the rate says: half to one and a half times the mean
    profit, or else a loss of 0.2 to 0.7 of it, held 0.4 to 1.6 times the mean, 2 bars at least.  Fewer
    than three members, no hold, or a null give none.  Repeated keys draw the same numbers.
    """
    usable = prototypes.where("member_count >= 3 AND avg_hold > 0 AND win_rate IS NOT NULL AND avg_profit_pct IS NOT NULL AND key IS NOT NULL")
    each = usable.withColumn("member", F.explode(F.expr("sequence(0, cast(least(30, greatest(5, member_count)) AS int) - 1)")))
    u = [uniform(seed, F.col("key").cast("string"), F.col("member") * 3 + i) for i in range(3)]
    drawn = each.select("key", "member", "avg_profit_pct", "avg_hold", (u[0] < F.col("win_rate")).alias("won"), u[1].alias("u"), u[2].alias("v"))
    return drawn.selectExpr(
        "key", "member", "won",
        "if(won, avg_profit_pct * (0.5D + u), -abs(avg_profit_pct) * (0.2D + u * 0.5D)) AS profit_pct",
        "greatest(2L, cast(floor(avg_hold * (0.4D + v * 1.2D)) AS bigint)) AS hold",
    )
