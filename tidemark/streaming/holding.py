"""How far open positions have strayed from the trajectories that their templates had while held.

The warping distance of every prefix is wanted as its last bar closes.  A band of constant width holds
it in one row: a bar turns the row of the bar before into its own, so that a position carries 2 radius
+ 1 numbers, whatever its age, and no bar is looked at twice.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.streaming.trackers import InOrder, _running

#: Half of the band, and the divergence over which a position should be left.
RADIUS, LIMIT = 5, 0.7

LOG = "at long, ord int, what string, id string, bar_idx long, numbers array<double>"
_OPEN = "id string, steps int, template array<double>, row array<double>"
DIVERGENCES = "symbol string, shard int, id string, bar_idx long, divergence double, leaves boolean"


def first_row(radius: int = RADIUS) -> list[float]:
    return [math.inf] * radius + [0.0] + [math.inf] * radius


def next_row(row: list[float], step: int, values: list[float], template: list[float]) -> list[float]:
    """The row of a position's step (from 1) out of the one before; place o stands for the template's
    step `step` - radius + o.  template is flat, of steps as wide as values."""
    radius, width = len(row) // 2, len(values)
    out, left = [], math.inf
    for o in range(len(row)):
        j = step - radius + o
        if 1 <= j <= len(template) // width:
            cost = math.dist(values, template[(j - 1) * width : j * width])
            left = cost + min(row[o], row[o + 1] if o + 1 < len(row) else math.inf, left)
        else:
            left = math.inf
        out.append(left)
    return out


def divergence(row: list[float], step: int, width: int) -> float:
    return min(1.0, row[len(row) // 2] / (step * math.sqrt(width) * 2))


class Holding(InOrder):
    """Open positions with their templates and rows."""

    def step(self, memory: list, row: tuple, out: list) -> list:
        _, _, what, name, bar, numbers = row
        if what == "open":
            return [*memory, (name, 0, numbers or [], first_row())]
        if what == "close":
            return [m for m in memory if m[0] != name]
        if not numbers or any(math.isnan(x) for x in numbers):
            return memory
        kept, width = [], len(numbers)
        for name, steps, template, carried in memory:
            if steps < len(template) // width:
                steps, carried = steps + 1, next_row(list(carried), steps + 1, numbers, list(template))
            d = divergence(carried, steps, width) if steps else 0.0
            out.append((name, bar, d, d > LIMIT))
            kept.append((name, steps, template, carried))
        return kept


def divergences(bars: DataFrame, positions: DataFrame, closes: DataFrame, shards: int = 1, delay: str = "2 hours") -> DataFrame:
    """DIVERGENCES, one row for each bar(symbol, ts, bar_idx, v) that a position is open at: the warping
    distance between what it has held and as many steps of its template, 0 to 1, and whether that is
    over LIMIT; all are streams.

    positions(symbol, ts, bar_idx, id, template) open before the bar of their ts, closes(symbol, ts,
    bar_idx, id) close after it.  When the template is over, its last divergence stands.  An empty or
    null template diverges by nothing; bars whose v is null or empty or holds a null or NaN don't
    count.  v and the template's steps have one width.  The positions of a symbol are dealt over
    `shards`, each of which sees all bars of the symbol.
    """
    mine = lambda df: df.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    row = lambda df, ord_, what, numbers: df.select("symbol", "ts", "shard", F.lit(ord_).alias("ord"), F.lit(what).alias("what"), "id", "bar_idx", numbers.alias("numbers"))
    b = bars.withColumn("id", F.lit(None).cast("string")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    log = row(mine(positions), 0, "open", F.flatten("template")).unionByName(row(b, 1, "bar", F.col("v")))
    log = log.unionByName(row(mine(closes), 2, "close", F.lit(None).cast("array<double>"))).withColumn("at", F.unix_millis("ts"))
    return _running(log, ["symbol", "shard"], Holding(LOG, _OPEN, DIVERGENCES), DIVERGENCES, delay)
