"""What another exit would have given: look-ups in tables of range extremes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.windows import lead, only_own, running, with_halo

#: A trade came out too early where this much more, in percent, was to be had.
MISSED = 1.0
#: A stop was too tight where the mean close after it lies this far beyond the exit again.
RETURNED = 0.01


def range_tables(bars: DataFrame, longest: int) -> DataFrame:
    """symbol, bar_idx, close, total (of closes so far), tops and bottoms: level k is the greatest high
    and the least low of the 2**k bars from this one on, for all 2**k up to `longest`.

    Each level doubles the one before within a piece; a range that the series ends in is cut.
    """
    levels = longest.bit_length()
    totals = running(with_halo(bars.select("symbol", "bar_idx", "high", "low", "close"), 0), {"total": ("sum", "close")})
    table = with_halo(only_own(totals), 0, longest).withColumns({"t0": F.col("high"), "b0": F.col("low")})
    for k in range(levels - 1):
        table = table.selectExpr("*", f"greatest(t{k}, {lead(f't{k}', 1 << k)}) AS t{k + 1}", f"least(b{k}, {lead(f'b{k}', 1 << k)}) AS b{k + 1}")
    arrays = [F.array(*[f"{c}{k}" for k in range(levels)]).alias(name) for c, name in (("t", "tops"), ("b", "bottoms"))]
    return only_own(table).select("symbol", "bar_idx", "close", "total", *arrays)


def other_exits(trades: DataFrame, bars: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """A row for each trade and horizon: best and worst profit in percent within that many bars after the
    exit, held (the profit of leaving then) and mean_after (the mean close until then).

    Two ranges of 2**k bars, which may overlap, cover each span, so that a trade costs the same
    however long the horizon is.  Where the series ends before, best and worst are of what there is and
    the others null; a trade out on the last bar has nulls only.  premature: more than MISSED was
    to be had.  too_tight: a loss, after which the mean close came back by RETURNED.  Repeated trades
    are one; trades with a null in symbol, side, entry, exit or price are left out.
    """
    keys = ["symbol", "entry_idx", "exit_idx", "side", "entry_price", "exit_price", "profit_pct"]
    known = trades.select(*keys).dropna(subset=keys).distinct()
    asked = known.withColumn("horizon", F.explode(F.array(*[F.lit(h).cast("long") for h in horizons])))
    asked = asked.withColumn("level", F.expr("cast(floor(log2(horizon)) AS int)"))
    at = [("first", "exit_idx + 1"), ("second", "exit_idx + 1 + horizon - shiftleft(1L, level)"), ("end", "exit_idx + horizon"), ("exit", "exit_idx")]
    places = F.array(*[F.struct(F.lit(name).alias("place"), F.expr(x).cast("long").alias("bar_idx")) for name, x in at])
    looked = asked.withColumn("p", F.explode(places)).select(*keys, "horizon", "level", "p.*")
    met = looked.join(range_tables(bars, max(horizons)), ["symbol", "bar_idx"], "left")
    ranged = F.col("place").isin("first", "second")
    one = lambda place, c: F.max(F.when(F.col("place") == place, F.col(c)))
    spans = met.groupBy(*keys, "horizon").agg(
        F.max(F.when(ranged, F.expr("tops[level]"))).alias("top"),
        F.min(F.when(ranged, F.expr("bottoms[level]"))).alias("bottom"),
        one("end", "close").alias("last"),
        ((one("end", "total") - one("exit", "total")) / F.col("horizon")).alias("mean_after"),
    )
    way = F.when(F.col("side") == "long", 1.0).otherwise(-1.0)
    gain = lambda price: way * (price - F.col("entry_price")) / F.col("entry_price") * 100
    return spans.select(
        *keys, "horizon", "mean_after",
        gain(F.when(way > 0, F.col("top")).otherwise(F.col("bottom"))).alias("best"),
        gain(F.when(way > 0, F.col("bottom")).otherwise(F.col("top"))).alias("worst"),
        gain(F.col("last")).alias("held"),
    ).withColumns({
        "premature": F.coalesce(F.col("best") > F.col("profit_pct") + MISSED, F.lit(False)),
        "too_tight": F.coalesce((F.col("profit_pct") <= 0) & (way * (F.col("mean_after") - F.col("exit_price")) > F.col("exit_price") * RETURNED), F.lit(False)),
    })
