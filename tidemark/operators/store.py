"""Results of combinations over rounds: cumulative metrics, ranking, keeping, diverse choice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Net gain and loss of a trade by pool and direction, and the rates that score 0 and 100.
NET = {("pool1", "long"): (0.0054, 0.0086), ("pool1", "short"): (0.0074, 0.0066), ("pool2", "long"): (0.0094, 0.0086), ("pool2", "short"): (0.0094, 0.0086)}
RATE_SPAN = {"long": (0.61, 0.75), "short": (0.47, 0.65)}


def metrics_sql(direction: str, pool: str = "pool1") -> dict[str, str]:
    """Columns over rounds, avg_rate, rate_std, triggers and hits."""
    low, high = RATE_SPAN[direction]
    gain, loss = NET[pool, direction]
    part = lambda x: f"least(100e0, greatest(0e0, {x}))"
    rate, stable, turns = part(f"(avg_rate - {low}e0) / ({high}e0 - {low}e0) * 100"), part("(1 - rate_std / 0.08e0) * 100"), "least(100e0, ln(rounds + 1) / ln(21) * 100)"
    return {
        "overall_rate": "hits / triggers",
        "stability": "avg_rate * (1 - rate_std) * ln(rounds + 1)",
        "composite": f"0.3e0 * {rate} + 0.4e0 * {stable} * least(1e0, rounds / 5e0) + 0.3e0 * {turns}",
        "ev_percent": f"(hits / triggers * {gain}e0 - (1 - hits / triggers) * {loss}e0) * 100",
        "penalty": "3e0 * greatest(0, n_conditions - 3)",
    }


def cumulative(history: DataFrame, direction: str, pool: str = "pool1") -> DataFrame:
    """One row a combination from history(combo, round, triggers, hits); population deviation."""
    rate = F.col("hits") / F.col("triggers")
    grouped = history.groupBy("combo").agg(
        F.count("*").alias("rounds"), F.avg(rate).alias("avg_rate"), F.stddev_pop(rate).alias("rate_std"), F.sum("triggers").alias("triggers"), F.sum("hits").alias("hits"), F.median("triggers").alias("median_triggers")
    )
    grouped = grouped.withColumn("n_conditions", F.size(F.split("combo", r"\+")))
    return grouped.selectExpr("*", *[f"{x} AS {n}" for n, x in metrics_sql(direction, pool).items()])


#: Rounds, mean rate and deviation of a stable combination.
STABLE = "rounds >= 5 AND avg_rate >= 0.62e0 AND rate_std <= 0.05e0"


def diverse(ranked: DataFrame, group: str, most: int = 10, overlap: float = 0.3) -> DataFrame:
    """Best first within each group, leaving out what shares too many families with one chosen.

    The list of a group is folded in order; it holds the ranked candidates of one market state
    and direction, of which there are at most as many as combinations.
    """
    item = F.struct(
        (-F.col("composite")).alias("o"),
        "combo",
        F.transform(F.split("combo", r"\+"), lambda c: F.regexp_replace(c, "_(loose|strict)$", "")).alias("f"),
    )
    lists = ranked.groupBy(group).agg(F.array_sort(F.collect_list(item)).alias("l"))
    near = f"exists(acc, a -> size(array_intersect(a.f, x.f)) >= {overlap}D * size(array_union(a.f, x.f)))"
    fold = f"aggregate(l, cast(array() as array<struct<o:double,combo:string,f:array<string>>>), (acc, x) -> IF(size(acc) >= {most} OR {near}, acc, concat(acc, array(x))))"
    return lists.select(group, F.posexplode(F.expr(fold)).alias("rank", "x")).select(group, (F.col("rank") + 1).alias("rank"), "x.combo")


def live_streak(trades: DataFrame) -> DataFrame:
    """Losses in a row at the end of each key's trades(key, t, won), and the counters."""
    last_win = trades.where("won").groupBy("key").agg(F.max("t").alias("w"))
    joined = trades.join(last_win, "key", "left")
    return joined.groupBy("key").agg(
        F.count("*").alias("total"), F.sum(F.col("won").cast("long")).alias("wins"), F.sum(F.when(F.col("w").isNull() | (F.col("t") > F.col("w")), 1).otherwise(0)).cast("long").alias("loss_streak")
    )
