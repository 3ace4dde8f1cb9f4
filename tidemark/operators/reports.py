"""Figures by regime and direction over closed trades: accuracy, learned ranges, fitness of weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.templates import BEARS, BULLS

SIDEWAYS = ("RANGE_BULL", "RANGE_BEAR")


def label_statistics(trades: DataFrame, *keys: str) -> DataFrame:
    """Counts, profits and holds of labelled trades(side, profit, profit_pct, hold)."""
    of = lambda s: F.sum((F.col("side") == s).cast("long"))
    return trades.groupBy(*keys).agg(
        F.count("*").alias("n"), of("long").alias("longs"), of("short").alias("shorts"), F.sum("profit").alias("total_profit"), F.avg("profit").alias("avg_profit"), F.avg("profit_pct").alias("avg_profit_pct"),
        F.max("profit_pct").alias("max_profit_pct"), F.min("profit_pct").alias("min_profit_pct"), F.avg("hold").alias("avg_hold"), F.max("hold").alias("max_hold"), F.min("hold").alias("min_hold"),
    )


def regime_right(regime: str, side: str, profit: str, move: str, hold: str) -> Column:
    """Whether a trade bears its regime out; null for an unknown one.

    A trend is right if its own side gains by it or the price goes on, or if the other side loses by
    it; a sideways regime is, if the price moved by less than 2 % or the trade was over in an hour.
    """
    r, long, p, m = F.col(regime), F.col(side) == "LONG", F.col(profit), F.col(move)
    up = F.when(long, (p > 0.5) | (m > 0.5)).otherwise(p < -0.5)
    down = F.when(~long, (p > 0.5) | (m < -0.5)).otherwise(p < -0.5)
    flat = (F.abs(m) < 2.0) | (F.col(hold) < 60)
    return F.when(r.isin(*SIDEWAYS), flat).when(r.isin(*BULLS), up).when(r.isin(*BEARS), down)


def regime_accuracy(trades: DataFrame, recent: int = 20) -> DataFrame:
    """trades(regime, right, closed, order_id): accuracy by regime, over all and over the last ones."""
    rank = F.row_number().over(Window.partitionBy("regime").orderBy(F.desc("closed"), F.desc("order_id")))
    known = trades.where("right is not null").withColumn("r", rank)
    right = F.col("right").cast("int")
    return known.groupBy("regime").agg(
        F.count("*").alias("n"),
        F.sum(right.cast("long")).alias("correct"),
        F.avg(right).alias("accuracy"),
        F.avg(F.when(F.col("r") <= recent, right)).alias("recent"),
    )


def learned_ranges(samples: DataFrame, least: int = 10, least_side: int = 5) -> DataFrame:
    """samples(regime, direction, feature, won, x): the quartiles of the winners where the losers' median
    lies outside them, or where losers are too few to tell."""
    keys = ["regime", "direction", "feature"]
    won = F.when(F.col("won"), F.col("x"))
    lost = F.when(~F.col("won"), F.col("x"))
    found = samples.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count(won).alias("wins"), F.count(lost).alias("losses"), F.percentile(
            won,
            F.lit(0.25),
        ).alias("low"), F.percentile(won, F.lit(0.75)).alias("high"), F.percentile(lost, F.lit(0.5)).alias("median")
    )
    tells = (F.col("losses") < least_side) | (F.col("median") < F.col("low")) | (F.col("median") > F.col("high"))
    return found.where((F.col("n") >= least) & (F.col("wins") >= least_side) & tells).select(*keys, "low", "high")


def quality(samples: DataFrame, ranges: DataFrame) -> DataFrame:
    """key and the share of its learned ranges that samples(key, regime, direction, feature, x) lie in;
    half where nothing was learned."""
    keys = ["regime", "direction", "feature"]
    judged = samples.join(ranges, keys, "left").withColumn("inside", F.col("x").between(F.col("low"), F.col("high")).cast("int"))
    return judged.groupBy("key").agg(F.coalesce(F.avg("inside"), F.lit(0.5)).alias("quality"))


def weight_fitness(points: DataFrame) -> DataFrame:
    """points(regime, side, a, b, c, profit): per regime of four points and more, how compact either
    side's points are, how far apart their centres, and how far gains shrink with the distance to the
    centre; fitness weighs them 0.3, 0.4 and 0.3."""
    axes = ("a", "b", "c")
    centre = points.groupBy("regime", "side").agg(F.count("*").alias("n"), *[F.avg(x).alias(f"m{x}") for x in axes])
    gap = sum(((F.col(x) - F.col(f"m{x}")) ** 2 for x in axes), F.lit(0.0))
    placed = points.join(centre, ["regime", "side"]).withColumn("d", F.when(F.col("n") >= 2, F.sqrt(gap)).otherwise(0.0))
    spread = placed.where("n >= 2").groupBy("regime", "side").agg((1 / (F.avg("d") + 0.01)).alias("tight")).groupBy("regime").agg(F.avg("tight").alias("compactness"))
    pick = lambda s, x: F.max(F.when((F.col("side") == s) & (F.col("n") >= 2), F.col(f"m{x}")))
    apart = centre.groupBy("regime").agg(*[(pick("LONG", x) - pick("SHORT", x)).alias(f"g{x}") for x in axes])
    apart = apart.select("regime", F.coalesce(F.sqrt(sum((F.col(f"g{x}") ** 2 for x in axes), F.lit(0.0))), F.lit(0.0)).alias("separation"))
    flat = (F.stddev_pop("d") <= 1e-9) | (F.stddev_pop("profit") <= 1e-9)
    tied = placed.groupBy("regime").agg(F.count("*").alias("n"), F.when((F.count("*") < 5) | flat, 0.0).otherwise(-F.corr("d", "profit")).alias("nearness"))
    both = tied.where("n >= 4").join(apart, "regime").join(spread, "regime", "left").fillna(0.0, ["compactness"])
    return both.withColumn("fitness", 0.3 * F.col("compactness") + 0.4 * F.col("separation") + 0.3 * F.greatest(F.lit(0.0), "nearness"))


def explored(candidates: DataFrame, every: int = 10) -> DataFrame:
    """Each tenth rejected candidate of a key, in order of t, is tried all the same."""
    place = F.row_number().over(Window.partitionBy("key").orderBy("t"))
    return candidates.withColumn("tried", place % every == 0)


def capped_families(entries: DataFrame, breakdown: DataFrame, most: int = 20, least_rate: float = 0.52, least_triggers: int = 5) -> DataFrame:
    """Entries in order of composite while none of their families has `most` before them; shorts then
    need `least_rate` in falling states, where they have triggers enough.

    A fold over one pool and direction, as what comes counts on what was taken."""
    fams = "array_distinct(transform(conditions, c -> regexp_replace(c, '_(loose|strict|mod_loose|mod_strict)$', '')))"
    item = F.struct((-F.col("composite")).alias("o"), F.col("combo").alias("combo"), F.expr(fams).alias("f"))
    lists = entries.groupBy("pool", "direction").agg(F.array_sort(F.collect_list(item)).alias("l"))
    room = f"forall(x.f, f -> coalesce(s.used[f], 0) < {most})"
    used = "map_zip_with(s.used, map_from_arrays(x.f, transform(x.f, f -> 1)), (k, a, b) -> coalesce(a, 0) + coalesce(b, 0))"
    start = "named_struct('kept', cast(array() as array<string>), 'used', cast(map() as map<string,int>))"
    fold = f"aggregate(l, {start}, (s, x) -> IF({room}, named_struct('kept', concat(s.kept, array(x.combo)), 'used', {used}), s), s -> s.kept)"
    kept = lists.select("pool", "direction", F.explode(F.expr(fold)).alias("combo"))
    falling = breakdown.where((F.col("state") == "BEAR") & (F.col("direction") == "short") & (F.col("triggers") >= least_triggers) & (F.col("rate") < least_rate))
    return kept.join(falling, ["pool", "direction", "combo"], "left_anti")
