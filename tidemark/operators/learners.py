"""What trackers learn from judged events: rates, suggestions, bounded steps, posteriors, grades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: By tracker, the rate below which to loosen and above which to tighten.
STEPS = {"gate": (0.4, 0.8), "near_miss": (0.25, 0.55)}
#: Weights of a reversed trade's result, the cap of a prior and its shrinking.
FLIP_WIN, FLIP_LOSS, PRIOR_CAP, DECAY = 2.0, 1.5, 10.0, 0.95
#: The cold start's relaxing by the hour, what it takes to graduate.
RELAX, GRADUATE_TRADES, GRADUATE_RATE = 0.05, 20, 0.80


def near_miss_band(similarity: str, threshold: str) -> Column:
    """How far below its threshold a similarity stays; null where it reaches it."""
    gap = F.col(threshold) - F.col(similarity)
    return F.when(gap <= 0, None).when(gap <= 0.02, "VERY_CLOSE").when(gap <= 0.05, "CLOSE").otherwise("MARGINAL")


def near_miss_scores(judged: DataFrame) -> DataFrame:
    """judged(band, profitable, move): rates and sums by band."""
    won, size = F.col("profitable"), F.abs("move")
    return judged.groupBy("band").agg(
        F.count("*").alias("n"), F.avg(won.cast("int")).alias("profitable_rate"), F.sum(F.when(won, size).otherwise(0.0)).alias("gain"), F.sum(F.when(won, 0.0).otherwise(size)).alias("loss")
    )


def exit_scores(judged: DataFrame) -> DataFrame:
    """judged(reason, verdict, favourable, adverse): the rates of the three verdicts by reason, what
    was left on the table and what was given back, and what to do about it."""
    rate = lambda v: F.avg((F.col("verdict") == v).cast("int")).alias(f"{v}_rate")
    of = lambda v, x: F.sum(F.when(F.col("verdict") == v, F.abs(x)).otherwise(0.0))
    found = judged.groupBy("reason").agg(
        F.count("*").alias("n"),
        rate("premature"),
        rate("correct"),
        rate("late"),
        of("premature", "favourable").alias("left"),
        of("late", "adverse").alias("given_back"),
    )
    return found.withColumn("suggestion", F.when(F.col("premature_rate") > 0.5, "loosen").when(F.col("late_rate") > 0.3, "tighten").otherwise("keep"))


def stop_scores(judged: DataFrame) -> DataFrame:
    """judged(kind, verdict, move): accuracy of correct against too_tight, neutral ones left out; half
    where nothing counts."""
    correct, tight = F.sum((F.col("verdict") == "correct").cast("long")), F.sum((F.col("verdict") == "too_tight").cast("long"))
    found = judged.groupBy("kind").agg(
        F.count("*").alias("n"), correct.alias("correct"), tight.alias("too_tight"), F.sum(F.when((F.col("verdict") == "correct") & (F.col("move") < 0), -F.col("move")).otherwise(0.0)).alias("saved"),
        F.sum(F.when(F.col("verdict") == "too_tight", F.abs("move")).otherwise(0.0)).alias("missed"),
    )
    total = F.col("correct") + F.col("too_tight")
    return found.withColumn("accuracy", F.when(total > 0, F.col("correct") / total).otherwise(0.5))


def suggestion(rate: str, tracker: str = "gate") -> Column:
    low, high = STEPS[tracker]
    return F.when(F.col(rate) < low, "loosen").when(F.col(rate) > high, "tighten").otherwise("keep")


def stepped(gates: DataFrame) -> DataFrame:
    """gates(gate, value, step, low, high, suggestion) with the new value, clamped, and whether it is
    another: at a bound there is no adjustment.  Loosening goes against the step."""
    sign = F.when(F.col("suggestion") == "tighten", 1).when(F.col("suggestion") == "loosen", -1).otherwise(0)
    new = F.greatest(F.col("low"), F.least(F.col("high"), F.col("value") + sign * F.col("step")))
    return gates.withColumn("new_value", F.round(new, 6)).withColumn("adjusted", F.abs(F.col("new_value") - F.col("value")) > 1e-12)


def audit(steps: DataFrame, applied: str) -> DataFrame:
    """One line for each adjustment that was made."""
    text = F.concat_ws(" ", F.col("suggestion"), F.col("gate"), F.format_number("value", 4), F.lit("->"), F.format_number("new_value", 4))
    return steps.where("adjusted").select("gate", "value", "new_value", text.alias("line"), F.lit(applied).alias("applied"))


def posteriors(trades: DataFrame, prior: DataFrame) -> DataFrame:
    """trades(key, won, flipped, hours) over prior(key, wins, losses): Beta parameters, mean and Kelly
    share.

    A prior weighs at most PRIOR_CAP observations; results of reversed trades weigh more; every full
    day since a trade shrinks its weight by DECAY.  Kelly's ratio is 1, its share 0 to 1.
    """
    shrink = F.least(F.lit(1.0), PRIOR_CAP / F.greatest(F.col("wins") + F.col("losses"), F.lit(1.0)))
    weight = F.pow(F.lit(DECAY), F.floor(F.col("hours") / 24)) * F.when(F.col("flipped"), F.when(F.col("won"), FLIP_WIN).otherwise(FLIP_LOSS)).otherwise(1.0)
    seen = trades.groupBy("key").agg(
        F.sum(F.when(F.col("won"), weight).otherwise(0.0)).alias("a"),
        F.sum(F.when(F.col("won"), 0.0).otherwise(weight)).alias("b"),
        F.count("*").alias("n"),
    )
    start = prior.select("key", (F.col("wins") * shrink).alias("a0"), (F.col("losses") * shrink).alias("b0"))
    both = start.join(seen, "key", "full").fillna(0, ["a0", "b0", "a", "b", "n"])
    table = both.select(
        "key",
        "n",
        F.greatest(F.lit(1.0), F.col("a0") + F.col("a")).alias("alpha"),
        F.greatest(F.lit(1.0), F.col("b0") + F.col("b")).alias("beta"),
    )
    mean = F.col("alpha") / (F.col("alpha") + F.col("beta"))
    return table.withColumn("mean", mean).withColumn("kelly", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * F.col("mean") - 1)))


def top_performers(table: DataFrame, most: int = 10, least: int = 3) -> DataFrame:
    return table.where(F.col("n") >= least).orderBy(F.desc("mean"), F.desc("n"), "key").limit(most)


def exit_learner(trades: DataFrame, recent: int = 100) -> DataFrame:
    """trades(signal, t, good, peak): Laplace estimates, the 75th percentile of the last peaks (from ten
    on, else 1), and the response to the next such signal."""
    rank = F.row_number().over(Window.partitionBy("signal").orderBy(F.desc("t")))
    last = trades.withColumn("r", rank)
    found = trades.groupBy("signal").agg(F.count("*").alias("n"), F.sum(F.col("good").cast("long")).alias("s"))
    peaks = last.where(F.col("r") <= recent).groupBy("signal").agg(F.count("*").alias("m"), F.percentile("peak", F.lit(0.75)).alias("p75"))
    table = found.join(peaks, "signal").withColumn("estimate", (F.col("s") + 1) / (F.col("n") + 2)).withColumn(
        "peak",
        F.when(F.col("m") >= 10, F.col("p75")).otherwise(1.0),
    )
    response = F.when(F.col("estimate") >= 0.8, "EXIT").when(F.col("estimate") >= 0.6, "PARTIAL").when(F.col("estimate") >= 0.4, "TIGHTEN").otherwise("IGNORE")
    return table.select("signal", "n", "estimate", "peak", response.alias("response"))


def cold_start(states: DataFrame) -> DataFrame:
    """states(key, trades, wins, idle_hours, threshold, floor): the relaxed threshold, 5 % for each full
    idle hour and not below its floor, and whether the start is over."""
    relaxed = F.greatest(F.col("floor"), F.col("threshold") * F.pow(F.lit(1 - RELAX), F.floor("idle_hours")))
    over = (F.col("trades") >= GRADUATE_TRADES) & (F.col("wins") / F.greatest("trades", F.lit(1)) >= GRADUATE_RATE)
    return states.withColumn("graduated", over).withColumn("relaxed", F.when(over, F.col("threshold")).otherwise(relaxed))


def walk_forward_summary(folds: DataFrame) -> DataFrame:
    """folds(key, sharpe, profit): means over folds, how many gain, and how even they are."""
    s = F.col("sharpe")
    found = folds.groupBy("key").agg(
        F.count("*").alias("folds"),
        F.avg(s).alias("mean_sharpe"),
        F.stddev_pop(s).alias("std_sharpe"),
        F.sum((F.col("profit") > 0).cast("long")).alias("profitable"),
    )
    return found.withColumn("consistency", F.col("profitable") / F.col("folds"))


def holdout_passed(sharpe: str, trades: str, win_rate: str, drawdown: str, limits: tuple[float, int, float, float] = (0.3, 20, 0.45, 15.0)) -> Column:
    least_sharpe, least_trades, least_rate, most_fall = limits
    return (F.col(sharpe) >= least_sharpe) & (F.col(trades) >= least_trades) & (F.col(win_rate) >= least_rate) & (F.col(drawdown) <= most_fall)


def group_importance(weights: DataFrame, default: float = 1.0) -> DataFrame:
    """weights(key, grp, weight): each group's share of the absolute deviation from the default."""
    apart = F.abs(F.col("weight") - default)
    total = weights.groupBy("key").agg(F.sum(apart).alias("total"))
    return weights.join(total, "key").select("key", "grp", "weight", F.when(F.col("total") > 1e-12, apart / F.col("total")).otherwise(0.0).alias("importance"))


def verified(protos: DataFrame, results: DataFrame) -> DataFrame:
    """protos(key) with the grade that results(key, matches, win_rate, avg_profit) give; PENDING where
    there are none."""
    grade = F.when(F.col("matches").isNull(), "PENDING").when(F.col("matches") < 3, "WATCHED").when(
        (F.col("win_rate") >= 0.6) & (F.col("avg_profit") > 0),
        "GOOD",
    ).when(F.col("avg_profit") > 0, "QUALIFIED").otherwise("ELIMINATED")
    return protos.join(results, "key", "left").withColumn("grade", grade)
