"""Decisions judged by later bars, and what the judgements suggest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.windows import frame, lead, only_own, with_halo

HORIZON = 30
GATES = ("SCORE", "MACD", "KDJ")


def decisions(table: DataFrame, decided: DataFrame) -> DataFrame:
    """decided(symbol, bar_idx, gate, direction) with the moves of the HORIZON bars after each, in
    percent and in the direction of the decision: of the last one (move), and the best and the worst."""
    ahead = ("1 FOLLOWING", f"{HORIZON} FOLLOWING")
    held = with_halo(table, 0, HORIZON + 1).selectExpr(
        "symbol", "bar_idx", "close", "own", "chunk", f"{lead('close', HORIZON)} AS later", f"{frame('max', 'high', *ahead)} AS top", f"{frame('min', 'low', *ahead)} AS bottom"
    )
    known = decided.join(only_own(held).where("later IS NOT NULL"), ["symbol", "bar_idx"])
    up, down = "(top / close - 1) * 100", "(1 - bottom / close) * 100"
    return known.selectExpr(
        "symbol", "bar_idx", "direction", "gate", "(later / close - 1) * 100 * IF(direction = 'long', 1, -1) AS move",
        f"IF(direction = 'long', {up}, {down}) AS favourable", f"IF(direction = 'long', {down}, {up}) AS adverse",
    )


#: The rules that judge a decision from its later bars.
JUDGEMENTS = {
    "rejection": "CASE WHEN move < 0.3e0 THEN 'correct' ELSE 'wrong' END",
    "exit_timing": "CASE WHEN favourable > 0.5e0 THEN 'premature' WHEN adverse > 0.5e0 AND favourable < 0.25e0 THEN 'late' ELSE 'correct' END",
    "stop": "CASE WHEN move >= 0.5e0 THEN 'too_tight' WHEN move <= -0.5e0 THEN 'correct' ELSE 'neutral' END",
    "near_miss": "CASE WHEN move >= 0.3e0 THEN 'profitable' ELSE 'unprofitable' END",
}
#: Least accuracy that keeps a gate, and the accuracy above which it may tighten.
LOOSEN, TIGHTEN = 0.4, 0.8


def judged(found: DataFrame) -> DataFrame:
    return found.selectExpr("*", *[f"{x} AS {n}" for n, x in JUDGEMENTS.items()])


def gate_scores(found: DataFrame) -> DataFrame:
    """Accuracy of each gate's rejections, what they saved and missed, and the step it suggests."""
    correct = F.col("rejection") == "correct"
    scored = found.groupBy("gate").agg(
        F.count("*").alias("n"), F.sum(correct.cast("long")).alias("correct"), F.sum(F.when(F.col("move") < 0, -F.col("move")).otherwise(0.0)).alias("saved"), F.sum(F.when(F.col("move") > 0, F.col("move")).otherwise(0.0)).alias("missed")
    )
    return scored.selectExpr(
        "*",
        "correct / n AS accuracy",
        f"CASE WHEN correct / n < {LOOSEN} THEN 'loosen' WHEN correct / n > {TIGHTEN} THEN 'tighten' ELSE 'keep' END AS suggestion",
    )


def bounded_step(df: DataFrame, value: str, action: str, step: float, low: float, high: float) -> DataFrame:
    """next: value moved by step as the action says, inside its bounds; null where nothing changes."""
    moved = F.when(
        F.col(action) == "loosen",
        F.greatest(F.col(value) - step, F.lit(low)),
    ).when(F.col(action) == "tighten", F.least(F.col(value) + step, F.lit(high)))
    return df.withColumn("next", F.when(moved != F.col(value), moved))


def recent_accuracy(found: DataFrame, last: int = 20) -> DataFrame:
    """Accuracy of each gate over its last decisions up to each one, by symbol."""
    from pyspark.sql import Window

    w = Window.partitionBy("symbol", "gate").orderBy("bar_idx").rowsBetween(-(last - 1), 0)
    return found.select("symbol", "gate", "bar_idx", F.avg((F.col("rejection") == "correct").cast("int")).over(w).alias("accuracy"))


def posteriors(outcomes: DataFrame, *keys: str, prior: float = 1.0) -> DataFrame:
    """Beta posterior of the hit rate and the Kelly share p - (1 - p) / b, from 0 to 1."""
    won = F.col("outcome").cast("long")
    got = outcomes.groupBy(*keys).agg((F.sum(won) + prior).alias("alpha"), (F.sum(1 - won) + prior).alias("beta"), F.avg("ratio").alias("ratio"))
    mean = F.col("alpha") / (F.col("alpha") + F.col("beta"))
    return got.withColumn("mean", mean).withColumn("kelly", F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean - (1 - mean) / F.col("ratio"))))
