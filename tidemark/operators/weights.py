"""Weights of feature groups as tables with dates from which they hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.windows import last_known

# The 32 layered features that share the weight of a group, and its default.
GROUPS = {
    "rsi": ((0, 1, 16, 17), 1.5),
    "macd": ((2, 18, 19), 1.5),
    "volatility": ((6, 7, 8, 20, 21), 1.3),
    "momentum": ((3, 4, 5), 1.5),
    "volume": ((14, 15, 24), 1.2),
    "trend": ((9, 10, 11, 12, 22, 23), 1.3),
    "structure": ((26, 27, 28, 29, 30, 31), 1.0),
    "adx": ((13, 25), 1.2),
}
FEATURES, LEAST = 32, 0.01


def group_of_feature() -> list[str]:
    found = {i: name for name, (places, _) in GROUPS.items() for i in places}
    return [found[i] for i in range(FEATURES)]


def normalised(weights: Column) -> Column:
    """At least LEAST each, with a mean of 1."""
    clipped = F.transform(weights, lambda w: F.greatest(w, F.lit(LEAST)))
    mean = F.aggregate(clipped, F.lit(0.0), lambda s, w: s + w) / F.size(clipped)
    return F.transform(clipped, lambda w: w / mean)


def expanded(versions: DataFrame) -> DataFrame:
    """direction, valid_from, weights: 32 normalised weights from rows (direction, valid_from, group, weight).

    A group without a row, or with a null weight, has its default; of repeated rows the greatest
    weight counts, and unknown groups are left out.
    """
    by = ["direction", "valid_from"]
    stated = [F.coalesce(F.max(F.when(F.col("group") == g, F.col("weight"))), F.lit(default)).alias(f"__{g}") for g, (_, default) in GROUPS.items()]
    return versions.groupBy(*by).agg(*stated).select(*by, normalised(F.array(*[f"__{g}" for g in group_of_feature()])).alias("weights"))


def default_weights() -> Column:
    return normalised(F.array(*[F.lit(GROUPS[g][1]) for g in group_of_feature()]))


def valid_versions(times: DataFrame, versions: DataFrame, directions: tuple[str, ...] = ("long", "short"), chunk: int = 4096) -> DataFrame:
    """direction, at, valid_from: the newest version of each direction by each distinct time of `times`
    (column at); null before the first one.

    Distinct times are few where many series share them; they and the versions go through one ordered
    fill by pieces of `chunk` units, so that no version is joined with a range of bars.
    """
    each = F.explode(F.array(*[F.lit(d) for d in directions])).alias("direction")
    asked = times.select("at").where("at IS NOT NULL").distinct().select(each, "at", F.lit(None).cast("long").alias("valid_from"), F.lit(1).alias("asked"))
    begun = versions.where("valid_from IS NOT NULL").select("direction", F.col("valid_from").alias("at"), "valid_from", F.lit(0).alias("asked")).distinct()
    log = asked.unionByName(begun).groupBy("direction", "at").agg(F.max("valid_from").alias("valid_from"), F.max("asked").alias("asked"))
    filled = last_known(log.withColumnsRenamed({"direction": "symbol", "at": "bar_idx"}), "valid_from", chunk)
    return filled.where("asked = 1").select(F.col("symbol").alias("direction"), F.col("bar_idx").alias("at"), "valid_from")


def scores(vectors: DataFrame, versions: DataFrame) -> DataFrame:
    """symbol, bar_idx, direction, valid_from, score: mean of the weighted features of rows (symbol,
    bar_idx, at, v) under each direction's version of that time, or the defaults before the first."""
    valid = valid_versions(vectors, versions).join(expanded(versions), ["direction", "valid_from"], "left")
    valid = valid.withColumn("weights", F.coalesce("weights", default_weights()))
    products = F.zip_with("v", "weights", lambda x, w: x * w)
    return vectors.join(valid, "at").select(
        "symbol", "bar_idx", "direction", "valid_from", (F.aggregate(products, F.lit(0.0), lambda s, x: s + x) / FEATURES).alias("score")
    )
