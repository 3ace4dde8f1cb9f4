"""Exact quantiles and histograms of groups of any size: only counts of bins reach one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scratch import stored

#: Bins of a pass, and the rows of one interval that may be sorted together.
BINS, SORTED = 4096, 65_536
_FINITE = "x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')"


def _bin(bins: int) -> Column:
    share = "if(hi - lo < double('Infinity'), (x - lo) / (hi - lo), (x / 2 - lo / 2) / (hi / 2 - lo / 2))"
    return F.expr(f"if(hi > lo, cast(least({bins - 1}, floor({share} * {bins})) AS int), 0)")


def _values(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """key (a struct of `by`, which equals itself with nulls too) and x, the finite numbers."""
    return df.select(F.struct(*by).alias("key"), F.col(column).cast("double").alias("x")).where(_FINITE)


def _sizes(values: DataFrame) -> DataFrame:
    return values.groupBy("key").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))


def quantiles(df: DataFrame, by: list[str], column: str, shares: list[float], bins: int = BINS, sorted_rows: int = SORTED) -> DataFrame:
    """by, share, value: interpolated quantiles of each group, as percentile() gives them.

    A wanted rank lies in an interval [lo, hi].  Each pass counts the interval's rows by bins, with
    their least and greatest number, and keeps the bin of the rank.  An interval of one number is
    done, and one of at most `sorted_rows` rows is sorted.  Nulls, NaN and infinities don't count; a
    group without other numbers, and an empty table, give no row; null keys are a group.
    """
    values = stored(_values(df, by, column))
    rank = "(n - 1) * cast(share AS double)"
    wanted = _sizes(values).withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
    wanted = wanted.select("key", "share", "n", "lo", "hi", F.expr(rank).alias("at"), F.explode(F.expr(f"array_distinct(array(floor({rank}), ceil({rank})))")).alias("rank"))
    ranks = stored(wanted.select("key", "share", "at", "rank", F.col("rank").alias("left"), "n", "lo", "hi"))
    wide = (F.col("n") > sorted_rows) & (F.col("lo") < F.col("hi"))
    place = ["key", "lo", "hi"]
    while not ranks.where(wide).limit(1).isEmpty():
        spans = ranks.where(wide).select(*place).distinct()
        binned = values.join(spans, "key").where("x BETWEEN lo AND hi").groupBy(*place, _bin(bins).alias("bin"))
        counts = binned.agg(F.count("*").alias("c"), F.min("x").alias("least"), F.max("x").alias("most"))
        order = Window.partitionBy(*place).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        counts = counts.withColumn("upto", F.sum("c").over(order))
        narrower = ranks.where(wide).join(counts, place).where("left < upto AND left >= upto - c").selectExpr(
            "key", "share", "at", "rank", "left - (upto - c) AS left", "c AS n", "least AS lo", "most AS hi"
        )
        ranks = stored(ranks.where(~wide).unionByName(narrower))
    spans = ranks.where("lo < hi").select(*place).distinct()
    row = F.row_number().over(Window.partitionBy(*place).orderBy("x")) - 1
    found = values.join(spans, "key").where("x BETWEEN lo AND hi").select(*place, row.cast("long").alias("left"), F.col("x").alias("value"))
    found = ranks.where("lo < hi").join(found, [*place, "left"]).unionByName(ranks.where("lo = hi").withColumn("value", F.col("lo")), allowMissingColumns=True)
    ends = found.groupBy("key", "share", "at").agg(F.min_by("value", "rank").alias("low"), F.max_by("value", "rank").alias("high"))
    return ends.select("key.*", "share", F.expr("low + (at - floor(at)) * (high - low)").alias("value"))


def histograms(df: DataFrame, by: list[str], column: str, bins: int = 20) -> DataFrame:
    """by, bin (from 0), low, high, n: equal bins from a group's least to its greatest number.

    The last bin has both ends, and empty bins are rows too.  A group of one number alone has bins
    from half below to half above it.  What counts is as in quantiles().
    """
    values = stored(_values(df, by, column))
    sizes = _sizes(values).selectExpr("key", "if(lo = hi, lo - 0.5, lo) AS lo", "if(lo = hi, hi + 0.5, hi) AS hi")
    counts = values.join(sizes, "key").groupBy("key", _bin(bins).alias("bin")).agg(F.count("*").alias("n"))
    every = sizes.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    edge = f"lo + (hi - lo) * {{}} / {bins}"
    return every.join(counts, ["key", "bin"], "left").select(
        "key.*", "bin", F.expr(edge.format("bin")).alias("low"), F.expr(edge.format("(bin + 1)")).alias("high"), F.coalesce("n", F.lit(0)).cast("long").alias("n")
    )
