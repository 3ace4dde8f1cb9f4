"""Bars: read, standardised, built from ticks, aggregated, sampled, parsed from feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Other spellings of the columns of a bar file (fixed values).
ALIASES = {"open_time": "timestamp", "time": "timestamp", "vol": "volume", "o": "open", "h": "high", "l": "low", "c": "close", "v": "volume"}
PRICES = ("open", "high", "low", "close", "volume")
TICK_DIVISOR = 50000.0


def standardise(df: DataFrame) -> DataFrame:
    """Column names in lower case and by ALIASES; prices as doubles, what is no number null."""
    names = {c: ALIASES.get(c.lower(), c.lower()) for c in df.columns}
    cast = lambda c, n: F.col(f"`{c}`").cast("string").try_cast("double").alias(n) if n in PRICES else F.col(f"`{c}`").alias(n)
    return df.select(*[cast(c, n) for c, n in names.items()])


def bars_from_ticks(spark: SparkSession, sf_dir: str, grain: str = "hour") -> DataFrame:
    """symbol, ts, open, high, low, close, volume, bar_idx from the events table.

    A tick moves its symbol's price by its value, up if the cents are even.  The running sum is
    taken in two steps, over the bars' totals and inside each bar, so that no window holds all
    ticks of a symbol.
    """
    ticks = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_type").alias("symbol"),
        F.date_trunc(grain, "ts").cast("timestamp_ntz").alias("bts"),
        "ts",
        "event_id",
        F.expr(f"CASE WHEN cast(round(value * 100) AS bigint) % 2 = 0 THEN 1 ELSE -1 END * value / {TICK_DIVISOR}D").alias("r"),
    )
    before = Window.partitionBy("symbol").orderBy("bts").rowsBetween(Window.unboundedPreceding, -1)
    order = Window.partitionBy("symbol").orderBy("bts")
    starts = ticks.groupBy("symbol", "bts").agg(F.sum("r").alias("t"))
    starts = starts.select(
        "symbol",
        "bts",
        F.coalesce(F.sum("t").over(before), F.lit(0.0)).alias("base"),
        (F.row_number().over(order) - 1).cast("long").alias("bar_idx"),
    )
    inside = Window.partitionBy("symbol", "bts").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    priced = ticks.withColumn("s", F.sum("r").over(inside)).join(starts, ["symbol", "bts"]).withColumn("p", 100.0 * F.exp(F.col("base") + F.col("s")))
    at = F.struct("ts", "event_id")
    return priced.groupBy("symbol", F.col("bts").alias("ts"), "bar_idx").agg(
        F.min_by("p", at).alias("open"),
        F.max("p").alias("high"),
        F.min("p").alias("low"),
        F.max_by("p", at).alias("close"),
        F.count("*").cast("double").alias("volume"),
    )


def aggregate_bars(bars: DataFrame, k: int) -> DataFrame:
    """Groups of k bars by place; an incomplete last group is dropped."""
    grouped = bars.groupBy("symbol", F.expr(f"bar_idx div {k}").alias("bar_idx")).agg(
        F.min("ts").alias("ts"),
        F.min_by("open", "bar_idx").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "bar_idx").alias("close"),
        F.sum("volume").alias("volume"),
        F.count("*").alias("n"),
    )
    return grouped.where(F.col("n") == k).drop("n")


def info(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(
        F.count("*").alias("n_bars"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("volume").alias("volume"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


def contiguous(bars: DataFrame, start: int, size: int) -> DataFrame:
    """A stretch of each symbol, with bar_idx counted from its start."""
    return bars.where(F.col("bar_idx").between(start, start + size - 1)).withColumn("bar_idx", F.col("bar_idx") - start)


def round_start(n: int, size: int, turn: int, warmup: int = 200) -> int:
    """The start of a round's stretch: fixed by the number of the round."""
    import numpy as np

    room = max(1, n - size - warmup)
    return warmup + int(np.random.default_rng(turn * 7919 + 42).integers(0, room)) if n > size + warmup else 0


def parse_rest(lines: DataFrame, now_ms: int) -> DataFrame:
    """Bars from positional JSON arrays [open_ms, o, h, l, c, v, close_ms, ...]; closed by now."""
    a = F.from_json("value", "array<string>")
    num = lambda i: a[i].try_cast("double")
    return lines.select(
        F.timestamp_millis(a[0].cast("long")).alias("ts"), num(1).alias("open"), num(2).alias("high"), num(3).alias("low"), num(4).alias("close"), num(5).alias("volume"),
        (a[6].cast("long") <= now_ms).alias("is_closed"),
    )


def parse_stream(lines: DataFrame) -> DataFrame:
    """Bars from messages {"s":…, "k":{"t":…, "o":…, "h":…, "l":…, "c":…, "v":…, "x":…}}."""
    m = F.from_json("value", "s string, k struct<t:bigint,o:string,h:string,l:string,c:string,v:string,x:boolean>")
    k = m["k"]
    num = lambda c: k[c].try_cast("double")
    return lines.select(
        m["s"].alias("symbol"), F.timestamp_millis(k["t"]).alias("ts"), num("o").alias("open"), num("h").alias("high"), num("l").alias("low"), num("c").alias("close"), num("v").alias("volume"),
        k["x"].alias("is_closed"),
    )


def scan(spark: SparkSession, *paths: str, symbol: str = "") -> DataFrame:
    """Bars of the first of the given files or folders that is there, standardised, with symbol (where
    the file has none) and bar_idx by time."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            found = standardise(spark.read.parquet(path)).withColumnRenamed("timestamp", "ts")
            named = found if "symbol" in found.columns else found.withColumn("symbol", F.lit(symbol))
            return named if "bar_idx" in found.columns else numbered(named)
    raise FileNotFoundError(f"none of {paths}")


def numbered(bars: DataFrame, piece: str = "MONTH") -> DataFrame:
    """bar_idx from 0 in order of time: places within pieces of time, plus the bars of the pieces before."""
    cut = bars.withColumn("__p", F.date_trunc(piece, "ts"))
    counts = cut.groupBy("symbol", "__p").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("symbol").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("symbol", "__p", F.coalesce(before, F.lit(0)).alias("__s"))
    place = F.row_number().over(Window.partitionBy("symbol", "__p").orderBy("ts"))
    return cut.withColumn("__r", place).join(starts, ["symbol", "__p"]).withColumn(
        "bar_idx",
        (F.col("__s") + F.col("__r") - 1).cast("long"),
    ).drop("__p", "__r", "__s")


def write(bars: DataFrame, path: str) -> None:
    """A folder of Parquet, one sub-folder for each symbol."""
    bars.write.partitionBy("symbol").parquet(path)
