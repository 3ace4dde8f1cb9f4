"""Ordered expressions over bars, and the ways to run them on series of any length.

Bars carry symbol and bar_idx.  A window over a whole symbol would put a long series into one
task, so windows run over pieces of CHUNK bars that each also hold some bars of their neighbours (a
halo).  Running sums and maxima, which look back without bound, take the totals of earlier pieces.
Exponential averages forget: they are summed by doubling, a lag of 1, 2, 4 and so on bars at a time,
as far back as a double can tell.  All of it stays within one exchange by symbol and piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 4096
HALO = 160


def lag(x: str, n: int = 1, by: str = "symbol, chunk") -> str:
    return f"lag({x}, {n}) OVER (PARTITION BY {by} ORDER BY bar_idx)"


def lead(x: str, n: int = 1, by: str = "symbol, chunk") -> str:
    return f"lead({x}, {n}) OVER (PARTITION BY {by} ORDER BY bar_idx)"


def roll(f: str, x: str, k: int, start: int = 0, by: str = "symbol, chunk") -> str:
    """f over the last k bars; null before k bars from bar `start` on, where x begins."""
    return f"CASE WHEN bar_idx >= {k - 1 + start} THEN {f}({x}) OVER (PARTITION BY {by} ORDER BY bar_idx ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) END"


def frame(f: str, x: str, first: str, last: str, by: str = "symbol, chunk") -> str:
    return f"{f}({x}) OVER (PARTITION BY {by} ORDER BY bar_idx ROWS BETWEEN {first} AND {last})"


def with_halo(bars: DataFrame, back: int = HALO, ahead: int = 0, chunk: int = CHUNK) -> DataFrame:
    """bars dealt into (symbol, chunk), with own = false for the copies of neighbours' bars."""
    home, place = F.expr(f"bar_idx div {chunk}"), F.expr(f"bar_idx % {chunk}")
    to = [home]
    if back:
        to.append(F.when(place >= chunk - back, home + 1))
    if ahead:
        to.append(F.when((place < ahead) & (home > 0), home - 1))
    dealt = bars.withColumn("__home", home).withColumn("chunk", F.explode(F.array_compact(F.array(*to))))
    return dealt.withColumn("own", F.col("chunk") == F.col("__home")).drop("__home")


def only_own(bars: DataFrame) -> DataFrame:
    return bars.where("own").drop("own", "chunk")


def running(pieces: DataFrame, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """pieces (with chunk, own and the halo before) with out = (sum or max, x) from the first bar to
    each bar of a symbol; for bars of the halo, sums only are right.

    The totals of a piece come from its own rows, one row each, and are added up over the pieces.
    """
    totals = pieces.groupBy("symbol", "chunk").agg(
        *[F.expr(f"{f}(CASE WHEN own THEN {x} END)").alias(f"__o_{o}") for o, (f, x) in columns.items()],
        *[F.expr(f"sum(CASE WHEN NOT own THEN {x} END)").alias(f"__h_{o}") for o, (f, x) in columns.items() if f == "sum"],
    )
    before = Window.partitionBy("symbol").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    # What stands before the piece, less what its halo will add again.
    carried = [
        (F.coalesce(F.sum(f"__o_{o}").over(before), F.lit(0)) - F.coalesce(f"__h_{o}", F.lit(0)) if f == "sum" else F.max(f"__o_{o}").over(before)).alias(f"__c_{o}")
        for o, (f, _) in columns.items()
    ]
    here = Window.partitionBy("symbol", "chunk").orderBy("bar_idx").rowsBetween(Window.unboundedPreceding, 0)
    out = pieces.select("*", *[F.expr(f"{f}({x})").over(here).alias(f"__r_{o}") for o, (f, x) in columns.items()])
    out = out.join(totals.select("symbol", "chunk", *carried), ["symbol", "chunk"])
    whole = {o: F.col(f"__r_{o}") + F.col(f"__c_{o}") if f == "sum" else F.greatest(f"__r_{o}", f"__c_{o}") for o, (f, _) in columns.items()}
    return out.withColumns(whole).drop(*[f"__{c}_{o}" for o in columns for c in "rc"])


def last_known(bars: DataFrame, name: str, chunk: int = CHUNK) -> DataFrame:
    """bars with name filled up by its last value before that is not null: within pieces, and from one
    row a piece beyond."""
    pieces = bars.withColumn("chunk", F.expr(f"bar_idx div {chunk}"))
    here = Window.partitionBy("symbol", "chunk").orderBy("bar_idx").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("symbol").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = pieces.groupBy("symbol", "chunk").agg(F.max_by(name, F.when(F.col(name).isNotNull(), F.col("bar_idx"))).alias("__end"))
    carried = ends.select("symbol", "chunk", F.last("__end", ignorenulls=True).over(before).alias("__before"))
    out = pieces.withColumn("__here", F.last(name, ignorenulls=True).over(here)).join(carried, ["symbol", "chunk"])
    return out.withColumn(name, F.coalesce("__here", "__before")).drop("__here", "__before", "chunk")


def ewm(columns: dict[str, tuple[str, float, int]], reach: int, by: str = "symbol, chunk") -> list[dict[str, str]]:
    """Steps for out = (x, alpha, start): y = x at bar `start`, where x begins, then
    alpha * x + (1 - alpha) * y.

    y is the sum of alpha * x[i] * q ** (t - i) over the last `reach` bars, a power of two: y of twice
    the reach is y plus q ** n times y of n bars before.
    """
    steps = [{f"__0_{o}": f"CASE WHEN {x} IS NULL THEN 0e0 WHEN bar_idx = {start} THEN {x} ELSE {a!r}D * {x} END" for o, (x, a, start) in columns.items()}]
    n, k = 1, 0
    while n < reach:
        steps.append({f"__{k + 1}_{o}": f"__{k}_{o} + {(1 - a) ** n!r}D * lag(__{k}_{o}, {n}, 0e0) OVER (PARTITION BY {by} ORDER BY bar_idx)" for o, (_, a, _) in columns.items()})
        n, k = 2 * n, k + 1
    return [*steps, {o: f"CASE WHEN {x} IS NOT NULL THEN __{k}_{o} END" for o, (x, _, _) in columns.items()}]
