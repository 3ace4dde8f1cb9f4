"""Decisions judged by what came after them, and entry candidates, as streams with state.

Both read one log of rows in event time.  Rows may arrive out of order: a processor holds them until
the watermark has passed them, and then takes them in order, so that the result does not depend on
how the log was cut into batches.  State is what is still held and what is still open, and an
event-time timer settles it when no further row of the key comes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.types import StructType

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


_TYPES = {"long": int, "int": int, "double": float, "boolean": bool, "string": str}


def _value(v, kind: str):
    if kind == "array<double>":
        return None if v is None else [math.nan if x is None else float(x) for x in v]
    return None if pd.isna(v) else _TYPES[kind](v)


class InOrder(StatefulProcessor):
    """Holds rows (their first column: event time in ms, their second: the order within it) until the
    watermark is behind them; step() then sees them one by one."""

    def __init__(self, rows: str, memory: str, output: str) -> None:
        self.rows, self.memory, self.columns = rows, memory, [c.split()[0] for c in output.split(", ")]

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.rows)
        self.open = handle.getListState("open", self.memory)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fields = [c.split() for c in self.rows.split(", ")]
        marked = (pdf.loc[pdf["bar_idx"].notna(), [name for name, _ in fields]] for pdf in rows)
        # A column with a null somewhere in the batch comes as floats, which the state would not take.
        fresh = [
            tuple(_value(v, kind) for v, (_, kind) in zip(r, fields, strict=True))
            for pdf in marked
            for r in pdf.itertuples(index=False)
        ]
        yield from self._advance(key, fresh, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, [], timerValues)

    def _advance(self, key, fresh: list, timers) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.held.get()] + fresh
        mark = timers.getCurrentWatermarkInMs()
        due = sorted((r for r in held if r[0] < mark), key=lambda r: r[:2])
        later = [r for r in held if r[0] >= mark]
        if fresh or due:
            self.held.put(later) if later else self.held.clear()
        if later:
            self.handle.registerTimer(max(r[0] for r in later) + 1)
        out = []
        if due:
            memory = [tuple(r) for r in self.open.get()]
            for row in due:
                memory = self.step(memory, row, out)
            self.open.put(memory) if memory else self.open.clear()
        yield pd.DataFrame([(*key, *r) for r in out], columns=self.columns)

    def step(self, memory: list, row: tuple, out: list) -> list:
        """The memory after a row; adds to out."""
        raise NotImplementedError

    def close(self) -> None:
        pass


#: Bars to wait, and the moves in percent that judge a decision.
HORIZON = 30
LEAST_PROFIT, STOP_MOVE, PREMATURE, GIVEN_BACK, EARLY = 0.3, 0.5, 0.5, 0.5, 0.5

#: what: "bar" or the kind of a decision; a bar counts before the decisions taken at it.
LOG = "at long, ord int, what string, id string, bar_idx long, direction string, price double, profit double, peak double"
_OPEN = "kind string, id string, bar_idx long, direction string, price double, profit double, peak double, best double, worst double"
VERDICTS = "symbol string, shard int, kind string, id string, bar_idx long, direction string, move double, best double, worst double, verdict string"


def verdict(kind: str, move: float, best: float, profit: float | None, peak: float | None) -> str:
    if kind == "rejection":
        return "correct" if move < LEAST_PROFIT else "wrong"
    if kind == "near_miss":
        return "profitable" if move >= LEAST_PROFIT else "unprofitable"
    if kind == "exit_timing":
        if best > PREMATURE:
            return "premature"
        given_back = peak is not None and peak > 0 and (peak - profit) / peak > GIVEN_BACK
        return "late" if given_back and best < PREMATURE / 2 else "correct"
    limit, wrong = (STOP_MOVE, "too_tight") if kind == "stop" else (EARLY, "too_aggressive")
    return wrong if move >= limit else "correct" if move <= -limit else "neutral"


class Judge(InOrder):
    """Open decisions with the best and worst move since; each is judged HORIZON bars later."""

    def step(self, memory: list, row: tuple, out: list) -> list:
        _, _, what, name, bar, direction, price, profit, peak = row
        if what != "bar":
            return [*memory, (what, name, bar, direction, price, profit, peak, 0.0, 0.0)]
        kept = []
        for kind, name, since, direction, then, profit, peak, best, worst in memory:
            if bar <= since:
                kept.append((kind, name, since, direction, then, profit, peak, best, worst))
                continue
            move = (price - then) / then * 100 * (1 if direction == "long" else -1)
            best, worst = max(best, move), max(worst, -move)
            if bar - since >= HORIZON:
                out.append((kind, name, since, direction, move, best, worst, verdict(kind, move, best, profit, peak)))
            else:
                kept.append((kind, name, since, direction, then, profit, peak, best, worst))
        return kept


def _running(df: DataFrame, keys: list[str], processor: InOrder, output: str, delay: str) -> DataFrame:
    marked = df.withWatermark("ts", delay).groupBy(*keys)
    return marked.transformWithStateInPandas(processor, StructType.fromDDL(output), "append", "eventTime")


def judgements(bars: DataFrame, decisions: DataFrame, shards: int = 1, delay: str = "2 hours") -> DataFrame:
    """VERDICTS of decisions(symbol, ts, bar_idx, kind, id, direction, price, profit, peak) by the
    closes of bars(symbol, ts, bar_idx, close), both streams.

    kind is rejection, exit_timing, stop, near_miss or early_exit.  The decisions of a symbol are
    dealt over `shards`, each of which sees all bars of the symbol.  Decisions whose horizon has not
    come yet stay open; rows behind the watermark are lost.
    """
    text, number = F.lit(None).cast("string"), F.lit(None).cast("double")
    b = bars.select("symbol", "ts", F.lit(0).alias("ord"), F.lit("bar").alias("what"), text.alias("id"), "bar_idx", text.alias("direction"), F.col("close").alias("price"), number.alias("profit"), number.alias("peak"))
    b = b.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    d = decisions.select("symbol", "ts", F.lit(1).alias("ord"), F.col("kind").alias("what"), "id", "bar_idx", "direction", "price", "profit", "peak")
    d = d.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    both = b.unionByName(d).withColumn("at", F.unix_millis("ts"))
    return _running(both, ["symbol", "shard"], Judge(LOG, _OPEN, VERDICTS), VERDICTS, delay)


#: Bars that a candidate lives without being entered, and that its direction stays shut
#: after a close.
TTL_BARS, SHUT_BARS = 5, 5

MATCHES = "at long, ord int, what string, bar_idx long, direction string, fingerprint string, passed boolean"
_LOCK = "what string, direction string, fingerprint string, bar_idx long"
ENTRIES = "symbol string, bar_idx long, direction string, fingerprint string, verdict string"


class Candidates(InOrder):
    """The one candidate of a symbol, and the direction that the last close has shut."""

    def step(self, memory: list, row: tuple, out: list) -> list:
        _, _, what, bar, direction, fingerprint, passed = row
        locks = {m[0]: m for m in memory}
        if what == "close":
            return [("shut", direction, None, bar)]  # the candidate goes with the position
        lock = locks.get("candidate")
        if lock is None or bar > lock[3] + TTL_BARS:
            lock = locks["candidate"] = ("candidate", direction, fingerprint, bar)
        shut = locks.get("shut")
        if shut is not None and bar - shut[3] >= SHUT_BARS:
            shut = locks.pop("shut") and None
        said = "shut" if shut is not None and shut[1] == lock[1] else "entered" if passed else "waits"
        if said == "entered":
            del locks["candidate"]
        out.append((bar, lock[1], lock[2], said))
        return list(locks.values())


def entries(log: DataFrame, delay: str = "2 hours") -> DataFrame:
    """ENTRIES: what each match of log(symbol, ts, ord, what, bar_idx, direction, fingerprint, passed)
    leads to.

    A match (what: match) without a live candidate becomes the candidate; one that has one confirms
    it, whatever it matched itself.  The candidate is entered if the gates passed and its direction
    is not shut, and is forgotten after TTL_BARS.  A close (what: close) drops the candidate and
    shuts its direction for SHUT_BARS.
    """
    return _running(log.withColumn("at", F.unix_millis("ts")), ["symbol"], Candidates(MATCHES, _LOCK, ENTRIES), ENTRIES, delay)


def started(result: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The query that appends a result to Parquet files; state lives in RocksDB, and the session's
    own choice of a state store is left as it was."""
    conf = result.sparkSession.conf
    before = conf.get(_PROVIDER, None)
    conf.set(_PROVIDER, _ROCKS)
    try:
        return result.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(_PROVIDER, before) if before else conf.unset(_PROVIDER)


def recorded(df: DataFrame, path: str, slices: int, delay_ms: int, files: int | None = None, span: tuple | None = None) -> None:
    """df(symbol, ts, …) as files in about the order of time: slice after slice, a row up to delay_ms
    late, and at last one row far ahead that moves the watermark over all others.

    With `files`, a slice has exactly that many, whatever the partitions of df, so that a stream that
    reads `files` a batch takes a slice at a time: part of a slice would move the watermark over the
    rest.  Streams that are read together also need the slices of one span, the least and the greatest
    ts of them all in ms.
    """
    first, last = span or df.agg(F.unix_millis(F.min("ts")), F.unix_millis(F.max("ts"))).first()
    if first is None:
        return
    width = (last - first) // slices + 1
    late = F.unix_millis("ts") + F.pmod(F.xxhash64(*df.columns), F.lit(delay_ms))
    cut = df.withColumn("__slice", F.least(F.lit(slices - 1), ((late - first) / width).cast("int")))
    rest = [F.lit(None).cast(t).alias(c) for c, t in df.dtypes if c not in ("symbol", "ts")]
    empty = lambda n, at: df.sparkSession.range(n).select(F.lit("").alias("symbol"), F.timestamp_millis(F.lit(at)).alias("ts"), *rest, F.col("id").alias("__file"))
    for i in range(slices):
        mine = cut.where(F.col("__slice") == i).drop("__slice")
        if files:  # a row without a bar in each file, as files without rows are not written
            dealt = mine.withColumn("__file", F.pmod(F.xxhash64(*df.columns), F.lit(files)))
            mine = dealt.unionByName(empty(files, first)).repartitionById(files, F.col("__file").cast("int")).drop("__file")
        mine.write.mode("append").parquet(path)
    empty(1, last + 10 * 86_400_000).drop("__file").select(df.columns).write.mode("append").parquet(path)
