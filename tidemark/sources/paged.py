"""Bars behind a paged interface, as a data source for batches and streams.

A server answers "bars of a symbol from this time on" with at most a page of positional rows
[open_ms, o, h, l, c, v, close_ms]; the next page starts right after the last close.  `recorded`
pages stand for it: a folder for each symbol, a JSON file for each page, named by its first time in
milliseconds, whose content is the list of answers that the server gave, one an attempt:
[{"status": 503}, {"status": 200, "rows": [...]}].

    spark.dataSource.register(PagedBars)
    spark.read.format("paged_bars").load(path)            # each symbol in spans of pages
    spark.readStream.format("paged_bars").load(path)      # offsets: the next time of each symbol

Folders are reached through pyarrow's file systems, so that any store will do that those know.
Answers other than 200 are tried again, `retries` times, with a growing pause.  A page that appears
behind others (late) is read by a stream as soon as it is there; bars are delivered once.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "symbol string, open_ms long, open double, high double, low double, close double, volume double, close_ms long"
PAGE_ROWS, SPAN_PAGES = 1000, 16
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


class Unavailable(Exception):
    """The server gave no page in all attempts."""


class Recorded:
    """Pages on a file system."""

    def __init__(self, options: dict) -> None:
        self.fs, self.root = fs.FileSystem.from_uri(options["path"]) if "://" in options["path"] or options["path"].startswith("file:") else (fs.LocalFileSystem(), options["path"])
        self.retries, self.pause = int(options.get("retries", 3)), float(options.get("pause", 0.05))

    def pages(self) -> dict[str, list[int]]:
        """Times at which pages start, by symbol."""
        found: dict[str, list[int]] = {}
        for info in self.fs.get_file_info(fs.FileSelector(self.root, recursive=True)):
            if info.is_file and info.base_name.endswith(".json"):
                symbol = info.path.rsplit("/", 2)[-2].removeprefix("symbol=")
                found.setdefault(symbol, []).append(int(info.base_name.removesuffix(".json")))
        return {symbol: sorted(starts) for symbol, starts in found.items()}

    def page(self, symbol: str, start: int) -> list[list]:
        with self.fs.open_input_stream(f"{self.root}/symbol={symbol}/{start}.json") as f:
            answers = json.loads(f.read())
        for attempt in range(self.retries + 1):
            answer = answers[min(attempt, len(answers) - 1)]
            if answer["status"] == 200:
                return answer["rows"]
            time.sleep(self.pause * 2**attempt)
        raise Unavailable(f"{symbol} from {start}: status {answer['status']}")


class Span(InputPartition):
    def __init__(self, symbol: str, starts: list[int]) -> None:
        self.symbol, self.starts = symbol, starts


def _batch(symbol: str, rows: list[list]) -> pa.RecordBatch:
    number = lambda i: pa.array([float(r[i]) for r in rows], pa.float64())
    times = lambda i: pa.array([int(r[i]) for r in rows], pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([symbol] * len(rows), pa.string()), times(0), *map(number, range(1, 6)), times(6)], _NAMES)


class _Reading:
    def __init__(self, options: dict) -> None:
        self.options = options

    def spans(self, wanted: dict[str, list[int]]) -> list[Span]:
        size = int(self.options.get("spanpages", SPAN_PAGES))
        return [Span(s, starts[i : i + size]) for s, starts in sorted(wanted.items()) for i in range(0, len(starts), size)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        server = Recorded(self.options)
        for start in partition.starts:
            if rows := server.page(partition.symbol, start):
                yield _batch(partition.symbol, rows)


class PagedReader(_Reading, DataSourceReader):
    def partitions(self) -> list[Span]:
        return self.spans(Recorded(self.options).pages())


class PagedStream(_Reading, DataSourceStreamReader):
    """Offsets: of each symbol, the time up to which all pages are read, and the pages that are read
    beyond it.  A late page fills its gap and moves the time on."""

    def initialOffset(self) -> dict:
        return {"read": {}}

    def latestOffset(self) -> dict:
        return {"read": {s: _compact(starts, self.options) for s, starts in Recorded(self.options).pages().items()}}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        wanted = {}
        for symbol, spans in end["read"].items():
            before = start["read"].get(symbol, [])
            here = Recorded(self.options).pages().get(symbol, [])
            wanted[symbol] = [p for p in here if _within(p, spans) and not _within(p, before)]
        return self.spans(wanted)

    def commit(self, end: dict) -> None:
        pass


def _compact(starts: list[int], options: dict) -> list[list[int]]:
    """Spans [first, last] of page starts with no gap between the pages, so that an offset stays small."""
    step = int(options["pagemillis"])
    spans: list[list[int]] = []
    for s in starts:
        if spans and s - spans[-1][1] <= step:
            spans[-1][1] = s
        else:
            spans.append([s, s])
    return spans


def _within(start: int, spans: list[list[int]]) -> bool:
    return any(a <= start <= b for a, b in spans)


class PagedBars(DataSource):
    """Options: path; retries, pause (seconds), spanPages (pages of a task); pageMillis, the time that
    a full page covers (streams only)."""

    @classmethod
    def name(cls) -> str:
        return "paged_bars"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagedReader:
        return PagedReader({k.lower(): v for k, v in self.options.items()})

    def streamReader(self, schema) -> PagedStream:
        return PagedStream({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedBars)


def record(bars: DataFrame, path: str, page_ms: int, width_ms: int, fails: int = 0) -> None:
    """bars(symbol, ts, open, high, low, close, volume) as recorded pages of page_ms each; of every
    `fails` pages one answers only at the third attempt."""
    at = F.unix_millis("ts")
    row = F.array(*[c.cast("string") for c in (at, *[F.col(c) for c in ("open", "high", "low", "close", "volume")], at + width_ms - 1)])
    pages = bars.withColumns({"start": at - F.pmod(at, F.lit(page_ms)), "row": row}).groupBy("symbol", "start").agg(F.array_sort(F.collect_list(F.struct(at.alias("at"), "row"))).alias("rows"))

    def write(rows: Iterator) -> None:
        for r in rows:
            where, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
            where.create_dir(f"{root}/symbol={r['symbol']}", recursive=True)
            failed = [{"status": 503}, {"status": 429}] if fails and r["start"] // page_ms % fails == 0 else []
            with where.open_output_stream(f"{root}/symbol={r['symbol']}/{r['start']}.json") as f:
                f.write(json.dumps([*failed, {"status": 200, "rows": [x["row"] for x in r["rows"]]}]).encode())

    pages.foreachPartition(write)


def standard(found: DataFrame) -> DataFrame:
    """symbol, ts, open, high, low, close, volume of read pages."""
    return found.select("symbol", F.timestamp_millis("open_ms").alias("ts"), *_NAMES[2:7])
