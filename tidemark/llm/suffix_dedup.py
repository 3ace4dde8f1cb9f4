"""Removal of byte strings of MIN_BYTES that start more than once in a corpus.

One suffix array over a corpus can be neither held nor shuffled within a few times its size, so
the interval expansion works on small texts that carry all that is undecided:

1. Anchors.  Each window of MIN_BYTES bytes names its least window of K bytes (by hash, leftmost)
   as its anchor.  Equal windows have equal anchors at equal offsets.  Neighbouring windows with
   one anchor are a run; runs whose anchor occurs once hold no repeat.
2. Whole runs, then blocks of STEP windows of the runs left, whose contents are equal are
   repeats throughout; only blocks across the edge of a common passage stay undecided.
3. All windows of such a block share a core.  With the core as one symbol the windows of a block
   are the strings of STEP symbols in a text of at most 2 * STEP - 1.  For each batch of cores a
   Burrows-Wheeler transform of these texts is built, and intervals are extended backwards,
   breadth first: level l holds the suffix-array intervals of all repeated strings of l symbols,
   so that the boundaries between them come out as common prefixes of increasing length, and the
   expansion stops at STEP symbols, which is MIN_BYTES bytes.
   A core with more than LEAF_ROWS texts is split first: the lower half of the offsets of its windows
   reads at least half the symbols to its right, the upper half those to its left, so that cores
   made longer by these symbols divide the texts, and again, down to one offset.

Equal texts are one text throughout, and wholly removed.  Equality of contents within equal anchors
or cores is judged by hashes of 64 bits, and not verified against the bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import id_key, in_small_batches, stored
from tidemark.llm.texthash import prefix_sums, range_hashes, window_hashes, window_minima

MIN_BYTES = 400
STEP = 16
LEAF_ROWS = 4_096
PIECE_ROWS = 16_384
BROADCAST_IDS = 500_000
_CHUNK = (1 << 20) - 4_096
_LOW = np.uint64((1 << 20) - 1)


def text_runs(data: np.ndarray, length: int = MIN_BYTES) -> tuple[np.ndarray, ...]:
    """Anchor hash, anchor place, first and last start of every run, a chunk of 1 MB at a time."""
    k = length - length // 2 + 1
    width = length - k + 1
    found = []
    for at in range(0, max(0, len(data) - length + 1), _CHUNK):
        part = data[at : at + _CHUNK + length - 1]
        h = window_hashes(part, k)
        key = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        place = (window_minima(key, width) & _LOW).astype(np.int64)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        last = np.append(first[1:], len(place)) - 1
        found.append((h[place[first]], place[first] + at, first + at, last + at))
    if not found:
        return (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def repeated_strings(symbols: np.ndarray, length: int) -> np.ndarray:
    """bool for each place: whether the string of `length` symbols from there starts elsewhere too.

    The last symbol of every text in `symbols` must be unique; strings that hold one never repeat.
    """
    n = len(symbols)
    if n < 2:
        return np.zeros(n, bool)
    # Suffix order by doubling; unique ends make all suffixes differ within one text.
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    depth = 1
    while True:
        after = np.zeros(n, np.int64)
        after[:-depth] = rank[depth:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank = np.empty(n, np.int64)
        rank[order] = new
        depth *= 2
        if new[-1] == n - 1 or depth >= n:
            break
    suffix = order
    before = np.where(suffix > 0, symbols[suffix - 1], -1)
    last_to_first = np.where(suffix > 0, rank[suffix - 1], -1)  # where the transform's row goes
    back = np.full(n, -1, np.int64)
    back[last_to_first[suffix > 0]] = np.flatnonzero(suffix > 0)
    alive, interval = np.arange(n), np.zeros(n, np.int64)
    for _ in range(length):
        rows = np.sort(last_to_first[alive[before[alive] >= 0]])
        if not len(rows):
            return np.zeros(n, bool)
        source = back[rows]
        edge = np.ones(len(rows), bool)
        # Rows of one interval that read the same symbol land side by side: a longer interval.
        edge[1:] = (np.diff(interval[source]) != 0) | (np.diff(before[source]) != 0) | (np.diff(rows) != 1)
        which = np.cumsum(edge) - 1
        shared = np.bincount(which)[which] > 1
        interval = np.full(n, -1, np.int64)
        alive = rows[shared]
        interval[alive] = which[shared]
    out = np.zeros(n, bool)
    out[suffix[alive]] = True
    return out


def _distinct_two():
    """Whether a group holds two different places (text, anchor), copies of a text apart."""
    place = F.struct("t1", "a")
    return F.min(place) != F.max(place)


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return in_small_batches(docs).select(id_key().alias("k"), text.alias("text")).select("k", "text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"))


def _with_lists(docs: DataFrame, runs: DataFrame, firsts: DataFrame) -> DataFrame:
    """t1, t2, text and runs (the list of a text's runs), one row for each distinct text."""
    lists = runs.groupBy("t1", "t2").agg(F.collect_set(F.struct("kh", "a", "lo", "hi")).alias("runs"))  # as many as a text has
    lists = stored(lists.join(firsts.select("t1", "t2", "k"), ["t1", "t2"]))
    ids = lists.select("k", "t1", "t2")
    keyed = _keyed(docs)
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:  # 24 bytes a row; only these texts are shuffled
        keyed = keyed.join(F.broadcast(ids), ["k", "t1", "t2"], "left_semi")
    return keyed.join(lists, ["k", "t1", "t2"]).dropDuplicates(["t1", "t2"]).select("t1", "t2", "text", "runs")


def _run_rows(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    for t1, t2, text, runs in zip(*[batch.column(c).to_pylist() for c in ("t1", "t2", "text", "runs")], strict=True):
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        yield t1, t2, data, np.array([r["kh"] for r in runs], np.int64), np.array([(r["a"], r["lo"], r["hi"]) for r in runs], np.int64).reshape(-1, 3)


def repeated_ranges(docs: DataFrame, length: int = MIN_BYTES, step: int = STEP, leaf_rows: int = LEAF_ROWS) -> tuple[DataFrame, DataFrame]:
    """ranges (t1, t2, first, last start of repeated strings) and firsts (t1, t2, k, copies)."""

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], [], [], [], []]
            for t1, t2, text in zip(*[batch.column(c).to_pylist() for c in ("t1", "t2", "text")], strict=True):
                kh, a, first, last = text_runs(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), length)
                if len(kh):
                    for c, x in zip(
                        cols,
                        (np.full(len(kh), t1, np.int64), np.full(len(kh), t2, np.int64), kh.view(np.int64), a, a - last, a - first),
                        strict=True,
                    ):
                        c.append(x)
            arrays = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in cols]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()).cast(t) for x, t in zip(arrays, types, strict=True)], ["t1", "t2", "kh", "a", "lo", "hi"])

    keyed = _keyed(docs)
    firsts = stored(keyed.groupBy("t1", "t2").agg(F.min("k").alias("k"), F.count("*").alias("copies")))
    runs = stored(keyed.where(F.octet_length("text") >= length).select("t1", "t2", "text").mapInArrow(anchors, "t1 long, t2 long, kh long, a long, lo int, hi int"))
    # Written before it is joined: Spark splits a hot key only in joins right above two shuffles.
    shared = stored(runs.groupBy("kh").agg(_distinct_two().alias("two")).where("two").select("kh"))

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for t1, t2, data, kh, r in _run_rows(batch):
                outer = range_hashes(prefix_sums(data), r[:, 0] - r[:, 2], r[:, 0] - r[:, 1] + length)
                out.append(pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(kh), t1)),
                        pa.array(np.full(len(kh), t2)),
                        pa.array(kh),
                        pa.array(r[:, 0]),
                        pa.array(r[:, 1].astype(np.int32)),
                        pa.array(r[:, 2].astype(np.int32)),
                        pa.array(outer.view(np.int64)),
                    ],
                    ["t1", "t2", "kh", "a", "lo", "hi", "outer"],
                ))
            yield from out

    whole = stored(_with_lists(docs, stored(runs.join(shared, "kh")), firsts).mapInArrow(contents, "t1 long, t2 long, kh long, a long, lo int, hi int, outer long"))
    same = ["kh", "lo", "hi", "outer"]
    kinds = stored(whole.groupBy(*same).agg(_distinct_two().alias("two"), F.min(F.struct("t1", "a", "t2")).alias("one")))
    settled = whole.join(kinds.where("two").select(*same), same).select(
        "t1",
        "t2",
        (F.col("a") - F.col("hi")).alias("first"),
        (F.col("a") - F.col("lo")).alias("last"),
    )

    open_anchors = stored(kinds.groupBy("kh").agg(F.count("*").alias("kinds"), F.max(~F.col("two")).alias("open")).where("open and kinds > 1").select("kh"))
    left = stored(kinds.join(open_anchors, "kh").select("kh", "lo", "hi", "one.t1", "one.t2", "one.a", "two"))
    flags = left.select("t1", "a", "lo", "hi", "two")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t1, t2, data, kh, r in _run_rows(batch):
                sums = prefix_sums(data)
                low, high = r[:, 1] // step, r[:, 2] // step
                counts = high - low + 1
                run = np.repeat(np.arange(len(kh)), counts)
                b = low[run] + np.arange(len(run)) - np.repeat(np.cumsum(counts) - counts, counts)
                a, x, y = r[run, 0], np.maximum(r[run, 1], step * b), np.minimum(r[run, 2], step * b + step - 1)
                begin, end = a - step * b, a - step * b - step + 1 + length  # of the core
                raw = data.tobytes()
                columns = [
                    pa.array(np.full(len(run), t1)), pa.array(np.full(len(run), t2)), pa.array(kh[run]), pa.array(a),
                    pa.array(r[run, 1].astype(np.int32)), pa.array(r[run, 2].astype(np.int32)), pa.array(x.astype(np.int32)), pa.array(y.astype(np.int32)), pa.array(b.astype(np.int32)),
                    pa.array(range_hashes(sums, a - y, a - x + length).view(np.int64)), pa.array(range_hashes(sums, begin, end).view(np.int64)),
                    pa.array([raw[i:j] for i, j in zip((a - y).tolist(), begin.tolist(), strict=True)], pa.binary()),
                    pa.array([raw[i:j] for i, j in zip(end.tolist(), (a - x + length).tolist(), strict=True)], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["t1", "t2", "kh", "a", "lo", "hi", "x", "y", "b", "outer", "core", "left", "right"])

    made = _with_lists(docs, left, firsts).mapInArrow(
        blocks, "t1 long, t2 long, kh long, a long, lo int, hi int, x int, y int, b int, outer long, core long, left binary, right binary"
    )
    made = stored(made.join(flags, ["t1", "a", "lo", "hi"]).drop("lo", "hi"))
    same = ["kh", "x", "y", "outer"]
    kinds = stored(made.groupBy(*same, "b", "core").agg(F.count("*").alias("c"), F.max("two").alias("two"), F.min(F.struct("t1", "a", "t2", "left", "right")).alias("one")))
    equal = made.where("not two").join(kinds.where("c > 1").select(*same), same).select(
        "t1",
        "t2",
        (F.col("a") - F.col("y")).alias("first"),
        (F.col("a") - F.col("x")).alias("last"),
    )

    undecided = (~F.col("two")) & (F.col("c") == 1)
    cores = stored(kinds.groupBy("core").agg(F.count("*").alias("m"), F.max(undecided).alias("open")).where("open and m > 1").select("core", "m"))
    parts = kinds.join(cores, "core").select("core", "m", "x", "y", "b", undecided.alias("open"), "one.t1", "one.t2", "one.a", "one.left", "one.right")
    parts = stored(parts.withColumns({"low": F.lit(0), "high": F.lit(step - 1)}))
    range_schema = "t1 long, t2 long, first long, last long"

    def piece(pdf: pd.DataFrame) -> pd.DataFrame:
        """Repeated windows among the texts left + core + right of whole groups of cores."""
        rows = len(pdf)
        size_l, size_r = pdf["left"].map(len).to_numpy(), pdf["right"].map(len).to_numpy()
        total = size_l + size_r + 2
        start = np.cumsum(total) - total
        symbols = np.zeros(int(total.sum()), np.int64)
        core_at, end_at = start + size_l, start + total - 1
        symbols[core_at] = 256 + np.unique(pdf["core"].to_numpy(), return_inverse=True)[1]
        symbols[end_at] = 256 + rows + np.arange(rows)
        text = np.ones(len(symbols), bool)
        text[core_at] = text[end_at] = False
        symbols[text] = np.frombuffer(b"".join(x for pair in zip(pdf["left"], pdf["right"], strict=True) for x in pair), np.uint8)
        repeated = repeated_strings(symbols, step)
        x, y, b = (pdf[c].to_numpy().astype(np.int64) for c in "xyb")
        n = np.where(pdf["open"].to_numpy(), y - x + 1, 0)
        row = np.repeat(np.arange(rows), n)
        o = x[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        hit = repeated[core_at[row] - (o - step * b[row])]
        row, o = row[hit], o[hit]
        at = pdf["a"].to_numpy()[row] - o
        return pd.DataFrame({"t1": pdf["t1"].to_numpy()[row], "t2": pdf["t2"].to_numpy()[row], "first": at, "last": at})

    def expanded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            held.append(pdf)
            if sum(map(len, held)) >= PIECE_ROWS:
                both = pd.concat(held, ignore_index=True)
                rest = both["core"] == both["core"].iloc[-1]  # this core may go on in the next batch
                if not rest.all():
                    yield piece(both[~rest].reset_index(drop=True))
                    both = both[rest].reset_index(drop=True)
                held = [both]
        if held and sum(map(len, held)):
            yield piece(pd.concat(held, ignore_index=True))

    found = [settled, equal]
    while True:
        found.append(parts.where(F.col("m") <= leaf_rows).repartition("core").sortWithinPartitions("core").mapInPandas(expanded, range_schema))
        large = parts.where(F.col("m") > leaf_rows)
        if not large.limit(1).count():
            break
        # Offsets i from low to high of a core all read the last `low` bytes of left and the first
        # step - 1 - high of right.  Half of them share more, which tells the texts apart.
        halves = F.array(
            F.struct(F.col("low"), ((F.col("low") + F.col("high") - 1) / 2).cast("int").alias("high")),
            F.struct(((F.col("low") + F.col("high") + 1) / 2).cast("int").alias("low"), F.col("high")),
        )
        cut = large.where("low < high").withColumn("half", F.explode(halves)).withColumns({"low": F.col("half.low"), "high": F.col("half.high")})
        cut = cut.withColumns({"x": F.greatest("x", step * F.col("b") + F.col("low")), "y": F.least("y", step * F.col("b") + F.col("high"))}).where("x <= y")
        cut = cut.withColumn(
            "core",
            F.xxhash64("core", "low", F.expr("substring(left, length(left) - low + 1)"), F.expr(f"substring(right, 1, {step - 1} - high)")),
        )
        one = large.where("low = high and open")  # with a single offset, all texts of a core are equal
        found.append(one.select("t1", "t2", (F.col("a") - F.col("x")).alias("first"), (F.col("a") - F.col("x")).alias("last")))
        sizes = cut.groupBy("core").agg(F.count("*").alias("m"), F.max("open").alias("some")).where("some and m > 1").select("core", "m")
        parts = stored(cut.drop("half", "m").join(sizes, "core"))
    ranges = found[0]
    for more in found[1:]:
        ranges = ranges.unionByName(more)
    return ranges, firsts


def _cut(text: str, ranges: list, length: int) -> tuple[int, int, bytes]:
    raw = text.encode("utf-8", "surrogatepass")
    gone = np.zeros(len(raw) + 1, np.int32)
    for first, last in ranges:
        gone[first] += 1
        gone[last + length] -= 1
    gone = np.cumsum(gone)[:-1] > 0
    spans = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
    return int(gone.sum()), spans, np.frombuffer(raw, np.uint8)[~gone].tobytes()


def dedup_bytes(docs: DataFrame, length: int = MIN_BYTES, **options) -> DataFrame:
    """k, t1, t2, n_bytes, n_removed, n_spans, kept_sha256 and kept (null: the whole text) of each row.

    A byte goes if any string of `length` bytes over it starts anywhere else, in the same text or
    another; strings are judged on the input.  Null texts are empty; rows that share a text are
    copies of each other, whatever their ids.
    """
    ranges, firsts = repeated_ranges(docs, length, **options)
    lists = stored(ranges.groupBy("t1", "t2").agg(F.collect_set(F.struct("first", "last")).alias("ranges")).join(firsts.where("copies = 1").select("t1", "t2", "k"), ["t1", "t2"]))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [_cut(t, [(r["first"], r["last"]) for r in rs], length) for t, rs in zip(pdf["text"], pdf["ranges"], strict=True)]
            yield pd.DataFrame(
                {
                    **{c: pdf[c] for c in ("k", "t1", "t2")},
                    "removed": [f[0] for f in found],
                    "spans": [f[1] for f in found],
                    "sha": [hashlib.sha256(f[2]).hexdigest() for f in found],
                    "rest": [f[2].decode("utf-8", "ignore") for f in found],
                }
            )

    keyed = _keyed(docs)
    ids, some = lists.select("k", "t1", "t2"), keyed
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        some = keyed.join(F.broadcast(ids), ["k", "t1", "t2"], "left_semi")
    done = some.join(lists, ["k", "t1", "t2"]).mapInPandas(cut, "k long, t1 long, t2 long, removed long, spans long, sha string, rest string")
    copies = firsts.where("copies > 1").select("t1", "t2", F.lit(True).alias("copy"))
    all_rows = keyed.select("k", "t1", "t2", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole"))
    joined = all_rows.join(copies, ["t1", "t2"], "left").join(done, ["k", "t1", "t2"], "left")
    gone = F.coalesce("copy", F.lit(False)) & (F.col("n_bytes") >= length)
    return joined.select(
        "k",
        "t1",
        "t2",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("sha", "whole")).alias("kept_sha256"),
        F.when(gone, "").otherwise(F.col("rest")).alias("kept"),
    )


def without_repeats(docs: DataFrame, length: int = MIN_BYTES, **options) -> DataFrame:
    """docs with the repeated bytes cut from text, all columns kept; a character that loses some
    of its bytes loses all."""
    cut = dedup_bytes(docs, length, **options).where("n_removed > 0").select("k", "t1", "t2", "kept").dropDuplicates(["k", "t1", "t2"])
    cut = cut.select(F.col("k").alias("__k"), F.col("t1").alias("__t1"), F.col("t2").alias("__t2"), F.col("kept").alias("__kept"))
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.withColumns({"__k": id_key(), "__t1": F.xxhash64(text), "__t2": F.xxhash64(F.lit(1), text)})
    return keyed.join(cut, ["__k", "__t1", "__t2"], "left").withColumn("text", F.coalesce("__kept", "text")).select(docs.columns)
