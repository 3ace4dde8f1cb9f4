"""Phrases of two to four words that hold together, mined level by level.

A phrase of k words is counted only where both of its overlapping parts of k - 1 words are frequent
(Apriori).  Which are, every task reads from a broadcast bitmap of hashes, whose size has a bound; a
place that a wrong hash lets through is counted in vain, but counts stay exact: pass k counts hashes
of phrases of k words and, of those whose hash came up often enough in the pass before, the phrases
of k - 1 words themselves, as text.  So a phrase that is rare is never shuffled as text, and two
phrases of one hash are never taken for one.  Parts of a frequent phrase are frequent, so that the
cuts of a candidate are scored from the tables of the levels below.

Texts go through numpy in buffers of about BUFFER bytes; longer texts are cut between words, where
phrases that reach over the cut are counted by where they begin.  Null texts are empty, a null lang
is "und"; repeated rows count again; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stored
from tidemark.llm.texthash import _LOWER, mix, prefix_sums, range_hashes

MIN_COUNT, MAX_WORDS, TOP, CONTAINED_PERCENT = 30, 4, 2000, 80
BUFFER = 2 << 20
#: The bitmap has 16 bits for each phrase, from 2**MIN_BITS to 2**MAX_BITS bits (32 MB).
MIN_BITS, MAX_BITS, BLOCK_BITS = 16, 28, 16

_WORD, _SPACE, _BREAK = 0, 1, 2
_KINDS = np.zeros(256, np.uint8)
_KINDS[[0x20, 0x09]] = _SPACE
_KINDS[[ord(c) for c in ".,;:!?\n\v\f\r"]] = _BREAK
_FACTORS = mix(np.arange(101, 101 + MAX_WORDS, dtype=np.uint64)) | np.uint64(1)
COUNTS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("h", pa.int64()), ("c", pa.int64())])


class Words:
    """The words of a buffer: exact ids, hashes, and the piece each lies in."""

    def __init__(self, data: np.ndarray, own: int) -> None:
        data = _LOWER[data]
        kinds = _KINDS[data]
        inside = kinds == _WORD
        edge = np.diff(inside.view(np.int8), prepend=0, append=0)
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.piece = np.cumsum(kinds == _BREAK, dtype=np.int32)[begin] if len(begin) else np.zeros(0, np.int32)
        self.own = int(np.searchsorted(begin, own))  # words that begin in the lookahead count elsewhere
        offsets = np.zeros(len(begin) + 1, np.int32)
        np.cumsum(end - begin, out=offsets[1:])
        packed = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
        coded = packed.dictionary_encode()
        self.texts, self.ids = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        ends = np.frombuffer(self.texts.buffers()[1], np.int32, len(self.texts) + 1)
        raw = np.frombuffer(self.texts.buffers()[2] or b"", np.uint8, int(ends[-1]))
        self.hashes = range_hashes(prefix_sums(raw), ends[:-1], ends[1:])[self.ids]

    def places(self, k: int) -> np.ndarray:
        """Whether the k words from here on lie in one piece."""
        n = max(0, len(self.ids) - k + 1)
        return self.piece[:n] == self.piece[k - 1 : k - 1 + n]

    def gram_hashes(self, k: int, seed: np.uint64) -> np.ndarray:
        n = max(0, len(self.ids) - k + 1)
        total = np.full(n, seed + np.uint64(k), np.uint64)
        for i in range(k):
            total += self.hashes[i : i + n] * _FACTORS[i]
        return mix(total)

    def counted(self, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """One place of each different phrase of k words that begins at one of `at`, and its count."""
        code = self.ids[at]
        for i in range(1, k):
            if i > 1:
                code = np.unique(code, return_inverse=True)[1]
            code = code * len(self.texts) + self.ids[at + i]
        _, first, count = np.unique(code, return_index=True, return_counts=True)
        return at[first], count

    def phrases(self, at: np.ndarray, k: int) -> pa.Array:
        parts = [self.texts.take(pa.array(self.ids[at + i])) for i in range(k)]
        return parts[0].cast(pa.string()) if k == 1 else pa.compute.binary_join_element_wise(*parts, pa.scalar(b" ", pa.binary())).cast(pa.string())


def cuts(data: np.ndarray, size: int = BUFFER) -> Iterator[tuple[int, int, int]]:
    """begin, end, own of parts of a text: words that begin before own are the part's; up to end
    follow the MAX_WORDS - 1 words that their phrases may need."""

    def word_end(at: int) -> int:
        for wanted in (True, False):  # over separators, then over a word
            while at < len(data):
                found = np.flatnonzero((_KINDS[data[at : at + 4096]] == _WORD) == wanted)
                if len(found):
                    at += int(found[0])
                    break
                at = min(len(data), at + 4096)
        return at

    at = 0
    while at < len(data):
        own = word_end(at + size) if at + size < len(data) else len(data)
        end = own
        for _ in range(MAX_WORDS - 1):
            end = word_end(end)
        yield at, end, own - at
        at = own


def buffers(batches: Iterator[pa.RecordBatch], size: int = BUFFER) -> Iterator[tuple[str, Words]]:
    """lang and words of buffers of texts, whose pieces never meet."""
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}

    def flushed(lang: str) -> tuple[str, Words]:
        data = b"\n".join(held.pop(lang))
        return lang, Words(np.frombuffer(data, np.uint8), sizes.pop(lang) and len(data))

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            raw = text.as_buffer()
            if len(raw) > size:
                data = np.frombuffer(raw, np.uint8)
                for begin, end, own in cuts(data, size):
                    yield lang, Words(data[begin:end], own)
            elif len(raw):
                held.setdefault(lang, []).append(raw.to_pybytes())
                sizes[lang] = sizes.get(lang, 0) + len(raw)
                if sizes[lang] > size:
                    yield flushed(lang)
        while sum(sizes.values()) > 4 * size:  # many languages
            yield flushed(max(sizes, key=sizes.get))
    for lang in list(held):
        yield flushed(lang)


def seed(lang: str) -> np.uint64:
    data = np.frombuffer(lang.encode(), np.uint8)
    return range_hashes(prefix_sums(data), np.array([0]), np.array([len(data)]))[0]


def member(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes >> np.uint64(64 - (len(bits) * 8).bit_length() + 1)
    return (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _pass(k: int, frequent, size: int) -> Callable:
    """Pass k over texts: phrases of k - 1 words as text where `frequent` has their hash, hashes of
    phrases of k words where it has those of both parts.  In pass 1: words as text, and how many
    words there are, as the phrase ""."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, w in buffers(batches, size):
            s = seed(lang)
            if k == 1:
                at, count = w.counted(np.arange(w.own), 1)
                texts, h = w.phrases(at, 1), w.gram_hashes(1, s)[at]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * (len(at) + 1), pa.string()),
                        pa.concat_arrays([texts, pa.array([""])]),
                        pa.array(np.append(h.view(np.int64), 0)),
                        pa.array(np.append(count, w.own)),
                    ],
                    schema=COUNTS,
                )
                continue
            below = w.gram_hashes(k - 1, s)
            good = w.places(k - 1) & member(frequent.value, below)
            own = np.arange(len(good)) < w.own
            if k > 2:  # words are counted already
                at, count = w.counted(np.flatnonzero(good & own), k - 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(at), pa.string()), w.phrases(at, k - 1), pa.array(below[at].view(np.int64)), pa.array(count)],
                    schema=COUNTS,
                )
            if k <= MAX_WORDS and len(good):
                both = good[:-1] & good[1:] & w.places(k) & own[:-1]
                h, count = np.unique(w.gram_hashes(k, s)[both], return_counts=True)
                empty = pa.nulls(len(h), pa.string())
                yield pa.RecordBatch.from_arrays([empty, empty, pa.array(h.view(np.int64)), pa.array(count)], schema=COUNTS)

    return run


def bitmap(hashes: DataFrame) -> np.ndarray:
    """A bitmap of the top bits of h, built by blocks in tasks; 32 MB at most reach the driver."""
    rows = hashes.count()
    bits = min(MAX_BITS, max(MIN_BITS, (16 * rows).bit_length()))

    def block(rows: pd.DataFrame) -> pd.DataFrame:
        found = np.zeros(1 << BLOCK_BITS, np.uint8)
        found[rows["slot"].to_numpy() & ((1 << BLOCK_BITS) - 1)] = 1
        return pd.DataFrame({"block": rows["block"].iloc[:1], "bits": [np.packbits(found, bitorder="little").tobytes()]})

    slots = hashes.select(F.expr(f"shiftrightunsigned(h, {64 - bits})").alias("slot")).distinct()
    blocks = slots.withColumn("block", F.expr(f"slot div {1 << BLOCK_BITS}")).groupBy("block").applyInPandas(block, "block long, bits binary")
    out = np.zeros((1 << bits) // 8, np.uint8)
    width = (1 << BLOCK_BITS) // 8
    for r in blocks.toLocalIterator():
        out[r["block"] * width : (r["block"] + 1) * width] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def levels(docs: DataFrame, min_count: int = MIN_COUNT, buffer: int = BUFFER) -> tuple[DataFrame, DataFrame]:
    """Frequent phrases (lang, k, phrase, f) of one to MAX_WORDS words, and words by lang (lang, n)."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    context, found, frequent = docs.sparkSession.sparkContext, [], None
    for k in range(1, MAX_WORDS + 2):
        counted = texts.mapInArrow(_pass(k, frequent, buffer), "lang string, phrase string, h long, c long")
        summed = counted.groupBy("lang", "phrase", "h").agg(F.sum("c").alias("f"))
        summed = stored(summed.where((F.col("f") >= min_count) | (F.col("phrase") == "")))
        if k == 1:
            totals = summed.where("phrase = ''").select("lang", F.col("f").alias("n"))
            found.append(summed.where("phrase != ''").select("lang", F.lit(1).alias("k"), "phrase", "f"))
            hashes = summed.where("phrase != ''")
        else:
            if k > 2:
                found.append(summed.where("phrase is not null").select("lang", F.lit(k - 1).alias("k"), "phrase", "f"))
            hashes = summed.where("phrase is null")
        if frequent is not None:
            frequent.unpersist()
        if k <= MAX_WORDS:
            frequent = context.broadcast(bitmap(hashes.select("h")))
    phrases = found[0]
    for more in found[1:]:
        phrases = phrases.unionByName(more)
    return phrases, totals


def scored(phrases: DataFrame) -> DataFrame:
    """lang, phrase, k, a, l, r, score of every phrase of two words or more, by its weakest cut."""
    ws = F.split("phrase", " ", -1)
    cut = (
        phrases.where("k > 1")
        .select("lang", "phrase", "k", F.col("f").alias("a"), ws.alias("ws"))
        .withColumn("at", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
        .select(
            "lang",
            "phrase",
            "k",
            "a",
            "at",
            F.expr("array_join(slice(ws, 1, at), ' ')").alias("head"),
            F.expr("array_join(slice(ws, at + 1, k - at), ' ')").alias("rest"),
        )
    )
    heads = phrases.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    rests = phrases.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    exact = "cast(a as decimal(20, 0)) * 2000000 div (cast(l as decimal(20, 0)) + r)"
    return (
        cut.join(heads, ["lang", "head"])
        .join(rests, ["lang", "rest"])
        .groupBy("lang", "phrase", "k", "a")
        .agg(F.min(F.struct(F.expr(exact).alias("score"), "at", "l", "r")).alias("weakest"))
        .select("lang", "phrase", "k", "a", "weakest.l", "weakest.r", "weakest.score")
    )


def outer(phrases: DataFrame) -> DataFrame:
    """lang, phrase, f: the most frequent longer phrase around each phrase within one."""
    ws = phrases.where("k > 2").select("lang", "k", "f", F.split("phrase", " ", -1).alias("ws"))
    inner = "flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), i -> array_join(slice(ws, i, m), ' '))))"
    return ws.select("lang", "f", F.explode(F.expr(inner)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("f"))


def first_of(df: DataFrame, by: str, order: list, n: int) -> DataFrame:
    """The first n rows of each `by` with their rank; large ones are cut down in shares first."""
    shares = max(1, df.count() // (16 * n))
    share = Window.partitionBy(by, "share").orderBy(*order)
    few = df.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(shares))).withColumn("rank", F.row_number().over(share)).where(F.col("rank") <= n)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= n).drop("share")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, buffer: int = BUFFER) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of each lang.

    A phrase within a longer one that has CONTAINED_PERCENT of its count goes, kept or not the
    longer one.  score is floor(2000000 a / (l + r)) at the cut where that is least.
    """
    phrases, totals = levels(docs, min_count, buffer)
    around = outer(phrases).select("lang", "phrase", F.col("f").alias("longer"))
    kept = (
        scored(phrases)
        .join(around, ["lang", "phrase"], "left")
        .where(F.expr(f"longer is null or cast(longer as decimal(20, 0)) * 100 < cast(a as decimal(20, 0)) * {CONTAINED_PERCENT}"))
    )
    ranked = first_of(stored(kept), "lang", [F.desc("score"), F.desc("a"), "phrase"], top)
    return ranked.join(F.broadcast(totals), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
