"""Packing documents into fixed windows by the online sum-of-squares rule.

Each Spark partition packs its own documents as they come, with no shuffle.  N[h] counts the
open windows filled to level h; a piece of s ids goes to the level whose change keeps the sum
of the squares of N least, which the level array gives for all levels in one numpy expression.
A document longer than a window is cut: its full windows close at once, the rest is placed.
At the end of a partition the windows still open stay as they are but for their gaps: the emptiest
ones are taken apart, from the end, to fill the fullest, and the ids of the last one are cut into
powers of two, which need no padding.  What moves is as much as the gaps hold.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import texts
from tidemark.llm.tokens import END_ID, tokenizer

WINDOW = 2048
PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class SumOfSquares:
    """Windows of one partition.  A piece is (doc_id, start, doc_tokens, ids)."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.n = np.zeros(window + 1, np.int64)
        self.open: list[list[list[tuple]]] = [[] for _ in range(window)]
        self.moved = 0  # ids that rest() took out of the windows they were placed in

    def level(self, size: int) -> int:
        """The level (0: a new window) to which a piece of this size goes.

        Moving a window from h to h + s changes the sum of squares by
        (N[h]-1)^2 - N[h]^2 + (N[h+s]+1)^2 - N[h+s]^2; level 0 and full windows don't count.
        Ties go to the fullest level.
        """
        n, w = self.n, self.window
        gain = 2 * n[size : w + 1] + 1
        gain[-1] = 0
        lose = 1 - 2 * n[: w + 1 - size]
        lose[0] = 0
        usable = n[: w + 1 - size] > 0
        usable[0] = True
        change = np.where(usable, gain + lose, np.iinfo(np.int64).max)
        return len(change) - 1 - int(np.argmin(change[::-1]))

    def place(self, piece: tuple) -> list[tuple] | None:
        """Puts a piece of at most a window into a level; the window's pieces if that fills it."""
        size = len(piece[3])
        h = self.level(size)
        if h:
            pieces = self.open[h].pop()
            self.n[h] -= 1
        else:
            pieces = []
        pieces.append(piece)
        if h + size == self.window:
            return pieces
        self.n[h + size] += 1
        self.open[h + size].append(pieces)
        return None

    def rest(self) -> Iterator[list[tuple]]:
        """The open windows, fullest first, their gaps filled from the emptiest."""
        windows = [pieces for h in range(self.window - 1, 0, -1) for pieces in self.open[h]]
        filled = [h for h in range(self.window - 1, 0, -1) for _ in self.open[h]]
        i, j = 0, len(windows) - 1
        while i < j:
            while filled[i] < self.window and i < j:
                name, start, total, ids = windows[j].pop()
                cut = max(0, len(ids) - (self.window - filled[i]))
                windows[i].append((name, start + cut, total, ids[cut:]))
                filled[i] += len(ids) - cut
                self.moved += len(ids) - cut
                if cut:
                    windows[j].append((name, start, total, ids[:cut]))
                if not windows[j]:
                    j -= 1
            if filled[i] == self.window:
                yield windows[i]
                i += 1
        if i == j:
            yield from _powers_of_two(windows[i])


def _powers_of_two(pieces: list[tuple]) -> Iterator[list[tuple]]:
    left = sum(len(p[3]) for p in pieces)
    now, room = [], 0
    for name, start, total, ids in pieces:
        while len(ids):
            if not room:
                room = 1 << (left.bit_length() - 1)
                left -= room
            take = ids[:room]
            now.append((name, start, total, take))
            ids, start, room = ids[len(take) :], start + len(take), room - len(take)
            if not room:
                yield now
                now = []


def pack_documents(docs: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are a document of the end id alone; rows that repeat a doc_id and null
    ids are documents of their own.  sequence_id holds the Spark partition above 40 bits.
    """

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        encoder, state, end, made, rows = tokenizer(vocabulary), SumOfSquares(window), np.array([end_id], np.uint16), 0, []

        def close(found: list[tuple]) -> None:
            nonlocal made
            offset = 0
            for doc_id, start, total, ids in found:
                rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, base + made, offset))
                offset += len(ids)
            made += 1

        def out() -> pd.DataFrame:
            pdf = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            pdf["doc_id"] = pdf["doc_id"].astype("Int64")
            rows.clear()
            return pdf

        for pdf in batches:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256]
                for name, ids in zip(part["doc_id"], encoder.encode_all(part["text"].tolist()), strict=True):
                    ids, name = np.concatenate([ids, end]), None if pd.isna(name) else int(name)
                    whole = len(ids) // window * window
                    for start in range(0, whole, window):
                        close([(name, start, len(ids), ids[start : start + window])])
                    if whole < len(ids) and (full := state.place((name, whole, len(ids), ids[whole:].copy()))):
                        close(full)
                yield out()
        for found in state.rest():
            close(found)
        yield out()

    return texts(docs).select("doc_id", "text").mapInPandas(pieces, PIECE_SCHEMA)
