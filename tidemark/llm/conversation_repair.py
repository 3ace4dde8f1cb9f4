"""Repair of the turn structure of conversations by cheapest edits.

A conversation becomes a string of symbols, one a row: the initial of its role and whether its text
is cut off, or that it must go.  The edits (keep, rerole, delete, insert) composed with the
automaton of wanted roles give a weighted automaton of four states.  It is determinised as it is
read: the least costs from each of its states to the end, less the least of them, are one state of
the deterministic automaton, which a table caches, so that reading a row is one look-up.  Rows are
read from the last to the first; the trace then runs back against that order, from the first row
on, along arcs whose cost is tight, and takes the least letter wherever several are.

Rows are split over tasks by conversation, because its audit and its hash are one value each; a
task reads them sorted and in batches and holds one symbol a row, never the texts.  Rows that
repeat within a turn are counted before that, and the first of equal texts is found by a grouped
minimum.

Null roles and texts are one blank.  Rows go by turn, null turns first; rows of one turn by role and
then by a hash of the text.  A null conv_id is a conversation of its own.  Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACES, stored

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Wanted roles, (s?(ua)+)?: from a state by an initial to a state; 0 and 3 accept.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: What is inserted in a state; never "s".
NEXT = ("u", "u", "a", "u")
NAMES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
GONE = ("", False, True)  # the symbol of a row that must go


class Automaton:
    """The deterministic automaton, as far as it has been needed.  A state is a tuple of four costs."""

    def __init__(self) -> None:
        end = (0, 2 * INSERT, INSERT, 0)
        self.states, self.ids = [end], {end: 0}
        self.arcs: dict = {}
        self.moves: dict = {}

    def _costs(self, after: tuple, symbol: tuple) -> list[int]:
        """Costs before a row of this symbol, from those after it."""
        initial, cut, gone = symbol
        costs = []
        for q in range(4):
            best = DELETE + after[q]
            if not gone:
                more = TRUNCATED if cut else 0
                if (q, initial) in STEPS:
                    best = min(best, KEEP + more + after[STEPS[q, initial]])
                best = min(best, REROLE + more + after[STEPS[q, NEXT[q]]])
            costs.append(best)
        for _ in range(2):
            costs = [min(costs[q], INSERT + costs[STEPS[q, NEXT[q]]]) for q in range(4)]
        return costs

    def arc(self, state: int, symbol: tuple) -> tuple[int, int]:
        """The state before a row of this symbol, and the cost that normalising took off."""
        if (state, symbol) not in self.arcs:
            costs = self._costs(self.states[state], symbol)
            least = min(costs)
            vector = tuple(c - least for c in costs)
            if vector not in self.ids:
                self.ids[vector] = len(self.states)
                self.states.append(vector)
            self.arcs[state, symbol] = self.ids[vector], least
        return self.arcs[state, symbol]

    def move(self, state: int, symbol: tuple, q: int) -> tuple[str, int]:
        """Letters of the least tight edits at a row, from q before it to the state after it."""
        if (state, symbol, q) not in self.moves:
            after, costs = self.states[state], self._costs(self.states[state], symbol)
            initial, cut, gone = symbol
            letters, at, more = "", q, TRUNCATED if cut else 0
            while True:
                to = STEPS[at, NEXT[at]]
                if costs[at] == DELETE + after[at]:
                    letters += "D"
                elif costs[at] == INSERT + costs[to]:
                    letters, at = letters + "I", to
                    continue
                elif not gone and (at, initial) in STEPS and costs[at] == KEEP + more + after[STEPS[at, initial]]:
                    letters, at = letters + "K", STEPS[at, initial]
                else:
                    letters, at = letters + "R", to
                break
            self.moves[state, symbol, q] = letters, at
        return self.moves[state, symbol, q]

    def repair(self, symbols: list[tuple]) -> tuple[int, str]:
        """Cost and letters of the cheapest edits of a string of symbols."""
        state, total, path = 0, 0, []
        for symbol in reversed(symbols):
            path.append(state)
            state, least = self.arc(state, symbol)
            total += least
        cost, q, letters = total + self.states[state][0], 0, []
        for symbol in symbols:
            more, q = self.move(path.pop(), symbol, q)
            letters.append(more)
        letters.append("I" * (self.states[0][q] // INSERT))
        return cost, "".join(letters)


def filled(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damage(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) with times: how often a row is left after the damage."""
    how = F.pmod(F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn"))), F.lit(20))
    r = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        filled("role").alias("role"),
        filled("text").alias("text"),
        how.alias("how"),
    )
    return r.select(
        "conv_id",
        "turn",
        F.when(F.col("how") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.expr("case how when 0 then 0 when 3 then 2 else 1 end").cast("long").alias("times"),
    )


def _keyed(rows: DataFrame) -> DataFrame:
    """rows with the columns none, conv (for conv_id), some, at (for turn) and h (for the text)."""
    return rows.select(
        F.col("conv_id").isNull().alias("none"),
        F.coalesce("conv_id", F.lit(0)).alias("conv"),
        F.col("turn").isNotNull().alias("some"),
        F.coalesce("turn", F.lit(0)).alias("at"),
        filled("role").alias("role"),
        F.unhex(F.sha2(filled("text"), 256)).alias("h"),
        filled("text").alias("text"),
        "times",
    )


CONV, ORDER = ["none", "conv"], ["none", "conv", "some", "at", "role", "h"]
SUMMARY = "none boolean, conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SUMMARY of sorted rows (ORDER, times, blank, cut, first)."""
    machine, names = Automaton(), [f.split()[0] for f in SUMMARY.split(", ")]
    kinds = pa.schema([(n, {"none": pa.bool_(), "audit": pa.string()}.get(n, pa.int64())) for n in names])
    key, found = None, []

    def closed() -> None:
        cost, audit = machine.repair(symbols)
        found.append((*key, span + 1 - n_turns if n_turns else 0, *counts, illegal, cost, audit))

    packed = lambda: pa.RecordBatch.from_pydict({n: [r[i] for r in found] for i, n in enumerate(names)}, kinds)
    for batch in batches:
        for none, conv, some, at, role, times, blank, cut, first in zip(
            *(batch.column(c).to_pylist() for c in ("none", "conv", "some", "at", "role", "times", "blank", "cut", "first"))
        ):
            if (none, conv) != key:
                if key is not None:
                    closed()
                key, symbols, counts = (none, conv), [], [0, 0, 0]
                start, span, n_turns, illegal, last = 0, 0, 0, 0, None
            if not times:
                continue
            if some:
                if not n_turns:
                    start, n_turns = at, 1
                elif at != start + span:
                    span, n_turns = at - start, n_turns + 1
            initial = role[:1]
            illegal += times - 1 + (last is not None and last + initial not in LEGAL)
            last = initial
            if blank:
                counts[0] += times
                symbols += [GONE] * times
            else:
                counts[1] += times - first
                if first:
                    counts[2] += cut
                    symbols.append((initial if initial in ("s", "u", "a") else "", cut, False))
                symbols += [GONE] * (times - first)
        if len(found) > 1000:
            yield packed()
            found.clear()
    if key is not None:
        closed()
    yield packed()


def repairs(rows: DataFrame) -> DataFrame:
    """SUMMARY of each conversation of rows (conv_id, turn, role, text, times).

    gaps: turns missing between the first and the last.  blank, duplicate, truncated: rows by their
    first fault.  illegal: neighbours whose initials may not follow.  cost and audit: of the
    cheapest edits, least in ASCII.  Conversations that have no row left: zeros and "".
    """
    trimmed = F.rtrim("text", F.lit(SPACES))
    keys = (
        _keyed(rows)
        .withColumn("blank", trimmed == "")
        .withColumn("cut", ~F.right(trimmed, F.lit(1)).isin(".", "!", "?"))
        .groupBy(*ORDER, "blank", "cut")
        .agg(F.sum("times").alias("times"))
    )
    keys = stored(keys)
    firsts = keys.where("times > 0").groupBy(*CONV, "role", "h").agg(F.min(F.struct("some", "at")).alias("least"))
    marked = keys.join(firsts, [*CONV, "role", "h"], "left").select(
        *ORDER, "times", "blank", "cut", F.coalesce(F.struct("some", "at") == F.col("least"), F.lit(False)).alias("first")
    )
    return marked.repartition(*CONV).sortWithinPartitions(*ORDER).mapInArrow(_summaries, SUMMARY)


def _edited(letters: str, roles_and_texts: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """The repaired rows of a conversation, from its audit and its rows in order."""
    q, at = 0, 0

    def inserted() -> Iterator[tuple[str, str]]:
        nonlocal q, at
        while at < len(letters) and letters[at] == "I":
            yield NAMES[NEXT[q]], ""
            q, at = STEPS[q, NEXT[q]], at + 1

    for role, text in roles_and_texts:
        yield from inserted()
        letter, at = letters[at], at + 1
        if letter == "K":
            q = STEPS[q, role[:1]]
            yield role, text
        elif letter == "R":
            yield NAMES[NEXT[q]], text
            q = STEPS[q, NEXT[q]]
    yield from inserted()


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Iterator[tuple[str, str]]]]:
    """Each summary row with its repaired rows; those must be used up before the next."""

    def flat() -> Iterator[dict]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                yield from batch.slice(i, 256).to_pylist()

    rows, head = flat(), None
    head = next(rows, None)
    while head is not None:
        summary, head = head, None

        def own() -> Iterator[tuple[str, str]]:
            nonlocal head
            for r in rows:
                if r["audit"] is not None:
                    head = r
                    return
                for _ in range(r["times"]):
                    yield r["role"], r["text"]

        yield summary, _edited(summary["audit"], own())


DIGEST = SUMMARY + ", repaired_sha256 string"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, names = [], [f.split()[0] for f in DIGEST.split(", ")]
    for summary, repaired in _conversations(batches):
        digest, begun = hashlib.sha256(), False
        for role, text in repaired:
            digest.update(f"{chr(10) if begun else ''}{role}:{text}".encode())
            begun = True
        out.append({n: summary[n] for n in names[:-1]} | {names[-1]: digest.hexdigest()})
        if len(out) > 1000:
            yield pa.RecordBatch.from_pylist(out)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out)


REPAIRED = "none boolean, conv long, position long, role string, text string"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, size = [], 0
    for summary, repaired in _conversations(batches):
        for i, (role, text) in enumerate(repaired):
            out.append({"none": summary["none"], "conv": summary["conv"], "position": i, "role": role, "text": text})
            size += len(text)
            if size > 1 << 22 or len(out) > 10_000:
                yield pa.RecordBatch.from_pylist(out)
                out, size = [], 0
    if out:
        yield pa.RecordBatch.from_pylist(out)


def _streamed(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Each summary and, behind it, the rows of its conversation in order."""
    texts = _keyed(rows).where("times > 0").withColumn("line", F.lit(1))
    heads = found.withColumn("line", F.lit(0))
    both = heads.unionByName(texts, allowMissingColumns=True)
    return both.repartition(*CONV).sortWithinPartitions(*CONV, "line", *ORDER[2:]).drop("h", "some", "at")


def _named(df: DataFrame) -> DataFrame:
    return df.select(F.expr("if(none, null, conv)").alias("conv_id"), *[c for c in df.columns if c not in CONV])


def digests(rows: DataFrame) -> DataFrame:
    """conv_id, what repairs() finds, and repaired_sha256 of the repaired rows ("role:text", by lines)."""
    found = stored(repairs(rows))
    return _named(_streamed(rows, found).mapInArrow(_digests, DIGEST))


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id, position, role, text: the conversations after their cheapest edits."""
    return _named(_streamed(rows, stored(repairs(rows))).mapInArrow(_rows, REPAIRED))
