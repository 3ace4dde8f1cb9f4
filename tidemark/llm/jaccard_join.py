"""Exact Jaccard self-join over word shingles as a metric-space join with pivots.

Jaccard distance is a metric, so pivots and the triangle inequality bound what a region can miss.

1. Shingles as pivots.  Documents of a corpus are nearly all at distance 1 from each other, where
   document pivots tell nothing apart; a set of one shingle is nearer to just the documents that
   hold it.  The home of a document is its first shingle in a fixed order (the nearest pivot, ties
   by the order).  A document within distance 1 - SIMILARITY can lack so many of its shingles
   only, so replicating each document to that many further shingles (its window) puts every
   linked pair into a common region.  The order puts frequent shingles last, as told by a sketch
   over all shingles of all texts: the order only steers cost, any fixed order is exact.
2. Documents as pivots.  The least member of a region is its pivot, and regions with one pivot are
   one group: copies and near copies share nearly all their regions, which so become one.
3. A group of over LEAF members gets CELLS pivots.  Each member is assigned to the nearest one by
   exact distance (its Voronoi cell) and replicated to those that are at most twice the threshold
   farther off, so that it meets everything it can be linked with in that one's home cell.  Members
   that the pivots link are one component, and a cell of one component is done.  Cells join in the
   same way again.  Where the cells don't separate (all members near each other), further pivots
   are tried while they at least halve the members outside the commonest component; what then is
   left is compared with the group in blocks of LEAF members.
4. In groups of LEAF members at most, counts of shingles by BUCKETS classes bound distances from
   below: sets that differ by at least L shingles in these counts are at distance 2 L / (both
   sizes + L) or more.  Only members with an open pair have their whole sets compared, none that the
   links so far join, and each pair in the first of its groups.

What comes out of a group is at most one link fewer than it has members.  Copies of one set are one
member throughout.  A member is a distinct set, named by the least row number u of the rows that
hold it, and not a doc_id: rows that repeat a doc_id or have none may hold different sets.  Only
finished components are given the least doc_id of their rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import NULL_ID, id_key, stored, text_key, texts
from tidemark.llm.components import components
from tidemark.llm.texthash import shingles, text_words

WORDS = 5
PERCENT = 80
SKETCH_BITS = 22
CHUNKS = 256
FREQUENT = 16
LEAF = 1_024
SET_SHINGLES = 1 << 22
CELLS = 8
#: Rows of keys that are sent round as they are; more are told by bits, in rows of 64 words (0.6 kB).
BROADCAST_IDS = 50_000
FILTER_BITS = 1 << 25
BROADCAST_BITS = 1 << 14
BUCKETS = 256
PIVOT, OUTSIDE, INSIDE, BOTH = range(4)


def _sets(batch: pa.RecordBatch, words: int) -> Iterator[tuple[int, np.ndarray]]:
    for i, text in enumerate(batch.column("text").to_pylist()):
        yield i, shingles(text_words(text.encode("utf-8", "surrogatepass")), words)


def frequent_bits(docs: DataFrame, words: int = WORDS, bits: int = SKETCH_BITS) -> np.ndarray:
    """A bitmap of 2**bits places, set where the shingles of all texts fall unusually often.

    Counters are summed by chunk of places in the cluster; the bitmap (512 kB) is all that
    comes to the driver, at any input size.
    """
    size = 1 << bits
    width = size // CHUNKS

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(size, np.uint32), 0
        for batch in batches:
            for _, s in _sets(batch, words):
                if len(s):
                    total[(s & np.uint64(size - 1)).astype(np.int64)] += 1  # a clash within one set counts once
                    seen += 1
        if seen:
            short = np.minimum(total, 65535).astype(np.uint16).reshape(CHUNKS, width)
            rows = [zlib.compress(c.tobytes(), 1) for c in short]
            yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array(rows, pa.binary())], ["chunk", "counts"])

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for pdf in batches:
            for chunk, counts in zip(pdf["chunk"], pdf["counts"], strict=True):
                new = np.frombuffer(zlib.decompress(counts), np.uint16).astype(np.int64)
                total[chunk] = total[chunk] + new if chunk in total else new
        rows = []
        for chunk, c in total.items():
            mean = c.mean()
            rows.append((chunk, np.packbits(c > mean + 6 * np.sqrt(mean) + FREQUENT).tobytes()))
        yield pd.DataFrame(rows, columns=["chunk", "bits"])

    counts = texts(docs).select("text").mapInArrow(counted, "chunk int, counts binary")
    got = counts.repartition("chunk").mapInPandas(summed, "chunk int, bits binary").collect()  # CHUNKS rows
    out = np.zeros((CHUNKS, width), bool)
    for r in got:
        out[r["chunk"]] = np.unpackbits(np.frombuffer(r["bits"], np.uint8))[:width].astype(bool)
    return out.reshape(-1)


def signatures(docs: DataFrame, frequent: np.ndarray, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, k, t (hash of the text), u (a number of the row), n (set size), fp (128 bits of the set; null if empty), counts
    (shingles by class, a byte each), window (shingles of its regions, as signed longs); written, so
    that u stays."""
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(frequent))
    size = len(frequent)

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            n, fps, counts, offsets, values = [], [], [], [0], []
            for _, s in _sets(batch, words):
                n.append(len(s))
                counts.append(np.minimum(np.bincount((s >> np.uint64(40)).astype(np.int64) % BUCKETS, minlength=BUCKETS), 255).astype(np.uint8).tobytes())
                fps.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                if len(s):
                    hot = often[(s & np.uint64(size - 1)).astype(np.int64)]
                    take = len(s) - -(-percent * len(s) // 100) + 1
                    ordered = np.concatenate([s[~hot], s[hot]]) if hot.any() else s
                    values.append(ordered[:take].view(np.int64))
                offsets.append(offsets[-1] + (len(values[-1]) if len(s) else 0))
            flat = pa.array(np.concatenate(values) if values else np.zeros(0, np.int64), pa.int64())
            window = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)
            columns = [
                batch.column("doc_id"),
                batch.column("k"),
                batch.column("t"),
                pa.array(n, pa.int32()),
                pa.array(fps, pa.binary()),
                pa.array(counts, pa.binary()),
                window,
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "k", "t", "n", "fp", "counts", "window"])

    keyed = texts(docs).select("doc_id", id_key().alias("k"), text_key().alias("t"), "text")
    made = keyed.mapInArrow(signed, "doc_id long, k long, t long, n int, fp binary, counts binary, window array<bigint>")
    return stored(made.withColumn("u", F.monotonically_increasing_id()))


def _bits(places: DataFrame) -> DataFrame:
    """__g, __words: bits set at places(p), 4,096 neighbours a row; written, as it is sent round often."""
    word = F.shiftright("p", 6)
    bit = F.expr("shiftleft(1L, cast(p & 63 AS int))")
    words = places.groupBy(word.alias("w")).agg(F.bit_or(bit).alias("bits"))
    held = words.groupBy(F.shiftright("w", 6).alias("__g")).agg(F.map_from_entries(F.collect_list(F.struct(F.expr("cast(w & 63 AS int)"), "bits"))).alias("m"))
    return stored(held.select("__g", F.expr("transform(sequence(0, 63), i -> coalesce(m[i], 0L))").alias("__words")))


def _by_bits(rows: DataFrame, bits: DataFrame, place: str, how: str) -> DataFrame:
    """The rows whose place, an expression, is set in bits (how: left_semi) or is not (left_anti)."""
    is_set = F.expr(f"__g = shiftright({place}, 12) AND getbit(get(__words, cast(shiftright({place}, 6) & 63 AS int)), cast({place} & 63 AS int)) = 1")
    return rows.join(F.broadcast(bits), is_set, how)


def _place(*keys: str) -> str:
    return f"pmod(xxhash64({', '.join(keys)}), {FILTER_BITS}L)"


def _key_bits(keyed: DataFrame, *keys: str) -> DataFrame:
    """Bits by hash of keys, 4.6 MB of them at most at any input size: what they leave out has none of
    the keys, the rest has yet to be joined."""
    return _bits(keyed.select(F.expr(_place(*keys)).alias("p")))


def _without_copies(sig: DataFrame, copies: DataFrame) -> DataFrame:
    """sig without the rows of copies(u), which are told by one bit of each row."""
    bits = _bits(copies.select(F.col("u").alias("p")))
    if bits.limit(BROADCAST_BITS + 1).count() <= BROADCAST_BITS:
        return _by_bits(sig, bits, "u", "left_anti")
    return stored(sig.join(copies, "u", "left_anti"))


def _whole_sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """u, s (sorted shingles) for ids(u, k, t), from every document of that k and t."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.view(np.int64) for _, s in _sets(batch, words)]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
            flat = pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("u"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)], ["u", "s"])

    keyed = texts(docs).select(id_key().alias("k"), text_key().alias("t"), "text")
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:  # 24 bytes a row, some 110 once hashed
        asked = keyed.join(F.broadcast(ids), ["k", "t"])
    else:  # no text is shuffled but those asked for and the few that share a bit with them
        asked = _by_bits(keyed, _key_bits(ids, "k", "t"), _place("k", "t"), "left_semi").join(ids, ["k", "t"])
    return asked.select("u", "text").mapInArrow(made, "u long, s array<bigint>")


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of one key at a time, of batches sorted by it."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        table = pa.Table.from_batches([batch])
        for i, (begin, end) in enumerate(zip(edges, edges[1:], strict=False)):
            if held and (i or held[0].column(key)[0].as_py() != keys[0]):
                yield pa.concat_tables(held).combine_chunks()
                held = []
            held.append(table.slice(begin, end - begin))
    if held:
        yield pa.concat_tables(held).combine_chunks()


def _arrays(rows: pa.Table) -> list[np.ndarray]:
    column = rows.column("s").combine_chunks()
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).view(np.uint64)
    return [values[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int(np.count_nonzero(y[at] == x)) if len(y) else 0


class _Open:
    """The pairs of a group that sizes and counts by class leave open, a row at a time."""

    def __init__(self, rows: pa.Table, percent: int):
        self.percent = percent
        self.n = rows.column("n").to_numpy().astype(np.int64)
        self.label = rows.column("label").to_numpy()
        self.role = rows.column("role").to_numpy()
        self.counts = np.frombuffer(b"".join(rows.column("counts").to_pylist()), np.uint8).reshape(-1, BUCKETS)
        self.against = np.flatnonzero(self.role != OUTSIDE)
        self.group, self.cells = rows.column("g")[0].as_py(), rows.column("cells").to_pylist()

    def __iter__(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        n, c, against = self.n, self.counts, self.against
        for i in np.flatnonzero(self.role != INSIDE):
            js = against[against > i] if self.role[i] == BOTH else against
            js = js[(self.label[js] != self.label[i]) & (100 * np.minimum(n[js], n[i]) >= self.percent * np.maximum(n[js], n[i]))]
            if not len(js):
                continue
            apart = (np.maximum(c[js], c[i]) - np.minimum(c[js], c[i])).sum(axis=1, dtype=np.int64)
            both = n[js] + n[i]
            left = 100 * (both - apart) >= self.percent * (both + apart)
            js, apart = js[left], apart[left]
            if len(js) and self.cells[i] and self.cells[i][0] < self.group:
                first = [self._first_met_here(i, j) for j in js.tolist()]
                js, apart = js[first], apart[first]
            if len(js):
                yield i, js, apart

    def _first_met_here(self, i: int, j: int) -> bool:
        """Whether no group of a lesser key holds both: each pair is judged in one of its groups."""
        mine = {c for c in self.cells[i] if c < self.group}
        return mine.isdisjoint(self.cells[j])


def _root(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _with_open_pairs(percent: int):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, "g"):
            some = np.zeros(rows.num_rows, bool)
            for i, js, _ in _Open(rows, percent):
                some[i] = True
                some[js] = True
            if some.any():
                yield from rows.filter(pa.array(some)).to_batches()

    return found


def _spanning_links(percent: int):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, "g"):
            sets, u = _arrays(rows), rows.column("u").to_numpy()
            pairs = _Open(rows, percent)
            _, at = np.unique(pairs.label, return_inverse=True)
            at, parent = at.tolist(), list(range(len(at)))
            a, b = [], []
            for i, js, apart in pairs:
                for j in js[np.argsort(apart, kind="stable")].tolist():
                    mine, other = _root(parent, at[i]), _root(parent, at[j])
                    if mine == other:
                        continue
                    common = _common(sets[i], sets[j])
                    if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                        parent[mine] = other
                        a.append(u[i])
                        b.append(u[j])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return found


def _distances(percent: int):
    """For the members of a block (after its pivots): whole-set distances to each pivot, linked
    where that joins what was not joined within the block."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, "g"):
            sets, role, u = _arrays(rows), rows.column("role").to_numpy(), rows.column("u").to_numpy()
            pivots = np.flatnonzero(role == PIVOT)
            parent = list(range(rows.num_rows))
            out: dict[str, list] = {name: [] for name in ("cell", "u", "n", "to")}
            for i in np.flatnonzero(role != PIVOT).tolist():
                to = []
                for j in pivots.tolist():
                    common = _common(sets[i], sets[j])
                    union = len(sets[i]) + len(sets[j]) - common
                    new = 100 * common >= percent * union and u[i] != u[j] and (x := _root(parent, i)) != (y := _root(parent, j))
                    if new:
                        parent[x] = y
                    to.append({"q": int(u[j]), "d": 1 - common / union, "linked": new})
                for name, value in (("cell", rows.column("cell")[i].as_py()), ("u", int(u[i])), ("n", len(sets[i])), ("to", to)):
                    out[name].append(value)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.struct([("q", pa.int64()), ("d", pa.float64()), ("linked", pa.bool_())])))
            yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(out.values(), kinds, strict=True)], list(out))

    return found


def _dealt(rows: DataFrame, *order: str) -> DataFrame:
    """Rows of a group g together, groups being of a bounded size."""
    return rows.repartition("g").sortWithinPartitions("g", *order)


class _Groups:
    """Joins groups(cell, u, n, label) of any size; label tells members known to be joined."""

    def __init__(self, docs: DataFrame, reps: DataFrame, repeated: bool, words: int, percent: int, leaf: int):
        self.docs, self.repeated, self.words, self.percent, self.leaf = docs, repeated, words, percent, leaf
        self.counts = reps.select("u", "counts")
        self.where = reps.select("u", "k", "t")
        self.eps = 1 - percent / 100

    def _sets(self, of: DataFrame) -> DataFrame:
        """u, s for the members of a table."""
        sets = _whole_sets(self.docs, stored(self.where.join(of.select("u").distinct(), "u")), self.words)
        return stored(sets.dropDuplicates(["u"]) if self.repeated else sets)

    def within(self, groups: DataFrame, one_block: bool) -> DataFrame:
        """a, b: links that join every group, members outside its commonest component against all
        (one_block: groups of a leaf at most, everything against everything)."""
        if one_block:
            dealt = groups.withColumns({"g": F.col("cell"), "role": F.lit(BOTH)})
        else:
            inner = F.coalesce(F.col("label") == F.col("main"), F.lit(False))
            weight = lambda x: F.greatest(F.ceil(F.sum(x) / self.leaf), F.ceil(F.sum(x * F.col("n")) / SET_SHINGLES), F.lit(1))
            sizes = groups.withColumn("out", (~inner).cast("int")).groupBy("cell").agg(
                weight(F.col("out")).cast("int").alias("outs"),
                weight(F.lit(1)).cast("int").alias("alls"),
            )
            cut = groups.join(sizes, "cell").withColumn("h", F.xxhash64("u"))
            sides = F.array(
                F.struct(F.lit(OUTSIDE).alias("role"), F.pmod("h", "outs").cast("int").alias("own"), F.col("alls").alias("times")),
                F.struct(F.lit(INSIDE).alias("role"), F.pmod("h", "alls").cast("int").alias("own"), F.col("outs").alias("times")),
            )
            sides = F.filter(sides, lambda x: (x["role"] == INSIDE) | ~inner)
            each = cut.withColumn("side", F.explode(sides)).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("side.times") - 1)))
            first, second = F.when(
                F.col("side.role") == OUTSIDE,
                F.col("side.own"),
            ).otherwise(F.col("with")), F.when(F.col("side.role") == OUTSIDE, F.col("with")).otherwise(F.col("side.own"))
            dealt = each.select("cell", "u", "n", "label", F.xxhash64("cell", first, second).alias("g"), F.col("side.role").alias("role"))
        kept = "g long, u long, n int, label long, role int, cells array<bigint>, counts binary"
        cells = F.col("cells") if "cells" in groups.columns else F.array().cast("array<bigint>").alias("cells")
        some = _dealt(dealt.join(self.counts, "u").select("g", "u", "n", "label", "role", cells, "counts"))
        left = stored(some.mapInArrow(_with_open_pairs(self.percent), kept))
        return stored(_dealt(left.join(self._sets(left), "u")).mapInArrow(_spanning_links(self.percent), "a long, b long"))

    def cells(self, groups: DataFrame, turn: int) -> DataFrame:
        """cell, u, n and the distances `to` its pivots, for groups(cell, u, n, m, blocks); members
        that no pivots were drawn for are missing."""
        drawn = groups.withColumn("h", F.xxhash64("u", F.lit(turn))).where(F.pmod("h", "m") < 4 * CELLS)
        rank = F.row_number().over(Window.partitionBy("cell").orderBy("h", "u"))
        pivots = drawn.withColumn("rank", rank).where(F.col("rank") <= CELLS)
        rows = groups.select("cell", F.pmod(F.xxhash64("u"), "blocks").cast("int").alias("block"), "u", F.lit(INSIDE).alias("role"))
        copies = pivots.select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "u", F.lit(PIVOT).alias("role"))
        both = rows.unionByName(copies).withColumn("g", F.xxhash64("cell", "block"))
        made = "cell long, u long, n int, to array<struct<q: long, d: double, linked: boolean>>"
        dealt = _dealt(both.join(self._sets(groups), "u").select("g", "cell", "u", "role", "s"), "role")
        return stored(dealt.mapInArrow(_distances(self.percent), made).where("size(to) > 0"))


def _with_main(groups: DataFrame) -> DataFrame:
    """With main, the commonest label of each cell, and outside, the members of another."""
    by_label = groups.groupBy("cell", "label").agg(F.count("*").alias("c"))
    main = by_label.groupBy("cell").agg(F.max_by("label", F.struct("c", -F.col("label"))).alias("main"), F.sum("c").alias("m"), F.max("c").alias("most"))
    return groups.drop("m").join(main.select("cell", "main", "m", (F.col("m") - F.col("most")).alias("outside")), "cell")


def _blocks(members: str, shingles: str, leaf: int) -> Column:
    """Into how many blocks a group goes, for no block to outgrow a task."""
    return F.greatest(F.ceil(F.col(members) / leaf), F.ceil(F.col(shingles) / SET_SHINGLES), F.lit(1)).cast("int")


def _split(state: DataFrame, to: DataFrame, labels: DataFrame, leaf: int, eps: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One turn over large groups: (cells small enough to join, groups to join in blocks, the next
    turn's groups), from the distances `to` the pivots and the labels that the links so far give."""
    had = state.select("cell", "u", F.col("m").alias("before"), F.col("outside").alias("outside_before"))
    now = to.join(had, ["cell", "u"]).join(labels, F.col("u") == F.col("node"), "left").withColumn("label", F.coalesce("component", "u"))
    now = stored(_with_main(now.drop("node", "component")).where("outside > 0"))
    # The home cell and the window of each member; pivots have met all others.
    nearest = F.array_min(F.transform("to", lambda p: p["d"]))
    window = F.filter("to", lambda p: p["d"] <= nearest + 2 * eps + 1e-9)
    parts = now.where(~F.exists("to", lambda p: p["q"] == F.col("u"))).withColumn("p", F.explode(window))
    parts = parts.select(F.col("cell").alias("parent"), F.xxhash64("cell", "p.q").alias("cell"), "u", "n", "label", "before", F.col("p.d").alias("d"))
    parts = _with_main(parts).where("outside > 0").withColumn("inner", F.col("label") == F.col("main"))
    # The commonest component stays only where one outside can be near it.
    ring = parts.where("not inner").groupBy("cell").agg(F.min("d").alias("low"), F.max("d").alias("high"))
    parts = parts.join(ring, "cell").where(~F.col("inner") | F.col("d").between(F.col("low") - eps - 1e-9, F.col("high") + eps + 1e-9))
    parts = stored(parts.select("parent", "cell", "u", "n", "label", "before"))
    sizes = parts.groupBy("parent", "cell", "before").agg(F.count("*").alias("m"), F.sum("n").alias("shingles"))
    sizes = stored(sizes.withColumn("blocks", _blocks("m", "shingles", leaf)))
    unsplit = sizes.where((F.col("blocks") > 1) & (4 * F.col("m") > 3 * F.col("before"))).select(F.col("parent").alias("cell")).distinct()
    split = parts.join(unsplit.withColumnRenamed("cell", "parent"), "parent", "left_anti").drop("parent", "before").join(sizes.drop("parent", "before"), "cell")
    whole = now.join(unsplit, "cell")
    halved = (F.col("outside") > leaf) & (2 * F.col("outside") <= F.col("outside_before"))
    undrawn = state.join(to.select("cell").distinct(), "cell", "left_anti").select("cell", "u", "n", "label", F.lit(None).cast("long").alias("main"))
    in_blocks = whole.where(~halved).select("cell", "u", "n", "label", "main").unionByName(undrawn)
    names = ("cell", "u", "n", "label", "m", "outside", "blocks")
    more = whole.where(halved).withColumn("blocks", F.ceil(F.col("m") / leaf).cast("int")).select(*names)
    more = more.unionByName(split.where("blocks > 1").withColumn("outside", F.col("m")).select(*names))
    return split.where("blocks = 1").select("cell", "u", "n", "label"), in_blocks, stored(more)


def links(docs: DataFrame, sig: DataFrame, words: int = WORDS, percent: int = PERCENT, leaf: int = LEAF) -> DataFrame:
    """a, b: links between different sets, by their least u, enough of them to give the components."""
    # Written before it is joined: Spark splits a hot key only in joins right above two shuffles.
    held = stored(sig.where("n > 0").groupBy("fp").agg(F.min("u").alias("first"), F.count("*").alias("c")).where("c > 1"))
    alike = stored(sig.select("fp", "u", "k", "t").join(held, "fp").select("u", "k", "t", "first"))
    repeated = bool(alike.groupBy("k", "t").count().where("count > 1").limit(1).count())
    reps = _without_copies(sig.where("n > 0"), alike.where("u != first").select("u"))
    postings = reps.select("u", F.explode("window").alias("r"))
    shared = stored(postings.groupBy("r").agg(F.count("*").alias("c"), F.min("u").alias("cell")).where("c > 1").select("r", "cell"))
    near = postings.join(shared, "r").select("cell", "u").distinct()
    near = stored(near.join(reps.select("u", "n"), "u").withColumn("label", F.col("u")))
    of_member = near.groupBy("u").agg(F.sort_array(F.collect_set("cell")).alias("cells"))  # fewer than its shingles
    sizes = near.groupBy("cell").agg(F.count("*").alias("m"), F.sum("n").alias("shingles"))
    large = stored(sizes.withColumn("blocks", _blocks("m", "shingles", leaf)).where("blocks > 1").select("cell", "m", "blocks"))
    join = _Groups(docs, reps, repeated, words, percent, leaf)
    if not large.limit(1).count():
        return join.within(near.join(of_member, "u"), True)
    found = [join.within(near.join(large, "cell", "left_anti").join(of_member, "u"), True)]
    state, turn = stored(near.join(large, "cell").withColumn("outside", F.col("m"))), 0
    while state.limit(1).count():
        turn += 1
        to = join.cells(state, turn)
        met = to.select(F.col("u").alias("b"), F.explode(F.filter("to", lambda p: p["linked"])).alias("p"))
        found.append(stored(met.select(F.col("p.q").alias("a"), "b")))
        small, in_blocks, state = _split(state, to, components(_union(found)), leaf, 1 - percent / 100)
        found += [join.within(small, True), join.within(in_blocks, False)]
    return _union(found)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def keyed_classes(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, leaf: int = LEAF) -> DataFrame:
    """doc_id, k, t, n and c, the least k of the component, for every row."""
    sig = signatures(docs, frequent_bits(docs, words), words, percent)
    comp = components(links(docs, sig, words, percent, leaf))
    sets = stored(sig.where("n > 0").groupBy("fp").agg(F.min("u").alias("node"), F.min("k").alias("least")))
    linked = stored(sets.join(comp, "node"))
    least = linked.groupBy("component").agg(F.min("least").alias("c"))
    of_set = sets.join(linked.join(least, "component").select("fp", "c"), "fp", "left").select("fp", F.coalesce("c", "least").alias("c"))
    out = sig.select("doc_id", "k", "t", "n", "fp").join(of_set, "fp", "left")
    return out.select("doc_id", "k", "t", "n", F.coalesce("c", "k").alias("c"))


def classes(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, leaf: int = LEAF) -> DataFrame:
    """doc_id, n_shingles, component_id for every row.

    Words are `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased.  Texts without words (null, empty, blank)
    have an empty set and are linked with nothing; fewer than `words` words are one shingle.
    Equal sets are linked.  A null doc_id counts as the greatest and comes out as null; rows
    that repeat a doc_id are judged by their own texts.
    """
    found = keyed_classes(docs, words, percent, leaf)
    return found.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("c") != NULL_ID, F.col("c")).alias("component_id"))


def first_of_classes(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs without the documents that have a smaller doc_id in their component; all columns kept.

    Rows that repeat that least doc_id are one document and stay together; so do rows without id.
    """
    later = stored(keyed_classes(docs, words, percent).where("k != c").select(F.col("k").alias("__k"), F.col("t").alias("__t")).distinct())
    keyed = docs.withColumn("__k", id_key()).withColumn("__t", F.xxhash64(F.coalesce("text", F.lit(""))))
    if later.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:  # 16 bytes a row, some 100 once hashed
        kept = keyed.join(F.broadcast(later), ["__k", "__t"], "left_anti")
    else:  # only documents that share a bit with a later one are shuffled
        bits, place = _key_bits(later, "__k", "__t"), _place("__k", "__t")
        kept = _by_bits(keyed, bits, place, "left_anti").unionByName(_by_bits(keyed, bits, place, "left_semi").join(later, ["__k", "__t"], "left_anti"))
    return kept.drop("__k", "__t")
