"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

fit() takes a bounded sample of the labelled rows outside the held-out fold.  INDEX_ROWS of them, as
many of either label as there are, become examples.  All their words are terms, and so are those
beginnings of words that go with a label in the sample by MIN_Z standard deviations; labels choose
these further terms, but weigh none.  Document frequencies are counted over all documents, and
norms are over all words of a text, those that no example holds included.

The examples are an inverted index: postings by term, in blocks of BLOCK examples that are alike, with
the greatest weight of each term in each block; the terms of many examples are rows of a matrix
instead.  A query adds up the block maxima of its terms, reads the blocks of the greatest bounds, and
then all whose bound is not below the k-th cosine found, so that the neighbours are exact.  Neighbours vote by the square of their cosine relative to the
nearest one's, against a constant weight of the base rate, and the votes are calibrated by a logistic
curve on sampled rows outside the index.  Sample and examples are bounded by parameters, so the
broadcast index is too; every document is scored, over its whole text.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Collection, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import stored, texts

SAMPLE_ROWS = 20_000
INDEX_ROWS = 2_048
CALIBRATION_ROWS = 4_096
CACHE_WORDS = 20_000
BLOCK = 64
PRODUCT_ROWS = 64  # rows of the matrix that are multiplied at once, in one place of memory
K, K_SHARE = 15, 7  # neighbours: a seventh of the examples of the rarer label, K at least
EVIDENCE = 15
COMMON = 512  # terms by which the examples are ordered
OFTEN = 16  # a term of more than one in OFTEN examples is kept as a row of a matrix
PREFIXES = (4, 5, 6)
MIN_ROWS, MIN_Z = 4, 5.0
PRIOR_WEIGHT = 1.0
FOLDS = 5
_CHUNK = 1 << 14
_WORD = re.compile(r"[^\W\d_]+")
#: Blanks for all of ASCII but its letters; other bytes are parts of characters beyond ASCII.
_BLANKS = bytes(c if c >= 0x80 or chr(c).isalpha() else 0x20 for c in range(256))


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def distinct_words(text: str, gathered: type = Counter):
    """Counter (or set) of words_of(text); only what isn't ASCII is searched character by character."""
    pieces = text.lower().encode("utf-8", "surrogatepass").translate(_BLANKS).decode("utf-8", "surrogatepass").split()
    found = gathered(pieces)
    if not text.isascii():
        for piece in [p for p in found if not p.isascii() and not p.isalpha()]:  # holds more than letters
            words = _WORD.findall(piece)
            if words != [piece]:
                if gathered is set:
                    found.discard(piece)
                    found.update(words)
                else:
                    n = found.pop(piece)
                    for word in words:
                        found[word] += n
    return found


def beginnings(word: str) -> tuple[str, ...]:
    return tuple(f"{word[:n]}~" for n in PREFIXES if len(word) > n)


def _spans(begin: np.ndarray, end: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places begin[i]..end[i] of all spans in a row, and the value of each one's span."""
    size = end - begin
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - ends + size, size), np.repeat(values, size)


class Terms:
    """Numbers and document frequencies of terms; vectors of texts."""

    def __init__(self, names: list[str], df: np.ndarray, documents: int):
        self.names = {t: i for i, t in enumerate(names)}
        idf = lambda d: np.log((1 + documents) / (1 + d)) + 0.01
        self.weight = idf(df.astype(np.float64))
        self.unseen = float(idf(0.0))
        self.known: dict[str, int] = {}  # of words without beginnings; frequent ones, as they come early
        self.starts = {t[:-1]: i for t, i in self.names.items() if t.endswith("~")}
        self.least = {t[: PREFIXES[0]] for t in self.starts}

    def more(self, word: str) -> list[int]:
        """The terms that are beginnings of a word."""
        if word[: PREFIXES[0]] not in self.least:
            return []
        starts, size = self.starts, len(word)
        return [starts[word[:n]] for n in PREFIXES if size > n and word[:n] in starts]

    def numbers(self, words: Collection[str]) -> tuple[np.ndarray, list[tuple[int, list[int]]]]:
        """The own term of each word (-1: none), and the beginnings of the words that have any, by place."""
        own = np.fromiter(map(self.known.get, words, repeat(-2)), np.int64, len(words))
        new, more, names, least, begin = np.flatnonzero(own == -2), [], self.names, self.least, PREFIXES[0]
        if len(new):
            words = list(words)
            for i in new.tolist():
                word = words[i]
                own[i] = t = names.get(word, -1)
                if word[:begin] in least and (found := self.more(word)):
                    more.append((i, found))
                elif len(self.known) < CACHE_WORDS:
                    self.known[word] = t
        return own, more

    def present(self, text: str) -> np.ndarray:
        """The terms of a text, each once."""
        own, more = self.numbers(distinct_words(text, set))
        found = {t for _, ts in more for t in ts}
        return np.concatenate([own[own >= 0], np.fromiter(found, np.int64, len(found))])

    def counts(self, text: str) -> tuple[dict[int, int], int]:
        """Occurrences of each term, and the number of distinct words that are none."""
        return self.counted(distinct_words(text))

    def counted(self, bag: dict[str, int]) -> tuple[dict[int, int], int]:
        at, n, unseen = self.occurring(bag)
        return dict(zip(at.tolist(), n.tolist(), strict=True)), unseen

    def occurring(self, bag: dict[str, int]) -> tuple[np.ndarray, np.ndarray, int]:
        """The terms of a text, each one's occurrences, and the number of distinct words that are none."""
        own, more = self.numbers(bag)
        n, known = np.fromiter(bag.values(), np.int64, len(bag)), own >= 0
        begun: dict[int, int] = {}
        for i, found in more:
            for t in found:
                begun[t] = begun.get(t, 0) + int(n[i])
        at = np.concatenate([own[known], np.fromiter(begun, np.int64, len(begun))])
        return at, np.concatenate([n[known], np.fromiter(begun.values(), np.int64, len(begun))]), len(own) - int(known.sum())

    def unit(self, counts: dict[int, int], unseen: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.fromiter(counts, np.int64, len(counts))
        return self.scaled(at, np.fromiter(counts.values(), np.int64, len(counts)), unseen)

    def scaled(self, at: np.ndarray, n: np.ndarray, unseen: int) -> tuple[np.ndarray, np.ndarray]:
        w = (1.0 + np.log(n)) * self.weight[at]
        norm = math.sqrt(float(w @ w) + unseen * self.unseen**2)
        return at, w / norm if norm else w


def _alike(units: list[tuple[np.ndarray, np.ndarray]], terms: int) -> list[int]:
    """An order in which examples that share their most common terms stand together, so that bounds of
    blocks are tight: halves along the direction in which they differ most, and those again."""
    if not units:
        return []
    common = np.argsort(-np.bincount(np.concatenate([at for at, _ in units]), minlength=terms), kind="stable")[:COMMON]
    column = np.full(terms, -1, np.int64)
    column[common] = np.arange(len(common))
    vectors = np.zeros((len(units), len(common)))
    for j, (at, w) in enumerate(units):
        some = column[at] >= 0
        vectors[j, column[at[some]]] = w[some]
    parts, out = [np.arange(len(units))], []
    while parts:
        part = parts.pop()
        if len(part) <= BLOCK:
            out.extend(part.tolist())
            continue
        x = vectors[part] - vectors[part].mean(axis=0)
        along = 1 + 1e-3 * np.arange(x.shape[1])
        for _ in range(20):
            along = x.T @ (x @ along)
            along /= np.linalg.norm(along) or 1.0
        part = part[np.argsort(x @ along, kind="stable")]
        half = BLOCK * (-(-len(part) // BLOCK) // 2)
        parts += [part[half:], part[:half]]
    return out


class BlockMaxIndex:
    """Examples as unit vectors in postings by term and block, with the maxima of the blocks."""

    def __init__(self, terms: Terms, ids: list[int], labels: list[int], vectors: list[tuple[dict[int, int], int]], base_rate: float):
        self.terms, self.base_rate = terms, base_rate
        units = [terms.unit(*v) for v in vectors]
        by_id = sorted(range(len(ids)), key=lambda j: ids[j])
        order = [by_id[j] for j in _alike([units[j] for j in by_id], len(terms.names))]
        self.ids = np.array([ids[j] for j in order], np.int64)
        self.labels = np.array([labels[j] for j in order], np.float64)
        self.blocks = max(1, -(-len(order) // BLOCK))
        self.k = max(K, int(min(self.labels.sum(), len(order) - self.labels.sum())) // K_SHARE)
        term = np.concatenate([units[j][0] for j in order] or [np.zeros(0, np.int64)])
        weight = np.concatenate([units[j][1] for j in order] or [np.zeros(0)])
        place = np.repeat(np.arange(len(order)), [len(units[j][0]) for j in order]) if order else np.zeros(0, np.int64)
        by = np.lexsort((place, term))
        term, weight, place = term[by], weight[by], place[by]
        # Terms of many examples are rows of a matrix, which one product adds up for all examples.
        often = np.flatnonzero(np.bincount(term, minlength=len(terms.names)) * OFTEN > len(order))
        self.row = np.full(len(terms.names), -1, np.int64)
        self.row[often] = np.arange(len(often))
        frequent = self.row[term] >= 0
        self.matrix = np.zeros((len(often), self.blocks * BLOCK))
        self.matrix[self.row[term[frequent]], place[frequent]] = weight[frequent]
        self.row_most = self.matrix.reshape(len(often), self.blocks, BLOCK).max(axis=2)
        term, self.weight, self.place = term[~frequent], weight[~frequent], place[~frequent]
        block = self.place // BLOCK
        self.place = self.place.astype(np.int32)
        edge = np.flatnonzero(np.diff(term, prepend=-1) | np.diff(block, prepend=-1))
        #: A list is the postings of one term in one block: lists[i] to lists[i + 1].
        self.lists = np.append(edge, len(term)).astype(np.int32)
        self.list_block, self.list_most = block[edge].astype(np.int32), np.maximum.reduceat(self.weight, edge) if len(edge) else np.zeros(0)
        self.of_term = np.searchsorted(term[edge], np.arange(len(terms.names) + 1))
        self.slope, self.shift, self.empty = 1.0, 0.0, base_rate
        self.taken: np.ndarray | None = None

    def nearest(self, at: np.ndarray, weights: np.ndarray, k: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """Places and cosines of the k nearest examples (cosine above 0), and the blocks read.

        Equal cosines are ordered by place."""
        k = k or self.k
        row = self.row[at]
        often = row >= 0
        rows, row_weights = row[often], weights[often]
        at, weights = at[~often], weights[~often]
        lists, mine = _spans(self.of_term[at], self.of_term[at + 1], weights)
        blocks = self.list_block[lists]
        bounds = np.bincount(blocks, mine * self.list_most[lists], self.blocks) + row_weights @ self.row_most[rows]
        order = np.argsort(-bounds, kind="stable")[: np.count_nonzero(bounds > 0)]
        places, scores, least, done, step = np.zeros(0, np.int64), np.zeros(0), 0.0, 0, -(-2 * k // BLOCK)
        while done < len(order):
            chosen = order[done : done + step]
            chosen = chosen[bounds[chosen] * 1.000001 >= least]
            if not len(chosen):
                break
            wanted = np.zeros(self.blocks, bool)
            wanted[chosen] = True
            some = np.flatnonzero(wanted[blocks])
            postings, by = _spans(self.lists[lists[some]], self.lists[lists[some] + 1], mine[some])
            sums = np.bincount(self.place[postings], self.weight[postings] * by, self.blocks * BLOCK)
            sums = sums.reshape(self.blocks, BLOCK)[chosen].ravel() + self._product(rows, row_weights, chosen)
            near = np.flatnonzero((sums >= least) & (sums > 0))
            places = np.concatenate([places, chosen[near // BLOCK] * BLOCK + near % BLOCK])
            scores = np.concatenate([scores, sums[near]])
            if len(scores) >= k:
                least = np.partition(scores, len(scores) - k)[len(scores) - k]
                places, scores = places[scores >= least], scores[scores >= least]
            done, step = done + len(chosen), len(order)  # then all blocks that can hold a nearer one
        top = np.lexsort((places, -scores))[:k]
        return places[top], scores[top], done

    def _product(self, rows: np.ndarray, weights: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """weights @ matrix[rows] in these blocks only, by parts into one place of memory that stays."""
        if self.taken is None:
            self.taken = np.empty((PRODUCT_ROWS * self.blocks, BLOCK))
        total, parts = np.zeros(len(blocks) * BLOCK), self.matrix.reshape(-1, BLOCK)
        for i in range(0, len(rows), PRODUCT_ROWS):
            at = (rows[i : i + PRODUCT_ROWS, None] * self.blocks + blocks).ravel()
            taken = np.take(parts, at, axis=0, out=self.taken[: len(at)], mode="clip")
            total += weights[i : i + PRODUCT_ROWS] @ taken.reshape(-1, len(total))
        return total

    def vote(self, cosines: np.ndarray, labels: np.ndarray) -> float:
        w = (cosines / cosines[0]) ** 2 if len(cosines) else cosines
        return float(((w * labels).sum() + PRIOR_WEIGHT * self.base_rate) / (w.sum() + PRIOR_WEIGHT))

    def calibrated(self, vote: float) -> float:
        odds = math.log(max(vote, 1e-6) / max(1 - vote, 1e-6))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * odds + self.shift))))

    def raw_vote(self, text: str) -> tuple[float, np.ndarray, np.ndarray] | None:
        """Vote, places and cosines; None for a text without words."""
        bag = distinct_words(text)
        if not bag:
            return None
        at, cosines, _ = self.nearest(*self.terms.scaled(*self.terms.occurring(bag)))
        return self.vote(cosines, self.labels[at]), at, cosines

    def score(self, text: str) -> tuple[float, list[int], list[float]]:
        """Calibrated score and the evidence: ids and cosines of the nearest examples."""
        found = self.raw_vote(text)
        if found is None or not len(self.ids):
            return self.empty, [], []
        vote, at, cosines = found
        return self.calibrated(vote), self.ids[at[:EVIDENCE]].tolist(), cosines[:EVIDENCE].tolist()


def _logistic(votes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and shift by weighted Newton steps on log-odds, with a little ridge."""
    x = np.log(np.clip(votes, 1e-6, 1 - 1e-6) / np.clip(1 - votes, 1e-6, 1 - 1e-6))
    a = np.stack([x, np.ones_like(x)], axis=1)
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        grad = a.T @ (weights * (labels - p)) - 0.1 * (beta - [1.0, 0.0])
        hess = (a * (weights * p * (1 - p))[:, None]).T @ a + 0.1 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    return max(0.05, float(beta[0])), float(beta[1])


def _frequencies(docs: DataFrame, terms: Terms) -> np.ndarray:
    """In how many of all documents each term occurs.  Counts of a task go as compressed chunks of
    the term numbers; the driver gets one number a term of the (bounded) index."""
    size = len(terms.names)
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, total = shared.value, np.zeros(size, np.int64)
        for pdf in batches:
            for text in pdf["text"]:
                total[own.present(text)] += 1
        chunks = range(0, size, _CHUNK)
        yield pd.DataFrame({"chunk": list(chunks), "counts": [zlib.compress(total[c : c + _CHUNK].tobytes(), 1) for c in chunks]})

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for pdf in batches:
            for chunk, counts in zip(pdf["chunk"], pdf["counts"], strict=True):
                total[chunk] = total.get(chunk, 0) + np.frombuffer(zlib.decompress(counts), np.int64)
        yield pd.DataFrame({"chunk": list(total), "counts": [zlib.compress(c.tobytes(), 1) for c in total.values()]})

    kind = "chunk int, counts binary"
    out = np.zeros(size, np.int64)
    for r in texts(docs).select("text").mapInPandas(counted, kind).repartition("chunk").mapInPandas(summed, kind).collect():
        part = np.frombuffer(zlib.decompress(r["counts"]), np.int64)
        out[r["chunk"] : r["chunk"] + len(part)] = part
    shared.destroy()  # else every executor keeps its copy until the driver collects its garbage
    return out


def _bags(rows: DataFrame) -> DataFrame:
    """doc_id, y, words and counts: the distinct words of each text."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            bags = [Counter(words_of(t)) for t in pdf["text"]]
            yield pdf[["doc_id", "y"]].assign(words=[list(b) for b in bags], counts=[list(b.values()) for b in bags])

    return rows.select("doc_id", "y", "text").mapInPandas(counted, "doc_id long, y int, words array<string>, counts array<int>")


def _telling_beginnings(rows: DataFrame, n: int, positive: int) -> set[str]:
    """Beginnings of words that occur with one label more often than chance allows."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                seen, with_label = Counter(), Counter()
                for text, y in zip(pdf["text"].iloc[at : at + 256], pdf["y"].iloc[at : at + 256], strict=True):
                    found = {t for w in set(words_of(text)) for t in beginnings(w)}
                    seen.update(found)
                    if y:
                        with_label.update(found)
                yield pd.DataFrame({"term": list(seen), "df": list(seen.values()), "dt": [with_label[t] for t in seen]})

    expected = F.col("df") * positive / n
    spread = F.sqrt(expected * (1 - F.col("df") / n) * (1 - positive / n) + 1e-9)
    counts = rows.select("text", "y").mapInPandas(counted, "term string, df long, dt long")
    sums = counts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("dt").alias("dt")).where(F.col("df") >= MIN_ROWS)
    return {r["term"] for r in sums.where(F.abs((F.col("dt") - expected) / spread) >= MIN_Z).select("term").collect()}  # of a bounded sample


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, index_rows: int = INDEX_ROWS) -> BlockMaxIndex:
    """The index from labelled rows outside the held-out fold.

    Rows with a null id or label, and labels without a document, teach nothing; a repeated
    doc_id is labelled by the greatest of its labels.  Without any labelled row every score is 0.
    """
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out())
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("y"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = stored(texts(docs).join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")))
    n, positive = rows.agg(F.count("*"), F.sum("y")).first()
    if not n:
        return BlockMaxIndex(Terms([], np.zeros(0), 0), [], [], [], 0.0)
    worded = rows.where(F.col("text").rlike("\\p{L}"))
    ranked = worded.select("doc_id", "text", "y", F.xxhash64("doc_id").alias("h"))
    # At least a quarter of either label stays for the calibration, which weighs it up again.
    of_label = {1: positive, 0: n - positive}
    share = {y: min(index_rows // 2, -(-3 * c // 4)) for y, c in of_label.items()}
    # At most index_rows, each as its distinct words.
    examples = [r for y in (1, 0) for r in _bags(ranked.where(F.col("y") == y).orderBy("h", "doc_id").limit(share[y])).collect()]
    names = sorted({w for r in examples for w in r["words"]} | _telling_beginnings(rows, n, positive))
    terms = Terms(names, _frequencies(docs, Terms(names, np.zeros(len(names)), 0)), docs.count())
    base_rate = positive / n
    vectors = [terms.counted(dict(zip(r["words"], r["counts"], strict=True))) for r in examples]
    index = BlockMaxIndex(terms, [r["doc_id"] for r in examples], [r["y"] for r in examples], vectors, base_rate)
    bare, bare_positive = rows.where(~F.col("text").rlike("\\p{L}")).agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    index.empty = (bare_positive + base_rate) / (bare + 1)

    shared = docs.sparkSession.sparkContext.broadcast(index)

    def voted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for pdf in batches:
            found = [own.raw_vote(t) for t in pdf["text"]]
            some = [f is not None for f in found]
            yield pd.DataFrame({"vote": [f[0] for f in found if f], "y": pdf["y"][some].astype(float).values})

    used = docs.sparkSession.createDataFrame([(r["doc_id"],) for r in examples], "doc_id long")
    rest = ranked.join(F.broadcast(used), "doc_id", "left_anti")
    # Examples have the least h of their label: another order, or few rows of the rarer label were left.
    rest = rest.orderBy(F.xxhash64("h", F.lit(1)), "doc_id").limit(CALIBRATION_ROWS)
    votes = rest.repartition(8).mapInPandas(voted, "vote double, y double").toPandas()
    shared.destroy()
    if len(votes):
        y = votes["y"].to_numpy()
        weights = np.where(y == 1, positive / max(1.0, y.sum()), (n - positive) / max(1.0, (1 - y).sum()))
        index.slope, index.shift = _logistic(votes["vote"].to_numpy(), y, weights)
    return index


def score(docs: DataFrame, index: BlockMaxIndex) -> DataFrame:
    """doc_id, score, predicted, evidence (ids of the nearest examples) and their cosines.

    Texts without words, empty and null ones too, get the rate of such rows in the sample.  Each row is scored alone, in its own partition.
    """
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(index)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for pdf in batches:
            found = [own.score(t) for t in pdf["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": pdf["doc_id"].astype("Int64"),
                    "score": [f[0] for f in found],
                    "evidence": [f[1] for f in found],
                    "cosines": [f[2] for f in found],
                }
            )

    out = texts(docs).mapInPandas(scored, "doc_id long, score double, evidence array<bigint>, cosines array<double>")
    return out.select("doc_id", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "evidence", "cosines")


def drop_toxic(docs: DataFrame, index: BlockMaxIndex) -> DataFrame:
    """docs without the rows predicted toxic, all columns kept."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    @F.pandas_udf("double")
    def scored(text: pd.Series) -> pd.Series:
        own = shared.value
        return pd.Series([own.score(t)[0] for t in text], dtype="float64")

    return docs.where(scored(F.coalesce("text", F.lit(""))) < 0.5)
