"""SentencePiece encoding and decoding as a shortest path through a weighted transducer.

compile_model() turns a model file into three transducers.

- The normaliser rewrites characters by its rules (leftmost, longest; read out of the model's double
  array), squeezes and trims blanks if the model says so, puts the dummy prefix first and writes
  blanks as U+2581.
- The pieces are arcs that read a string and write an id.  A unigram model's arcs weigh minus their
  score and leave one state.  A merge-trained model's states are the last piece read: an arc from
  piece a to piece b weighs 0 if the merges of the string ab end in exactly a, b, and is infinite
  otherwise, as a sequence all of whose neighbours agree is the one that the merges give for the
  whole string.  So only one state of a position has a finite weight.
- The byte fallback reads a character that is no piece and writes its bytes; in a unigram model it
  weighs PENALTY more than the worst piece.

They are composed with an input as it is read: shortest() relaxes the arcs into each position in the
tropical semiring (min, +), longest first, so that of equal weights the longest arc stays; weight 0
cannot be improved on and ends the search of a merge model's position.  The input is cut where no
arc can cross, and the paths of frequent stretches and of their parts are kept in bounded tables.
"""

from __future__ import annotations

import heapq
import re
import struct
import zlib
from array import array
from collections.abc import Iterator, Sequence
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tidemark.llm.common import texts

MODEL = "piece_bpe_32k.model"
BLANK = "\u2581"
CACHE_ENTRIES = 300_000
#: Fixed values of the model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)
UNIGRAM, MERGES = 1, 2
PENALTY = 10.0
INFINITE = float("inf")


def _fields(data: bytes) -> Iterator[tuple[int, int, bytes | int]]:
    """(number, wire type, value) of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            value: bytes | int = varint()
        else:
            size = varint() if kind == 2 else 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        yield key >> 3, kind, value


class Normaliser:
    """Rewriting rules, white space and the dummy prefix of a model."""

    def __init__(self, spec: bytes):
        found = dict((n, v) for n, _, v in _fields(spec))
        self.dummy_prefix, self.squeeze = bool(found.get(3, 1)), bool(found.get(4, 1))
        if not found.get(5, 1):
            raise ValueError("models that don't write blanks as U+2581 are not compiled")
        self.rules = self._rules(found.get(2, b""))
        self.longest = max(map(len, self.rules), default=0)
        starts = sorted({k[0] for k in self.rules})
        self.at = re.compile("[" + "".join(map(re.escape, starts)) + "]") if starts else None

    @staticmethod
    def _rules(charsmap: bytes) -> dict[str, str]:
        """The strings of the double array and what they become."""
        if not charsmap:
            return {}
        size = struct.unpack("<I", charsmap[:4])[0]
        units, written = np.frombuffer(charsmap[4 : 4 + size], "<u4").astype(np.int64), charsmap[4 + size :]
        below = lambda unit: (unit >> 10) << ((unit & 512) >> 6)
        out, labels = {}, np.arange(256)
        todo = [(int(below(units[0])), b"")]
        while todo:
            node, key = todo.pop()
            at = node ^ labels
            at = at[at < len(units)]
            for b in np.flatnonzero((units[at] & (1 << 31 | 255)) == labels[: len(at)]).tolist():
                unit = int(units[node ^ b])
                child = (node ^ b) ^ below(unit)
                if b == 0:
                    continue
                if unit >> 8 & 1:
                    begin = int(units[child]) & (1 << 31) - 1
                    out[key + bytes((b,))] = written[begin : written.index(b"\0", begin)]
                todo.append((int(child), key + bytes((b,))))
        return {k.decode(): v.decode() for k, v in out.items()}

    def rewritten(self, text: str) -> str:
        if self.at is None or not self.at.search(text):
            return text
        out, done = [], 0
        while found := self.at.search(text, done):
            begin = found.start()
            out.append(text[done:begin])
            for n in range(min(self.longest, len(text) - begin), 0, -1):
                new = self.rules.get(text[begin : begin + n])
                if new is not None:
                    out.append(new)
                    break
            else:
                n = 1
                out.append(text[begin])
            done = begin + n
        return "".join([*out, text[done:]])

    def __call__(self, text: str) -> str:
        text = self.rewritten(text)
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        return (BLANK if self.dummy_prefix else "") + text.replace(" ", BLANK)

    def restored(self, text: str) -> str:
        """What a normalised text says, with blanks and without the dummy prefix."""
        text = text.replace(BLANK, " ")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


class PieceTransducer:
    """Models of unknown arcs raise ValueError: user-defined pieces, no byte fallback, over 65,536 ids."""

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        self.names: list[str] = []
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.byte_ids: dict[int, int] = {}
        self.bytes_of: dict[int, int] = {}
        self.kind, spec = UNIGRAM, b""
        with open(path, "rb") as f:
            model = f.read()
        for number, _, value in _fields(model):
            if number == 1:
                piece = {n: v for n, _, v in _fields(value)}
                name, kind = piece[1].decode(), piece.get(3, NORMAL)
                i = len(self.names)
                self.names.append(name)
                if kind == NORMAL:
                    self.ids[name], self.scores[name] = i, struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0]
                elif kind == BYTE:
                    self.byte_ids[int(name[3:5], 16)], self.bytes_of[i] = i, int(name[3:5], 16)
                elif kind == USER_DEFINED:
                    raise ValueError(f"user-defined piece {name!r}")
            elif number == 2:
                self.kind = {n: v for n, _, v in _fields(value)}.get(3, UNIGRAM)
            elif number == 3:
                spec = value
        if self.kind not in (UNIGRAM, MERGES) or len(self.byte_ids) != 256 or len(self.names) > 1 << 16:
            raise ValueError("only unigram and merge models with byte fallback and at most 65,536 ids are compiled")
        self.normalise = Normaliser(spec)
        self.least = 0.0 if self.kind == MERGES else -INFINITE  # a weight that no arc can improve on
        self.fallback = PENALTY - min(self.scores.values(), default=0.0)
        #: The automaton of the pieces: a state is the longest beginning of a piece that ends at a character.
        self.beginnings = {name[:i] for name in self.ids for i in range(1, len(name) + 1)}
        self.steps: dict[str, tuple[str, tuple[str, ...]]] = {}
        self.inner = {name[i : i + 2] for name in self.ids for i in range(len(name) - 1)}
        self.weights: dict[tuple[str, str], float] = {}
        self.cache: dict[str, bytes] = {}  # of parts
        self.whole: dict[str, bytes] = {}  # of stretches
        self.entries = entries
        #: The bytes that each id stands for.
        self.written = [bytes((self.bytes_of[i],)) if i in self.bytes_of else n.encode() for i, n in enumerate(self.names)]
        crossed = any(BLANK in name.lstrip(BLANK) or "\n" in name or "\t" in name for name in self.ids)
        self.stretches = re.compile("(?s).+" if crossed else f"[\n\t]|{BLANK}*[^{BLANK}\n\t]+|{BLANK}+")

    def merges(self, text: str) -> list[str]:
        """The pieces that merging leaves, best score first, leftmost of equals."""
        parts: list[str | None] = list(text)
        after = [*range(1, len(parts)), -1]
        before = list(range(-1, len(parts) - 1))
        scores = self.scores
        heap = [(-scores[p], i, i + 1, p) for i in range(len(parts) - 1) if (p := text[i : i + 2]) in scores]
        heapq.heapify(heap)
        while heap:
            _, i, j, p = heapq.heappop(heap)
            if parts[i] is None or parts[j] is None or after[i] != j or parts[i] + parts[j] != p:
                continue
            parts[i], parts[j], after[i] = p, None, after[j]
            if after[i] >= 0:
                before[after[i]] = i
                if (q := p + parts[after[i]]) in scores:
                    heapq.heappush(heap, (-scores[q], i, after[i], q))
            if before[i] >= 0 and (q := parts[before[i]] + p) in scores:
                heapq.heappush(heap, (-scores[q], before[i], i, q))
        return [p for p in parts if p is not None]

    def weight(self, state: str, piece: str) -> float:
        """Of the arc that reads piece in this state; kept in a bounded table."""
        if self.kind == UNIGRAM:
            found = -self.scores[piece] if piece in self.scores else self.fallback
        else:
            found = 0.0 if self.merges(state + piece) == ([state, piece] if state else [piece]) else INFINITE
        if len(self.weights) > 4 * self.entries:
            self.weights.clear()
        self.weights[state, piece] = found
        return found

    def step(self, key: str) -> tuple[str, tuple[str, ...]]:
        """Where a state goes with a character (key: both), and what arcs end there, longest first;
        kept in a bounded table."""
        state = next((key[i:] for i in range(len(key)) if key[i:] in self.beginnings), "")
        arcs = tuple(state[i:] for i in range(len(state) - 1) if state[i:] in self.ids)
        if len(self.steps) > self.entries:
            self.steps.clear()
        found = self.steps[key] = state, (*arcs, key[-1])
        return found

    def shortest(self, text: str) -> list[str]:
        """The strings that the arcs of the shortest path over a stretch read."""
        total, last, states = [0.0], [""], [""]
        steps, weights, least, merged, at = self.steps, self.weights, self.least, self.kind == MERGES, ""
        for end, c in enumerate(text, 1):
            key = at + c
            at, arcs = steps.get(key) or self.step(key)
            best = INFINITE
            for piece in arcs:
                begin = end - len(piece)
                w = weights.get((states[begin], piece))
                w = total[begin] + (self.weight(states[begin], piece) if w is None else w)
                if w < best:
                    best, found = w, piece
                    if w <= least:
                        break
            total.append(best)
            last.append(found)
            states.append(found if merged else "")
        out, end = [], len(text)
        while end:
            out.append(last[end])
            end -= len(last[end])
        return out[::-1]

    def _write(self, pieces: list[str]) -> bytes:
        try:
            return array("H", map(self.ids.__getitem__, pieces)).tobytes()
        except KeyError:  # bytes are needed
            out = array("H")
        for p in pieces:
            i = self.ids.get(p)
            if i is None:
                out.extend(self.byte_ids[b] for b in p.encode())
            else:
                out.append(i)
        return out.tobytes()

    def _new(self, stretch: str) -> bytes:
        """A stretch is cut once more between characters that stand together in no piece."""
        inner, cache, whole = self.inner, self.cache, self.whole
        together = list(map(inner.__contains__, map(add, stretch, stretch[1:])))
        cuts = [0, *([] if all(together) else [i for i, t in enumerate(together, 1) if not t]), len(stretch)]
        out = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = stretch[a:b]
            found = cache.get(part)
            if found is None:
                found = self._write(self.shortest(part))
                if len(cache) < self.entries and b - a <= 64:
                    cache[part] = found
            out.append(found)
        ids = out[0] if len(out) == 1 else b"".join(out)
        if len(whole) < self.entries and len(stretch) <= 64:
            whole[stretch] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """ids (little-endian u16) of the whole text."""
        return self.encode_normal(self.normalise(text))

    def encode_normal(self, text: str) -> bytes:
        """The same of a text that is normalised already."""
        stretches = self.stretches.findall(text)
        found = list(map(self.whole.get, stretches))
        if None in found:
            found = [self._new(s) if f is None else f for s, f in zip(stretches, found, strict=True)]
        return b"".join(found)

    def decode(self, ids: Sequence[int]) -> str:
        """The inverse: pieces' strings and bytes, blanks restored, the dummy prefix taken off."""
        return self.normalise.restored(b"".join(map(self.written.__getitem__, ids)).decode("utf-8", "replace"))

    def kept(self, text: str) -> str:
        """What of a text its ids keep: all but what the normaliser rewrites."""
        return self.normalise.restored(self.normalise(text))


_compiled: dict[str, PieceTransducer] = {}


def compile_model(path: str) -> PieceTransducer:
    """One for each worker process, kept between tasks."""
    if path not in _compiled:
        _compiled[path] = PieceTransducer(path)
    return _compiled[path]


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids (binary, little-endian u16) and decoded, for every row in its own partition.

    Null and empty texts have no ids and decode to the empty text.  A text that holds U+2581
    itself decodes to a blank there, as in the model's own format.
    """

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fst = compile_model(model)
        for pdf in batches:
            for at in range(0, len(pdf), 512):
                part = pdf.iloc[at : at + 512]
                ids = [fst.encode(t) for t in part["text"]]
                decoded = [fst.decode(array("H", i)) for i in ids]
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64").values, "ids": ids, "decoded": decoded, "same": [d == fst.kept(t) for d, t in zip(decoded, part["text"], strict=True)]})

    return texts(docs).mapInPandas(encoded, "doc_id long, ids binary, decoded string, same boolean")


def encode_summary(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of little-endian u32 ids) and round_trip, without the texts."""

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fst = compile_model(model)
        for pdf in batches:
            for at in range(0, len(pdf), 512):
                part = pdf.iloc[at : at + 512]
                normal = [fst.normalise(t) for t in part["text"]]
                ids = [array("H", fst.encode_normal(t)) for t in normal]
                yield pd.DataFrame(
                    {
                        "doc_id": part["doc_id"].astype("Int64").values,
                        "n_pieces": [len(i) for i in ids],
                        "ids_crc32": [zlib.crc32(array("I", i).tobytes()) for i in ids],
                        "round_trip": [fst.decode(i) == fst.normalise.restored(t) for i, t in zip(ids, normal, strict=True)],
                    }
                )

    return texts(docs).mapInPandas(summed, "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean")
