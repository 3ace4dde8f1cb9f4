"""Token ids of whole texts by the tokenizers library, through a bounded cache of its answers.

The normaliser and the splitting pattern of the vocabulary never look across a white space,
so that the ids of a text are the ids of its pieces between blanks, line feeds and tabs, in
order.  Invented or rare words still cost one call; frequent ones a dictionary look-up.
"""

from __future__ import annotations

import os
import string
from array import array
from collections.abc import Sequence
from itertools import islice

import numpy as np

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
CACHE_ENTRIES = 300_000
MARKS = 4_096  # runs of marks behind words that are kept

_loaded: dict[str, CachedTokenizer] = {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class CachedTokenizer:
    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.entries = Tokenizer.from_file(path), entries
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        assert not any(c.isspace() for t in special for c in t)
        # How a byte-level vocabulary writes bytes (fixed format): printable Latin-1 characters
        # stand for themselves, the others for U+0100 and on.
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in plain]
        as_char = {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(others)}
        self.letters = {c: "".join(as_char[b] for b in chr(c).encode()) for c in range(0x80, 0x180)}
        self.marks = {m: self._whole([m])[0] for m in ("", *".,;:!?", "...", "?!")}
        self.cache: dict[str, bytes] = {"": b""}

    def _whole(self, words: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [array("H", e.ids).tobytes() for e in found]

    def _encode_new(self, words: set[str]) -> dict[str, bytes]:
        """A run of simple letters is one unit of the vocabulary's pattern, and so are the ASCII marks
        behind it: only its merges are left to ask for.  All else takes the library's whole way."""
        out, rest, model, cache, letters, marks = {}, [], self.tokenizer.model, self.cache, self.letters, self.marks
        for w in words:
            stem = w.rstrip(string.punctuation)
            tail = w[len(stem) :]
            if tail not in marks and len(marks) < MARKS:
                marks[tail] = self._whole([tail])[0]
            if stem.isalpha() and len(stem) <= 64 and (stem.isascii() or max(stem) < "\u0180" and "\u0130" not in stem) and tail in marks:
                stem = stem.lower()
                ids = cache.get(stem)
                if ids is None:
                    unit = stem if stem.isascii() else stem.translate(letters)
                    ids = array("H", [t.id for t in model.tokenize(unit)]).tobytes()
                out[w] = ids + marks[tail]
            else:
                rest.append(w)
        out.update(zip(rest, self._whole(rest), strict=True))
        return out

    def encode(self, text: str) -> np.ndarray:
        """ids of the whole text as uint16."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: Sequence[str]) -> list[np.ndarray]:
        pieces = [t.replace("\n", " ").replace("\t", " ").split(" ") for t in texts]
        get = self.cache.get
        found = [list(map(get, ws)) for ws in pieces]
        missing = {w for ws, known in zip(pieces, found, strict=True) for w, ids in zip(ws, known, strict=True) if ids is None}
        new = self._encode_new(missing) if missing else {}
        if missing:
            found = [[new[w] if ids is None else ids for w, ids in zip(ws, known, strict=True)] for ws, known in zip(pieces, found, strict=True)]
        # What came first stays: frequent words come early.
        self.cache.update(islice(new.items(), max(0, self.entries - len(self.cache))))
        return [np.frombuffer(b"".join(known), np.uint16) for known in found]


def tokenizer(path: str) -> CachedTokenizer:
    """One for each worker process, kept between tasks."""
    if path not in _loaded:
        _loaded[path] = CachedTokenizer(path)
    return _loaded[path]
