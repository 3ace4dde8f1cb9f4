"""URL rules as a bit-parallel wildcard automaton.

Every rule becomes glob patterns over the canonical url host + `/` + path: one for the host
itself and one with a leading `*.` for its subdomains, each ending in `*`; a `*` of the host does
not read `/`, so that it never leaves the host.  All patterns are laid end
to end over 64-bit words; a Shift-And step moves all of them over one character at once, and
numpy runs the step for all urls of an Arrow batch together.  `*` is a self loop on the state
before it; states never shift from one pattern into the next, because every first state is
masked out of the shift.  The patterns are a parameter, so their masks are small and broadcast
with the task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (verdict, host, path prefix).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
DEFAULT = "allow"


class ShiftAnd:
    """Many globs (`*` is the only wildcard, any bytes, none too) in multiword Shift-And masks.

    A `*` among the first tied[g] characters of glob g reads no `/`.
    State s of a pattern means: its first s literals are matched; the last state is accepting.
    """

    def __init__(self, globs: Sequence[str], tied: Sequence[int] | None = None):
        self.globs = list(globs)
        starts, literals, loops, free, accepts = [], [], [], [], []
        for glob, bound in zip(self.globs, tied or [0] * len(self.globs), strict=True):
            starts.append(len(literals))
            literals.append(None)
            loops.append(False)
            free.append(False)
            for at, c in enumerate(glob):
                if c == "*":
                    loops[-1] = True
                    free[-1] |= at >= bound
                else:
                    for byte in c.encode():
                        literals.append(byte)
                        loops.append(False)
                        free.append(False)
            accepts.append(len(literals) - 1)
        n = self.words = (len(literals) + 63) // 64
        self.masks = np.zeros((256, n), np.uint64)
        self.loops, self.start = np.zeros((256, n), np.uint64), np.zeros(n, np.uint64)
        bit = lambda i: (i // 64, np.uint64(1) << np.uint64(i % 64))
        for i, (c, stays, any_byte) in enumerate(zip(literals, loops, free, strict=True)):
            w, b = bit(i)
            if c is not None:
                self.masks[c, w] |= b
            if stays:
                self.loops[:, w] |= b
                if not any_byte:
                    self.loops[ord("/"), w] &= ~b
        for i in starts:
            w, b = bit(i)
            self.start[w] |= b
        self.accepts = [bit(i) for i in accepts]

    def match(self, urls: Sequence[bytes]) -> np.ndarray:
        """bool[urls, globs]: whether the whole url fits the glob."""
        lengths = np.array([len(u) for u in urls], np.int64)
        out = np.zeros((len(urls), len(self.globs)), bool)
        order = np.argsort(-lengths, kind="stable")
        flat = np.frombuffer(b"".join(urls[i] for i in order) or b"\0", np.uint8)
        length = lengths[order]
        begin = np.concatenate([[0], np.cumsum(length)[:-1]]) if len(urls) else np.zeros(0, np.int64)
        state = np.repeat(self.start[None, :], len(urls), axis=0)
        one, top = np.uint64(1), np.uint64(63)
        for at in range(int(length[0]) if len(urls) else 0):
            live = int(np.searchsorted(-length, -at, side="left"))  # urls longer than at come first
            s = state[:live]
            moved = s << one
            if self.words > 1:
                moved[:, 1:] |= s[:, :-1] >> top
            read = flat[begin[:live] + at]
            moved &= ~self.start & self.masks[read]
            state[:live] = moved | (s & self.loops[read])
        for g, (w, b) in enumerate(self.accepts):
            out[order, g] = (state[:, w] & b) != 0
        return out


def rule_globs(rules) -> tuple[list[str], list[int], list[int]]:
    """Globs over host + `/` + path, the rule of each, and the length of its host."""
    globs, of, heads = [], [], []
    for i, (_, host, path) in enumerate(rules):
        for head in (host, f"*.{host}"):
            globs.append(f"{head}/{path}*")
            of.append(i)
            heads.append(len(head))
    return globs, of, heads


def judge_urls(pages: DataFrame, rules=RULES, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule, verdict for every url.

    The host is A-Z lower-cased and reaches from the first `://` to `/`, `?`, `#` or the end; the
    path from there to `?`, `#` or the end; without `://` or url both are empty.  A host never
    holds `/`, so that the first one parts host and path, and no `*` of a rule's host reads it.  The
    longest rule text wins; where no rule fits, rule is null and the verdict is `default`.  Repeated
    and null page_ids are rows as any other.  A rule holding `*` keeps its meaning as a wildcard.
    """
    globs, of, heads = rule_globs(rules)
    names = [f"{host}{path}" for _, host, path in rules]
    ranked = sorted(range(len(globs)), key=lambda g: (-len(names[of[g]]), of[g]))

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = ShiftAnd(globs, heads)
        for pdf in batches:
            found = automaton.match([f"{h}/{p}".encode() for h, p in zip(pdf["host"], pdf["path"], strict=True)])
            best = np.full(len(pdf), -1)
            for g in reversed(ranked):
                best[found[:, g]] = of[g]
            pdf["rule"] = [None if b < 0 else names[b] for b in best]
            pdf["verdict"] = [default if b < 0 else rules[b][0] for b in best]
            yield pdf

    rest = F.expr("if(contains(url, '://'), substring(url, locate('://', url) + 3), '')")
    split = pages.select("page_id", F.coalesce(rest, F.lit("")).alias("rest")).select(
        "page_id",
        F.translate(F.regexp_extract("rest", r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"),
        F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1).alias("path"),
    )
    return split.mapInPandas(judged, "page_id long, host string, path string, rule string, verdict string")
