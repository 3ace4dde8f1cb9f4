"""Decontamination, conversation repair and collocations against brute force on awkward fixtures."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from tidemark.llm import collocations, conversation_repair, decontamination

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- decontamination


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def contaminated(text, items, width):
    """Words, hit words and items by looking for every window everywhere."""
    w, hit, found = item_words(text), set(), set()
    for item, passage in items:
        p = item_words(passage)
        k = min(width, len(p))
        for i in range(len(p) - k + 1 if p else 0):
            for at in range(len(w) - k + 1):
                if w[at : at + k] == p[i : i + k]:
                    hit |= set(range(at, at + k))
                    found.add(item or "")
    return len(w), len(hit), sorted(found)


ITEMS = [
    ("b", "One two three, four FIVE six seven eight nine ten eleven twelve."),
    ("a", "two three four five six seven eight nine ten eleven and on"),
    ("a", "two three four five six seven eight nine ten eleven and on"),
    ("c", "short item"),
    (None, "Wort"),
    ("d", ""),
    ("e", None),
    ("é", "naïve CAFÉ über straße 漢字 x1 x2 x3 x4 x5 x6"),
    ("f", "la la la la la la la la la la la la"),
]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    draw = lambda n: " ".join(r.choice(["one", "two", "la", "item", "short", "wort", "x1", "é"]) for _ in range(n))
    out = [None, "", " .,! ", ITEMS[0][1], ITEMS[0][1].upper(), "zero " + ITEMS[0][1] + " tail " + ITEMS[0][1]]
    out += [f"{draw(5)} {ITEMS[1][1]} {draw(5)}", "la " * 40, "naïve CAFÉ über straße 漢字 x1 x2 x3 x4 x5 x6", "shorter items"]
    out += [draw(r.randint(0, 60)) for _ in range(30)] + [draw(6000) + ITEMS[7][1]]
    return list(enumerate(out))


@pytest.mark.parametrize("broadcast", [1 << 20, 0])
def test_windows_of_items_are_found(spark, texts, broadcast, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", broadcast)
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in texts], "doc_id long, text string, k int, n int").repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontamination.contamination(docs, items).collect()}
    want = {i: contaminated(t, ITEMS, 10) for i, t in texts}
    assert got == want and sum(v[1] > 0 for v in want.values()) > 10
    kept = decontamination.clean(docs, items)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, v in want.items() if not v[1]}


def test_no_items_no_documents_repeated_rows(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (1, "c")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b"), (10, "b"), (2, "b")], "item_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_hit"], r["items"]) for r in decontamination.contamination(docs, items).collect())
    assert got == [(0, 2, ["1", "10", "2"]), (1, 0, []), (1, 2, ["1", "10", "2"]), (1, 2, ["1", "10", "2"])]
    assert all(r["n_hit"] == 0 for r in decontamination.contamination(docs, items.limit(0)).collect())
    assert decontamination.contamination(docs.limit(0), items).count() == 0


# --- conversations


def repaired(rows):
    """(cost, audit, repaired rows) by trying ever longer strings of edits, cheapest first."""
    import heapq

    steps = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    heap, seen = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, i, q, out = heapq.heappop(heap)
        if i == len(rows) and q in (0, 3):
            return cost, audit, [r for r in out]
        if (i, q) in seen:
            continue
        seen.add((i, q))
        for role in ("user", "assistant"):
            if (q, role[0]) in steps:
                heapq.heappush(heap, (cost + 3, audit + "I", i, steps[q, role[0]], (*out, (role, ""))))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, q, out))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if (q, role[:1]) in steps:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, steps[q, role[:1]], (*out, (role, text))))
                for new in ("user", "assistant"):
                    if (q, new[0]) in steps:
                        heapq.heappush(heap, (cost + more + 3, audit + "R", i + 1, steps[q, new[0]], (*out, (new, text))))


def judged(rows):
    """What the operator should say of rows (turn, role, text, times), before its digest."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x, n in rows for _ in range(n)]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    seen, marked, counts, illegal = set(), [], collections.Counter(), 0
    for i, (turn, role, text) in enumerate(rows):
        body = text.rstrip("\t\n\v\f\r ")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        counts[fault] += 1
        illegal += i > 0 and rows[i - 1][1][:1] + role[:1] not in ("su", "ua", "au")
        marked.append((role, text, fault))
    cost, audit, out = repaired(marked)
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    lines = "\n".join(f"{r}:{x}" for r, x in out)
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256(lines.encode()).hexdigest()


@pytest.fixture(scope="module")
def conversations():
    r = random.Random(5)
    roles = ["system", "user", "assistant", "tool", "", None, "user", "assistant"]
    texts = ["Fine.", "Cut off", "", " \n", "Why?", "No! ", None, "漢字", "x" * 5000 + "."]
    out = []
    for c in range(150):
        for t in range(r.randint(0, 9)):
            out.append((c, r.choice([t, t, t, t + 3, None, 2]), r.choice(roles), r.choice(texts), r.choice([0, 1, 1, 1, 2])))
    out += [(None, 0, "user", "Hi.", 1), (None, 1, "assistant", "Ho.", 1), (999, 0, "user", "gone", 0)]
    out += [(1000, t, ("user", "assistant")[t % 2], f"Turn {t}.", 1) for t in range(3000)] + [(1001, 5, "user", "same.", 400)]
    return out


SCHEMA = "conv_id long, turn long, role string, text string, times long"
FIELDS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_cheapest_edits_of_conversations(spark, conversations):
    df = spark.createDataFrame(conversations, SCHEMA).repartition(5)
    got = {r["conv_id"]: tuple(r[f] for f in FIELDS) for r in conversation_repair.digests(df).collect()}
    groups = collections.defaultdict(list)
    for c, *rest in conversations:
        groups[c].append(tuple(rest))
    assert got == {c: judged(rows) for c, rows in groups.items()}
    assert got[999] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    out = collections.defaultdict(list)
    for r in conversation_repair.repaired(df).orderBy("conv_id", "position").collect():
        out[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    for c, values in got.items():
        assert hashlib.sha256("\n".join(out[c]).encode()).hexdigest() == values[-1]


def test_every_short_string_of_roles(spark):
    machine = conversation_repair.Automaton()
    kinds = [("s", False, False), ("u", True, False), ("u", False, False), ("a", False, False), ("", False, False), conversation_repair.GONE]
    for n in range(5):
        for symbols in itertools.product(kinds, repeat=n):
            rows = [(s or "x", "", "blank" if gone else "truncated" if cut else "") for s, cut, gone in symbols]
            assert machine.repair(list(symbols)) == repaired(rows)[:2]
    assert len(machine.states) < 60


def test_damage(spark):
    rows = [(c, t, "assistant", "A. B! C?") for c in range(20) for t in range(8)] + [(None, None, None, None), (3, 1, None, None)]
    df = conversation_repair.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    text = lambda x: " " if x is None else str(x)
    want = collections.Counter()
    for c, t, role, body in rows:
        how = zlib.crc32(f"{text(c)}:{text(t)}".encode()) % 20
        body = "" if how == 1 else re.sub("[.!?]", "", text(body)) if how == 2 else text(body)
        want[c, t, "user" if how == 4 else text(role), body, {0: 0, 3: 2}.get(how, 1)] += 1
    assert collections.Counter(tuple(r) for r in df.collect()) == want


def test_no_conversations(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert conversation_repair.digests(empty).count() == conversation_repair.repaired(empty).count() == 0


# --- collocations


def mined(rows, least, top):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    f = {k: v for k, v in f.items() if v >= least}
    around = collections.Counter()
    for (lang, p), v in f.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                around[lang, p[i : i + m]] = max(around[lang, p[i : i + m]], v)
    by_lang = collections.defaultdict(list)
    for (lang, p), a in f.items():
        if len(p) > 1 and not 100 * around[lang, p] >= 80 * a:
            score, _, left, right = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            by_lang[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return {(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, v in by_lang.items() for i, (s, a, p, left, right) in enumerate(sorted(v)[:top])}


@pytest.fixture(scope="module")
def prose():
    r = np.random.default_rng(11)
    vocabulary = ["the", "of", "New", "york", "CITY", "é", "漢字", "a-b", "x_1", "in"] + ["w%d" % i for i in range(30)]
    weights = np.r_[np.full(10, 4.0), np.full(30, 1.0)]
    out = [(None, None), ("en", ""), ("en", " \t "), (None, "new york city. " * 20), ("", "p q " * 9)]
    for i in range(120):
        w = list(r.choice(vocabulary, int(r.integers(1, 80)), p=weights / weights.sum()))
        for j in range(0, len(w) - 3, 11):
            w[j : j + 3] = ["New", "york", "city"]
        text = "".join(x + str(r.choice([" ", " ", "\t", "  ", ", ", ".", "\n", "!?", "\v"])) for x in w)
        out.append((["en", "de", None][i % 3], text))
    out.append(("en", "la " * 3000 + "end. " + "of the " * 2000))
    return out


@pytest.mark.parametrize("buffer", [collocations.BUFFER, 700])
def test_phrases_equal_a_count_of_all(spark, prose, buffer):
    docs = spark.createDataFrame([(i, a, b, 1, 2) for i, (a, b) in enumerate(prose)], "doc_id long, lang string, text string, f int, n int").repartition(3)
    got = {tuple(r) for r in collocations.collocations(docs, 5, 60, buffer).collect()}
    want = mined(prose, 5, 60)
    assert got == want and {x[0] for x in want} == {"en", "de", "und", ""} and any(len(x[2].split()) == 4 for x in want)


def test_shares_and_bitmaps(spark, monkeypatch):
    df = spark.range(5000).selectExpr("id % 2 as g", "cast(id as string) as phrase", "id % 7 as v")
    got = collocations.first_of(df, "g", [df.v.desc(), df.phrase], 20).orderBy("g", "rank").collect()
    rows = collections.defaultdict(list)
    for r in df.collect():
        rows[r["g"]].append((-r["v"], r["phrase"]))
    assert [(r["g"], r["rank"], r["phrase"]) for r in got] == [(g, i + 1, p) for g in (0, 1) for i, (_, p) in enumerate(sorted(rows[g])[:20])]
    h = np.random.default_rng(0).integers(-(2**63), 2**63 - 1, 5000)
    bits = collocations.bitmap(spark.createDataFrame([(int(x),) for x in h], "h long"))
    assert collocations.member(bits, h.view(np.uint64)).all()
    other = np.random.default_rng(1).integers(0, 2**64, 50_000, dtype=np.uint64)
    assert collocations.member(bits, other).mean() < 0.1


def test_no_texts(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(empty).count() == 0
