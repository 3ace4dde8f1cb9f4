"""The text operators against brute force on small, awkward fixtures."""

import collections
import hashlib
import re
import struct
import zlib
from array import array

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import fingerprints, jaccard_join, line_dedup, packing, quality_rules, sentencepiece_fst, suffix_dedup, texthash, token_blocks, toxicity, url_filter
from tidemark.llm.components import components
from tidemark.llm.tokens import tokenizer, vocabulary_path

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, k long, n int"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(7)
    vocabulary = ["".join(r.choice(list("abcdeé"), r.integers(2, 7))) for _ in range(400)]
    draw = lambda n: " ".join(r.choice(vocabulary, n))
    base, passage = draw(120), draw(90)
    texts = [None, "", " \n\t ", "one two", "One  two", "É à", base, base, base.upper()]
    for i in range(30):  # near copies
        w = base.split()
        for j in r.integers(0, len(w), r.integers(0, 5)):
            w[j] = "x%d" % i
        texts.append(" ".join(w))
    texts += [f"{draw(60)}\nShared line of the corpus\n{draw(5)}\n{passage} {draw(30)}" for _ in range(25)]
    texts += [draw(int(n)) + "\n" + draw(8) + ".\n Shared LINE of the corpus \n" for n in r.integers(1, 200, 30)]
    texts += ["a " * 3000, "w" * 5000, draw(6000), "na " * 10, "Σ <|endoftext|> 漢字 🙂 ﬁ  it's I'LL\r\n"]
    return [(i, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", 1, 2) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Null and repeated ids, repeated rows."""
    t = "a line that is long enough\nother words here"
    return spark.createDataFrame([(None, t, "x", 1, 1), (3, t, "x", 1, 1), (3, t, "x", 1, 1), (3, "different", None, None, None), (1, None, None, None, None)], SCHEMA)


def test_token_blocks_round_trip():
    r = np.random.default_rng(0)
    for n in (0, 1, 127, 128, 129, 1000):
        for top in (2, 300, 49408, 2**32):
            ids = r.integers(0, top, n).astype(np.uint32)
            ids[r.random(n) < 0.02] = top - 1
            packed = token_blocks.pack(ids)
            assert token_blocks.unpack(packed, n).tolist() == ids.tolist()
    assert token_blocks.pack(np.r_[np.zeros(127, np.uint32), 2**31].astype(np.uint32))["exceptions"]


def test_cached_tokens_equal_the_library(rows):
    t = tokenizer(vocabulary_path())
    got = t.encode_all([x or "" for _, x in rows])
    for ids, (_, x) in zip(got, rows):
        assert ids.tolist() == t.tokenizer.encode(x or "", add_special_tokens=False).ids


def test_files_hold_every_document(spark, docs, rows, tmp_path):
    token_blocks.write_blocks(docs, str(tmp_path / "t"), vocabulary_path(), segment_ids=1000)
    got = {r["doc_id"]: r for r in token_blocks.read_documents(spark, str(tmp_path / "t")).collect()}
    t, start = tokenizer(vocabulary_path()).tokenizer, 0
    for i, x in rows:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        want = (start, len(ids), zlib.crc32(array("I", ids).tobytes()))
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == want
        start += len(ids)


def test_packing_is_gapless(docs, rows):
    got = packing.pack_documents(docs, vocabulary_path()).toPandas()
    t = tokenizer(vocabulary_path()).tokenizer
    assert sorted(got["doc_id"].unique()) == [i for i, _ in rows]
    for i, g in got.groupby("doc_id"):
        ids, at = [*t.encode(rows[i][1] or "", add_special_tokens=False).ids, 1], 0
        for p in g.sort_values("start").itertuples():
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(array("I", ids[at : at + p.length]).tobytes())
            at += p.length
        assert at == len(ids)
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == np.r_[0, g["length"].cumsum()[:-1]].tolist()
        total = int(g["length"].sum())
        assert total <= 2048 and total & (total - 1) == 0


def test_sum_of_squares_picks_the_least(spark):
    s = packing.SumOfSquares(16)
    r = np.random.default_rng(3)
    for i in range(200):
        size = int(r.integers(1, 16))
        changes = {}
        for h in range(0, 17 - size):
            if h == 0 or s.n[h]:
                n = s.n.copy()
                n[h] -= 1 if h else 0
                if h + size < 16:
                    n[h + size] += 1
                changes[h] = int((n[1:16] ** 2).sum())
        assert changes[s.level(size)] == min(changes.values())
        s.place((i, 0, size, np.zeros(size, np.uint16)))


def test_open_windows_keep_what_was_placed():
    r = np.random.default_rng(8)
    s, closed, placed = packing.SumOfSquares(256), [], 0
    for i in range(3000):
        size = int(r.integers(1, 256))
        placed += size
        if full := s.place((i, 0, size, np.full(size, i, np.uint16))):
            closed.append(full)
    gaps = sum((256 - h) * len(s.open[h]) for h in range(1, 256))
    rest = list(s.rest())
    assert s.moved <= gaps and sum(len(p[3]) for w in closed + rest for p in w) == placed
    sizes = [sum(len(p[3]) for p in w) for w in rest]
    assert all(n & (n - 1) == 0 for n in sizes) and all(n < 256 for n in sizes[len(sizes) - 8 :] if n != 256)
    whole = collections.Counter()
    for w in closed + rest:
        for i, start, _, ids in w:
            assert (ids == i % 65536).all()
            whole[i] += len(ids)
    assert len(whole) == 3000 and not list(packing.SumOfSquares(16).rest())


def test_packing_of_odd_rows(odd, empty):
    """Null and repeated ids are documents of their own; no text is the end id alone."""
    got = packing.pack_documents(odd, vocabulary_path()).collect()
    assert sorted((str(g["doc_id"]) for g in got if g["start"] == 0)) == ["1", "3", "3", "3", "None"]
    assert [g["doc_tokens"] for g in got if g["doc_id"] == 1] == [1]
    assert packing.pack_documents(empty, vocabulary_path()).count() == 0


def brute_components(rows):
    sets = {}
    for i, x in rows:
        w = words((x or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_jaccard_classes_equal_brute_force(docs, rows):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.classes(docs).collect()}
    assert got == brute_components(rows)


@pytest.mark.parametrize(("leaf", "edits", "clusters"), [(8, 6, 1), (16, 16, 3)])
def test_jaccard_recursion_equals_brute_force(spark, leaf, edits, clusters):
    """Groups beyond a leaf, dense ones and ones that fall into cells, joined to one another."""
    r = np.random.default_rng(leaf)
    rows, shared = [], [f"s{i}" for i in range(40)]
    for c in range(clusters):
        base = shared + [f"w{c}-{i}" for i in range(60)]
        for _ in range(90 // clusters):
            w = list(base)
            for j in r.integers(0, len(w), int(r.integers(0, edits))):
                w[j] = f"v{r.integers(0, 3)}"
            rows.append((len(rows), " ".join(w)))
    got = jaccard_join.classes(spark.createDataFrame(rows, "doc_id long, text string"), leaf=leaf).collect()
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in got} == brute_components(rows)


def test_links_of_a_clique_are_as_many_as_its_members(spark):
    r = np.random.default_rng(1)
    rows, base = [], [f"w{i}" for i in range(150)]
    for i in range(3000):
        w = list(base)
        w[int(r.integers(0, 150))] = f"x{i}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sig = jaccard_join.signatures(docs, jaccard_join.frequent_bits(docs))
    assert jaccard_join.links(docs, sig).count() < 4 * len(rows)
    assert {x["component_id"] for x in jaccard_join.classes(docs).collect()} == {0}


def test_jaccard_tells_rows_of_one_id_apart(spark):
    r = np.random.default_rng(9)
    draw = lambda: [f"v{i}" for i in r.integers(0, 5000, 60)]
    near = lambda w, n=1: [*w[:-n], *[f"x{i}" for i in r.integers(0, 5000, n)]]
    a, b, c, d, e = (draw() for _ in range(5))
    rows = [(1, a), (None, near(a)), (None, b), (None, near(b)), (7, c), (7, d), (4, near(d)), (None, [*near(d)]), (7, e), (7, near(e)), (7, c), (7, c), (9, near(c)), (None, b)]
    chain = [draw()]
    for _ in range(5):
        chain.append([f"y{len(chain)}{i}" for i in range(3)] + chain[-1][3:] if len(chain) % 2 else near(chain[-1], 3))
    rows += [(None, w) for w in chain[1:]] + [(20, chain[0])]
    rows = [(i, " ".join(w)) for i, w in rows]
    of_row = brute_components(list(enumerate(t for _, t in rows)))
    least = collections.defaultdict(list)
    for at, (i, _) in enumerate(rows):
        least[of_row[at][1]].append(jaccard_join.NULL_ID if i is None else i)
    least = [min(least[of_row[at][1]]) for at in range(len(rows))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = [(i, of_row[at][0], None if least[at] == jaccard_join.NULL_ID else least[at]) for at, (i, _) in enumerate(rows)]
    assert sorted(map(tuple, jaccard_join.classes(docs).collect()), key=str) == sorted(want, key=str)
    stay = [row for at, row in enumerate(rows) if least[at] == (jaccard_join.NULL_ID if row[0] is None else row[0])]
    assert sorted(map(tuple, jaccard_join.first_of_classes(docs).collect()), key=str) == sorted(stay, key=str)
    assert (None, rows[2][1]) in stay and (None, rows[1][1]) not in stay


def test_components_of_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert components(links.where("a < 0")).count() == 0


def test_line_bitmaps(docs, rows, odd, empty):
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs, salts=2).collect()}
    first, holders = {}, collections.defaultdict(set)
    key = lambda line: line.strip(" \t\n\v\f\r").translate(LOWER)
    for i, x in rows:
        for line in (x or "").split("\n"):
            holders[key(line)].add(i)
            first.setdefault(key(line), i)
    for i, x in rows:
        lines = (x or "").split("\n")
        kept = [v for v in lines if len(key(v)) < 10 or len(holders[key(v)]) < 2 or first[key(v)] == i]
        assert (got[i]["n_lines"], got[i]["n_dropped"], got[i]["kept"]) == (len(lines), len(lines) - len(kept), "\n".join(kept))
    # Only where lines go is there a bitmap, and other lines of a long text are in none of its runs.
    long = "\n".join(["the same long line"] * 300 + [f"line of its own {i}" for i in range(500)] + ["the same long line"])
    two = docs.sparkSession.createDataFrame([(1, "x\nthe same long line"), (2, long), (3, None)], "doc_id long, text string")
    two = two.withColumns({c: F.lit(7) for c in ("kept", "n_lines", "n_dropped", "keep", "k", "t", "words")})
    maps = {r["k"]: r["keep"] for r in line_dedup.keep_bitmaps(two, salts=2).collect()}
    assert [(r["word"], r["times"], r["bits"]) for r in maps[2]] == [(0, 4, 0), (4, 1, -(1 << 44)), (12, 1, ~(1 << 32))] and len(maps) == 1
    cut = line_dedup.without_lines(two, line_dedup.keep_bitmaps(two))
    left = {r["doc_id"]: r for r in cut.collect()}
    assert cut.columns == two.columns and left[2]["text"] == "\n".join(f"line of its own {i}" for i in range(500))
    assert left[1]["text"] == "x\nthe same long line" and left[3]["text"] is None and {r["n_lines"] for r in left.values()} == {7}
    kept = [(r["doc_id"], r["n_dropped"]) for r in line_dedup.dedup_lines(odd).collect()]
    assert sorted(kept, key=str) == sorted([(None, 2), (3, 0), (3, 0), (3, 0), (1, 0)], key=str)
    assert line_dedup.dedup_lines(empty).count() == 0


def test_fingerprints(docs, rows, odd, empty):
    got = {r["doc_id"]: r for r in fingerprints.compare(docs, 4).collect()}
    for at, (i, x) in enumerate(rows):
        x, after = x or "", rows[(at + 1) % len(rows)][1] or ""
        q = len(x) // 4
        assert got[i]["n_chars"] == len(x) and got[i]["edited_sha256"] == hashlib.sha256((x[: len(x) - q] + after[:q]).encode()).hexdigest()
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
    by_text = collections.defaultdict(set)
    for i, x in rows:
        by_text[x or ""].add(got[i]["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values()) and got[6]["near_next"] == 1.0
    assert fingerprints.compare(odd, 4).count() == 5 and fingerprints.compare(empty, 4).count() == 0


def test_fingerprint_likeness_with_repeated_paragraphs(spark):
    """Against the true share of the multisets, where lines stand up to fifty times."""
    r = np.random.default_rng(11)
    texts = ["\n".join(f"line {j}" for j in r.integers(0, 40, int(r.integers(1, 30))) for _ in range(int(r.choice([1, 2, 50])))) for _ in range(150)]
    got = {x["doc_id"]: x for x in fingerprints.compare(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 4).collect()}
    cut = lambda text: collections.Counter(p for p in re.split(fingerprints.PARAGRAPH_END, text) if p)
    errors = []
    for i, own in enumerate(texts):
        follows, n = texts[(i + 1) % len(texts)], len(own) // 4
        for column, other in (("near_edited", own[: len(own) - n] + follows[:n]), ("near_next", follows)):
            a, b = cut(own), cut(other)
            errors.append(got[i][column] - sum((a & b).values()) / sum((a | b).values()))
    assert np.sqrt(np.mean(np.square(errors))) < 0.05 and np.abs(errors).max() < 0.2


def test_fingerprints_are_homomorphic(spark):
    rows = [(1, "first line\nsecond line"), (2, "second line\nfirst line"), (3, "first line"), (4, "second line")]
    got = {r["doc_id"]: r["v"] for r in fingerprints.fingerprint(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == got[2] == [a + b for a, b in zip(got[3], got[4])]
    # Likeness estimates the common share of the paragraphs, within three standard errors of 120 lanes.
    r = np.random.default_rng(4)
    mixed = []
    for i in range(60):
        mine, both = int(r.integers(0, 60)), int(r.integers(0, 60))
        mixed.append((i, "\n".join([f"common {i} {j}" for j in range(both)] + [f"own {i} {j}" for j in range(mine)])))
        mixed.append((i + 100, "\n".join([f"common {i} {j}" for j in range(both)] + [f"other {i} {j}" for j in range(mine)])))
    prints = fingerprints.fingerprint(spark.createDataFrame(mixed, "doc_id long, text string"))
    a, b = prints.where("doc_id < 100").select("doc_id", F.col("v").alias("a")), prints.where("doc_id >= 100").select((F.col("doc_id") - 100).alias("doc_id"), F.col("v").alias("b"))
    found = {x["doc_id"]: x["l"] for x in a.join(b, "doc_id").select("doc_id", fingerprints.likeness(F.col("a"), F.col("b")).alias("l")).collect()}
    count = lambda i, w: mixed[2 * i][1].count(w)
    true = [count(i, "common") / max(1, count(i, "common") + 2 * count(i, "own")) for i in range(60)]
    assert max(abs(found[i] - true[i]) for i in range(60) if mixed[2 * i][1]) < 0.2 and np.mean([abs(found[i] - t) for i, t in enumerate(true) if mixed[2 * i][1]]) < 0.06
    one = spark.createDataFrame([(got[1], got[4])], "a array<bigint>, b array<bigint>").select(fingerprints.delete(F.col("a"), F.col("b")).alias("x")).first()
    assert one["x"] == got[3]


@pytest.mark.parametrize("leaf_rows", [4096, 2])
def test_repeated_bytes_equal_brute_force(docs, rows, leaf_rows):
    got = {r["k"]: r for r in suffix_dedup.dedup_bytes(docs, leaf_rows=leaf_rows).collect()}
    raw = {i: (x or "").encode() for i, x in rows}
    counts = collections.Counter(b[p : p + 400] for b in raw.values() for p in range(len(b) - 399))
    for i, b in raw.items():
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 399):
            if counts[b[p : p + 400]] > 1:
                gone[p : p + 400] = True
        spans = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
        kept = hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == (len(b), int(gone.sum()), spans, kept)


def test_large_cores_are_split(spark):
    """Texts that share a long core with differing edges, in groups far over a leaf."""
    r = np.random.default_rng(6)
    core, ends = "".join(r.choice(list("abcdefgh"), 396)), ["".join(r.choice(list("xy"), 8)) for _ in range(60)]
    rows = [(i, "".join(r.choice(list("pq"), 3)) + e[:4] + core + e[4:] + "".join(r.choice(list("pq"), 3))) for i, e in enumerate(ends)]
    rows += [(100 + i, f"{'z' * i}{core}tt{i % 3}{i}") for i in range(12)]
    got = {g["k"]: g for g in suffix_dedup.dedup_bytes(spark.createDataFrame(rows, "doc_id long, text string"), leaf_rows=3).collect()}
    counts = collections.Counter(t[p : p + 400] for _, t in rows for p in range(len(t) - 399))
    for i, t in rows:
        gone = {q for p in range(len(t) - 399) if counts[t[p : p + 400]] > 1 for q in range(p, p + 400)}
        assert got[i]["n_removed"] == len(gone)
    assert sum(g["n_removed"] > 0 for g in got.values()) > 20


def test_interval_expansion_equals_counting():
    r = np.random.default_rng(0)
    for _ in range(100):
        parts = []
        for i in range(int(r.integers(1, 6))):
            parts += [*r.integers(0, 3, r.integers(0, 30)), 1000 + i]
        s, n = np.array(parts), int(r.integers(1, 7))
        c = collections.Counter(tuple(s[i : i + n]) for i in range(len(s) - n + 1))
        assert suffix_dedup.repeated_strings(s, n).tolist() == [i + n <= len(s) and c[tuple(s[i : i + n])] > 1 for i in range(len(s))]


def test_quality_statistics(docs, rows, odd, empty):
    got = {r["doc_id"]: r for r in quality_rules.judge(docs).collect()}
    for i, x in rows:
        x, w = x or "", words(x)
        lines = [v for v in x.split("\n") if words(v)]
        c = collections.Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        covered = {j + o for j in range(len(w) - 2) if c[tuple(w[j : j + 3])] > 1 for o in range(3)}
        g = got[i]
        assert (g["n_words"], g["word_chars"], g["n_symbols"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)))
        assert (g["n_dup_lines"], g["n_repeat_words"]) == (len(lines) - len(set(lines)), len(covered))
        assert g["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (g["base_failed"] and g["kept"])
    assert quality_rules.judge(odd).count() == 5 and quality_rules.judge(empty).count() == 0


def test_shift_and_equals_regular_expressions():
    r = np.random.default_rng(2)
    globs = ["".join(r.choice(list("ab*"), r.integers(1, 9))) for _ in range(60)]
    urls = ["".join(r.choice(list("ab"), r.integers(0, 12))).encode() for _ in range(200)]
    found = url_filter.ShiftAnd(globs).match(urls)
    assert url_filter.ShiftAnd(globs).words > 1
    for g, glob in enumerate(globs):
        p = re.compile(".*".join(map(re.escape, glob.split("*"))))
        assert found[:, g].tolist() == [bool(p.fullmatch(u.decode())) for u in urls]


def test_url_verdicts(spark):
    urls = [None, "", "no scheme", "http://A.Example.ORG/es/x?y#z", "http://example.org", "http://example.org/en/12", "https://x.com/de/a", "https://x.com/fr", "http://notexample.org/es/", "http://a.net/?u=http://b.com/de/"]
    got = [(r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).orderBy("page_id").collect()]
    assert got == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("a.example.org", "/es/x", "example.org/es/", "block"), ("example.org", "", None, "allow"),
        ("example.org", "/en/12", "example.org/en/1", "block"), ("x.com", "/de/a", "com/de/", "block"), ("x.com", "/fr", None, "allow"), ("notexample.org", "/es/", "org/", "allow"), ("a.net", "/", None, "allow"),
    ]


def test_urls_in_paths_keep_their_hosts(spark):
    urls = [
        "http://a.net/x.com/de/", "https://web.archive.org/web/2020/http://www.b.com/de/", "http://a.net/.com/de/", "http://a.net/b.example.org/es/", "http://b.com//de/", "http://.com/de/",
        "http://b.com/fr/x.com/de/", "http://a.com.net/com/de/", "http://com/de/", "http://a.b.example.org/en/1/x.com/de/",
    ]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = [(r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages).orderBy("page_id").collect()]
    assert got == [
        (None, "allow"), ("org/", "allow"), (None, "allow"), (None, "allow"), (None, "allow"), ("com/de/", "block"),
        ("com/fr/", "allow"), (None, "allow"), ("com/de/", "block"), ("example.org/en/1", "block"),
    ]
    wild = [(r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, (("block", "a*.net", "/*/de/"),)).orderBy("page_id").collect()]
    assert wild == [("a*.net/*/de/", "block") if i in (0, 2, 7) else (None, "allow") for i in range(len(urls))]


def test_transducer_equals_the_library(docs, rows, empty):
    import sentencepiece

    path = vocabulary_path(sentencepiece_fst.MODEL)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r["doc_id"]: r for r in sentencepiece_fst.encode_documents(docs, path).collect()}
    for i, x in rows:
        ids = library.encode(x or "")
        assert array("H", got[i]["ids"]).tolist() == ids and got[i]["same"] and got[i]["decoded"] == library.decode(ids)
    assert sentencepiece_fst.encode_summary(empty, path).count() == 0


def _message(number, value):
    head = lambda kind: bytes((number << 3 | kind,))
    if isinstance(value, float):
        return head(5) + struct.pack("<f", value)
    if isinstance(value, int):
        return head(0) + bytes((value,))
    size, out = len(value), b""
    while size > 127:
        out, size = out + bytes((size & 127 | 128,)), size >> 7
    return head(2) + out + bytes((size,)) + value


@pytest.mark.parametrize(("rules", "squeeze"), [("identity", 0), ("nmt_nfkc", 1), ("nmt_nfkc_cf", 0)])
def test_unigram_models_equal_the_library(rows, tmp_path, rules, squeeze):
    """A model written by hand: random scores, byte fallback, the library's own rewriting rules."""
    import sentencepiece

    r = np.random.default_rng(3)
    pieces = {"".join(r.choice(list("abcdeé \u2581ofi"), r.integers(1, 6))).replace(" ", "") or "a" for _ in range(300)} | set("abcde\u2581")
    model = b"".join(_message(1, _message(1, n) + _message(2, 0.0) + _message(3, k)) for n, k in ((b"<unk>", 2), (b"<s>", 3), (b"</s>", 3)))
    model += b"".join(_message(1, _message(1, b"<0x%02X>" % b) + _message(2, 0.0) + _message(3, 6)) for b in range(256))
    model += b"".join(_message(1, _message(1, n.encode()) + _message(2, float(-r.uniform(1, 12)))) for n in sorted(pieces))
    model += _message(2, _message(3, 1) + bytes((35 << 3 & 127 | 128, 35 >> 4, 1)))
    charsmap = next((v for n, _, v in sentencepiece_fst._fields(next(v for n, _, v in sentencepiece_fst._fields(sentencepiece.SentencePieceNormalizer(rule_name=rules).serialized_model_proto()) if n == 3)) if n == 2), b"")
    model += _message(3, _message(1, rules.encode()) + _message(2, charsmap) + _message(3, 1) + _message(4, squeeze) + _message(5, 1))
    path = str(tmp_path / "unigram.model")
    with open(path, "wb") as f:
        f.write(model)
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_fst.PieceTransducer(path)
    for text in [x or "" for _, x in rows] + ["ＡＢＣ  ﬁ ①  ㍿ e\u0301 ", "  ", " a\tb ", "Ω Å ½"]:
        assert array("H", own.encode(text)).tolist() == library.encode(text), text[:80]
        assert own.decode(array("H", own.encode(text))) == own.kept(text)
    with open(path, "ab") as f:
        f.write(_message(1, _message(1, b"own") + _message(3, sentencepiece_fst.USER_DEFINED)))
    with pytest.raises(ValueError):
        sentencepiece_fst.PieceTransducer(path)


def test_transducer_of_odd_rows(odd):
    path = vocabulary_path(sentencepiece_fst.MODEL)
    got = sentencepiece_fst.encode_summary(odd, path).collect()
    assert sorted(str(g["doc_id"]) for g in got) == ["1", "3", "3", "3", "None"] and all(g["round_trip"] for g in got)
    assert [g["n_pieces"] for g in got if g["doc_id"] == 1] == [0]


def test_toxicity_on_held_out_rows(spark, empty, monkeypatch):
    r = np.random.default_rng(11)
    common, bad = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)], ["vilest", "rotten", "awfully"]
    rows, labels = [], []
    for i in range(600):
        toxic = int(r.random() < 0.2)
        text = [*r.choice(common, 60), *(r.choice(bad, 3) if toxic else [])]
        r.shuffle(text)
        rows.append((i, " ".join(text)))
        labels.append((i, 1, toxic))
    rows.append((600, None))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([*labels, (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    index = toxicity.fit(docs, known)
    got = {x["doc_id"]: x for x in toxicity.score(docs, index).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i]["predicted"] == labels[i][2] for i in held]) > 0.97 and 0 <= got[600]["score"] < 0.5
    assert all(e in range(600) and zlib.crc32(str(e).encode()) % 5 for i in held for e in got[i]["evidence"])
    # The same with an index that holds half of the toxic rows, and a small calibration.
    monkeypatch.setattr(toxicity, "CALIBRATION_ROWS", 100)
    small = toxicity.fit(docs, known, index_rows=100)
    again = {x["doc_id"]: x["predicted"] for x in toxicity.score(docs, small).collect()}
    assert np.mean([again[i] == labels[i][2] for i in held]) > 0.95 and small.labels.sum() == 50
    # Neighbours by blocks are those of a full scan over all words, and every text with words has some.
    dense = np.zeros((len(index.ids), len(index.terms.names)))
    for j, i in enumerate(index.ids):  # from the examples' texts, whatever the index makes of them
        at, dense_row = index.terms.unit(*index.terms.counts(rows[i][1]))
        dense[j, at] = dense_row
    monkeypatch.setattr(toxicity, "OFTEN", 1)  # the same examples with all terms in postings
    bags = [index.terms.counts(rows[i][1]) for i in index.ids]
    sparse = toxicity.BlockMaxIndex(index.terms, index.ids.tolist(), index.labels.tolist(), bags, index.base_rate)
    assert len(index.matrix) and len(sparse.place) and not len(sparse.matrix)
    np.testing.assert_allclose((dense**2).sum(axis=1), 1)
    for i, text in rows[:50]:
        at, w = index.terms.unit(*index.terms.counts(text + " Unseen word"))
        places, cosines, _ = index.nearest(at, w)
        np.testing.assert_allclose(sparse.nearest(at, w)[1], cosines)
        full = dense[:, at] @ w
        assert places.tolist() == np.lexsort((np.arange(len(full)), -full.round(12)))[: len(places)].tolist() or np.allclose(full[places], np.sort(full)[::-1][: len(places)])
        assert 0 < (w**2).sum() < 1 and len(got[i]["evidence"]) == toxicity.K
    assert toxicity.score(empty, toxicity.fit(empty, known)).count() == 0


def test_toxicity_of_odd_rows(spark, odd, empty):
    """Null and repeated ids and labels, texts without words, a text of a million words, ties."""
    r = np.random.default_rng(2)
    texts = [" ".join(r.choice(["foul", "nasty", "plain", "word", "other"], 20)) for _ in range(40)]
    docs = spark.createDataFrame([(i, t, "x", 1, 1) for i, t in enumerate(texts)], SCHEMA).unionByName(odd)
    docs = docs.unionByName(spark.createDataFrame([(90, "12 34 !", "x", 1, 1), (91, "plain " * 300_000, "x", 1, 1), (92, "", "x", 1, 1)], SCHEMA))
    known = spark.createDataFrame([(i, 1, i % 2) for i in range(40)] + [(3, 1, None), (3, 1, 0), (None, 1, 1), (500, 1, 1), (90, 1, 0)], "doc_id long, quality int, toxic int")
    index = toxicity.fit(docs, known)
    got = toxicity.score(docs, index).collect()
    assert len(got) == 48 and all(0 <= g["score"] <= 1 and g["predicted"] == (g["score"] >= 0.5) for g in got)
    assert len({g["score"] for g in got if g["doc_id"] in (90, 92)}) == 1
    kept = toxicity.drop_toxic(docs, index)
    assert kept.columns == docs.columns and kept.count() == sum(g["score"] < 0.5 for g in got)
    nothing = toxicity.fit(docs, known.where("false"))
    assert {g["score"] for g in toxicity.score(docs, nothing).collect()} == {0.0}


def test_repeated_and_null_ids(odd, empty):
    got = [(r["doc_id"], r["component_id"]) for r in jaccard_join.classes(odd).collect()]
    assert sorted(got, key=str) == sorted([(None, 3), (3, 3), (3, 3), (3, 3), (1, 1)], key=str)
    assert jaccard_join.classes(empty).count() == 0 and jaccard_join.first_of_classes(odd).columns == odd.columns
    assert suffix_dedup.dedup_bytes(odd).count() == 5 and suffix_dedup.dedup_bytes(empty).count() == 0
    assert suffix_dedup.without_repeats(odd).count() == 5


def test_hashes_do_not_depend_on_cuts():
    r = np.random.default_rng(4)
    text = " ".join("".join(r.choice(list("abcXYZ"), r.integers(1, 9))) for _ in range(3000)).encode()
    assert texthash.text_words(text, 500).tolist() == texthash.word_hashes(np.frombuffer(text, np.uint8)).tolist()
    assert len(texthash.text_words(b"")) == 0
