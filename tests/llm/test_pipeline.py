"""Stages of the pipeline: columns, effects on what each stage is given, and brute force over all."""

import collections
import hashlib
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import toxicity
from tidemark.llm.tokens import tokenizer, vocabulary_path

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLASHING = {"kept": "k", "n_lines": 77, "n_dropped": 78, "component_id": 3, "score": 0.5, "t": 1, "k": 2, "u": 3, "n": 4, "ranges": "r"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert after.columns == docs.columns and after.select("doc_id").distinct().count() == after.count()
            assert after.select("doc_id").exceptAll(docs.select("doc_id")).count() == 0
        else:
            assert after.select("doc_id").distinct().count() == docs.count()
        docs = after
        seen.append(docs.count())
    assert seen[0] >= seen[1] == seen[2] >= seen[3] == seen[4]


def test_empty_input(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    assert docs.count() == 0


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Toxic rows, shared lines, near copies, shared passages; nulls, repeats and clashing columns."""
    r = np.random.default_rng(21)
    words = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnrst"]
    draw = lambda n: " ".join(r.choice(words, n))
    base, passage, rows, labels = draw(80), draw(120), [], []
    for i in range(300):
        toxic = i % 6 == 0
        text = [*draw(int(r.integers(20, 60))).split(), *(["vilest", "rotten", "awfully"] if toxic else [])]
        r.shuffle(text)
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    for i in range(12):
        w = base.split()
        w[int(r.integers(0, 80))] = f"x{i}"
        rows.append((400 + i, " ".join(w)))
    rows += [(500 + i, f"{draw(10)}\\n A line that MANY share \\n{draw(10)} {passage} {draw(10)}".replace("\\n", "\n")) for i in range(8)]
    rows += [(600, None), (601, ""), (602, " \n\t"), (603, draw(30_000)), (None, draw(50)), (None, draw(50)), (604, base), (604, base)]
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id long, text string, n_chars long")
    return docs.withColumns({c: F.lit(v) for c, v in CLASHING.items()}).repartition(5), rows, str(folder)


def _sets(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def _plain(docs):
    return sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=str)


def test_each_stage_against_brute_force(spark, corpus, tmp_path):
    docs, _, folder = corpus
    kept = dict(CLASHING)
    stages = dict(corpus_pipeline.STAGES)

    def stage(name, docs):
        stages[name](spark, docs, folder).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert out.columns == docs.columns
            assert {tuple(r[c] for c in kept) for r in out.select(*kept).distinct().collect()} == {tuple(kept.values())}
        return out

    # Toxicity: what goes are rows whose own score says so, among them nearly all toxic ones.
    scores = {(r["doc_id"], r["score"]) for r in toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))).collect()}
    clean = stage("toxicity", docs)
    gone = {i for i, s in scores if s >= 0.5}
    assert {r["doc_id"] for r in clean.select("doc_id").collect()} == {i for i, s in scores if s < 0.5}
    assert len(gone & {i for i in range(0, 300, 6)}) >= 48 and len(gone - {i for i in range(0, 300, 6)}) <= 3
    # Lines: the first holder of a shared line keeps it.
    before, cut = _plain(clean), stage("line_dedup", clean)
    key = lambda line: line.strip(" \t\n\v\f\r").translate(LOWER)
    order = lambda i: 2**63 if i is None else i
    holders = collections.defaultdict(set)
    for i, t in before:
        for line in (t or "").split("\n"):
            holders[key(line)].add(order(i))
    want = [(i, t if t is None else "\n".join(x for x in t.split("\n") if len(key(x)) < 10 or min(holders[key(x)]) == order(i))) for i, t in before]
    assert _plain(cut) == sorted(want, key=str)
    assert {(r["n_chars"], len(r["text"] or "")) for r in cut.where("text is not null").collect() if r["n_chars"] != len(r["text"])} == set()
    # Near copies: of each group of linked sets the document of the least id stays.
    before, one = _plain(cut), stage("jaccard_join", cut)
    sets = [_sets(t) for _, t in before]
    least = [order(i) for i, _ in before]
    changed = True
    while changed:
        changed = False
        for a in range(len(before)):
            for b in range(a):
                if least[a] != least[b] and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    least[a] = least[b] = min(least[a], least[b])
                    changed = True
    assert _plain(one) == sorted((x for x, m in zip(before, least) if order(x[0]) == m), key=str)
    # Repeated bytes: what any other 400 bytes equal goes.
    before, apart = _plain(one), stage("suffix_dedup", one)
    raw = [(t or "").encode() for _, t in before]
    counts = collections.Counter(hashlib.md5(b[p : p + 400]).digest() for b in raw for p in range(len(b) - 399))
    want = []
    for (i, t), b in zip(before, raw):
        stays = np.ones(len(b), bool)
        for p in range(len(b) - 399):
            if counts[hashlib.md5(b[p : p + 400]).digest()] > 1:
                stays[p : p + 400] = False
        want.append((i, t if stays.all() else np.frombuffer(b, np.uint8)[stays].tobytes().decode()))
    assert _plain(apart) == sorted(want, key=str) and any(a != b for a, b in zip(sorted(want, key=str), before))
    # Packing: all ids of all rows, once.
    packed = stage("packing", apart)
    encode = tokenizer(vocabulary_path()).tokenizer.encode
    want = collections.Counter()
    for i, t in _plain(apart):
        want[i] += len(encode(t or "", add_special_tokens=False).ids) + 1
    got = collections.Counter()
    for r in packed.collect():
        got[r["doc_id"]] += r["length"]
    assert got == want
