"""What the check tool's findings of round 3 came from: rows moved or worked on more often than needed."""

import zlib
from array import array
from collections import Counter

import numpy as np
import pytest
from pyspark import SparkContext

import corpus_pipeline
from tidemark.llm import queries, sentencepiece_fst, token_blocks, toxicity
from tidemark.llm.tokens import CachedTokenizer, tokenizer, vocabulary_path


def test_segments_are_read_where_they_lie(spark, tmp_path):
    rows = [(i, " ".join(f"word{(i * j) % 97}" for j in range(i % 50))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    token_blocks.write_blocks(docs, str(tmp_path / "t"), vocabulary_path(), segment_ids=200)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = token_blocks.read_documents(spark, str(tmp_path / "t"), with_ids=False)
        got = {r["doc_id"]: r for r in found.collect()}
        plan = found._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan and found.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    files = spark.read.parquet(str(tmp_path / "t"))
    assert files.groupBy("shard").count().where("count > 2").count()  # starts are sums over several segments
    t, start = tokenizer(vocabulary_path()).tokenizer, 0
    for i, text in rows:
        ids = [*t.encode(text, add_special_tokens=False).ids, 1]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(array("I", ids).tobytes()))
        start += len(ids)


def test_packed_bytes_are_the_bits_in_order():
    r = np.random.default_rng(5)
    for width in range(1, 33):
        for block in (1, 7, 128):
            values = r.integers(0, 2**32, (3, block)).astype(np.uint32)
            bits = ((values[:, :, None] >> np.arange(width, dtype=np.uint32)) & 1).astype(np.uint8)
            packed = token_blocks._bytes_of(values, width)
            assert (packed == np.packbits(bits.reshape(3, -1), axis=1, bitorder="little")).all()
            assert (token_blocks._values_of(packed, width, block) == values & np.uint32((1 << width) - 1)).all()


def test_stretches_of_several_parts_are_kept():
    fst = sentencepiece_fst.PieceTransducer(vocabulary_path(sentencepiece_fst.MODEL))
    text = "Some wordsq\u6f22x again; zq\u6f22, \U0001f642end."
    ids = fst.encode(text)
    fst._new = lambda stretch: pytest.fail(f"{stretch!r} is cut and searched again")
    assert fst.encode(text) == ids


def test_arcs_of_a_position_are_the_pieces_that_end_there():
    fst = sentencepiece_fst.PieceTransducer(vocabulary_path(sentencepiece_fst.MODEL), entries=50)  # tables overflow
    text, state = "\u2581internationalisation\u6f22\u2581the\u2581underwritten", ""
    for end, c in enumerate(text, 1):
        state, arcs = fst.step(state + c)
        want = [text[begin:end] for begin in range(end - 1) if text[begin:end] in fst.ids]
        assert list(arcs) == [*want, c] and len(fst.steps) <= 51


def test_terms_of_texts_with_a_full_table(monkeypatch):
    monkeypatch.setattr(toxicity, "CACHE_WORDS", 3)
    names = sorted({"the", "word", "words", "word~", "wordi~", "nasti~"})
    terms = toxicity.Terms(names, np.ones(len(names)), 10)
    for text in ("the word the", "Wordiness and words, nastiness; the nasti word unseen unseen", "other new kinds of words"):
        found = toxicity.words_of(text)
        want = {t: sum((w == t) + (t in toxicity.beginnings(w)) for w in found) for t in names}
        counts, unseen = terms.counts(text)
        assert {names[t]: n for t, n in counts.items()} == {t: n for t, n in want.items() if n}
        assert unseen == len(set(found) - set(names)) and sorted(names[t] for t in terms.present(text)) == [t for t in names if want[t]]
        assert {"the", "word"} <= set(terms.known) and len(terms.known) <= 3  # what came first stays


def test_a_product_reads_the_rows_of_the_text_only():
    texts = [f"common often w{chr(97 + i)} w{chr(97 + i // 2)}" for i in range(26)]
    names = sorted({w for t in texts for w in toxicity.words_of(t)})
    terms = toxicity.Terms(names, np.full(len(names), 3), 100)
    index = toxicity.BlockMaxIndex(terms, list(range(26)), [i % 2 for i in range(26)], [terms.counts(t) for t in texts], 0.5)
    at, weights = terms.unit(*terms.counts("common wc wd"))
    want = index.nearest(at, weights, 26)
    index.matrix[index.row[terms.names["often"]]] = np.nan
    got = index.nearest(at, weights, 26)
    assert got[0].tolist() == want[0].tolist() and len(want[0]) == 26
    np.testing.assert_allclose(got[1], want[1])


def test_marks_behind_a_word_are_asked_for_once():
    t = CachedTokenizer(vocabulary_path(), entries=4)
    t.encode("one*** two&&&,")
    t._whole = lambda words: pytest.fail(f"{words} take the whole way") if words else []
    odd = "Three*** él&&&, fiveß*** six seven***"
    assert t.encode(odd).tolist() == t.tokenizer.encode(odd, add_special_tokens=False).ids


def test_a_full_table_of_words_keeps_what_came_first():
    t = CachedTokenizer(vocabulary_path(), entries=4)
    assert set(t.cache) == {""} and t.encode_all(["a", "b", "c"]) and set(t.cache) == {"", "a", "b", "c"}
    texts = ["d d a İx 'tis don't", "", "d\n__e__\tb<|endoftext|>x c's"]
    for _ in range(2):
        found = [ids.tolist() for ids in t.encode_all(texts)]
        assert found == [t.tokenizer.encode(x, add_special_tokens=False).ids for x in texts]
        assert set(t.cache) == {"", "a", "b", "c"}


def test_distinct_words_are_the_words():
    for text in ("a—b b² ½x É_é ü9ß İI ΑΣ ΑΣ.Α", "It's 5x_y\x1cz\x00w It", " café ٥á", ""):
        assert toxicity.distinct_words(text) == Counter(toxicity.words_of(text))
        assert toxicity.distinct_words(text, set) == set(toxicity.words_of(text))


def test_examples_that_are_alike_share_blocks():
    common = ("red green blue pink", "uno dos tres cuatro")
    texts = [f"{common[i % 2]} z{chr(97 + i // 26)}{chr(97 + i % 26)} {common[i % 2].split()[i // 2 % 4]}" for i in range(256)]
    names = sorted({w for t in texts for w in toxicity.words_of(t)})
    df = np.array([sum(n in t.split() for t in texts) for n in names])
    terms = toxicity.Terms(names, df, 300)
    index = toxicity.BlockMaxIndex(terms, list(range(256)), [i % 2 for i in range(256)], [terms.counts(t) for t in texts], 0.5)
    for text in (texts[5], texts[6], "red green unknown", "uno dos zaa"):
        at, cosines, read = index.nearest(*terms.unit(*terms.counts(text)), 15)
        assert read <= 3 and len(at) == 15
        vectors = np.zeros((257, len(names)))
        for j, t in enumerate([*(texts[i] for i in index.ids), text]):
            where, w = terms.unit(*terms.counts(t))
            vectors[j, where] = w
        want = vectors[:256] @ vectors[256]
        np.testing.assert_allclose(cosines, np.sort(want)[::-1][:15])
        np.testing.assert_allclose(want[at], cosines)


def test_what_fit_sends_round_is_dropped(spark, monkeypatch):
    sent, broadcast = [], SparkContext.broadcast
    monkeypatch.setattr(SparkContext, "broadcast", lambda self, value: sent.append(broadcast(self, value)) or sent[-1])
    docs = spark.createDataFrame([(i, f"word{chr(97 + i % 7)} nasty{chr(97 + i % 2)} text") for i in range(120)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, toxic int")
    toxicity.fit(docs, labels, index_rows=20)
    assert len(sent) >= 2 and not any(b._jbroadcast.isValid() for b in sent)


def test_passages_of_over_50_words_are_read_by_what_is_removed(spark, tmp_path):
    r = np.random.default_rng(8)
    words = [f"{a}{b}{c}{d}" for a in "bcdf" for b in "aeiou" for c in "lmnrst" for d in "aeiou"]
    draw = lambda n: " ".join(r.choice(words, n))
    long, short = draw(90), draw(60)  # 449 and 299 bytes: 400 is what op7's contract names
    shared = {i: long if i < 10 else short for i in range(20)}
    rows = [(i, " ".join([draw(100), *([shared[i]] if i in shared else []), draw(100)])) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {x["doc_id"]: x for x in queries.op7_suffix_dedup(spark, str(tmp_path)).collect()}
    assert all(got[i]["n_bytes"] == len(t) for i, t in rows)  # the input's length says nothing of removal
    assert {i for i in got if got[i]["lost_bytes"]} == {i for i in got if got[i]["n_removed"] >= 449} == set(range(10))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    cut = {x["doc_id"]: x["text"] for x in dict(corpus_pipeline.STAGES)["suffix_dedup"](spark, docs, str(tmp_path)).collect()}
    assert len(cut) == 60 and {i for i, t in rows if cut[i] != t} == set(range(10))
