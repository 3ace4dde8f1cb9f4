"""Defined results of operators on awkward rows, as their docstrings state them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import fingerprints, jaccard_join, line_dedup, packing, quality_rules, sentencepiece_fst, suffix_dedup, token_blocks, url_filter
from tidemark.llm.tokens import vocabulary_path

SCHEMA = "doc_id long, text string, keep string, n int, k long, t long"


@pytest.fixture(scope="module")
def awkward(spark):
    """Null and repeated ids, repeated rows, null, empty and blank texts, a text of a million bytes."""
    r = np.random.default_rng(3)
    long = " ".join("".join(r.choice(list("abcde"), 6)) for _ in range(150_000))
    line = "one line that is long enough"
    rows = [(None, line), (None, line), (None, None), (5, f"{line}\nown"), (5, f"{line}\nown"), (5, "other"), (1, None), (2, ""), (3, " \t\n "), (4, long)]
    return spark.createDataFrame([(i, t, "x", 1, 2, 3) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


IDS = ["1", "2", "3", "4", "5", "5", "5", "None", "None", "None"]


def ids(df):
    return sorted(str(r["doc_id"]) for r in df.select("doc_id").collect())


def test_every_row_has_a_result(awkward, nothing):
    model = vocabulary_path(sentencepiece_fst.MODEL)
    for run in (
        jaccard_join.classes,
        line_dedup.dedup_lines,
        lambda d: fingerprints.compare(d, 4),
        quality_rules.judge,
        lambda d: sentencepiece_fst.encode_summary(d, model),
        lambda d: packing.pack_documents(d, vocabulary_path()).where("start = 0"),
        lambda d: suffix_dedup.dedup_bytes(d).withColumn("doc_id", F.when(F.col("k") != 2**63 - 1, F.col("k"))),
    ):
        assert ids(run(awkward)) == IDS and run(nothing).count() == 0


def test_blocks_of_awkward_tables(spark, awkward, nothing, tmp_path):
    token_blocks.write_blocks(awkward, str(tmp_path / "a"), vocabulary_path())
    got = token_blocks.read_documents(spark, str(tmp_path / "a")).collect()
    assert sorted(str(r["doc_id"]) for r in got) == IDS
    ends, at = {}, 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
        ends[str(r["doc_id"])] = r["n_tokens"]
    assert ends["1"] == ends["2"] == ends["3"] == 1
    token_blocks.write_blocks(nothing, str(tmp_path / "b"), vocabulary_path())
    assert token_blocks.read_documents(spark, str(tmp_path / "b")).count() == 0


def test_rows_of_no_id_are_one_last_document(awkward):
    """Lines: two rows without id hold the line, but the document of id 5 is the first."""
    cut = line_dedup.without_lines(awkward, line_dedup.keep_bitmaps(awkward))
    assert cut.columns == awkward.columns
    left = sorted((str(r["doc_id"]), str(r["text"])[:6]) for r in cut.where("doc_id is null or doc_id = 5").collect())
    assert left == [("5", "one li"), ("5", "one li"), ("5", "other"), ("None", ""), ("None", ""), ("None", "None")]


def test_no_pair_of_empty_sets_is_linked(awkward):
    got = jaccard_join.classes(awkward).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got if r["n_shingles"] == 0} == {(None, None), (1, 1), (2, 2), (3, 3)}
    kept = jaccard_join.first_of_classes(awkward)
    assert kept.columns == awkward.columns and kept.count() == 10


def test_urls_of_awkward_pages(spark):
    rows = [(1, None, "h"), (None, "http://a.org/x", None), (1, "http://a.org/x", "h"), (2, "", "h"), (3, "http://" + "b." * 50_000 + "com/de/" + "p" * 100_000, "h"), (4, "no scheme", "h")]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, host string, rule string")
    got = url_filter.judge_urls(pages).collect()
    assert sorted((str(r["page_id"]), str(r["rule"]), r["verdict"]) for r in got) == [
        ("1", "None", "allow"), ("1", "org/", "allow"), ("2", "None", "allow"), ("3", "com/de/", "block"), ("4", "None", "allow"), ("None", "org/", "allow"),
    ]
    assert url_filter.judge_urls(pages.where("false")).count() == 0


def test_hosts_and_paths_of_random_urls(spark):
    r = np.random.default_rng(4)
    rules = url_filter.RULES
    part = lambda: str(r.choice(["org", "example.org", "com", "a.com", "x", "es", "en", "de", "fr", "1", ".com", "com.", ""]))
    urls = [f"http://{'.'.join(part() for _ in range(r.integers(1, 4)))}/{'/'.join(part() for _ in range(r.integers(0, 5)))}" for _ in range(3000)]
    got = {x["page_id"]: (x["rule"], x["verdict"]) for x in url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    for i, u in enumerate(urls):
        host, _, rest = u[7:].partition("/")
        fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and ("/" + rest).startswith(p)]
        best = max(fits, default=(0, None, url_filter.DEFAULT))
        assert got[i] == (best[1], best[2]), u
