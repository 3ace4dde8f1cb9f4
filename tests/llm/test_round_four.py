"""What larger tables brought up: what the driver gathers and sends round must not grow with the rows."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import jaccard_join


@pytest.fixture(scope="module")
def rows():
    """1,500 texts, each with a copy, and half with a near copy, by ids far apart; some repeat an id."""
    r = random.Random(7)
    base = [" ".join(str(r.randrange(10**6)) for _ in range(30)) for _ in range(1_500)]
    out = [(7 * i, t) for i, t in enumerate(base)] + [(7 * i + 3 + 10**9, t) for i, t in enumerate(base)]
    out += [(-7 * i - 1, f"{t} x{i}") for i, t in enumerate(base[::2])] + [(None, base[4]), (None, "alone and without id"), (14, base[9]), (14, base[2])]
    r.shuffle(out)
    return out


@pytest.fixture
def sent(monkeypatch):
    """Rows of each table that is marked for a broadcast."""
    found, broadcast = [], F.broadcast

    def noted(df):
        found.append(df.count())
        return broadcast(df)

    monkeypatch.setattr(F, "broadcast", noted)
    return found


def wanted(rows):
    """component_id by row: a text, its copies and its near copy are one component."""
    least = {}
    for i, t in rows:
        key = " ".join(w for w in t.split() if w[0] != "x")
        least[key] = min(least.get(key, jaccard_join.NULL_ID), jaccard_join.NULL_ID if i is None else i)
    return [(i, t, None if (c := least[" ".join(w for w in t.split() if w[0] != "x")]) == jaccard_join.NULL_ID else c) for i, t in rows]


def test_copies_are_not_sent_round_by_the_row(spark, rows, sent):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = jaccard_join.classes(docs).collect()
    want = [(i, c) for i, _, c in wanted(rows)]
    assert sorted(((x["doc_id"], x["component_id"]) for x in got), key=str) == sorted(want, key=str)
    assert sent[0] <= 4  # over 1,500 copies, in four partitions


@pytest.mark.parametrize("few_bits", [True, False])
def test_results_are_the_same_by_bits_and_by_shuffles(spark, rows, sent, monkeypatch, few_bits):
    monkeypatch.setattr(jaccard_join, "BROADCAST_IDS", 5)
    monkeypatch.setattr(jaccard_join, "FILTER_BITS", 1 << 12)  # a third of all places is set: many share a bit
    if not few_bits:
        monkeypatch.setattr(jaccard_join, "BROADCAST_BITS", 0)
    docs = spark.createDataFrame([(i, t, n, "c") for n, (i, t) in enumerate(rows)], "doc_id long, text string, g int, words string").repartition(3)
    want = wanted(rows)
    got = jaccard_join.classes(docs).select("doc_id", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == sorted(((i, c) for i, _, c in want), key=str)
    stay = sorted(n for n, (i, _, c) in enumerate(want) if i == c)
    kept = jaccard_join.first_of_classes(docs)
    assert kept.columns == docs.columns and sorted(x["g"] for x in kept.collect()) == stay
    assert max(sent) <= 4
